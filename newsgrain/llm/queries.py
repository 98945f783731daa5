"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsgrain.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: One word: a maximal run outside the ASCII white space.
WORDS_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsgrain.llm.quality import quality_cascade

    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    found = quality_cascade(table(spark, sf_dir, "documents"), measures=measures)
    return found.select("doc_id", *measures, "base_failed", "kept")


SQL["op9_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {WORDS_SQL} AS w FROM documents),
lines AS (
  SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2),
dups AS (SELECT doc_id, sum(n) AS n_lines, sum(n - 1) AS n_dup FROM lines GROUP BY 1),
win AS (SELECT doc_id, i, w[i:i + 7] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM twice, range(8) r(o) GROUP BY 1),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN dups ON dups.doc_id = d.doc_id LEFT JOIN rep ON rep.doc_id = d.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 10 * n_symbols > 2 * n_words OR 100 * n_dup_lines > 50 * n_lines) AS kept
FROM m
"""


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsgrain.llm import toxicity
    from newsgrain.llm.common import crc_of_id

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.train(docs, labels))
    return found.select("doc_id", (crc_of_id("doc_id") % 3 == 1).alias("held_out"), "score", "predicted")


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsgrain.llm import langid
    from newsgrain.llm.common import crc_of_id

    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(docs))
    return found.select("doc_id", (crc_of_id("doc_id") % 3 == 1).alias("held_out"), "lang_pred", "score")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@_query
def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    from newsgrain.llm import repair
    from newsgrain.llm.common import shared_dir

    folder = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    repair.write_shards(table(spark, sf_dir, "documents"), folder, _vocabulary("byte_bpe_50k.json"))
    return repair.read_shards(spark, folder)


@_query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsgrain.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


@_query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsgrain.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


@_query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from newsgrain.llm.substring import remove_repeats

    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL["op6_substring_dedup"] = rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM again, range(20) r(o)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


@_query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsgrain.llm.minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


#: Only ASCII letters are lower-cased.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op5_minhash_near_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
g AS (SELECT x, min(y) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN g ON g.x = d.doc_id
"""


@_query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsgrain.llm.embeddings import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL["op1_embedding_near_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.95),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y),
g AS (SELECT x, min(y) AS c FROM reach GROUP BY 1), n AS (SELECT x, count(*) AS n FROM e GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN g ON g.x = vec_id LEFT JOIN n ON n.x = vec_id
"""


@_query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its five best segmentations: piece count of the best, scores and id crcs, and the crc of the decoded text."""
    from newsgrain.llm.segment import digests, segment_documents

    return digests(segment_documents(table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model")))


@_query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every text; of those that the id's crc names, the words from a place on first repeat a period."""
    from pyspark.sql import functions as F

    from newsgrain.llm.common import crc_of_id
    from newsgrain.llm.periodic import periodic_runs

    h = crc_of_id("doc_id")
    g = F.floor(h / 10)
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n = F.size(words)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    turns = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    repeated = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(turns, F.lit(1), n - a)), " ")
    text = F.when(F.col("doc_id").isNotNull() & (h % 10 == 0) & (n > 0), repeated).otherwise(F.col("text"))
    found = periodic_runs(table(spark, sf_dir, "documents").select("doc_id", text.alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit(""))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return found.withColumn("_run", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("_run.start")).alias("start"),
        F.col("_run.length").alias("length"),
        (-F.col("_run.period")).alias("period"),
        F.floor(1000 * F.col("_run.length") / -F.col("_run.period")).cast("long").alias("exponent_milli"),
        digest(lines).alias("runs_sha256"),
        digest(F.col("collapsed_text")).alias("collapsed_sha256"),
    )


#: crc32 of the decimal id, bit by bit.
_CRC_SQL = "xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda e, b: list_reduce([xor(e, b)] || list_transform(range(8), lambda z: CAST(0 AS BIGINT)), lambda f, z: xor(f >> 1, CASE WHEN f & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"
#: A run of q words repeats at least 5 words at distance q, so equal 5-word windows at one distance, in islands, give all runs.
SQL["op13_periodic_runs"] = rf"""
WITH d AS (SELECT doc_id, {WORDS_SQL} AS w, {_CRC_SQL} AS h FROM documents),
v AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS again FROM d),
s AS (SELECT doc_id, w, n, again, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM v),
x AS MATERIALIZED (SELECT doc_id, n, CASE WHEN again THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM s),
win AS (SELECT doc_id, i, hash(w[i + 1:i + 5]) AS k, array_to_string(w[i + 1:i + 5], ' ') AS t FROM (SELECT doc_id, w, unnest(range(n - 4)) AS i FROM x WHERE n >= 6)),
eq AS (SELECT a.doc_id, a.i, b.i - a.i AS q FROM win a JOIN win b ON a.doc_id = b.doc_id AND a.k = b.k AND a.i < b.i WHERE a.t = b.t),
isl AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS grp FROM eq),
per AS (SELECT doc_id, q, min(i) AS start, count(*) + 4 + q AS length FROM isl GROUP BY doc_id, q, grp),
run AS (SELECT doc_id, start, length, min(q) AS period FROM per WHERE length >= 2 * q GROUP BY 1, 2, 3 HAVING length >= 6 AND length >= 4 * min(q)),
agg AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, start, period) AS r FROM run) WHERE r = 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
word AS (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS t FROM x),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT x.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM x LEFT JOIN agg ON agg.doc_id = x.doc_id LEFT JOIN best ON best.doc_id = x.doc_id LEFT JOIN kept ON kept.doc_id = x.doc_id
"""


@_query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from newsgrain.llm.mining import hard_negatives

    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), "vec_id % 100 = 0")


SQL["op12_hard_negatives"] = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id AND len(a.v) = len(b.v)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
"""


@_query
def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsgrain.llm import pages

    rows = table(spark, sf_dir, "pages")
    return pages.extract(rows, pages.train(rows))


#: The main text of the test tables' pages, whose articles are marked and hold headlines and paragraphs.
SQL["op11_html_extraction"] = r"""
WITH b AS (
  SELECT page_id, generate_subscripts(x, 1) AS i, unnest(x) AS t
  FROM (SELECT page_id, regexp_split_to_array(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') AS x FROM pages)),
c AS (SELECT page_id, i, regexp_replace(replace(replace(replace(regexp_replace(replace(t, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS t FROM b),
d AS (SELECT page_id, i, trim(regexp_replace(t, '\s+', ' ', 'g')) AS t FROM c),
e AS (SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS t FROM d WHERE t <> '' GROUP BY 1)
SELECT page_id, url, coalesce(t, '') AS text, CAST(length(coalesce(t, '')) AS BIGINT) AS n_chars FROM pages LEFT JOIN e USING (page_id)
"""
