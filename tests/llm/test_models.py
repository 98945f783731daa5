"""The queries of the classifiers on small tables, exact samples, and a unigram model against its library."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from newsgrain.llm import langid, quality, queries, segment, toxicity


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of three languages, toxic ones among them; labels for two thirds."""
    rnd = random.Random(12)
    vocab = {lang: ["".join(rnd.choice(letters) for _ in range(rnd.randrange(2, 8))) for _ in range(150)] for lang, letters in (("aa", "abcdefg"), ("bb", "hijklmnop"), ("cc", "абвгд"))}
    bad = ["vexor", "grulk", "zonkat", "brimp"]
    docs, labels = [], []
    for i in range(600):
        lang = "aabbcc"[2 * (i % 3) :][:2]
        toxic = rnd.random() < 0.3
        words = [rnd.choice(vocab[lang]) for _ in range(rnd.randrange(10, 60))]
        if toxic:
            for _ in range(4):
                words[rnd.randrange(len(words))] = rnd.choice(bad)
        docs.append((i, " ".join(words), lang if i % 10 else None, "s", 1))
        if i % 3:
            labels.append((i, 1, int(toxic)))
    docs += [(600, None, "aa", "s", 0), (601, "", "bb", "s", 0), (602, "123 456", "cc", "s", 7)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, docs, labels


def test_toxicity_query(spark, folder, tmp_path):
    at, docs, labels = folder
    found = {r.doc_id: r for r in queries.QUERIES["op2_toxicity"](spark, str(at)).collect()}
    assert len(found) == len(docs)
    for i, r in found.items():
        assert r.held_out == (crc(i) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if crc(i) % 3 == 1]
    assert sum(found[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    # held-out labels, and any of the other columns, change nothing
    spark.read.parquet(f"{at}/documents.parquet").withColumn("lang", F.lit("zz")).withColumn("source", F.lit("t")).write.parquet(f"{tmp_path}/documents.parquet")
    flipped = [(i, q, 1 - t if crc(i) % 3 == 1 else t) for i, q, t in labels]
    spark.createDataFrame(flipped, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    again = {r.doc_id: r.score for r in queries.QUERIES["op2_toxicity"](spark, str(tmp_path)).collect()}
    assert again == {i: r.score for i, r in found.items()}


def test_toxicity_scores_by_hand(spark, folder):
    """The query's scores are those of the model applied to each text alone."""
    at, docs, _ = folder
    model = toxicity.train(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    found = {r.doc_id: r.score for r in queries.QUERIES["op2_toxicity"](spark, str(at)).collect()}
    for i, text, *_ in docs[::37] + docs[-3:]:
        assert abs(found[i] - float(model.scores([text])[0])) < 1e-4


def test_language_query(spark, folder, tmp_path):
    at, docs, _ = folder
    found = {r.doc_id: r for r in queries.QUERIES["op7_language_id"](spark, str(at)).collect()}
    assert len(found) == len(docs)
    for i, text, lang, *_ in docs:
        r = found[i]
        assert r.held_out == (crc(i) % 3 == 1) and 0 <= r.score <= 1
        if i >= 600:
            assert r.lang_pred == "und"
        elif lang and r.held_out:
            assert r.lang_pred == lang
    swapped = spark.read.parquet(f"{at}/documents.parquet").withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit("aa")).otherwise(F.col("lang")))
    swapped.withColumn("source", F.lit("other")).write.parquet(f"{tmp_path}/documents.parquet")
    again = {r.doc_id: (r.lang_pred, r.score) for r in queries.QUERIES["op7_language_id"](spark, str(tmp_path)).collect()}
    assert again == {i: (r.lang_pred, r.score) for i, r in found.items()}


def test_many_languages_and_exact_samples(spark, monkeypatch):
    """Thousands of values of lang, one of them with most texts; no sample is larger than it may be."""
    monkeypatch.setattr(langid, "SAMPLE_PER_LANGUAGE", 40)
    rows = [(i, f"l{i}" if i % 2 else "main", f"only{i}" if i % 2 else f"word{i}") for i in range(4000)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(4))
    assert sum(r[1] == "main" and crc(r[0]) % 3 != 1 for r in rows) > 1000
    assert len(model.languages) == 1 + sum(r[1] != "main" and crc(r[0]) % 3 != 1 for r in rows)
    drawn = [w for _, lang, w in rows if lang == "main" and model.word_score(w).argmax() == model.languages.index("main") and crc(_) % 3 != 1]
    assert len(drawn) >= 30


def test_toxicity_sample_is_bounded(spark, folder, monkeypatch):
    at, *_ = folder
    monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", 20)
    sizes = []
    real = toxicity.fit

    def counted(rows, y, *rest):
        sizes.append((int((y == 0).sum()), int((y == 1).sum())))
        return real(rows, y, *rest)

    monkeypatch.setattr(toxicity, "fit", counted)
    toxicity.train(spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet"))
    ((zeros, ones),) = sizes
    assert 10 <= zeros <= 20 and 10 <= ones <= 20


def test_quality_sample_is_by_hash(spark):
    texts = [f"text {i}" for i in range(500)] + ["the same"] * 700 + [None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    one = quality.sample_texts(df.repartition(2), rows=60)
    assert one == quality.sample_texts(df.repartition(7).orderBy(F.desc("text")), rows=60) and len(set(one)) == len(one) == 60
    assert quality.sample_texts(df.filter("text = 'the same'")) == ["the same"] and quality.sample_texts(df.limit(0)) == []


def test_unigram_model_against_the_library(tmp_path):
    """For a model of log probabilities, written by hand, the N best paths are the library's."""
    sentencepiece = pytest.importorskip("sentencepiece")
    from sentencepiece import sentencepiece_model_pb2 as pb

    rnd = random.Random(21)
    model = pb.ModelProto()
    model.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.add_dummy_prefix = True
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        model.pieces.add(piece=piece, score=0.0, type=kind)
    parts = {"▁", *"abcde"}
    while len(parts) < 90:
        parts.add(rnd.choice(["", "▁"]) + "".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 5))))
    for p in sorted(parts):
        model.pieces.add(piece=p, score=-rnd.uniform(2, 12), type=1)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    own = segment.Segmenter(str(path), 5)
    untied = 0
    for _ in range(150):
        text = " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randrange(1, 12))) for _ in range(rnd.randrange(1, 6)))
        ((*mine,),) = own.segment([text])
        want = library.nbest_encode_as_ids(text, 5)
        scores = [sum(library.get_score(p) for p in ids) for ids in want]
        best = library.encode(text)
        assert round(sum(library.get_score(p) for p in best), 3) == round(mine[0][0], 3)
        assert len(mine) == len(want) and [round(s, 3) for s, _ in mine] == [round(s, 3) for s in scores]
        for score, ids in mine:
            assert abs(sum(library.get_score(int(p)) for p in ids) - score) < 1e-3
        six = sorted(sum(library.get_score(p) for p in ids) for ids in library.nbest_encode_as_ids(text, 6))
        if all(b - a > 1e-3 for a, b in zip(six, six[1:], strict=False)):  # no ties, not with the next path either
            assert [ids.tolist() for _, ids in mine] == want and want[0] == best
            untied += 1
    assert untied > 30
