"""Redirect chains over a table of responses.

Following refreshes is a walk on a graph in which every address has one next
address at most.  All walks are taken together by pointer doubling: after k
rounds an address knows where 2**k hops lead, so a chain of n hops takes log2(n)
joins on addresses, and no address is visited one hop after another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgrain.functions.url import joined
from newsgrain.operators.ranges import written

#: Seconds beyond which a refresh is not followed.
MAX_DELAY = 20


def refresh_of(header: Column, content: Column) -> Column:
    """``delay;url=address`` of a Refresh header, or else of a meta element of that kind; null without one."""
    tag = F.regexp_extract(content, r"""(?is)<meta[^>]*?content=["']([^>]+?url=[^>]*?)["'][^>]*""", 0)
    inner = F.regexp_extract(tag, r"""(?is)content=["']([^>]+?url=[^>]*?)["']""", 1)
    meta = F.when(F.lower(tag).rlike("""http-equiv=["']refresh"""), inner)
    return F.coalesce(header, meta)


def _unescaped(text: Column) -> Column:
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def steps(responses: DataFrame, url: str, status: str, header: str, content: str, max_delay: int = MAX_DELAY) -> DataFrame:
    """The responses with ``delay``, ``next`` and ``stop``: why no further address is asked, null where one is.

    ``error``: status 400 or more; ``end``: no refresh; ``delay``: it waits longer
    than ``max_delay``; ``failed``: it is malformed or leads to no web address;
    ``empty``: the page stops here, with status 200 and no content.
    """
    refresh = refresh_of(F.col(header), F.col(content))
    cut = F.instr(refresh, ";")
    after = F.substr(refresh, cut + 1)
    equals = F.instr(after, "=")
    target = F.when((cut > 0) & (equals > 0), joined(F.col(url), _unescaped(F.substr(after, equals + 1))))
    delay = F.when(cut > 0, F.trim(F.substring_index(refresh, ";", 1))).try_cast("int")
    found = responses.withColumns({"_refresh": refresh, "delay": delay, "next": target})
    why = (
        F.when(F.col(status) >= 400, "error")
        .when(F.col("_refresh").isNull(), "end")
        .when(F.col("delay").isNull() | F.col("next").isNull() | ~F.col("next").startswith("http"), "failed")
        .when(F.col("delay") > max_delay, "delay")
    )
    blank = (F.col(status) == 200) & (F.coalesce(F.length(content), F.lit(0)) == 0)
    found = found.withColumn("stop", F.when(why.isNotNull() & blank & (why != "failed"), "empty").otherwise(why))
    return found.withColumn("next", F.when(F.col("stop").isNull(), F.col("next"))).drop("_refresh")


def _doubled(jump: DataFrame) -> DataFrame:
    """(u, j, m) of twice as many hops; ``m`` is the least address met after u; walks that end before are gone."""
    b = jump.select(F.col("u").alias("j"), F.col("j").alias("_j"), F.col("m").alias("_m"))
    return jump.join(b, "j").select("u", F.col("_j").alias("j"), F.least("m", "_m").alias("m"), F.col("_m").alias("seen"))


def cycle_roots(edges: DataFrame) -> DataFrame:
    """(u): the least address of every cycle of edges (u, v), each u once.

    An address that is the least of those met in 2**k hops after it has met itself.
    Walks that are seen to lead into a found cycle, or to end, are left out of further rounds.
    """
    jump = written(edges.select("u", F.col("v").alias("j"), F.col("v").alias("m")))
    roots = jump.filter("u = j").select("u")
    jump = written(jump.join(roots, "u", "left_anti"))
    while jump.limit(1).count():
        wide = written(_doubled(jump))
        roots = written(roots.unionByName(wide.filter("u = m").select("u")).distinct())
        jump = written(wide.join(roots.select(F.col("u").alias("seen")), "seen", "left_anti").select("u", "j", "m"))
    return roots


def _ranked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(u, root, d): the last address of every walk on edges without cycles, and how many hops it is away."""
    at = written(nodes.join(edges, "u", "left").select("u", F.coalesce("v", "u").alias("root"), F.col("v").isNotNull().cast("long").alias("d")))
    while True:
        b = at.select(F.col("u").alias("root"), F.col("root").alias("_root"), F.col("d").alias("_d"))
        nxt = written(at.join(b, "root").select("u", F.col("_root").alias("root"), (F.col("d") + F.col("_d")).alias("d"), (F.col("_d") > 0).alias("moved")))
        at = nxt.drop("moved")
        if not nxt.filter("moved").limit(1).count():
            return at


def chains(responses: DataFrame, starts: DataFrame, url: str = "url", next_url: str = "next", stop: str = "stop") -> DataFrame:
    """(start, hop, url, stop) and the response's other columns: a row for each hop of each start, from 0 on.

    ``stop`` is set on the last hop: the response's own reason, ``failed`` where the
    next address has no response, ``loop`` where it is one that was met before.
    ``responses`` has one row an address; starts without a response give no rows.
    """
    known = written(responses.withColumn("_u", F.col(url)))
    targets = known.select("_u").select(F.col("_u").alias("v"))
    edges = written(known.select(F.col("_u").alias("u"), F.col(next_url).alias("v")).filter("v IS NOT NULL").join(targets, "v", "left_semi").select("u", "v"))
    roots = cycle_roots(edges)
    ranks = _ranked(known.select(F.col("_u").alias("u")), edges.join(roots, "u", "left_anti"))
    # round a cycle: from the address after its root, back to it
    around = edges.join(roots, "u").select(F.col("u").alias("root"), F.col("v").alias("u")).join(ranks.select("u", "d"), "u").select("root", (F.col("d") + 1).alias("around"))
    length = ranks.join(around, "root", "left").select(F.col("u").alias("start"), (F.col("d") + 1 + F.coalesce("around", F.lit(0))).alias("hops"), F.col("around").isNotNull().alias("loops"))
    walks = written(starts.select(F.col(starts.columns[0]).alias("start")).distinct().join(length, "start").select("start", F.lit(0).cast("long").alias("hop"), F.col("start").alias("at"), "hops", "loops"))
    longest = walks.agg(F.max("hops")).first()[0] or 0
    jump, reach = edges.select("u", F.col("v").alias("j")), 1
    while reach < longest:
        further = walks.join(jump.select(F.col("u").alias("at"), "j"), "at").withColumn("hop", F.col("hop") + reach).filter("hop < hops")
        walks = written(walks.unionByName(further.select("start", "hop", F.col("j").alias("at"), "hops", "loops")))
        reach *= 2
        if reach < longest:
            jump = written(jump.join(jump.select(F.col("u").alias("j"), F.col("j").alias("_j")), "j").select("u", F.col("_j").alias("j")))
    once = walks.filter("loops").groupBy("start", "at").agg(F.min("hop").alias("hop"))
    met = written(walks.filter("NOT loops").select("start", "at", "hop", F.lit(False).alias("loops")).unionByName(once.select("start", "at", "hop", F.lit(True).alias("loops"))))
    last = met.groupBy("start").agg(F.max("hop").alias("_last"))
    rest = [c for c in responses.columns if c not in (url, next_url, stop)]
    rows = met.join(last, "start").join(known, F.col("at") == F.col("_u"))
    why = F.when(F.col("hop") == F.col("_last"), F.when(F.col("loops"), "loop").otherwise(F.coalesce(F.col(stop), F.lit("failed"))))
    return rows.select("start", F.col("hop").cast("int").alias("hop"), F.col("at").alias("url"), why.alias("stop"), *rest)


def outcomes(hops: DataFrame) -> DataFrame:
    """One row a start (L7): its last address and why the walk stopped there, and the number of hops."""
    last = F.max_by(F.struct("url", "stop"), "hop")
    return hops.groupBy("start").agg(F.count(F.lit(1)).cast("int").alias("hops"), last.alias("_l")).select("start", "hops", F.col("_l.url").alias("final"), F.col("_l.stop").alias("stop"))
