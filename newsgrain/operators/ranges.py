"""Written steps, ranks and quantiles that no single task has to hold."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F


def written(df: DataFrame) -> DataFrame:
    """Checkpoint in the session's folder.

    Where none is named, a session of one machine (a test) gets a temporary folder and a cluster an error.
    """
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        there = spark.conf.get("spark.checkpoint.dir", None)
        if not there:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
            import tempfile

            there = tempfile.mkdtemp(prefix="newsgrain-")
        spark.sparkContext.setCheckpointDir(there)
    return df.checkpoint()


def numbered(df: DataFrame, order: Sequence[Column | str], name: str, kind: str = "int") -> DataFrame:
    """Rows numbered from 1 in a total order of the whole table.

    Ranges of the order are sorted apart; the count of rows before a range is
    added to the place within it, so no task sees more than its range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))  # a row per range
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("_part", before.alias("_base"))
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(base, "_part").withColumn(name, (F.col("_base") + within + 1).cast(kind)).drop("_id", "_part", "_base")


def _heavy(df: DataFrame, groups: Sequence[str]) -> list[Row]:
    """Groups with more than twice an even share of all rows: fewer than half as many as there are partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("_c"))
    total = counts.agg(F.sum("_c").alias("_t"))  # one row
    return counts.crossJoin(F.broadcast(total)).filter(F.col("_c") * parts > 2 * F.col("_t")).select(*groups).collect()


def running(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Each row with sums over the earlier rows of its group, in ranges of (group, order): a group's rows may fill many tasks.

    What a range has of a group is summed within the range and added to what the
    ranges before it have.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    amounts = {f"_a{i}": c for i, c in enumerate(sums.values())}
    ranged = df.withColumns(amounts).repartitionByRange(parts, *groups, *order)
    placed = written(ranged.withColumn("_part", F.spark_partition_id()))
    by = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    names = [f"_g{i}" for i in range(len(groups))]
    here = placed.groupBy("_part", *by).agg(*[F.sum(a).alias(a) for a in amounts])
    past = Window.partitionBy(*names).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    base = here.select(F.col("_part").alias("_p"), *names, *[F.coalesce(F.sum(a).over(past), F.lit(0)).alias(f"_b{a}") for a in amounts])
    within = Window.partitionBy("_part", *groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumns({f"_w{a}": F.coalesce(F.sum(a).over(within), F.lit(0)) for a in amounts})
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(groups, names, strict=True)]
    met = inside.join(base, [F.col("_part") == F.col("_p"), *same])
    out = {name: F.col(f"_b{a}") + F.col(f"_w{a}") for name, a in zip(sums, amounts, strict=True)}
    return met.withColumns(out).select(*df.columns, *sums)


def numbered_within(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], name: str) -> DataFrame:
    """Rows numbered from 1 within their group; groups that hold much of the table are numbered by ranges, the others whole."""
    window = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    heavy = _heavy(df, groups)
    if not heavy:
        return df.withColumn(name, window)
    spark = df.sparkSession
    side = spark.createDataFrame(heavy, df.select(*groups).schema).select(*[F.col(g).alias(f"_h{i}") for i, g in enumerate(groups)], F.lit(True).alias("_heavy"))
    marked = df.join(F.broadcast(side), [F.col(g).eqNullSafe(F.col(f"_h{i}")) for i, g in enumerate(groups)], "left")
    light = marked.filter("_heavy IS NULL").select(*df.columns).withColumn(name, window)
    rest = running(marked.filter("_heavy").select(*df.columns), groups, order, {"_before": F.lit(1)})
    return light.unionByName(rest.withColumn(name, (F.col("_before") + 1).cast("int")).drop("_before"))


def lowest(df: DataFrame, groups: Sequence[str], order: Column, key: str, wanted: Column, sizes: DataFrame | None = None) -> DataFrame:
    """The ``wanted`` rows of each group that come first by a hash (hexadecimal) and key; ``wanted`` reads columns of ``sizes``.

    Rows are counted by group and the first three digits of the hash; only rows
    up to the digits that reach the wanted number are ranked, so a group is never
    sorted whole.  ``sizes`` (groups and any more columns) defaults to each group's ``_n``.
    """
    cell = F.conv(F.substring(order, 1, 3), 16, 10).cast("int")
    named = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]
    hist = df.select(*named, cell.alias("_cell")).groupBy(*[f"_g{i}" for i in range(len(groups))], "_cell").agg(F.count(F.lit(1)).alias("_c"))
    by = [f"_g{i}" for i in range(len(groups))]
    w = Window.partitionBy(*by)  # 4096 rows a group at most
    hist = hist.withColumns({"_before": F.coalesce(F.sum("_c").over(w.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_c").over(w)})
    if sizes is not None:
        same = [F.col(f"_g{i}").eqNullSafe(F.col(f"_s{i}")) for i in range(len(groups))]
        side = sizes.select(*[F.col(g).alias(f"_s{i}") for i, g in enumerate(groups)], *[c for c in sizes.columns if c not in groups])
        hist = hist.join(side, same).drop(*[f"_s{i}" for i in range(len(groups))])
    need = hist.withColumn("_wanted", wanted).filter(F.col("_before") < F.col("_wanted")).select(*by, "_cell", "_before", "_wanted")
    met = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)] + [cell == F.col("_cell")]
    near = df.join(need, met)
    place = F.row_number().over(Window.partitionBy(*by, "_cell").orderBy(order, key)) + F.col("_before")
    return near.withColumn("_place", place).filter(F.col("_place") <= F.col("_wanted")).drop(*by, "_cell", "_before", "_wanted", "_place")


#: Cells of a pass of ``quantiles``, and ranks that are kept on the driver between passes.
CELLS, KNOWN_RANKS = 1 << 14, 20_000


def _narrowed(rows: DataFrame, open_: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each rank's range of values cut to the one of ``CELLS`` cells it falls into: from the least to the greatest value there."""
    same = [F.col(f"x.{b}").eqNullSafe(F.col(f"t.{b}")) for b in by]
    met = rows.alias("x").join(open_.alias("t"), [*same, F.col("_x") >= F.col("_lo"), F.col("_x") <= F.col("_hi")])
    share = (F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)  # halves, so that no difference overflows
    inner = F.when(F.isnan(share) | (F.abs(share) > 1), CELLS // 2).otherwise(1 + F.floor(share * (CELLS - 2)))  # of infinite ranges the middle
    cell = F.when(F.col("_x") == F.col("_lo"), 0).when(F.col("_x") == F.col("_hi"), CELLS).otherwise(inner).cast("int")
    mine = [F.col(f"t.{b}").alias(b) for b in by]
    cells = met.select(*mine, "_n", "_r", "_before", cell.alias("_cell"), "_x").groupBy(*by, "_n", "_r", "_before", "_cell").agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    w = Window.partitionBy(*by, "_r").orderBy("_cell")  # CELLS rows at most
    run = cells.withColumn("_upto", F.col("_before") + F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = run.filter(F.col("_upto") > F.col("_r")).withColumn("_place", F.row_number().over(w)).filter("_place = 1")
    return first.select(*by, "_n", "_r", (F.col("_upto") - F.col("_c")).alias("_before"), "_lo", "_hi")


def quantiles(df: DataFrame, keys: Sequence[str], value: Column, points: Sequence[float], discrete: bool = False) -> DataFrame:
    """(keys, _n, _q0, _q1, ...): exact quantiles of the values that are not null, interpolated or by rank.

    A wanted rank is followed down: the range from the least to the greatest value
    is cut into cells, their counts tell in which one the rank falls, and its least
    and greatest value are the next range, until they are one value.  A pass is one
    aggregate with map-side combine and reads the rows; nothing is sorted or
    written.  Between passes a few numbers a rank go over the driver, or into the
    checkpoint folder where there are more than ``KNOWN_RANKS``.
    """
    by = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], value.cast("double").alias("_x")).filter("_x IS NOT NULL")
    stats = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).filter("_n > 0")
    whole = lambda c: c.cast("bigint")
    places = [F.lit(p) * (F.col("_n") - 1) for p in points]
    if discrete:
        ranks = [(whole(F.greatest(F.ceil(F.lit(p) * F.col("_n")) - 1, F.lit(0))),) * 2 for p in points]
    else:
        ranks = [(whole(F.floor(at)), whole(F.ceil(at))) for at in places]
    wanted = F.array_distinct(F.array(*[r for pair in ranks for r in pair]))
    targets = stats.select(*by, "_n", F.explode(wanted).alias("_r"), F.lit(0).cast("bigint").alias("_before"), "_lo", "_hi")
    spark, done = df.sparkSession, None
    while True:
        first = targets.limit(KNOWN_RANKS + 1).collect()
        small = len(first) <= KNOWN_RANKS
        targets = spark.createDataFrame(first, targets.schema) if small else written(targets)
        found = targets.filter("_lo = _hi")
        done = found if done is None else done.unionByName(found)
        open_ = targets.filter("_lo <> _hi")
        if not (any(r["_lo"] != r["_hi"] for r in first) if small else open_.limit(1).count()):
            break
        targets = _narrowed(rows, F.broadcast(open_) if small else open_, by)
    known = done.groupBy(*by, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_r", "_lo"))).alias("_v"))
    out = []
    for i, ((a, b), at) in enumerate(zip(ranks, places, strict=True)):
        low, high, share = F.element_at("_v", a), F.element_at("_v", b), at - F.floor(at)
        out.append((low if discrete else F.when(low == high, low).otherwise(low * (1 - share) + high * share)).alias(f"_q{i}"))
    return known.select(*[F.col(b).alias(k) for b, k in zip(by, keys, strict=True)], "_n", *out)
