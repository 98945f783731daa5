"""Share-count bins and their labels (H12-H16), as native columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decades for the drill-down, and tenths of decades for histograms; edges are truncated to whole shares.
COARSE = (0, 1, 10, 100, 1000, 10_000, 100_000, 1_000_000)
FINE = (0, *(int(10 ** (i / 10)) for i in range(67)))


def log_shares(x: Column) -> Column:
    """Base-10 log; null below 1 share, where the log is not defined for counts of 0."""
    return F.when(x > 0, F.log10(x))


def bin_of(x: Column, edges: Sequence[int] = FINE) -> Column:
    """Index of the first edge that x does not exceed; ``len(edges)`` beyond the last; null for null."""
    cases = reduce(lambda c, e: c.when(x <= F.lit(e[1]), F.lit(e[0])), list(enumerate(edges)), F.when(x.isNull(), F.lit(None)))
    return cases.otherwise(F.lit(len(edges))).cast("int")


def with_bins(df: DataFrame, fields: Sequence[str], edges: Sequence[int] = FINE, keep_null: bool = True) -> DataFrame:
    """Add ``binned_<field>`` for each field; rows with a null in any go unless ``keep_null``."""
    if not keep_null:
        df = df.dropna(subset=list(fields))
    return df.withColumns({f"binned_{f}": bin_of(F.col(f), edges) for f in fields})


def bin_low(b: Column, edges: Sequence[int] = FINE) -> Column:
    """What a bin's counts exceed: the edge before, -1 for the first bin."""
    return F.element_at(F.array(F.lit(-1), *[F.lit(x) for x in edges]), b + 1)


def bin_high(b: Column, edges: Sequence[int] = FINE) -> Column:
    """Greatest share count of a bin; null for the overflow bin."""
    return F.element_at(F.array(*[F.lit(x) for x in edges], F.lit(None).cast("int")), b + 1)


def bin_label(b: Column, edges: Sequence[int] = FINE) -> Column:
    """Axis label: 0 and whole powers of ten as 1, 10, 100, 1K, 1M; blank elsewhere, and for repeated bins of 1."""
    s = bin_high(b, edges).cast("string")
    whole = s.rlike("^(10*|0)$") & ~((s == "1") & (b > 1))
    return F.when(~F.coalesce(whole, F.lit(False)), "").when(s.endswith("000000"), F.regexp_replace(s, "000000$", "M")).when(s.endswith("000"), F.regexp_replace(s, "000$", "K")).otherwise(s)
