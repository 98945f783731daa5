"""Reading, cutting lineage, and connected components shared by the operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Edges that are contracted together.
STRETCH = 500_000


#: Bytes of a batch that goes to a Python worker, whatever its rows' lengths.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; batches to Python workers are bounded by bytes unless the session was started with a bound."""
    if not spark.sparkContext.getConf().contains(_BATCH):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where neither the session nor its context names one, a session of one machine (a test) gets a temporary folder and a cluster an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_by_hand.isDefined():
            there = set_by_hand.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            there = tempfile.mkdtemp(prefix="newsgrain-")
        else:
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(f: Batches) -> Batches:
    """f, after which the worker gives the memory it holds for nothing back: workers outlive tasks and stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return run


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it again: a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a table made by ``cut`` whose readers have all run."""
    path = getattr(df, "_cut_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def crc_of_id(col: str) -> F.Column:
    """crc32 of the id as text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary"))


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges of each stretch of a partition replaced by stars on their least node: the same components, nearly flat.

    No shuffle, and at most ``STRETCH`` edges in memory at a time.
    """

    def stars(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        ids, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = flat[: len(u)], flat[len(u) :]
        label = np.arange(len(ids))
        while True:
            low = np.minimum(label[a], label[b])
            new = label.copy()
            for side in (a, b, label[a], label[b]):
                np.minimum.at(new, side, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
        moved = label != np.arange(len(ids))
        return pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= STRETCH:
                yield stars(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))
                held, rows = [], 0
        if rows:
            yield stars(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))

    return edges.mapInArrow(run, "u bigint, v bigint")


def _is_flat(e: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none: then the stars are the components."""
    degree = e.groupBy("u").agg(F.count(F.lit(1)).alias("c"))
    several = degree.filter("c > 1").select("u")
    deeper = e.select(F.col("v").alias("u")).join(degree.select("u"), "u", "left_semi")
    return several.unionByName(deeper).limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id of an edge (a, b).

    Stretches of edges are first contracted where they lie.  Then large-star and
    small-star steps (Kiveris et al., 2014) alternate, each as an aggregate with
    map-side combine and a join on the node, so a hub of any degree is split by
    adaptive skew handling and never met in one task.  Every step is written to
    the shared folder; only whether it is done reaches the driver.
    """
    ids = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "edges")
    e = cut(_contracted(ids).distinct(), "edges")
    while not _is_flat(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        forget(e)
        e = nxt
    found = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = e.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    forget(ids)
    return found.unionByName(roots)
