"""Counting and search services as Spark data sources, with a ledger of what is finished.

A transport is named ``module:class`` and made from the source's options on the
executors.  ``requests`` reads planned batches, each a partition of at most 50
keys; ``ledger`` writes answers and keeps account of them: every finished task of
a run that breaks off is still entered, so the next run asks only for the rest.
``topics`` is a stream that pages through a search, and goes on from its last page.
"""

from __future__ import annotations

import importlib
import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, SimpleDataSourceStreamReader, WriterCommitMessage

from newsgrain.functions.url import without_host
from newsgrain.operators.ranges import numbered
from newsgrain.sources.adapters import fetch_all

#: Keys of one request, requests of one file of a plan, and rows of a page and pages of a search before it starts again.
PER_REQUEST, PER_FILE, PER_PAGE, MOST_PAGES = 50, 20, 10, 100


def _folder(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def _checksum() -> Column:
    return F.crc32(F.col("key").cast("binary"))


def _transport(options: dict):
    module, name = options["transport"].split(":")
    return getattr(importlib.import_module(module), name)(options)


# ---------------------------------------------------------------- requests


def pending(entries: DataFrame, entry: str, url: str, domains: Sequence[str], finished: DataFrame | None) -> DataFrame:
    """(entry, domain, key): each entry's address at each domain that the ledger does not have yet."""
    every = entries.select(F.col(entry).cast("string").alias("entry"), F.explode(F.array(*[F.lit(d) for d in domains])).alias("domain"), F.col(url).alias("_url"))
    keyed = every.select("entry", "domain", F.concat(F.lit("http://"), "domain", F.lit("/"), without_host(F.col("_url"))).alias("key")).filter("key IS NOT NULL")
    return keyed if finished is None else keyed.join(finished.select("entry", "domain"), ["entry", "domain"], "left_anti")


def plan(wanted: DataFrame, folder: str) -> None:
    """Write (entry, domain, key) as requests of at most ``PER_REQUEST`` keys, in the order of the keys' checksums."""
    placed = numbered(wanted.select("entry", "domain", "key"), [_checksum(), "key", "entry", "domain"], "n", "long")
    request = F.floor((F.col("n") - 1) / PER_REQUEST).alias("request")
    batches = placed.groupBy(request).agg(F.collect_list(F.struct("entry", "domain", "key")).alias("items"))  # PER_REQUEST rows
    batches.write.option("maxRecordsPerFile", PER_FILE).parquet(folder)


@dataclass
class _Request(InputPartition):
    file: str
    row: int

    def __init__(self, file: str, row: int):
        self.file, self.row = file, row


class Requests(DataSource):
    """(entry, domain, key, body) of planned requests; options ``path``, ``transport``, ``limit`` (requests of this run) and the transport's own."""

    @classmethod
    def name(cls) -> str:
        return "requests"

    def schema(self) -> str:
        return "entry string, domain string, key string, body string"

    def reader(self, schema) -> DataSourceReader:
        return _RequestReader(dict(self.options))


class _RequestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        """One per request, from the files' row counts; the keys themselves are read where they are asked for."""
        fs, path = _folder(self.options["path"])
        files = sorted(f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(path)) if f.path.endswith(".parquet"))
        found = []
        for f in files:
            with fs.open_input_file(f) as source:
                found += [_Request(f, i) for i in range(pq.ParquetFile(source).metadata.num_rows)]
        limit = self.options.get("limit")
        return found if limit is None else found[: int(limit)]

    def read(self, partition: _Request | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty plan
            return
        fs, _ = _folder(self.options["path"])
        with fs.open_input_file(partition.file) as source:
            items = pq.read_table(source, columns=["items"]).column(0)[partition.row].as_py()
        answers = dict(fetch_all(_transport(self.options), dict.fromkeys(i["key"] for i in items)))
        bodies = [None if answers.get(i["key"]) is None else json.dumps(answers[i["key"]]) for i in items]
        yield pa.RecordBatch.from_arrays([*(pa.array([i[c] for i in items], pa.string()) for c in ("entry", "domain", "key")), pa.array(bodies, pa.string())], names=["entry", "domain", "key", "body"])


class Stored:
    """A transport that answers from a table (bucket, key, body) of stored answers, at option ``stored``; keys that end in ``down`` break a run off.

    ``buckets`` ranges of the keys' checksums are folders, so that a request reads
    one or two of them.
    """

    def __init__(self, options: dict):
        self.batch, self.folder, self.down, self.buckets = PER_REQUEST, options["stored"], options.get("down"), int(options.get("buckets", 16))

    def fetch(self, keys: list[str]) -> dict[str, dict]:
        import zlib

        fs, path = _folder(self.folder)
        if not keys:
            return {}
        if len(keys) > PER_REQUEST:
            raise ValueError(f"more than {PER_REQUEST} keys in a request")
        if self.down and any(k.endswith(self.down) for k in keys):
            raise RuntimeError("service is down")
        found = {}
        for bucket in sorted({zlib.crc32(k.encode()) * self.buckets >> 32 for k in keys}):
            where = f"{path}/bucket={bucket}"
            if fs.get_file_info(where).type == pyarrow.fs.FileType.Directory:
                table = ds.dataset(where, filesystem=fs, format="parquet").to_table(columns=["key", "body"], filter=ds.field("key").isin(keys))
                found |= {r["key"]: json.loads(r["body"]) for r in table.to_pylist()}
        return found

    @classmethod
    def write(cls, answers: DataFrame, folder: str, buckets: int = 16) -> None:
        """Store (key, body) for this transport."""
        bucket = F.shiftright(_checksum() * buckets, 32).cast("int").alias("bucket")
        answers.select(bucket, "key", "body").repartition("bucket").write.partitionBy("bucket").parquet(folder)


# ------------------------------------------------------------------ ledger


@dataclass
class _Done(WriterCommitMessage):
    part: str
    rows: int


class Ledger(DataSource):
    """Rows as part files, and a list of the finished ones for each run; option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "ledger"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("a ledger is only added to")
        return _LedgerWriter(self.options["path"], schema.fieldNames())


class _LedgerWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        """One part, there as a whole before its message is sent."""
        fs, path = _folder(self.path)
        held = [tuple(r) for r in rows]  # the rows of one request
        part = f"{uuid.uuid4().hex}.parquet"
        fs.create_dir(f"{path}/parts", recursive=True)
        table = pa.table({n: pa.array([r[i] for r in held], pa.string()) for i, n in enumerate(self.names)})
        with fs.open_output_stream(f"{path}/parts/{part}") as out:
            pq.write_table(table, out)
        return _Done(part, len(held))

    def _enter(self, messages: list[WriterCommitMessage | None], state: str) -> None:
        fs, path = _folder(self.path)
        fs.create_dir(f"{path}/runs", recursive=True)
        lines = [json.dumps({"part": m.part, "rows": m.rows, "state": state}) for m in messages if m is not None]
        with fs.open_output_stream(f"{path}/runs/{uuid.uuid4().hex}.json") as out:
            out.write("".join(f"{x}\n" for x in lines).encode())

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        self._enter(messages, "whole")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """What finished before the failure is entered as well."""
        self._enter(messages, "partial")


def entered(spark: SparkSession, path: str) -> DataFrame | None:
    """(entry, domain, key, body) of the ledger's finished parts; None while there are none. Parts of lost tasks are not read."""
    fs, where = _folder(path)
    if fs.get_file_info(f"{where}/runs").type == pyarrow.fs.FileType.NotFound or fs.get_file_info(f"{where}/parts").type == pyarrow.fs.FileType.NotFound:
        return None
    runs = spark.read.schema("part string, rows bigint, state string").json(f"{path}/runs").select("part").distinct()
    rows = spark.read.schema("entry string, domain string, key string, body string").parquet(f"{path}/parts")
    return rows.withColumn("part", F.element_at(F.split(F.input_file_name(), "/"), -1)).join(runs, "part", "left_semi").drop("part")


def fetch(entries: DataFrame, entry: str, url: str, domains: Sequence[str], ledger: str, work: str, transport: str, limit: int | None = None, **options: str) -> None:
    """One run (A22, A30): plan what the ledger lacks, ask for it, and enter the answers; ``limit`` requests at most."""
    spark = entries.sparkSession
    for source in (Requests, Ledger):
        spark.dataSource.register(source)
    folder = f"{work}/plan-{uuid.uuid4().hex}"
    plan(pending(entries, entry, url, domains, entered(spark, ledger)), folder)
    reader = spark.read.format("requests").option("path", folder).option("transport", transport).options(**options)
    if limit is not None:
        reader = reader.option("limit", str(limit))
    reader.load().write.format("ledger").option("path", ledger).mode("append").save()


# ------------------------------------------------------------------ topics


class TopicTransport(Protocol):
    """A search that gives ``PER_PAGE`` rows a page, the latest first."""

    def page(self, query: str, until: str | None, page: int) -> list[dict]: ...


class Topics(DataSource):
    """A search as a stream of (id, published, body); options ``transport``, ``query``, ``since`` and the transport's own."""

    @classmethod
    def name(cls) -> str:
        return "topics"

    def schema(self) -> str:
        return "id string, published string, body string"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _TopicReader(dict(self.options))


class _TopicReader(SimpleDataSourceStreamReader):
    """Pages follow each other, since each search is known only from the last: after ``MOST_PAGES`` pages it starts again before the last row's time.

    An offset says where the next page is: the time before which is searched, the
    page, and the ids at exactly that time that have been given already.
    """

    def __init__(self, options: dict):
        self.options, self.most = options, int(options.get("pages", MOST_PAGES))

    def initialOffset(self) -> dict:
        return {"until": "", "page": 0, "seen": "[]", "over": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if start["over"]:
            return iter([]), start
        rows = _transport(self.options).page(self.options.get("query", ""), start["until"] or None, start["page"])
        seen, since = set(json.loads(start["seen"])), self.options.get("since", "")
        fresh = [r for r in rows if r["id"] not in seen and r["published"] >= since]
        over = len(rows) < PER_PAGE or any(r["published"] < since for r in rows)
        nxt = start | {"page": start["page"] + 1, "over": int(over)}
        if not over and nxt["page"] >= self.most:
            last = rows[-1]["published"]
            if last == start["until"] and not fresh:
                raise ValueError(f"more than {self.most} pages at {last}")
            at_last = sorted({r["id"] for r in rows if r["published"] == last} | (seen if last == start["until"] else set()))
            nxt = {"until": last, "page": 0, "seen": json.dumps(at_last), "over": 0}
        return iter([(r["id"], r["published"], json.dumps(r["body"])) for r in fresh]), nxt

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        """The same rows again, page by page."""
        while start != end:
            rows, start = self.read(start)
            yield from rows

    def commit(self, end: dict) -> None:
        """Nothing is held for what has been read."""


class StoredTopics:
    """A search over a table (id, published, body) at option ``stored``."""

    def __init__(self, options: dict):
        self.folder = options["stored"]

    def page(self, query: str, until: str | None, page: int) -> list[dict]:
        fs, path = _folder(self.folder)
        wanted = None if until is None else ds.field("published") <= until
        if query:
            match = pa.compute.match_substring(ds.field("body"), query)
            wanted = match if wanted is None else wanted & match
        rows = ds.dataset(path, filesystem=fs, format="parquet").to_table(filter=wanted).sort_by([("published", "descending"), ("id", "ascending")])
        return rows.slice(page * PER_PAGE, PER_PAGE).to_pylist()
