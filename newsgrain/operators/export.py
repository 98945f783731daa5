"""Exports: CSV, folders, archives, rules."""

from __future__ import annotations

import csv
import io
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgrain.functions import bins
from newsgrain.functions import text as X
from newsgrain.operators.ingest import status_text
from newsgrain.operators.ranges import numbered_within, running, written
from newsgrain.operators.rules import bare, specificity


def in_order(ids: DataFrame, articles: DataFrame, key: str, fields: Sequence[str], binned: Sequence[str] = (), ascii_only: bool = False) -> DataFrame:
    """Chosen fields of a list of ids (pos, key) in list order; unknown ids have ``missing`` true; texts folded to ASCII if wanted (B1)."""
    texts = {f.name for f in articles.schema if ascii_only and f.dataType.simpleString() == "string"}
    cols = [X.folded(F.col(f)).alias(f) if f in texts else F.col(f) for f in fields] + [bins.bin_of(F.col(f)).alias(f"binned_{f}") for f in binned]
    side = articles.select(key, *cols, F.lit(True).alias("_known"))
    return ids.join(side, key, "left").withColumn("missing", F.col("_known").isNull()).drop("_known").orderBy("pos")


def top_shares(df: DataFrame, measure: str, key: str, n: int | None = None, cutoff: float | None = None, domain: Column | None = None) -> DataFrame:
    """Rows by falling measure, cut by number or value, of a domain perhaps (B2)."""
    if cutoff is not None:
        df = df.filter(F.col(measure) >= cutoff)
    if domain is not None:
        df = df.filter(domain)
    out = df.orderBy(F.desc(measure), key)
    return out.limit(n) if n is not None else out


def index(df: DataFrame, group: str | None, name: str, key: str) -> DataFrame:
    """Unique file names: repeated ones, of a group or of all, get ``_(n)`` with their number from the second on."""
    n = F.col("_n")
    named = numbered_within(df, [*([group] if group else []), name], [key], "_n")
    return named.withColumn("filename", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_("), n, F.lit(")")))).drop("_n")


def _words(text: str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))


def index_rows(df: DataFrame, group: str, measures: Sequence[str], key: str, status: str = "fetch_status", when: str = "pubdate") -> DataFrame:
    """Rows of ``index.csv`` (B3): group, measures, file name, id, url, date and word count of the body.

    Names count up over all groups and only among fetched articles; one that was
    not fetched has ``<JUNK: status n>`` for a name and neither date nor count.
    """
    named = index(df.withColumn("_good", F.coalesce(F.col(status) == 200, F.lit(False))), "_good", "name", key)
    junk = F.concat(F.lit("<JUNK: status "), F.col(status).cast("string"), F.lit(">"))
    pick = lambda good, bad: F.when(F.col("_good"), good).otherwise(bad)
    return named.select(
        F.col(group).alias("group"), *measures, pick(F.col("filename"), junk).alias("filename"), F.col(key).alias("id"), "url",
        pick(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), "").alias("pubdate"), pick(_words("body_text").cast("string"), "").alias("body_wordcount"),
    )


def csv_line(*cells: Column) -> Column:
    """A line of CSV: cells with commas, quotes or line ends are quoted; nulls are empty."""
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in cells]
    return F.concat_ws(",", *[F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in text])


def folders(df: DataFrame, group: str, status: str = "fetch_status") -> DataFrame:
    """(path, content): six files per article of an index()ed table with url, html, headline, body_text.

    Articles that were not fetched hold ``<JUNK: status n>`` in their text files.
    """
    junk = F.concat(F.lit("<JUNK: status "), F.col(status).cast("string"), F.lit(">"))
    text = lambda c: F.when(F.col(status) == 200, X.export_text(c)).otherwise(junk)
    files = {
        "redirect.html": X.redirect_page(F.col("url")),
        "html": F.coalesce("html", F.lit("")),
        "fulltext.txt": text(X.full_text(F.col("headline"), F.col("body_text"))),
        "headline.txt": text(F.col("headline")),
        "lead.txt": text(X.first_paragraph(F.col("body_text"))),
        "body.txt": text(F.col("body_text")),
    }
    pairs = F.array(*[F.struct(F.concat_ws("/", group, F.lit(k.split(".")[0]), F.concat(F.col("filename"), F.lit("." + k.split(".")[-1]))).alias("path"), v.alias("content")) for k, v in files.items()])
    return df.select(F.explode(pairs).alias("f")).select("f.path", "f.content")


#: Compressed bytes and entries after which an archive goes on in another volume.
VOLUME_BYTES, VOLUME_ENTRIES = 256 << 20, 60_000
#: Columns of the manifest of a JSON archive.
ARCHIVE_MANIFEST = ("binned_facebook_shares_5d", "body_word_count")

# Fixed values of the ZIP format: signatures and layouts of an entry, of its line in the directory and of the directory's end;
# version, the flag of UTF-8 names, deflate, and the first day that a date can name.
_ENTRY, _LINE, _END = ("<4s5H3I2H", b"PK\x03\x04"), ("<4s6H3I5H2I", b"PK\x01\x02"), ("<4s4H2IH", b"PK\x05\x06")
_VERSION, _UTF8, _DEFLATE, _DATE = 20, 0x800, 8, 0x21


def _record(path: str, content: bytes) -> tuple[bytes, int, int]:
    """(header and deflated bytes, crc32, deflated size) of an entry."""
    press = zlib.compressobj(zlib.Z_DEFAULT_COMPRESSION, zlib.DEFLATED, -15)
    data, crc, name = press.compress(content) + press.flush(), zlib.crc32(content), path.encode()
    return struct.pack(_ENTRY[0], _ENTRY[1], _VERSION, _UTF8, _DEFLATE, 0, _DATE, crc, len(data), len(content), len(name), 0) + name + data, crc, len(data)


def _deflated(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows as entries, where they lie."""
    extras = "".join(f", `{c}` string" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for archive, path, content, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = (content or "").encode()
                out.append((archive, path, *[None if x is None else str(x) for x in rest], *_record(path, raw), len(raw)))
            kinds = [pa.string(), pa.string(), *[pa.string()] * len(columns), pa.binary(), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=["archive", "path", *columns, "record", "crc", "packed", "size"])

    return rows.mapInArrow(run, f"archive string, path string{extras}, record binary, crc bigint, packed bigint, size bigint")


def zipped(files: DataFrame, archive: Column, manifest: Sequence[str] = ()) -> DataFrame:
    """(archive, volume, payload): ZIP files by archive name from rows (path, content, any columns of a manifest).

    Entries are deflated where the rows lie, so an archive of any size is
    compressed by many tasks.  Running sums of the entries' sizes, taken of their
    names and sizes alone and in ranges of (archive, path), say where an entry
    starts; an archive beyond ``VOLUME_BYTES`` or ``VOLUME_ENTRIES`` goes on in
    further volumes.  A volume's entries are then put one behind the other, and
    its directory, from their figures, behind them.  With ``manifest`` each volume
    ends with ``MANIFEST.csv`` of the paths and those columns.
    """
    columns = list(manifest)
    rows = files.select(archive.alias("archive"), "path", "content", *columns)
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = written(_deflated(rows, columns).withColumn("entry", F.monotonically_increasing_id()))
    sizes = entries.select("entry", F.col("archive").alias("_archive"), "path", F.length("record").alias("_bytes"))
    placed = running(sizes, ["_archive"], ["path", "entry"], {"_at": F.col("_bytes"), "_n": F.lit(1)})
    volume = (F.floor(F.col("_at") / VOLUME_BYTES) + F.floor(F.col("_n") / VOLUME_ENTRIES)).cast("int")
    dealt = entries.join(placed.select("entry", volume.alias("volume"), "_n"), "entry").select("archive", "volume", "_n", "path", "record", "crc", "packed", "size", *columns)
    return dealt.repartition(parts, "archive", "volume").sortWithinPartitions("archive", "volume", "_n").mapInArrow(_assembler(columns), "archive string, volume int, payload binary")


def _assembler(columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted entries to whole volumes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, lines, listed_, table = None, bytearray(), [], io.StringIO(), None

        def put(path: str, record: bytes, crc: int, packed: int, size: int) -> None:
            name = path.encode()
            lines.append(struct.pack(_LINE[0], _LINE[1], _VERSION, _VERSION, _UTF8, _DEFLATE, 0, _DATE, crc, packed, size, len(name), 0, 0, 0, 0, 0, len(out)) + name)
            out.extend(record)

        def close() -> pa.RecordBatch:
            if columns:
                raw = listed_.getvalue().encode()
                record, crc, packed = _record("MANIFEST.csv", raw)
                put("MANIFEST.csv", record, crc, packed, len(raw))
            directory, start = b"".join(lines), len(out)
            out.extend(directory + struct.pack(_END[0], _END[1], 0, 0, len(lines), len(lines), len(directory), start, 0))
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int32()), pa.array([bytes(out)], pa.binary())], names=["archive", "volume", "payload"])

        for b in batches:
            for archive, volume, _, path, record, crc, packed, size, *rest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is not None and (archive, volume) != now:
                    yield close()
                    now = None
                if now is None:
                    now, out, lines, listed_ = (archive, volume), bytearray(), [], io.StringIO()
                    table = csv.writer(listed_)
                    table.writerow(["filename", *columns])
                put(path, record, crc, packed, size)
                table.writerow([path, *rest])
        if now is not None:
            yield close()

    return build


#: Compressed bytes and entries after which the bytes of a whole archive go on in another part.
PART_BYTES, PART_ENTRIES = 32 << 20, 4096
#: Greatest figures of a ZIP directory without the 64-bit fields.
_MOST, _MANY = 0xFFFFFFFF, 0xFFFF
# The 64-bit extra field of an offset, the 64-bit end of a directory and its locator.
_WIDE, _END64, _AT64 = "<2HQ", ("<4sQ2H2I4Q", b"PK\x06\x06"), ("<4sIQI", b"PK\x06\x07")


def _line(path: str, crc: int, packed: int, size: int, at: int) -> bytes:
    """An entry's line in the directory of an archive of any size."""
    name, wide = path.encode(), b"" if at < _MOST else struct.pack(_WIDE, 1, 8, at)
    return struct.pack(_LINE[0], _LINE[1], 45, _VERSION, _UTF8, _DEFLATE, 0, _DATE, crc, packed, size, len(name), len(wide), 0, 0, 0, 0, min(at, _MOST)) + name + wide


def _ending(entries: int, directory: int, start: int) -> bytes:
    """The end of an archive with so many entries, whose directory of so many bytes starts there."""
    wide = b""
    if entries >= _MANY or directory >= _MOST or start >= _MOST:
        wide = struct.pack(_END64[0], _END64[1], 44, 45, 45, 0, 0, entries, entries, directory, start) + struct.pack(_AT64[0], _AT64[1], 0, start + directory, 1)
    return wide + struct.pack(_END[0], _END[1], 0, 0, min(entries, _MANY), min(entries, _MANY), min(directory, _MOST), min(start, _MOST), 0)


def spanned(files: DataFrame, archive: Column) -> DataFrame:
    """(archive, part, start, payload, directory, ending): one ZIP file by archive name from rows (path, content), however large.

    Its bytes are the payloads by part, then the directories by part, then the
    ending, which the last part has.  Entries are deflated where the rows lie and
    placed by running sums as in ``zipped``; as an entry's place in the archive is
    known beforehand, a part is put together with its piece of the directory
    alone, and no task holds more than ``PART_BYTES`` or ``PART_ENTRIES`` of an
    archive (and one entry).  Beyond 65 534 entries or 4 GB the 64-bit fields of
    the format are used.
    """
    rows = files.select(archive.alias("archive"), "path", "content")
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = written(_deflated(rows, []).withColumn("entry", F.monotonically_increasing_id()))
    sizes = entries.select("entry", F.col("archive").alias("_archive"), "path", F.length("record").alias("_bytes"))
    placed = written(running(sizes, ["_archive"], ["path", "entry"], {"_at": F.col("_bytes"), "_n": F.lit(1)}))
    part = F.struct(F.floor(F.col("_at") / PART_BYTES).alias("b"), F.floor(F.col("_n") / PART_ENTRIES).alias("n"))
    line = struct.calcsize(_LINE[0]) + F.octet_length("path") + F.when(F.col("_at") >= _MOST, struct.calcsize(_WIDE)).otherwise(0)
    whole = placed.groupBy(F.col("_archive").alias("_a")).agg(F.count(F.lit(1)).alias("_entries"), F.sum("_bytes").alias("_start"), F.sum(line).alias("_directory"))
    known = placed.join(whole, F.col("_archive").eqNullSafe(F.col("_a"))).select("entry", part.alias("part"), "_at", "_n", "_entries", "_directory", "_start")
    dealt = entries.join(known, "entry").select("archive", "part", "_n", "_at", "path", "record", "crc", "packed", "size", "_entries", "_directory", "_start")
    kinds = "archive string, part struct<b: bigint, n: bigint>, start bigint, payload binary, directory binary, ending binary"
    return dealt.repartition(parts, "archive", "part").sortWithinPartitions("archive", "part", "_n").mapInArrow(_join_parts, kinds)


def _join_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted and placed entries to parts of archives."""
    kinds = [pa.string(), pa.struct([("b", pa.int64()), ("n", pa.int64())]), pa.int64(), *[pa.binary()] * 3]
    names = ["archive", "part", "start", "payload", "directory", "ending"]
    now, start, out, lines, ending = None, 0, bytearray(), [], None

    def close() -> pa.RecordBatch:
        held = (now[0], now[1], start, bytes(out), b"".join(lines), ending)
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(held, kinds, strict=True)], names=names)

    for b in batches:
        for archive, part, n, at, path, record, crc, packed, size, *whole in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if now is not None and (archive, part) != now:
                yield close()
                now = None
            if now is None:
                now, start, out, lines, ending = (archive, part), at, bytearray(), [], None
            out.extend(record)
            lines.append(_line(path, crc, packed, size, at))
            if n + 1 == whole[0]:
                ending = _ending(*whole)
    if now is not None:
        yield close()


def archive_files(df: DataFrame, document: Column, domain: str, when: str, key: str = "id") -> DataFrame:
    """(archive, path, content, manifest columns): JSON documents named for ZIP files by domain, year and month."""
    keyed = archive_keys(df, domain, when)
    archive = F.format_string("%s-%04d-%02d.zip", F.col(domain), F.col("year"), F.col("month"))
    path = F.concat(F.concat_ws("-", F.col(key).cast("string"), F.col("name")), F.lit(".json"))
    content = F.concat(F.to_json(document), F.lit("\n"))
    return keyed.select(archive.alias("archive"), path.alias("path"), content.alias("content"), bins.bin_of(F.col("fb_count_5d")).alias("binned_facebook_shares_5d"), _words("body_text").alias("body_word_count"))


def listed(archives: DataFrame) -> DataFrame:
    """(archive, volume, path, bytes, packed, method, crc32) of every entry of ZIP files, each inflated and checked."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                with zipfile.ZipFile(io.BytesIO(b.column(2)[i].as_py())) as z:
                    broken = z.testzip()
                    if broken is not None:
                        raise ValueError(f"{broken} does not have its checksum")
                    info = z.infolist()
                n = len(info)
                figures = [pa.array([f(x) for x in info], pa.int64()) for f in (lambda x: x.file_size, lambda x: x.compress_size, lambda x: x.compress_type, lambda x: x.CRC)]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * n, pa.string()), pa.array([b.column(1)[i].as_py()] * n, pa.int32()), pa.array([x.filename for x in info], pa.string()), *figures], names=["archive", "volume", "path", "bytes", "packed", "method", "crc32"])

    return archives.select("archive", "volume", "payload").mapInArrow(read, "archive string, volume int, path string, bytes bigint, packed bigint, method bigint, crc32 bigint")


def listed_parts(parts: DataFrame) -> DataFrame:
    """(archive, volume, path, bytes, packed, method, crc32) of every entry of ``spanned`` archives, as the directory says; each inflated and checked where it lies."""
    head, line, wide = (struct.calcsize(x) for x in (_ENTRY[0], _LINE[0], _WIDE))

    def entries(start: int, payload: bytes, directory: bytes) -> Iterator[tuple]:
        at, last = 0, 0
        while at < len(directory):
            sign, _, _, _, method, _, _, crc, packed, size, name, extra, _, volume, _, _, offset = struct.unpack_from(_LINE[0], directory, at)
            path = directory[at + line : at + line + name]
            if extra == wide:
                offset = struct.unpack_from(_WIDE, directory, at + line + name)[2]
            at += line + name + extra
            here = offset - start
            own, own_method, own_crc, own_packed, own_size, own_name = (struct.unpack_from(_ENTRY[0], payload, here)[i] for i in (0, 3, 6, 7, 8, 9))
            data = here + head + name
            content = zlib.decompress(payload[data : data + packed], -15)
            if sign != _LINE[1] or own != _ENTRY[1] or here != last or payload[here + head : data] != path or (own_method, own_crc, own_packed, own_size, own_name) != (method, crc, packed, size, name):
                raise ValueError(f"{path.decode()} is not where the directory says")
            if zlib.crc32(content) != crc or len(content) != size:
                raise ValueError(f"{path.decode()} does not have its checksum")
            last = data + packed
            yield volume, path.decode(), size, packed, method, crc
        if last != len(payload):
            raise ValueError("a part has bytes of no entry")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
        for b in batches:
            for archive, *held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = list(zip(*entries(*held), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(found[0]), pa.string()), *[pa.array(x, k) for x, k in zip(found, kinds, strict=True)]], names=["archive", "volume", "path", "bytes", "packed", "method", "crc32"])

    return parts.select("archive", "start", "payload", "directory").mapInArrow(read, "archive string, volume int, path string, bytes bigint, packed bigint, method bigint, crc32 bigint")


def archive_document(exclude: Sequence[str] = ()) -> Column:
    """The nested archive document of an article row (B15); excluded dotted paths are dropped, unknown ones ignored; nulls vanish in JSON."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    parts = {
        "id": F.col("id"),
        "url": F.struct(F.col("url").alias("original"), F.col("canonical_url").alias("canonical"), F.col("signature").alias("signature")),
        "when": F.struct(iso("spider_when").alias("spidered"), iso("fetch_when").alias("fetched")),
        "fetch_status": status_text(F.col("fetch_status")),
        "shares": F.struct(F.col("fb_count_5d").alias("fb"), F.col("tw_count_5d").alias("tw"), bins.bin_of(F.col("fb_count_5d")).alias("fb_bin")),
        "extracted": F.struct(*[F.struct(F.col(f).alias("text"), bare(F.col(f"{f}_selector")).alias("selector"), specificity(F.col(f"{f}_selector")).alias("rule")).alias(f) for f in ("headline", "body_text")]),
    }
    for path in exclude:
        head, _, rest = path.partition(".")
        if head not in parts:
            continue
        if rest:
            parts[head] = parts[head].dropFields(rest)
        else:
            del parts[head]
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def archive_keys(df: DataFrame, domain: str, when: str) -> DataFrame:
    """Year and month of an archive, 0 where unknown."""
    return df.withColumns({"year": F.coalesce(F.year(when), F.lit(0)), "month": F.coalesce(F.month(when), F.lit(0))})


def write_archives(df: DataFrame, document: Column, domain: str, when: str, folder: str) -> None:
    """JSON lines partitioned by domain, year and month."""
    archive_keys(df, domain, when).select(F.col(domain).alias("domain"), "year", "month", F.to_json(document).alias("value")).write.partitionBy("domain", "year", "month").text(folder)


def rule_files(rules: DataFrame, fields: Sequence[str], defaults: dict[str, str]) -> DataFrame:
    """(path, content): ``field/domain.txt`` for domains' own rules and ``field/DEFAULT.txt``."""
    spark = rules.sparkSession
    own = rules.filter("signature = base_domain").unpivot(["base_domain"], [f"{f}_selector" for f in fields], "field", "content").filter("content IS NOT NULL AND NOT startswith(content, '<default>')")
    named = own.select(F.concat(F.regexp_replace("field", "_selector$", ""), F.lit("/"), "base_domain", F.lit(".txt")).alias("path"), "content")
    rest = spark.createDataFrame([(f"{f}/DEFAULT.txt", defaults[f]) for f in fields], "path string, content string")
    return named.unionByName(rest)
