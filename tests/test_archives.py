"""ZIP archives made in parallel, and names numbered within hot groups."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from newsgrain.operators import export, ranges


def test_one_archive_of_many_ranges(spark):
    """Opened by a standard reader: contents, order, compression, checksums."""
    rnd = random.Random(5)
    rows = [(f"{i:04d}-é.txt", " ".join(rnd.choice(["aa", "bb", "ü"]) for _ in range(rnd.randrange(400))) if i % 9 else None, i) for i in range(500)]
    rnd.shuffle(rows)
    files = spark.createDataFrame(rows, "path string, content string, words int").repartition(5)
    (whole,) = export.zipped(files, F.lit("all"), ["words"]).collect()
    with zipfile.ZipFile(io.BytesIO(whole.payload)) as z:
        assert z.testzip() is None
        want = {p: (c or "").encode() for p, c, _ in rows}
        assert z.namelist() == [*sorted(want), "MANIFEST.csv"]
        assert {n: z.read(n) for n in z.namelist()[:-1]} == want
        assert {x.compress_type for x in z.infolist()} == {zipfile.ZIP_DEFLATED}
        assert z.read("MANIFEST.csv").decode().split("\r\n")[:-1] == ["filename,words", *(f"{p},{n}" for p, _, n in sorted(rows))]
    assert len(whole.payload) < sum(map(len, want.values()))
    listed = export.listed(export.zipped(files, F.lit("all"))).collect()
    assert {(r.path, r.bytes, r.method) for r in listed} == {(p, len(c), 8) for p, c in want.items()}
    assert export.zipped(files.limit(0), F.lit("all")).collect() == []


@pytest.mark.parametrize(("most", "entries"), [(3000, 60_000), (1 << 20, 7)])
def test_volumes(spark, monkeypatch, most, entries):
    monkeypatch.setattr(export, "VOLUME_BYTES", most)
    monkeypatch.setattr(export, "VOLUME_ENTRIES", entries)
    rnd = random.Random(1)
    rows = [("ab"[i % 3 > 0], f"{i:03d}", "".join(chr(rnd.randrange(32, 127)) for _ in range(200))) for i in range(90)]
    got = export.zipped(spark.createDataFrame(rows, "box string, path string, content string").repartition(4), F.col("box")).collect()
    names = {}
    for r in sorted(got, key=lambda r: (r.archive, r.volume)):
        with zipfile.ZipFile(io.BytesIO(r.payload)) as z:
            assert len(z.namelist()) <= entries and len(r.payload) < most + 1000 + 80 * entries
            names.setdefault(r.archive, []).extend(z.namelist())
    assert names == {b: sorted(p for x, p, _ in rows if x == b) for b in "ab"} and len(got) > 4


def test_numbers_within_hot_groups(spark):
    """One group with most rows, others small, nulls among them; ranges and whole groups give the same numbers."""
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), i) for i in rnd.sample(range(5000), 900)]
    df = spark.createDataFrame(rows, "g string, i int").repartition(4)
    assert [r.g for r in ranges._heavy(df, ["g"])] == ["hot"]
    got = {r.i: r.n for r in ranges.numbered_within(df, ["g"], ["i"], "n").collect()}
    want = {}
    for g in {g for g, _ in rows}:
        want |= {i: n + 1 for n, i in enumerate(sorted(i for x, i in rows if x == g))}
    assert got == want
    sums = {r.i: (r.before, r.n) for r in ranges.running(df, ["g"], ["i"], {"before": F.col("i"), "n": F.lit(1)}).collect()}
    assert sums == {i: (sum(j for x, j in rows if x == g and j < i), want[i] - 1) for g, i in rows}
    names = {r.i: r.filename for r in export.index(df.withColumn("name", F.lit("all")), None, "name", "i").collect()}
    order = sorted(i for _, i in rows)
    assert names == {i: "all" if k == 0 else f"all_({k + 1})" for k, i in enumerate(order)}
    assert ranges.numbered_within(df.limit(0), ["g"], ["i"], "n").collect() == []


@pytest.mark.parametrize(("most", "entries"), [(3000, 60_000), (1 << 20, 7)])
def test_whole_archives_in_parts(spark, monkeypatch, most, entries):
    """Parts are bounded; one behind the other they are an archive that a standard reader opens."""
    monkeypatch.setattr(export, "PART_BYTES", most)
    monkeypatch.setattr(export, "PART_ENTRIES", entries)
    rnd = random.Random(1)
    rows = [("ab"[i % 3 > 0], f"é{i:03d}", "".join(chr(rnd.randrange(32, 127)) for _ in range(200))) for i in range(90)]
    parts = export.spanned(spark.createDataFrame(rows, "box string, path string, content string").repartition(4), F.col("box"))
    got = sorted(parts.collect(), key=lambda r: (r.archive, r.part))
    assert len(got) > 4 and all(len(r.payload) < most + 1000 for r in got)
    for box in "ab":
        mine = [r for r in got if r.archive == box]
        assert [r.ending is None for r in mine] == [True] * (len(mine) - 1) + [False]
        whole = b"".join([*(r.payload for r in mine), *(r.directory for r in mine), mine[-1].ending])
        with zipfile.ZipFile(io.BytesIO(whole)) as z:
            assert z.testzip() is None and {n: z.read(n).decode() for n in z.namelist()} == {p: c for x, p, c in rows if x == box}
    assert {(r.archive, r.volume, r.path, r.bytes) for r in export.listed_parts(parts).collect()} == {(x, 0, p, len(c)) for x, p, c in rows}


def test_more_entries_than_a_volume(spark):
    """An archive of 66 000 entries stays one archive; ``zipped`` made two volumes of it."""
    files = spark.range(66_000).select(F.format_string("%06d", "id").alias("path"), F.col("id").cast("string").alias("content"))
    got = sorted(export.spanned(files, F.lit("all")).collect(), key=lambda r: r.part)
    whole = b"".join([*(r.payload for r in got), *(r.directory for r in got), got[-1].ending])
    with zipfile.ZipFile(io.BytesIO(whole)) as z:
        assert len(z.namelist()) == 66_000 and z.read("065999") == b"65999"
    assert export.spanned(files.limit(0), F.lit("all")).collect() == []


def test_offsets_beyond_four_gigabytes(tmp_path):
    """A sparse file with an entry behind 5 GB of nothing is opened by a standard reader."""
    at = 5 << 30
    record, crc, packed = export._record("far.txt", b"far away")
    line = export._line("far.txt", crc, packed, 8, at)
    with open(tmp_path / "a.zip", "wb") as f:
        f.seek(at)
        f.write(record + line + export._ending(1, len(line), at + len(record)))
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.read("far.txt") == b"far away"
