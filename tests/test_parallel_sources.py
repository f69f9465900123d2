"""CSV and archives that many tasks read, against reading them from the beginning."""

import csv
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewright.sources import archives, csvblocks, files, ranges


def field(rng):
    kind = rng.randrange(6)
    if kind == 0:
        return ""
    if kind == 1:
        return '"' + rng.choice(["a\nb", 'say ""x""', "1,2", "\r\n\r\nend", '""', "\n" * 40, "x" * 300 + "\n"]) + '"'
    return "w" * rng.randrange(1, 9)


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_csv_in_many_tasks_equals_one(spark, tmp_path, small_blocks, end):
    rng = random.Random(1)
    rows = [f"{k},{field(rng)},{field(rng)}" for k in range(150)]
    for k, part in enumerate((rows[:80], rows[80:])):
        (tmp_path / f"{k}.csv").write_bytes(("\ufeffid,b,c" + end + end.join(part) + (end if k else "")).encode())
    path = f"{tmp_path}/*.csv"
    found = csvblocks.records(spark, path)
    assert found.rdd.getNumPartitions() > 1 and spark.read.text(path).rdd.getNumPartitions() > 10
    got, want = (reader(spark, path, ["id", "c", "none", "b"], ["id"]) for reader in (csvblocks.read_csv, files.read_csv))
    whole = [r for k in range(2) for r in list(csv.reader(io.StringIO((tmp_path / f"{k}.csv").read_bytes().decode("utf-8-sig"), newline="")))[1:]]
    found = sorted(map(tuple, got.collect()), key=str)
    assert found == sorted(((r[0], r[2] or None, None, r[1] or None) for r in whole), key=str)
    # Spark's own reader makes line breaks within fields LF if lines end with CRLF.
    plain = lambda rows: sorted((tuple(v and v.replace("\r\n", "\n") for v in r) for r in rows), key=str)
    assert plain(found) == plain(map(tuple, want.collect()))
    with pytest.raises(ValueError):
        csvblocks.read_csv(spark, path, ["id"], ["lacking"])


def test_a_quoted_field_that_is_not_closed_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(Exception, match="isn't closed"):
        csvblocks.read_csv(spark, str(tmp_path / "a.csv"), ["a"]).collect()
    (tmp_path / "e.csv").write_text("a,b\n")
    assert csvblocks.read_csv(spark, str(tmp_path / "e.csv"), ["a"]).count() == 0


def zipped(entries, level=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", level) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


def test_archives_by_runs_equal_whole_ones(spark, tmp_path):
    rng = random.Random(2)
    inner = zipped([("p/A.class", b"inner"), ("q.jar", zipped([("deep.txt", b"deep")])), ("../out", b"x")])
    (tmp_path / "big.jar").write_bytes(zipped([(f"d{k}/f{k}.class", rng.randbytes(rng.randrange(3000))) for k in range(200)] + [("lib/in.jar", inner), ("/abs", b"1"), ("d/", b"")], zipfile.ZIP_STORED))
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    paths = ranges.list_archives(spark, str(tmp_path))
    assert ranges.runs(paths, 20_000).where("reason IS NULL").count() > 10
    names = ["entry", "depth", "bytes", "sha256", "content", "reason"]
    got = ranges.entries(paths, (".class",), run_bytes=20_000).where("archive LIKE '%big%'").select(*names)
    want = archives.entries(archives.read(spark, str(tmp_path)), (".class",)).where("archive LIKE '%big%'").select(*names)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert [r.reason for r in ranges.entries(paths).where("archive LIKE '%bad%'").collect()] == ["ARCHIVE_FORMAT_INVALID"]


def test_limits_hold_over_all_runs(spark, tmp_path):
    (tmp_path / "many.jar").write_bytes(zipped([(f"f{k}", b"0123456789") for k in range(50)] + [("f7", b"again")]))
    (tmp_path / "bomb.zip").write_bytes(zipped([("a", b"a"), ("zeros", b"\0" * (3 << 20)), ("b", b"b")]))
    paths = ranges.list_archives(spark, str(tmp_path))
    of = lambda df, name: df.where(F.col("archive").endswith(name))
    few = ranges.entries(paths, limits=archives.Limits(entries=20), run_bytes=60)
    assert of(few, "many.jar").where("sha256 IS NOT NULL").count() == 20 and [r.reason for r in of(few, "many.jar").where("sha256 IS NULL").collect()] == ["ARCHIVE_ENTRY_COUNT_EXCEEDED"]
    small = ranges.entries(paths, limits=archives.Limits(total_bytes=95), run_bytes=60)
    assert of(small, "many.jar").where("sha256 IS NOT NULL").count() == 9
    whole = ranges.entries(paths, run_bytes=60)
    assert [(r.entry, r.reason) for r in of(whole, "many.jar").where("reason IS NOT NULL").collect()] == [("f7", "ARCHIVE_DUPLICATE_ENTRY")]
    assert sorted((r.entry, r.reason or "") for r in of(whole, "bomb.zip").collect()) == [("", "ARCHIVE_EXPANSION_RATIO_EXCEEDED"), ("a", ""), ("b", "")]
    assert {r.reason for r in ranges.over_limits(whole, archives.Limits(entries=40)).collect()} == {"ARCHIVE_ENTRY_COUNT_EXCEEDED"}
