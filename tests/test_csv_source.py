"""Header CSV files by byte ranges: every part size gives the same rows, ranges leave parts unread, files follow each other by name."""

import pytest
from pyspark.sql import functions as F

from streamlode.sources import csv_source as c
from streamlode.sources import observations as o

HEAD = b"5,3,2\n"
FILES = {"a.csv": HEAD + b"0,1,0\n" + b"12,345,1\n" * 3 + b"7,8,1", "b.csv": HEAD, "c.csv": b"", "d.csv": HEAD + b"\n1,,2,0\r\n5\n", "_skipped": b"9,9,9\n9,9,9\n"}
ROWS = [([0, 1], 0)] + [([12, 345], 1)] * 3 + [([7, 8], 1), ([], None), ([1, 2], 0), ([5], None)]


@pytest.fixture
def folder(tmp_path):
    for name, data in FILES.items():
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def rows_of(df):
    return [(r.row_id, r.features, r.label) for r in df.orderBy("row_id").collect()]


@pytest.mark.parametrize("size", [1, 7, 9, 64, 1 << 20])
def test_parts_of_any_size(spark, folder, size):
    want = [(i, f, y) for i, (f, y) in enumerate(ROWS)]
    assert rows_of(c.read_rows(spark, folder, part_bytes=size)) == want
    assert rows_of(c.read_rows(spark, folder, first=3, last=6, part_bytes=size)) == want[3:7]
    assert rows_of(c.read_rows(spark, f"file://{folder}", first=8, part_bytes=size)) == []


def test_ranges_leave_parts_unread(spark, folder):
    starts = {r.part: (r.start, r.lines) for r in c.part_starts(spark, folder, 9).collect()}
    read = c.Reader({"path": folder, "partBytes": "9", "firstPart": "2", "lastPart": "3"})
    assert [p.number for p in read.partitions()] == [2, 3] and len(starts) > 4
    assert sum(n for _, n in starts.values()) == len(ROWS)
    assert sum(len(x) for p in read.partitions() for x in c.lines_of(p)) == starts[2][1] + starts[3][1]


def test_header(spark, folder, tmp_path):
    assert c.header(folder) == c.Header(5, 3, 2)
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "x.csv").write_text("4,x")
    assert c.header(str(tmp_path / "only")) == c.Header(4, 0, 0)
    with pytest.raises(FileNotFoundError):
        c.files_of(str(tmp_path / "nothing"))


def test_text_reader_gives_the_same(spark, folder):
    want = [(i, f, y) for i, (f, y) in enumerate(ROWS)]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("7", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        got = rows_of(o.read_csv(spark, folder, 3))
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert got == want


def test_streamed_files(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for k, name in enumerate(("a.csv", "d.csv")):
        (source / name).write_bytes(FILES[name])
        query = c.stream_rows(spark, str(source), part_bytes=9).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress").trigger(availableNow=True).start()
        query.awaitTermination()
        got = [(r.features, r.label) for r in spark.read.parquet(out).orderBy("row_id").collect()]
        assert got == (ROWS[:5] if k == 0 else ROWS)
    assert spark.read.parquet(out).agg(F.count_distinct("row_id")).first()[0] == len(ROWS)


def test_values_are_parsed_once_and_by_prefix(spark):
    one = lambda x: spark.range(1).select(x.alias("x")).first()["x"]
    assert one(o.parse_row(F.lit("1e2, +4 ,2147483648,-7x,99"), 5)) == [1, 4, 0, -7, 99]
    assert one(o.parse_row(F.lit(",,,"), 2)) == [] and one(o.parse_row(F.lit("1,2,3"), 2)) == [1, 2]


def test_written_files_are_read_back(spark, tmp_path):
    rows = [(i, [i / 8, -1e-7 * i], i % 3 if i % 10 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "row_id long, features array<double>, label int").repartition(3)
    path = str(tmp_path / "out")
    c.write_rows(df, path, 3, files=4)
    assert c.header(path) == c.Header(60, 3, 3) and len(c.files_of(path)) == 4
    assert rows_of(c.read_rows(spark, path, "double", part_bytes=50)) == rows
    c.write_rows(df.limit(0), path, 3)
    assert c.read_rows(spark, path, "double").count() == 0
