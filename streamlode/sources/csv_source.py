"""Header CSV files as a data source, batch and stream, read by byte ranges.

    spark.dataSource.register(ObservationsSource)
    spark.read.format("observations").load("/data/x.csv")     # or a folder, read file by file in order of names

The first line of each file declares num_data, num_features and num_classes. Files are cut into parts of ``partBytes`` bytes; a line
belongs to the part where it begins. The source gives part (numbered over all files, in order), line (from 0 in the part, the header
left out) and value; ``read_rows`` numbers rows with it and parses them in Spark. ``firstPart`` and ``lastPart`` leave other parts unread; ``write_rows`` writes such files.
Paths are local or URIs that pyarrow opens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .observations import cached_apart, parse_row

LINES = "part long, line long, value string"
COUNTS = "part long, lines long"
#: Bytes that a task reads and hands on at a time.
READ = 1 << 20


def opened(path: str):
    """A pyarrow file system and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """The files at path (a file or a folder) by name, and their sizes. Names that start with a dot or underscore do not count."""
    from pyarrow import fs

    system, inner = opened(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner))
    scheme = path[: path.index("://") + 3] if "://" in path else ""
    host = path[len(scheme) :].split("/", 1)[0] if scheme and scheme != "file://" else ""
    prefix = scheme + host if host and not inner.startswith(host) else scheme
    return sorted((prefix + x.path, x.size) for x in found if x.is_file and x.base_name[0] not in "._")


@dataclass
class Part(InputPartition):
    number: int
    path: str
    start: int
    end: int


def cut_files(files: list[tuple[str, int]], part_bytes: int, first_number: int = 0) -> list[Part]:
    """Byte ranges of the files, numbered in order. An empty file has none."""
    out = []
    for path, size in files:
        for start in range(0, size, part_bytes):
            out.append(Part(first_number + len(out), path, start, min(size, start + part_bytes)))
    return out


def lines_of(part: Part) -> Iterator[list[bytes]]:
    """The lines that begin in a part, a read at a time; the first line of the file (its header) is left out.

    Lines end with a line feed, a carriage return before it goes; a last line without one counts, an empty rest does not.
    """
    system, inner = opened(part.path)
    with system.open_input_file(inner) as f:
        at = max(0, part.start - 1)
        f.seek(at)
        held, begins = b"", at  # the text not yet cut into lines, and where it begins
        skip = True  # the header, or the line that begins in the part before
        while True:
            data = f.read(READ)
            held += data
            pieces = held.split(b"\n")
            held, out = pieces.pop(), []
            for piece in pieces:
                if begins >= part.end:
                    break
                if not skip:
                    out.append(piece.removesuffix(b"\r"))
                skip = False
                begins += len(piece) + 1
            if out:
                yield out
            if begins >= part.end:
                return
            if not data:
                if held and not skip:
                    yield [held.removesuffix(b"\r")]
                return


def batches(part: Part, counting: bool) -> Iterator:
    import pyarrow as pa

    n = 0
    for lines in lines_of(part):
        if not counting:
            texts = [x.decode("utf-8", "replace") for x in lines]
            yield pa.RecordBatch.from_arrays([pa.array([part.number] * len(lines), pa.int64()), pa.array(range(n, n + len(lines)), pa.int64()), pa.array(texts, pa.string())], ["part", "line", "value"])
        n += len(lines)
    if counting:
        yield pa.RecordBatch.from_arrays([pa.array([part.number], pa.int64()), pa.array([n], pa.int64())], ["part", "lines"])


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}  # as Spark hands them on
        self.path, self.counting = options["path"], options.get("counting", "false") == "true"
        self.size = int(options.get("partbytes", 64 << 20))
        self.first, self.last = int(options.get("firstpart", 0)), int(options.get("lastpart", 1 << 62))

    def partitions(self) -> list[Part]:
        return [p for p in cut_files(files_of(self.path), self.size) if self.first <= p.number <= self.last]

    def read(self, partition: Part) -> Iterator:
        return batches(partition, self.counting) if partition else iter(())


class StreamReader(DataSourceStreamReader):
    """New files in order of names; the offset is how many files, and parts, came before. Files must not change, and later ones sort behind."""

    def __init__(self, options: dict):
        options = {k.lower(): v for k, v in options.items()}
        self.path, self.size = options["path"], int(options.get("partbytes", 64 << 20))

    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(files_of(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        files = files_of(self.path)
        before = len(cut_files(files[: start["files"]], self.size))
        return cut_files(files[start["files"] : end["files"]], self.size, before)

    def read(self, partition: Part) -> Iterator:
        return batches(partition, False)


class ObservationsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "observations"

    def schema(self) -> str:
        return COUNTS if self.options.get("counting", "false") == "true" else LINES

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(dict(self.options))


@dataclass(frozen=True)
class Header:
    """What the first line of a file declares; missing or unreadable numbers are 0."""

    num_data: int
    num_features: int
    num_classes: int


def header(path: str) -> Header:
    """The header of the first file at path."""
    import re

    system, inner = opened(files_of(path)[0][0])
    with system.open_input_file(inner) as f:
        text = f.read(4096).split(b"\n")[0].decode("utf-8", "replace")
    found = [re.match(r"\s*([+-]?[0-9]+)", x) for x in text.split(",")[:3]]
    return Header(*([int(m[1]) if m else 0 for m in found] + [0, 0, 0])[:3])


def part_starts(spark: SparkSession, path: str, part_bytes: int = 64 << 20) -> DataFrame:
    """part, lines and start: the row number of each part's first line. Parts are counted in parallel; the window runs over one row for each part."""
    spark.dataSource.register(ObservationsSource)
    counts = spark.read.format("observations").option("counting", "true").option("partBytes", part_bytes).load(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("lines").over(before), F.lit(0)))


def read_rows(spark: SparkSession, path: str, kind: str = "int", first: int = 0, last: int | None = None, part_bytes: int = 64 << 20, most_broadcast: int = 500_000) -> DataFrame:
    """row_id, features and label of the rows first to last (the end, if None), over all files at path in order of names.

    The header of the first file tells the width, its last value being the label; rows are parsed as ``parse_row`` tells, short ones
    have a null label. Parts outside the range are not read. The table of part starts is broadcast while it has at most ``most_broadcast`` parts.
    """
    declared = header(path)
    starts = cached_apart(part_starts(spark, path, part_bytes))
    inside = (F.col("start") + F.col("lines") > first) & (F.lit(last is None) | (F.col("start") <= (last if last is not None else 0)))
    low, high, n = starts.where(inside).agg(F.min("part"), F.max("part"), F.count(F.lit(1))).first()
    lines = spark.read.format("observations").option("partBytes", part_bytes).option("firstPart", low if n else 0).option("lastPart", high if n else -1).load(path)
    wanted = starts.where(inside).select("part", "start")
    rows = lines.join(F.broadcast(wanted) if n <= most_broadcast else wanted, "part")
    rows = rows.select((F.col("start") + F.col("line")).alias("row_id"), parse_row("value", declared.num_features, kind).alias("v"))
    rows = rows.where((F.col("row_id") >= first) & (F.lit(last is None) | (F.col("row_id") <= (last if last is not None else 0))))
    label = F.get("v", F.lit(declared.num_features - 1)).cast("int")
    return rows.select("row_id", F.slice("v", 1, max(declared.num_features - 1, 0)).alias("features"), label.alias("label"))


def stream_rows(spark: SparkSession, path: str, kind: str = "int", part_bytes: int = 64 << 20) -> DataFrame:
    """A stream of row_id, features and label over the files at path. row_id follows the order of parts and lines, with gaps between parts."""
    spark.dataSource.register(ObservationsSource)
    declared = header(path)
    lines = spark.readStream.format("observations").option("partBytes", part_bytes).load(path)
    rows = lines.select((F.col("part") * part_bytes + F.col("line")).alias("row_id"), parse_row("value", declared.num_features, kind).alias("v"))
    return rows.select("row_id", F.slice("v", 1, max(declared.num_features - 1, 0)).alias("features"), F.get("v", F.lit(declared.num_features - 1)).cast("int").alias("label"))


def write_rows(rows: DataFrame, path: str, num_classes: int, files: int = 8) -> None:
    """Write row_id, features and label as header CSV files below path, in order of row_id over the files in order of names.

    Each file's header declares the count of all rows. A null label is left out, so the line is short.
    """
    first = rows.agg(F.count(F.lit(1)), F.max(F.size("features"))).first()
    declared = f"{first[0]},{(first[1] or 0) + 1},{num_classes}"
    lines = rows.repartitionByRange(files, "row_id").sortWithinPartitions("row_id")
    lines = lines.select(F.concat_ws(",", F.col("features").cast("array<string>"), F.col("label").cast("string")).alias("value"))

    def headed(batches) -> Iterator:
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([declared])], ["value"])
        for b in batches:  # under one schema
            yield pa.RecordBatch.from_arrays([b.column(0)], ["value"])

    lines.mapInArrow(headed, "value string").write.mode("overwrite").text(path)
