"""Text files as tables: listings, byte ranges, charsets, quoted records that ranges may cut anywhere, loads that go on after a stop, an event log, and lines as a data source for batches and streams.

A file is read by ranges of RANGE_BYTES in tasks of their own, whatever its size. A range owns the record at the file's start and
the records behind each line end in it, so every record is read once, and the last one of a range is read on past its end.
Whether a line end stands within quotes depends on the number of quotes before it in the file: the ranges count theirs first.

Empty files have no records; a last line without a line end is one, and an empty line is an empty record. A record of more than
MAX_RECORD bytes (a quote that is never closed) fails the job with its file and place, instead of filling a task's memory.
Bytes that the charset can't decode become U+FFFD.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from factloom.session import checkpointed

RANGE_BYTES = 16 << 20
MAX_RECORD = 256 << 20
BLOCK = 1 << 20
HEAD_BYTES = 16 << 10
MOST_TASKS = 20_000
#: What a batch of records holds at most (the last one of it may be longer).
BATCH_ROWS, BATCH_BYTES = 1_000, 4 << 20
#: Byte order marks, the delimiters of tables, and where a log's values are cut.
MARKS = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be", b"\xef\xbb\xbf": "utf-8"}
DELIMITERS = (";", ",", "|", "\t")
LOG_CHARS = 4000
#: The ten most frequent letters of Russian, and the charsets in which their bytes are looked for.
FREQUENT, CYRILLIC = "оеаинтсрвл", ("windows-1251", "koi8-r", "cp866")
UNITS = {"utf-16-le": np.dtype("<u2"), "utf-16-be": np.dtype(">u2")}
COUNTS = ("quotes", "high", "beside", *(f"in_{c.replace('-', '_')}" for c in CYRILLIC))


def opened(path: str):
    """A file for reading at any place, on a local or shared file system or one that pyarrow knows by its scheme."""
    local = re.sub(r"^file:/+", "/", path)
    system, at = (arrow_fs.LocalFileSystem(), local) if "://" not in local else arrow_fs.FileSystem.from_uri(local)
    return system.open_input_file(at)


def walked(root: str) -> list[tuple[str, int]]:
    """Path and size of each file below root, but for names that begin with a dot or an underscore."""
    local = re.sub(r"^file:/+", "/", root)
    system, at = (arrow_fs.LocalFileSystem(), local) if "://" not in local else arrow_fs.FileSystem.from_uri(local)
    found = system.get_file_info(arrow_fs.FileSelector(at, recursive=True, allow_not_found=True))
    scheme = local.split("://")[0] + "://" if "://" in local else ""
    return sorted((scheme + f.path, f.size) for f in found if f.type == arrow_fs.FileType.File and f.base_name[:1] not in "._")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, size of the files below root, listed by Spark; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("size"))


def ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, start, end, size: files (path, size) in byte ranges, each in a task of its own up to MOST_TASKS. range_bytes is even, so that ranges don't cut the units of UTF-16."""
    step = range_bytes + range_bytes % 2
    cut = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(step).cast("long"))).alias("start"))
    return spread(checkpointed(cut.select("path", "start", F.least(F.col("start") + step, F.col("size")).alias("end"), "size")))


def spread(kept: DataFrame) -> DataFrame:
    """Rows of a small table, each of which is much work, over many tasks."""
    return kept.repartition(max(1, min(kept.count(), MOST_TASKS)), "path", "start")


def mark_of(f) -> tuple[str | None, int]:
    """The charset that a file's byte order mark names, and the mark's length."""
    head = f.read_at(min(3, f.size()), 0)
    return next(((charset, len(mark)) for mark, charset in MARKS.items() if head.startswith(mark)), (None, 0))


def valid_utf8(data: bytes) -> bool:
    """Whether data is UTF-8 but for what its two ends may have lost: up to three bytes of a character cut there."""
    inner = data[next((i for i, b in enumerate(data[:3]) if b & 0xC0 != 0x80), min(3, len(data))):]
    try:
        inner.decode()
    except UnicodeDecodeError as e:
        return e.reason == "unexpected end of data" and len(inner) - e.start <= 3
    return True


def counted(f, start: int, end: int) -> dict:
    """What a range tells of its file's charset, and how many quotes it has."""
    begin, (mark, _) = max(0, start - 3), mark_of(f)
    around = f.read_at(end + 3 - begin, begin)  # whether a byte is in place in UTF-8 shows within three bytes
    data = around[start - begin : end - begin]
    codes = np.frombuffer(data, UNITS.get(mark, np.uint8), len(data) // (2 if mark in UNITS else 1))
    per_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    high = np.frombuffer(around[max(0, start - begin - 1) : end - begin], np.uint8) >= 128  # and the byte before
    beside = int((high[1:] & high[:-1]).sum())
    own = {f"in_{c.replace('-', '_')}": int(per_byte[list(FREQUENT.encode(c))].sum()) for c in CYRILLIC}
    whole = valid_utf8(b" " * 3 * (begin == 0) + around + b" " * (end + 3 >= f.size()))  # what the file itself cuts is invalid
    return {"mark": mark, "utf8": whole, "quotes": int((codes == ord('"')).sum()), "high": int(per_byte[128:].sum()), "beside": beside, **own, "head": f.read_at(HEAD_BYTES, 0) if start == 0 else None}


def _profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        for r in rows.itertuples(index=False):
            with opened(r.path) as f:
                yield pd.DataFrame([{"path": r.path, "start": r.start, "end": r.end, "size": r.size, **counted(f, r.start, r.end)}])


def charset(total) -> Column:
    """The charset of a file by its ranges' counts, totalled by `total`: its mark's; UTF-8 if all of it is valid; otherwise Western where most high bytes
    stand alone, or the Cyrillic one in which most of them are frequent letters."""
    score = [total(F.sum(f"in_{c.replace('-', '_')}")) for c in CYRILLIC]
    best = F.greatest(*score)
    cyrillic = F.coalesce(*(F.when(s == best, F.lit(c)) for s, c in zip(score, CYRILLIC)))
    guess = F.when(total(F.min("utf8")), F.lit("utf-8")).when(total(F.sum("beside")) * 2 < total(F.sum("high")), F.lit("windows-1252")).otherwise(cyrillic)
    return F.coalesce(total(F.max("mark")), guess)


def profiled(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, start, end, size, charset, quoted (whether the range begins within quotes), head (of a file's first range): the ranges of files, each read once. A range of a file is one small row, so windows by file are bounded by its ranges."""
    schema = "path string, start long, end long, size long, mark string, utf8 boolean, " + ", ".join(f"{c} long" for c in COUNTS) + ", head binary"
    told = checkpointed(ranges(files, range_bytes).mapInPandas(_profiles, schema))
    whole = Window.partitionBy("path")
    before = whole.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    quoted = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1
    return told.select("path", "start", "end", "size", charset(lambda c: c.over(whole)).alias("charset"), quoted.alias("quoted"), "head")


def records(f, start: int, end: int, last: int, first: bool, quoted: bool | None, unit: np.dtype | None = None) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the records that the range start to end of a file owns, without line ends; the file counts up to `last`.
    first: whether the range begins with a record. quoted: whether it begins within quotes, or None where quotes mean nothing."""
    unit = unit or np.dtype(np.uint8)
    at, begun, inside = start, start if first else None, bool(quoted)
    held: list[bytes] = []
    size = 0
    while at < last and (at < end or begun is not None):
        data = f.read_at(min(BLOCK, (end if at < end else last) - at), at)
        codes = np.frombuffer(data, unit, len(data) // unit.itemsize)
        ends = codes == 10
        if quoted is not None:
            within = (np.cumsum(codes == ord('"'), dtype=np.uint8) & 1).astype(bool) ^ inside
            ends &= ~within
            inside = bool(within[-1]) if len(within) else inside
        cut = 0
        for e in (np.flatnonzero(ends) * unit.itemsize).tolist():
            if begun is not None:
                yield begun, b"".join(held) + data[cut:e]
            held, size, cut = [], 0, e + unit.itemsize
            begun = at + cut if at < end else None
            if begun is None:
                return
        if begun is not None:
            held.append(data[cut:])
            size += len(data) - cut
            if size > MAX_RECORD:
                raise ValueError(f"the record at byte {begun} has over {MAX_RECORD} bytes: is a quote left open?")
        at += len(data)
    if begun is not None and begun < last:
        yield begun, b"".join(held)


def _delimiter(head: bytes, name: str) -> str:
    """The delimiter by which a file's first records have most cells, where all have alike; or the one that stands in it most; or a comma."""
    head = head[:-1] if name in UNITS and len(head) % 2 else head
    every = head.decode(name, errors="replace").lstrip("\ufeff")
    text, broken = every[:4096], len(every) > 4096 or len(head) >= HEAD_BYTES
    quoted = np.cumsum([c == '"' for c in text], dtype=np.int64) % 2
    bare = "".join(c if not q else "_" for c, q in zip(text, quoted.tolist()))
    lines = [x for x in bare.split("\n") if x.strip()]
    lines = lines[:-1] if len(lines) > 1 and broken else lines
    each = {d: {x.count(d) for x in lines} for d in DELIMITERS}
    alike = {d: max(n) for d, n in each.items() if len(n) == 1 and max(n) > 0}
    found = alike or {d: bare.count(d) for d in (",", ";", "|", "\t")}
    return max(found, key=found.get)


def _owned(r, quotes: bool) -> Iterator[tuple[int, str]]:
    with opened(r.path) as f:
        _, mark = mark_of(f)
        for at, data in records(f, r.start, r.end, r.size, r.start == 0, r.quoted if quotes else None, UNITS.get(r.charset)):
            text = (data[mark:] if at == 0 else data).decode(r.charset, errors="replace")
            yield at, text.removesuffix("\r")


def _batches(rows: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pd.DataFrame(held, columns=columns)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns)


def read_lines(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, at (byte offset), line of the text files (path, size), decoded by their own charsets."""

    def lines(batches):
        rows = ((r.path, at, text) for b in batches for r in b.itertuples(index=False) for at, text in _owned(r, False))
        yield from _batches(rows, ["path", "at", "line"])

    return spread(checkpointed(profiled(files, range_bytes).drop("head"))).mapInPandas(lines, "path string, at long, line string")


def read_csv(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """path, at (byte offset), record, cells of the tables (path, size): each by its own charset and delimiter. Quotes stand about whole fields and are doubled within; quoted fields may hold delimiters and line ends. Empty lines have no cells."""

    def cells(batches):
        csv.field_size_limit(MAX_RECORD)

        def rows():
            for b in batches:
                for r in b.itertuples(index=False):
                    for at, text in _owned(r, True):
                        yield r.path, at, text, next(csv.reader(io.StringIO(text, newline=""), delimiter=r.delimiter), [])

        yield from _batches(rows(), ["path", "at", "record", "cells"])

    @F.pandas_udf("string")
    def delimiter(head: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([_delimiter(h, c) for h, c in zip(head, name)])

    told = profiled(files, range_bytes)
    heads = told.where("start = 0").select("path", delimiter("head", "charset").alias("delimiter"))
    return spread(checkpointed(told.drop("head").join(heads, "path"))).mapInPandas(cells, "path string, at long, record string, cells array<string>")


def location(path: Column) -> Column:
    """The folder of a file, `name=value` folders by their value; null for the one that stands for null."""
    folder = F.regexp_extract(path, r"/(?:[^/=]+=)?([^/]*)/[^/]*$", 1)
    return F.when(folder != "__HIVE_DEFAULT_PARTITION__", F.try_url_decode(F.replace(folder, F.lit("+"), F.lit("%2B"))))


class Load:
    """A load of the files below a root that can stop anywhere: each run takes the files that the log hasn't got, writes their lines as a part of
    its own, then logs them. A part that was written but not logged is written again; readers see logged parts only."""

    def __init__(self, spark: SparkSession, root: str, store: str):
        self.spark, self.root, self.store = spark, root, store.rstrip("/")

    def log(self) -> DataFrame:
        """path, status, run."""
        return self.spark.read.schema("path string, status string, run int").parquet(f"{self.store}/log") if self._begun() else self.spark.createDataFrame([], "path string, status string, run int")

    def _begun(self) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.store}/log")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def run(self, range_bytes: int = RANGE_BYTES) -> int:
        """The number of files loaded."""
        log = self.log()
        number = (log.agg(F.max("run")).first()[0] if self._begun() else None)
        number = 0 if number is None else number + 1
        todo = checkpointed(listing(self.spark, self.root).join(log.where("status = 'uploaded'"), "path", "left_anti"))
        count = todo.count()
        if count:
            lines = read_lines(todo, range_bytes).select("path", "at", "line", location(F.col("path")).alias("source_location"))
            lines.write.mode("overwrite").parquet(f"{self.store}/lines/run={number}")
            todo.select("path", F.lit("uploaded").alias("status")).write.mode("overwrite").parquet(f"{self.store}/log/run={number}")
        return count

    def lines(self) -> DataFrame:
        """path, at, line, source_location, run of what was logged."""
        runs = [r["run"] for r in self.log().select("run").distinct().collect()]  # one row a run
        schema = "path string, at long, line string, source_location string, run int"
        return self.spark.read.schema(schema).parquet(f"{self.store}/lines").where(F.col("run").isin(runs)) if runs else self.spark.createDataFrame([], schema)


def clipped(value: Column) -> Column:
    """A log's value, cut at LOG_CHARS with a note of how much is left out."""
    rest = F.concat(F.substring(value, 1, LOG_CHARS), F.lit("\n… (+"), (F.char_length(value) - LOG_CHARS).cast("string"), F.lit(" симв.)"))
    return F.when(F.char_length(value) > LOG_CHARS, rest).otherwise(value)


def append_log(entries: DataFrame, path: str) -> None:
    """Entries appended to an event log as JSON lines; their texts are clipped."""
    cut = [clipped(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in entries.dtypes]
    entries.select(*cut).write.mode("append").option("ignoreNullFields", False).json(path)


def parsed_log(lines: DataFrame, schema: str) -> DataFrame:
    """The columns of schema from JSON lines (path, at, line), and `corrupt`: a line that isn't such an entry, which has no other columns."""
    got = F.from_json("line", f"{schema}, corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    entry = lines.where("trim(line) <> ''").select("path", "at", got.alias("entry")).select("path", "at", "entry.*")
    return entry.select("path", "at", *(F.when(F.col("corrupt").isNull(), F.col(c)).alias(c) for c in entry.columns[2:-1]), "corrupt")


class TextLines(DataSource):
    """path, at (byte offset), line of the text files below `path`, in UTF-8, by files and byte ranges of `rangeBytes`. As a stream it gives the lines
    that were appended, whole ones only; its offset holds one number for each file, so a log should be few files that grow."""

    @classmethod
    def name(cls) -> str:
        return "text_lines"

    def schema(self) -> str:
        return "path string, at long, line string"

    def reader(self, schema) -> DataSourceReader:
        return LinesReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return AppendedLines(self.options)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, last: int, first: bool):
        self.path, self.start, self.end, self.last, self.first = path, start, end, last, first


def cut(path: str, begin: int, last: int, step: int) -> list[Range]:
    return [Range(path, at, min(at + step, last), last, at == begin) for at in range(begin, last, step)]


def lines_of(part: Range) -> Iterator[tuple[str, int, str]]:
    with opened(part.path) as f:
        for at, data in records(f, part.start, part.end, part.last, part.first, None):
            yield part.path, at, data.removeprefix(b"\xef\xbb\xbf" if at == 0 else b"").decode("utf-8", "replace").removesuffix("\r")


class LinesReader(DataSourceReader):
    def __init__(self, options):
        self.root, self.step = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        return [p for path, size in walked(self.root) for p in cut(path, 0, size, self.step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_of(partition)


class AppendedLines(DataSourceStreamReader):
    def __init__(self, options):
        self.root, self.step = options["path"], int(options.get("rangeBytes", RANGE_BYTES))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {path: end for path, size in walked(self.root) if (end := self.whole(path, size))}

    @staticmethod
    def whole(path: str, size: int) -> int:
        """The length of a file up to its last line end."""
        with opened(path) as f:
            while size:
                data = f.read_at(min(BLOCK, size), max(0, size - BLOCK))
                if (e := data.rfind(b"\n")) >= 0:
                    return max(0, size - BLOCK) + e + 1
                size = max(0, size - BLOCK)
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [p for path, last in sorted(end.items()) for p in cut(path, start.get(path, 0), last, self.step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return lines_of(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept for offsets that are done."""

    def stop(self) -> None:
        """Nothing is open."""
