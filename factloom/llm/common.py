"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of text that a Python task handles at a time.
SLAB_CHARS = 1 << 20
#: The run that tables kept now belong to.
_run: ContextVar[Run | None] = ContextVar("run", default=None)
#: Rows and bytes of an Arrow batch, whichever is reached first.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="factloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return at if "://" in at else f"file://{at}"


class Run:
    """The tables that operators keep inside `with run:`. They are the run's own: `clear` removes them and no others, to be
    called when the results made of them have been written. What is kept outside any run stays."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables, self._before = spark, [], []

    def __enter__(self) -> Run:
        self._before.append(_run.set(self))
        return self

    def __exit__(self, *_: object) -> None:
        _run.reset(self._before.pop())

    def clear(self) -> None:
        while self.tables:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.tables.pop())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for what an operator keeps while its result is in use; it belongs to the run that is open, if any."""
    at = new_folder(spark, name)
    if run := _run.get():
        run.tables.append(at)
    return at


def kept(df: DataFrame, name: str = "kept") -> DataFrame:
    """The same rows, written as a table to the shared folder and read from there: computed once, and lost executors cost nothing."""
    at = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, everything else untouched."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def modest(df: DataFrame) -> DataFrame:
    """df, for a Python task over whole texts: its session sends BATCH_ROWS rows or BATCH_BYTES at a time, so that batches of
    long texts stay small. Both settings are read when the plan runs, so they stay with the session."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def tidied(batches: Iterator[pa.RecordBatch], end: Callable[[], None] | None = None) -> Iterator[pa.RecordBatch]:
    """The batches of a Python task; when it ends, `end` is called and freed memory goes back to the system, for Spark keeps its Python workers."""
    try:
        yield from batches
    finally:
        if end:
            end()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not this C library
            pass


class Places(dict[str, int]):
    """The places of words; one that isn't there gets the next place and is noted as new."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        place = self[word] = len(self)
        return place


class WordCache:
    """The ids of words met before: the place of each word, and at each place where its ids start in `flat` and how many there are."""

    #: Words after which a cache becomes the old one, which keeps those that come again.
    most = 60_000

    def fresh(self) -> None:
        self.words = Places()
        self.starts, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def keep(self, words: list[str], counts: np.ndarray, flat: np.ndarray) -> None:
        self.words.update(zip(words, range(len(self.starts), len(self.starts) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, flat.astype(np.int32)])

    def ids_at(self, places: np.ndarray) -> np.ndarray:
        counts = self.counts[places]
        first = np.repeat(self.starts[places] - (np.cumsum(counts) - counts), counts)
        return self.flat[first + np.arange(len(first))]

    def learn(self, words: list[str]) -> None:
        raise NotImplementedError

    def meet(self, seen: set[str]) -> None:
        """Makes sure that the words are in the cache; when it is full, of the others only those stay that are here again."""
        if len(self.words) > self.most:
            old, counts = self.words, self.counts
            again = list(seen.intersection(old))
            at = np.fromiter(map(old.__getitem__, again), np.int64, len(again))
            ids = self.ids_at(at)
            self.fresh()
            self.keep(again, counts[at], ids)
        new = seen.difference(self.words)
        if new:
            self.learn(list(new))

    def places(self, cut: list[list[str]]) -> np.ndarray:
        """The places of all words in a row; a full cache begins anew."""
        if len(self.words) > self.most:
            self.fresh()
        known = len(self.words)
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cut)), np.int64)
        if new := self.words.new:
            self.words.new = []
            self.learn(new)
            places = np.fromiter(map(self.words.__getitem__, new), np.int64, len(new))
            met = at >= known
            at[met] = places[at[met] - known]
        return at


def slabs(sizes: list[int], limit: int = SLAB_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch whose texts sum to about limit characters; a longer text is a range of its own."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def small_side(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are at most `most`; otherwise as it is, for a shuffle join."""
    return F.broadcast(df) if rows <= most else df


def others(df: DataFrame, *out: str) -> tuple[list[Column], list[T.StructField]]:
    """df's columns and their fields, without those whose names new columns take."""
    taken = {c.lower() for c in out}
    fields = [f for f in df.schema.fields if f.name.lower() not in taken]
    return [F.col(f"`{f.name}`") for f in fields], fields


def unused(df: DataFrame, name: str) -> str:
    """A name like `name` that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def row_key(id_col: str, text_col: str) -> Column:
    """A hash of id and text, which tells rows of one id (null among them) apart."""
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def without(df: DataFrame, gone: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """The rows of df whose id and row_key aren't those of `gone` (id, row; checkpointed, distinct); df stays where it is if
    gone has no more than `most` rows."""
    gid, grow = unused(df, "gone_id"), unused(df, "gone_row")
    side = small_side(gone.select(F.col("id").alias(gid), F.col("row").alias(grow)), gone.count(), most)
    return df.join(side, (row_key(id_col, text_col) == F.col(grow)) & F.col(f"`{id_col}`").eqNullSafe(F.col(gid)), "left_anti")
