"""Importance resampling towards a target: documents whose words look like the target's are drawn more often.

Features are the runs of 1 to 3 words, in hashed buckets. The corpus and the target count all their features; a bucket's
gain is the log of how much likelier the target makes it, in thousandths. The gains are one array of BUCKETS numbers, by
which each document's features are scored at once; Gumbel noise of its id makes the highest scores a draw without
replacement by weight.

The draw is cut exactly without sorting all scores: each partition gives the median of its candidates, the driver takes
the median of these weighted by their partitions' sizes, at least a quarter of the candidates stand on either side of it,
and counting them tells which side holds the cutoff. That goes on until a few are left, whose keys are looked at. The
winners alone are sorted, in ranges, for their ranks.

A run's CRC comes from its words': CRC is linear, so the CRC of a run is that of its beginning, moved on by the length of
its last word, xor the last word's own.

Defined cases: null text is no words, weight 0; documents of fewer than MIN_WORDS words are scored and never drawn; null
ids hash as the empty string and come last among equal scores, and rows of one id and score are told apart by their number
of features, of rows equal in all any are drawn; texts are taken whole; an empty table gives an empty one; an empty
target counts none of its features; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import kept, modest, row_key, slabs, tidied, unused
from factloom.llm.crc import moved

BUCKETS, MAX_WORDS, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Fixed value: what counts as part of a word, in UTF-8 and A-Z being lower-cased before.
WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Candidates of which the keys are looked at, and rows of a range of winners.
FEW, RANGE_ROWS = 1000, 500_000
#: Distinct words whose CRCs a task keeps.
CACHE_WORDS = 200_000


class Words(dict[bytes, int]):
    """Distinct words of a task by place, and by place the CRC with a blank before it, the CRC alone, and the length in bytes."""

    def __init__(self) -> None:
        self.fresh()

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        place = self[word] = len(self)
        return place

    def fresh(self) -> None:
        self.clear()
        self.new: list[bytes] = []
        self.alone, self.spaced, self.size = (np.zeros(0, t) for t in (np.uint32, np.uint32, np.int64))

    def places(self, cut: list[list[bytes]]) -> np.ndarray:
        """The places of all words in a row."""
        if len(self) > CACHE_WORDS:
            self.fresh()
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(cut)), np.int64)
        new, self.new = self.new, []
        add = lambda old, xs: np.concatenate([old, np.fromiter(xs, old.dtype, len(new))])
        self.alone = add(self.alone, map(zlib.crc32, new))
        self.spaced = add(self.spaced, (zlib.crc32(b" " + w) for w in new))
        self.size = add(self.size, map(len, new))
        return at

    def features(self, texts: list[bytes], buckets: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all features of the texts, the text of each, and how many words each text has."""
        cut = [WORD.findall(t.lower()) for t in texts]
        counts, at = np.array([len(c) for c in cut], np.int64), self.places(cut)
        text = np.repeat(np.arange(len(texts)), counts)
        crc, last = self.alone[at], np.arange(len(at))
        out, whose = [crc % np.uint32(buckets)], [text]
        for _ in range(most - 1):
            last = last + 1
            ok = np.flatnonzero(last < len(at))
            ok = ok[text[last[ok]] == whose[-1][ok]]
            last, crc = last[ok], crc[ok]
            crc = moved(crc, self.size[at[last]] + 1) ^ self.spaced[at[last]]
            out.append(crc % np.uint32(buckets))
            whose.append(text[last])
        return np.concatenate(out), np.concatenate(whose), counts


def totals(df: DataFrame, text: str = "text", buckets: int = BUCKETS, most: int = MAX_WORDS) -> np.ndarray:
    """How many features of all texts are in each bucket. Tasks add theirs up, so at most `buckets` rows of each shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            words, n = Words(), np.zeros(buckets, np.int64)
            for batch in batches:
                texts = batch.column(0).cast(pa.binary())
                for i, j in slabs(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                    n += np.bincount(words.features([t or b"" for t in texts[i:j].to_pylist()], buckets, most)[0], minlength=buckets)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], names=["bucket", "n"])

        yield from tidied(counted())

    parts = modest(df.select(F.col(f"`{text}`").alias("text"))).mapInArrow(task, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of how much likelier the target makes each bucket than the corpus, one added to each count; floors go down."""
    n, a, b = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (a + n) / ((s + 1.0) * (b + n)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(df: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text: str = "text", most: int = MAX_WORDS) -> DataFrame:
    """id, row (a hash of id and text), n_words, n_features and weight of each document."""
    buckets = len(gain)
    sent = df.sparkSession.sparkContext.broadcast(gain)  # one array of `buckets` numbers

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, words = sent.value, Words()
        for batch in tidied(batches, words.fresh):
            texts = batch.column(2).cast(pa.binary())
            for i, j in slabs(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                found, whose, counts = words.features([t or b"" for t in texts[i:j].to_pylist()], buckets, most)
                order = np.argsort(whose, kind="stable")
                ends = np.cumsum(np.bincount(whose, minlength=j - i))
                sums = np.concatenate([[0], np.cumsum(gain[found[order]])])
                weight = sums[ends] - sums[np.concatenate([[0], ends[:-1]])]
                features = np.diff(ends, prepend=0)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(1)[i:j], *(pa.array(x, pa.int64()) for x in (counts, features, weight))], names=["id", "row", "n_words", "n_features", "weight"])

    rows = modest(df.select(F.col(f"`{id_col}`").alias("id"), row_key(id_col, text).alias("row"), F.col(f"`{text}`").alias("text")))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(task, f"id {kind}, row long, n_words long, n_features long, weight long")


def noisy(weight: Column, id_: Column, seed: int = SEED) -> Column:
    """weight with Gumbel noise in thousandths, from the first 32 bits of a SHA-256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


#: The order of the draw: higher scores, smaller ids (null last), then what tells rows of one id apart.
ORDER = [("score", "descending"), ("id", "ascending"), ("n_features", "ascending"), ("number", "ascending")]


def place(r: dict) -> tuple:
    """A key's place in the order of the draw."""
    return -r["score"], r["id"] is None, 0 if r["id"] is None else r["id"], r["n_features"], r["number"]


def before(key: dict, or_at: bool = False) -> Column:
    """Whether a row's key comes before a given one (or is it)."""
    same_id = F.col("id").eqNullSafe(F.lit(key["id"]))
    less_id = F.col("id").isNotNull() if key["id"] is None else F.coalesce(F.col("id") < F.lit(key["id"]), F.lit(False))
    number = F.col("number") <= key["number"] if or_at else F.col("number") < key["number"]
    tie = (F.col("n_features") < key["n_features"]) | ((F.col("n_features") == key["n_features"]) & number)
    return (F.col("score") > key["score"]) | ((F.col("score") == key["score"]) & ((less_id & ~same_id) | (same_id & tie)))


def medians(candidates: DataFrame) -> list[dict]:
    """The median key of each partition's candidates, and their number: one row a partition, whatever its size."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = [b for b in batches if b.num_rows]
        if keys:
            t = pa.Table.from_batches(keys)
            order = pc.sort_indices(t, sort_keys=ORDER, null_placement="at_end")
            middle = t.take(order[(t.num_rows - 1) // 2 : (t.num_rows - 1) // 2 + 1])
            yield from middle.append_column("size", pa.array([t.num_rows], pa.int64())).to_batches()

    kind = candidates.schema["id"].dataType.simpleString()
    return [r.asDict() for r in candidates.select("score", "id", "n_features", "number").mapInArrow(task, f"score long, id {kind}, n_features long, number long, size long").collect()]


def cutoff(rows: DataFrame, k: int, few: int = FEW) -> dict | None:
    """The key of the k-th of rows (score, id, n_features, number) in the order of the draw; None if k is 0.

    In each round the weighted median of the partitions' medians leaves at least a quarter of the candidates on either
    side. Candidates are written anew when less than a quarter of those last written are left, so all rounds together read
    little more than the first ones.
    """
    if k <= 0:
        return None
    candidates = rows
    found = medians(candidates)
    n = written = sum(r["size"] for r in found)
    while n > few:
        found.sort(key=place)
        total, half = 0, n / 2
        for pivot in found:
            total += pivot["size"]
            if total >= half:
                break
        upto = candidates.where(before(pivot, or_at=True)).count()
        if upto >= k:
            candidates, n = candidates.where(before(pivot, or_at=True)), upto
        else:
            candidates, n, k = candidates.where(~before(pivot, or_at=True)), n - upto, k - upto
        if 4 * n < written:
            candidates, written = kept(candidates), n
        found = medians(candidates)
    return sorted((r.asDict() for r in candidates.collect()), key=place)[k - 1]


def ranked(winners: DataFrame) -> DataFrame:
    """winners with `rank`, 1, 2, 3... in the order of the draw: sorted in ranges, whose sizes tell where each begins."""
    spark = winners.sparkSession
    n = max(-(-winners.count() // RANGE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("number")]
    ranges = kept(winners.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "winners")
    starts, at = [], 0
    for r in sorted(ranges.groupBy("part").count().collect()):  # one row a range
        starts.append((r["part"], at))
        at += r["count"]
    first = F.create_map(*(F.lit(x) for s in starts for x in s)) if starts else F.lit(None).cast("map<int,bigint>")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranges.withColumn("rank", (inside + first[F.col("part")]).cast("long")).drop("part")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS, most: int = MAX_WORDS, seed: int = SEED, few: int = FEW) -> DataFrame:
    """One row for each of docs: id_col, row (a hash of id and text), n_words, n_features, weight, score, and the rank of those drawn:
    percent / 100 of the documents with at least min_words words, rounded down."""
    gain = gains(totals(docs, text, buckets, most), totals(target, text, buckets, most))
    rows = weighed(docs, gain, id_col, text, most).withColumn("score", noisy(F.col("weight"), F.col("id"), seed))
    rows = kept(rows.withColumn("number", F.monotonically_increasing_id()), "weighed")
    able = F.col("n_words") >= min_words
    last = cutoff(rows.where(able).select("score", "id", "n_features", "number"), percent * rows.where(able).count() // 100, few)
    none = F.lit(None).cast("long").alias("rank")
    if last is None:
        out = rows.select("*", none)
    else:
        won = able & before(last, or_at=True)
        out = rows.where(~won).select("*", none).unionByName(ranked(rows.where(won)))
    return out.select(F.col("id").alias(id_col), *(c for c in ("row", "n_words", "n_features", "weight", "score", "rank")))


def drawn(docs: DataFrame, sampled: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The drawn documents, with all their columns: of rows equal in id and text as many as were drawn."""
    gid, grow, times, copy = (unused(docs, c) for c in ("drawn_id", "drawn_row", "drawn_times", "drawn_copy"))
    won = sampled.where(F.col("rank").isNotNull()).groupBy(F.col(f"`{id_col}`").alias(gid), F.col("row").alias(grow)).agg(F.count("*").alias(times))
    met = docs.join(won, (row_key(id_col, text) == F.col(grow)) & F.col(f"`{id_col}`").eqNullSafe(F.col(gid)))
    return met.withColumn(copy, F.row_number().over(Window.partitionBy(gid, grow).orderBy(F.lit(0)))).where(F.col(copy) <= F.col(times)).select(*(F.col(f"`{c}`") for c in docs.columns))
