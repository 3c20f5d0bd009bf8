"""Benchmark decontamination by templates.

Words are canonicalised: numbers, the units after them and names (capitalised inside a sentence) become typed
placeholders, so that a re-parameterised question keeps its windows of WINDOW words; a second, literal form without name
placeholders catches text whose case was changed. Windows of all documents pass a bitmap of the benchmark's windows
(BITMAP_BITS bits whatever the benchmark's size); what passes is joined to the benchmark's windows by hash. The windows of
one document and item at one relative position must fill their slots consistently: a benchmark value may stand for itself
and for one other value, the one that most windows give it (of equally many its own, then the least). Windows equal to the item's and windows
that fill every slot by that value agree. An item is leaked by a document if the windows that agree cover at least COVERAGE of the item.

Defined cases: null and empty texts match nothing; an item of fewer words than a window is one window of its own length,
found only verbatim, anywhere in a document; a window of placeholders alone tells nothing, so it is matched by its values; equal
items are one (the smallest item_id, null if none has one, with their number; items of null id with different texts are
different items); a document is a row, told from others of its doc_id by a hash of id and text, so null and repeated ids
don't mix; rows equal in both are one; repeated passages in a document count once; texts are taken whole, whatever their
length; columns besides id and text don't matter to `leaks` and pass through `drop_leaks`.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import kept, modest, row_key, slabs, small_side, tidied, without

WINDOW, COVERAGE = 5, 0.5
BITMAP_BITS = 1 << 24
CACHE_WORDS = 150_000
#: Windows of the benchmark and leaking rows that every task gets, if there are no more; otherwise the joins shuffle.
SENT_WINDOWS, SENT_ROWS = 200_000, 500_000
#: Units that may follow a number.
UNITS = frozenset("mm cm m km in ft mi mg g kg t lb lbs oz ml l gal s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years % percent usd eur gbp dollars dollar euros cents cent mph kmh hz khz mhz ghz v w kw mw j kj cal kcal pa kpa bar degrees".split())
_NUMBER = re.compile(r"[$€£]?\d+(?:[.,:/]\d+)*")
WORD, NUMBER, UNIT, NAME = range(4)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


class Tokens(dict):
    """Raw blank-separated tokens to places in arrays of their parts (hash, kind, value) and of their flags."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.counts: list[int] = []
        self.caps: list[bool] = []
        self.ends: list[bool] = []
        self.hashes: list[int] = []
        self.kinds: list[int] = []
        self.values: list[str] = []
        self.frozen = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, bool, np.uint64, np.int8, bool))

    def __missing__(self, raw: str) -> int:
        if raw.isalpha():  # most tokens: one word
            value = raw.lower()
            self.starts.append(len(self.hashes))
            self.counts.append(1)
            self.caps.append(len(raw) > 1 and raw[0].isupper() and raw[1:].islower())
            self.ends.append(False)
            self.hashes.append(xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")))
            self.kinds.append(WORD)
            self.values.append(value)
            self[raw] = at = len(self.starts) - 1
            return at
        core = _EDGE.sub("", raw) if not raw[:1].isalnum() or not raw[-1:].isalnum() else raw
        parts: list[tuple[int, str]] = []
        m = _NUMBER.match(core)
        if m:
            rest = core[m.end() :].strip("-").lower()
            parts = [(NUMBER, m[0])] + ([(UNIT if rest in UNITS else WORD, rest)] if rest else [])
            if raw.rstrip(".,;:!?)").endswith("%"):
                parts.append((UNIT, "%"))
        elif core:
            parts = [(WORD, core.lower())]
        self.starts.append(len(self.hashes))
        self.counts.append(len(parts))
        self.caps.append(len(core) > 1 and core[0].isupper() and core[1:].islower())
        self.ends.append(raw[-1:] in ".!?:" or raw[-2:-1] in ".!?")
        for kind, value in parts:
            self.hashes.append(xxhash.xxh3_64_intdigest(value.encode("utf-8", "surrogatepass")))
            self.kinds.append(kind)
            self.values.append(value)
        self[raw] = at = len(self.starts) - 1
        return at

    def arrays(self) -> tuple:
        """starts, counts, caps, ends of the tokens and hashes, kinds, units of the parts so far."""
        t, p = len(self.frozen[0]), len(self.frozen[4])
        if t < len(self.starts):
            new = (self.starts[t:], self.counts[t:], self.caps[t:], self.ends[t:], self.hashes[p:], self.kinds[p:], [v in UNITS for v in self.values[p:]])
            self.frozen = tuple(np.concatenate([x, np.array(y, x.dtype)]) for x, y in zip(self.frozen, new, strict=True))
        return self.frozen

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The places of all texts' tokens in a row, and how many each text has."""
        raw = [t.split() for t in texts]
        return np.fromiter(map(self.__getitem__, chain.from_iterable(raw)), np.int64, sum(map(len, raw))), np.array([len(r) for r in raw], np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    return x ^ (x >> np.uint64(29))


def _rolled(x: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width values."""
    total = np.zeros(max(len(x) - width + 1, 0), np.uint64)
    for i in range(width):
        total = _mixed(total + x[i : len(x) - width + 1 + i])
    return total ^ np.uint64(width)


def parts_of(at: np.ndarray, sizes: np.ndarray, tokens: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, value hashes and kinds of the parts of some texts' tokens (sizes: tokens of each), and where each text's parts end; names are capitalised words inside a sentence."""
    starts, counts, caps, ends, hashes, kinds, units = tokens.arrays()
    begins = (np.cumsum(sizes) - sizes)[sizes > 0]
    name = caps[at]
    name[1:] &= ~ends[at[:-1]]
    name[begins] = False
    n = counts[at]
    until = np.cumsum(n)
    first = np.repeat(starts[at] - (until - n), n)
    parts, name = first + np.arange(len(first)), np.repeat(name, n)
    stops = np.concatenate([[0], until])[np.cumsum(sizes)]
    kind = kinds[parts].copy()
    follows = np.zeros(len(parts), bool)
    follows[1:] = kind[:-1] == NUMBER
    follows[stops[stops < len(parts)]] = False  # the first part of a text follows none
    kind[follows & units[parts]] = UNIT
    kind[name & (kind == WORD)] = NAME
    return parts, hashes[parts], kind, stops


def windows(h: np.ndarray, kind: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the template windows and of the literal ones, by start: parts are told by their values, placeholders by
    their kind (in the literal form numbers alone are placeholders), but by their values where a window has no other part."""
    values, out = None, []
    for slot in (kind != WORD, kind == NUMBER):
        held = np.concatenate([[0], np.cumsum(slot)])
        alone = held[width:] - held[: len(h) - width + 1] == width if len(h) >= width else np.zeros(0, bool)
        hashes = _rolled(np.where(slot, kind.astype(np.uint64), h), width)
        if alone.any():
            values = _rolled(h, width) if values is None else values
            hashes = np.where(alone, values, hashes)
        out.append(hashes)
    return out[0], out[1]


def window_rows(df: DataFrame, bitmap: np.ndarray | None = None, widths: Sequence[int] = ()) -> DataFrame:
    """id, row, pos, hash, slots (value of each placeholder in the window), width, n_windows of the rows (id, row, text): of the
    given widths, those in the bitmap; without a bitmap all, of WINDOW parts or as many as there are."""
    sent = None if bitmap is None else df.sparkSession.sparkContext.broadcast(bitmap)
    schema = "id long, row long, pos int, hash long, slots array<string>, width int, n_windows int"
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int32())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bits = Tokens(), None if sent is None else sent.value
        for batch in tidied(batches):
            ids, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, j in slabs(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                if len(tokens) > CACHE_WORDS:
                    tokens = Tokens()
                at, sizes = tokens.places([t or "" for t in texts[i:j].to_pylist()])
                parts, hashes, kind, stops = parts_of(at, sizes, tokens)
                begins = np.concatenate([[0], stops[:-1]]).astype(np.int64)
                rows: list[tuple] = []
                for width in widths or range(1, WINDOW + 1):
                    # the windows that lie in one text, of the texts that have windows of this width
                    counts = np.maximum(stops - begins - width + 1, 0)
                    if bits is None:
                        counts[np.minimum(stops - begins, WINDOW) != width] = 0
                    owner = np.repeat(np.arange(len(counts)), counts)
                    pos = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
                    place = begins[owner] + pos
                    if not len(place):
                        continue
                    template, literal = windows(hashes, kind, width)
                    for h, family in ((template, True), (literal, False)):
                        keep = np.arange(len(place)) if family else np.flatnonzero(literal[place] != template[place])
                        own = h[place[keep]]
                        if bits is not None:
                            cell = own & np.uint64(BITMAP_BITS - 1)
                            hit = (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
                            keep, own = keep[hit], own[hit]
                        for d, p, q, x in zip(owner[keep].tolist(), pos[keep].tolist(), place[keep].tolist(), own.view(np.int64).tolist(), strict=True):
                            slots = [tokens.values[parts[k]].lower() for k in range(q, q + width) if (kind[k] != WORD if family else kind[k] == NUMBER)]
                            rows.append((ids[i + d], keys[i + d], p, x, slots, width, int(counts[d])))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["id", "row", "pos", "hash", "slots", "width", "n_windows"])

    return modest(df.select("id", "row", "text")).mapInArrow(task, schema)


def bitmap_of(items: DataFrame) -> np.ndarray:
    """A bit for each window hash: at most BITMAP_BITS bits in 4 KB rows come to the driver."""
    cell = F.expr(f"hash & {BITMAP_BITS - 1}L")
    packed = items.select((cell + 1).alias("cell")).groupBy(F.expr("bitmap_bucket_number(cell)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(cell))").alias("bits"))
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in packed.collect():
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(out) - at]
    return out


def agreeing(found: list[dict]) -> list[int]:
    """The places in the item of the windows (place, theirs, own) at one relative position that agree, each once."""
    votes = Counter(pair for w in found for pair in zip(w["theirs"], w["own"], strict=True))
    chosen: dict[str, tuple] = {}
    for (theirs, own), n in votes.items():
        chosen[theirs] = min(chosen.get(theirs, (0,)), (-n, own != theirs, own))
    return sorted({w["place"] for w in found if w["theirs"] == w["own"] or all(chosen[x][2] == y for x, y in zip(w["theirs"], w["own"], strict=True))})


def consistent(at: DataFrame) -> DataFrame:
    """id, row, item, total, places (of the windows that agree) of the rows (id, row, item, total, found)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            places = pa.array([agreeing(x.as_py()) for x in batch.column(4)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], places], names=["id", "row", "item", "total", "places"])

    return modest(at.select("id", "row", "item", "total", "found")).mapInArrow(task, "id long, row long, item long, total int, places array<int>")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """id, row (hash of id and text), item, n_items, matched, n_windows, coverage: documents that leak an item, a row for each such pair."""
    bench = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("id"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL")
    same = bench.groupBy("text").agg(F.min("id").alias("item"), F.count("*").alias("n_items"))
    same = kept(same.withColumn("id", F.monotonically_increasing_id()).withColumn("row", F.lit(0).cast("long")))
    items = kept(window_rows(same))
    short = [r["width"] for r in items.where(F.col("width") < WINDOW).select("width").distinct().collect()]  # fewer than WINDOW rows
    key = row_key(id_col, text_col).alias("row")
    own = window_rows(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), key, F.col(f"`{text_col}`").alias("text")), bitmap_of(items), [WINDOW, *sorted(short)])
    theirs = items.select(F.col("id").alias("item"), F.col("pos").alias("ipos"), F.col("hash").alias("ihash"), F.col("slots").alias("islots"), F.col("n_windows").alias("total"))
    verbatim = F.col("slots") == F.col("islots")
    both = own.join(small_side(theirs, items.count(), SENT_WINDOWS), (F.col("hash") == F.col("ihash")) & F.when(F.col("width") < WINDOW, verbatim).otherwise(F.size("slots") == F.size("islots")))
    window = F.struct(F.col("ipos").alias("place"), F.col("islots").alias("theirs"), F.col("slots").alias("own"))
    at = consistent(both.groupBy("id", "row", "item", (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.collect_set(window).alias("found"), F.max("total").alias("total")))
    found = at.groupBy("id", "row", "item").agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).alias("matched"), F.max("total").alias("n_windows"))
    found = found.withColumn("coverage", F.col("matched") / F.col("n_windows")).where(F.col("coverage") >= coverage)
    named = found.withColumnRenamed("item", "key").join(same.select(F.col("id").alias("key"), "item", "n_items"), "key")
    return named.select(F.col("id").alias(id_col), "row", F.col("item").alias(item_col), "n_items", "matched", "n_windows", "coverage")


def drop_leaks(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that leak nothing; texts stay where they are if the leaking rows are few enough to send."""
    gone = kept(found.select(F.col(f"`{id_col}`").alias("id"), "row").distinct())
    return without(df, gone, id_col, text_col, SENT_ROWS)
