"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are compared as lower-cased words. Two lines of at least MIN_WORDS words are alike if one word inserted, deleted
or replaced makes one the other (so at most a fifth of a line differs); shorter ones if they are equal. In corpus order, by
(id, line number), a line is dropped if one alike that stays stands earlier; the row names the earliest such line. So what
a dropped line says is never more than one edit from a line that stays, however long a chain of edits is.

One edit leaves the first or the second half of a line as it is, so only lines that share a half with another line emit
their neighbourhood: the line itself and, for each word, the line without it, as 128-bit hashes. Lines with the same word
missing at the same place differ by a replacement; a line without a word and a line that is
that, by an insertion. So the join needs the earliest member of each variant alone, never pairs of members: groups of
any size are summed up map-side. Round by round, lines that are the earliest undecided in all their variants stay, and
what shares a variant with them goes; few lines are left after the first round. What ROUNDS of them leave are chains of decisions:
each component of at most FINISH_ROWS memberships is decided in one task, line by line in their order, and a larger one goes on in rounds. The edit distance of each dropped line and the line it names is verified on the words.

Defined cases: lines without words stay; null texts have no lines; lines of identical rows (same id and text) stand at
the same place, so neither is earlier; null ids come first; a text is split at \\n only and kept apart from that; columns of df
besides id and text pass through `drop_lines`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import kept, modest, row_key, slabs, small_side, tidied, unused
from factloom.llm.minhash import components

MIN_WORDS = 5
#: Rows of hashes that are sent to every task, if there are no more; otherwise the join shuffles.
SENT_ROWS = 500_000
#: Rounds over all lines before components are finished by themselves, and the memberships in groups of lines alike of a component that one task takes.
ROUNDS, FINISH_ROWS = 6, 500_000
#: Odd multipliers and seeds of the two halves of a variant's hash.
_BASES = ((0xD6E8FEB86659FD93, 0x1234567), (0xA0761D6478BD642F, 0x89ABCDEF))


def _joined(words: list[str]) -> bytes:
    return " ".join(words).encode("utf-8", "surrogatepass")


def half_keys(words: list[str]) -> list[int]:
    """Hashes of the line's first and second half: as the longer and as the shorter (or equal) line of a pair.

    A half of one word less is the same half or the other one's, so three joined parts serve for the four.
    """
    n, half = len(words), len(words) // 2
    head, tail = _joined(words[:half]), _joined(words[half:])
    shorter = (head, _joined(words[half + 1 :])) if n % 2 else (_joined(words[: half - 1]), tail)
    parts = (head, tail, *shorter)
    return [xxhash.xxh3_64_intdigest(p, seed=2 * (n - k // 2) + k % 2) - (1 << 63) for k, p in enumerate(parts)]


def occurrences(docs: DataFrame) -> DataFrame:
    """id, row (hash of id and text), line, cid (128-bit hash of the words), halves of every line with words."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            ids, rows, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, j in slabs(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                out: tuple[list, ...] = ([], [], [], [], [])
                for doc, row, text in zip(ids[i:j], rows[i:j], texts[i:j].to_pylist(), strict=True):
                    for n, line in enumerate((text or "").split("\n")):
                        if words := line.lower().split():
                            for column, x in zip(out, (doc, row, n, xxhash.xxh3_128_digest(_joined(words)), half_keys(words) if len(words) >= MIN_WORDS else None), strict=True):
                                column.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["id", "row", "line", "cid", "halves"])

    return modest(docs.select("id", "row", "text")).mapInArrow(task, "id long, row long, line int, cid binary, halves array<long>")


def variant_hashes(words: list[str]) -> np.ndarray:
    """(words + 1, 2) longs: a 128-bit hash of the line, then of the line without each word. Linear in the line: the hash is
    a polynomial of the words' hashes, so leaving a word out takes what is before it and what is after it, one power down."""
    first = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    out = np.empty((len(words) + 1, 2), np.uint64)
    for column, (base, seed) in enumerate(_BASES):
        h = (first ^ np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        power = np.full(len(words), base, np.uint64)
        power[0] = 1
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * np.multiply.accumulate(power), dtype=np.uint64)])
        out[0, column] = sums[-1]
        out[1:, column] = sums[:-1] + np.uint64(pow(base, -1, 1 << 64)) * (sums[-1] - sums[1:])
    out[0] += np.uint64(len(words))
    out[1:] += np.uint64(len(words) - 1)
    return out.view(np.int64)


def neighbourhoods(lines: DataFrame) -> DataFrame:
    """va, vb (a 128-bit hash), place (of the missing word; -1: none is), rank of the lines (rank, text)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidied(batches):
            for i, j in slabs(pc.utf8_length(batch.column(1)).to_pylist(), 1 << 18):
                hashes = [variant_hashes(text.lower().split()) for text in batch.column(1)[i:j].to_pylist()]
                sizes = [len(h) for h in hashes]
                both = np.concatenate(hashes)
                places = np.concatenate([np.arange(-1, n - 1, dtype=np.int32) for n in sizes])
                ranks = np.repeat(batch.column(0)[i:j].to_numpy(), sizes)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(places), pa.array(ranks)], names=["va", "vb", "place", "rank"])

    return modest(lines.select("rank", "text")).mapInArrow(task, "va long, vb long, place int, rank long")


def one_edit(pairs: DataFrame) -> DataFrame:
    """Those of the pairs (with words_a, words_b) whose word edit distance is at most one: what remains between their common prefix and suffix."""
    a, b = F.col("words_a"), F.col("words_b")
    def same(x: Column, y: Column) -> Column:
        """How many words the two lines share from the start."""
        first = F.array_position(F.zip_with(x, y, lambda u, v: u.eqNullSafe(v)), False)
        return F.when(first == 0, F.size(x)).otherwise(first - 1)

    same_head, same_tail = same(a, b), same(F.reverse(a), F.reverse(b))
    return pairs.where((F.abs(F.size(a) - F.size(b)) <= 1) & (same_head + same_tail >= F.greatest(F.size(a), F.size(b)) - 1))


def decide(rows: pd.DataFrame) -> pd.DataFrame:
    """rank, stays of the lines of a component: in their order, a line stays unless one alike stays before it. rows: rank and a group of lines alike (ga, gb), or a line one word shorter (ga, where gb is -1)."""
    swapped, longer = rows[rows["gb"] >= 0], rows[rows["gb"] < 0]
    ranks = np.unique(np.concatenate([rows["rank"].to_numpy(), longer["ga"].to_numpy()]))
    groups: list[list[int]] = [[] for _ in ranks]
    beside: list[list[int]] = [[] for _ in ranks]
    numbers = swapped.groupby(["ga", "gb"]).ngroup().to_numpy()
    for at, group in zip(np.searchsorted(ranks, swapped["rank"].to_numpy()).tolist(), numbers.tolist(), strict=True):
        groups[at].append(group)
    for at, whole in zip(np.searchsorted(ranks, longer["rank"].to_numpy()).tolist(), np.searchsorted(ranks, longer["ga"].to_numpy()).tolist(), strict=True):
        beside[at].append(whole)
        beside[whole].append(at)
    taken, gone = set(), np.zeros(len(ranks), bool)
    for at in range(len(ranks)):
        if gone[at] or not taken.isdisjoint(groups[at]):
            gone[at] = True
            continue
        taken.update(groups[at])
        gone[[x for x in beside[at] if x > at]] = True
    return pd.DataFrame({"rank": ranks, "stays": ~gone})


def finished(swapped: DataFrame, longer: DataFrame, sent_rows: int, finish_rows: int) -> DataFrame:
    """rank, stays of the undecided lines (swapped: ga, gb, rank; longer: rank, whole) whose component has at most finish_rows memberships."""
    first = swapped.groupBy("ga", "gb").agg(F.min("rank").alias("early"))
    edges = swapped.join(first, ["ga", "gb"]).select(F.col("rank").alias("a"), F.col("early").alias("b")).unionByName(longer.select(F.col("rank").alias("a"), F.col("whole").alias("b")))
    labels = components(edges, sent_rows).withColumnRenamed("node", "rank")
    rows = swapped.select("rank", "ga", F.col("gb").cast("long").alias("gb")).unionByName(longer.select("rank", F.col("whole").alias("ga"), F.lit(-1).cast("long").alias("gb")))
    rows = kept(rows.join(labels, "rank", "left").withColumn("label", F.coalesce("label", "rank")))
    small = rows.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") <= finish_rows).select("label")
    return kept(rows.join(small, "label").groupBy("label").applyInPandas(decide, "rank long, stays boolean"))


def undecided(swapped: DataFrame, longer: DataFrame, now: DataFrame, sent_rows: int) -> tuple[DataFrame, DataFrame]:
    """swapped and longer without the lines of now."""
    done = small_side(now.select(F.col("rank").alias("done")), now.count(), sent_rows)
    longer = longer.join(done, F.col("rank") == F.col("done"), "left_anti").join(done, F.col("whole") == F.col("done"), "left_anti")
    return kept(swapped.join(done, F.col("rank") == F.col("done"), "left_anti")), kept(longer)


def kept_lines(variants: DataFrame, lines: int, sent_rows: int, rounds: int = ROUNDS, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """rank, early: of every line to drop, the earliest line alike that stays; of the neighbourhoods of so many distinct lines."""
    gone = variants.where("place >= 0")
    swaps = kept(gone.groupBy("va", "vb", "place").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1").select("va", "vb", "place", "first"))
    # lines with the same words missing at the same place, told by the earliest of them: a member can't be so by two variants
    # of one place, and two places of one first line are different groups
    swapped = gone.join(small_side(swaps, swaps.count(), sent_rows), ["va", "vb", "place"]).select(F.col("first").alias("ga"), F.col("place").alias("gb"), "rank")
    whole = variants.where("place < 0").select("va", "vb", F.col("rank").alias("whole"))
    longer = gone.join(small_side(whole, lines, sent_rows), ["va", "vb"]).select("rank", "whole").distinct()
    # one table of groups: a shorter line and all lines one word longer are a star around it, which isn't itself a group of lines alike
    swapped, longer = kept(swapped), kept(longer)
    decided = None
    left_s, left_l = swapped, longer
    for n_round in count(1):
        first = left_s.groupBy("ga", "gb").agg(F.min("rank").alias("early"))
        ways = left_s.join(first, ["ga", "gb"]).select("rank", "early")
        ways = ways.unionByName(left_l.select("rank", F.col("whole").alias("early")))
        ways = ways.unionByName(left_l.groupBy("whole").agg(F.min("rank").alias("early")).select(F.col("whole").alias("rank"), "early"))
        open_ = ways.groupBy("rank").agg(F.min("early").alias("early"))
        stay = kept(open_.where("early >= rank").select("rank", F.lit(True).alias("stays")))
        n = stay.count()
        if n == 0:
            break
        staying = small_side(stay.select(F.col("rank").alias("kept")), n, sent_rows)
        heads = left_s.join(staying, F.col("rank") == F.col("kept")).groupBy("ga", "gb").agg(F.min("kept").alias("kept"))
        out = left_s.join(heads, ["ga", "gb"]).where("rank <> kept").select("rank")
        out = out.unionByName(left_l.join(staying, F.col("whole") == F.col("kept")).select("rank"))
        out = out.unionByName(left_l.join(staying, F.col("rank") == F.col("kept")).select(F.col("whole").alias("rank")))
        now = kept(stay.unionByName(out.distinct().withColumn("stays", F.lit(False))))
        decided = now if decided is None else decided.unionByName(now)
        left_s, left_l = undecided(left_s, left_l, now, sent_rows)
        if n_round % rounds == 0 and not (left_s.isEmpty() and left_l.isEmpty()):
            now = finished(left_s, left_l, sent_rows, finish_rows)
            decided = decided.unionByName(now)
            left_s, left_l = undecided(left_s, left_l, now, sent_rows)
    if decided is None:
        return swapped.select("rank", F.col("rank").alias("early")).where("false")
    # the earliest line that stays among those alike
    stay = decided.where("stays").select(F.col("rank").alias("kept"))
    stay = small_side(stay, stay.count(), sent_rows)
    heads = swapped.join(stay, F.col("rank") == F.col("kept")).groupBy("ga", "gb").agg(F.min("kept").alias("early"))
    found = swapped.join(heads, ["ga", "gb"]).select("rank", "early")
    found = found.unionByName(longer.join(stay, F.col("whole") == F.col("kept")).select("rank", F.col("kept").alias("early")))
    found = found.unionByName(longer.join(stay, F.col("rank") == F.col("kept")).select(F.col("whole").alias("rank"), F.col("kept").alias("early")))
    return found.where("early < rank").groupBy("rank").agg(F.min("early").alias("early"))


def duplicate_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent_rows: int = SENT_ROWS, rounds: int = ROUNDS, finish_rows: int = FINISH_ROWS) -> DataFrame:
    """id, row, line, keep_id, keep_line, edits of every line to drop (row: a hash of id and text, which tells rows of one id apart)."""
    text = F.col(f"`{text_col}`")
    docs = df.where(text.isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("id"), row_key(id_col, text_col).alias("row"), text.alias("text"))
    seen = kept(occurrences(docs), "lines")
    place = F.struct("id", "line", "row")
    # distinct lines, and those of them that share a half with another
    distinct = seen.groupBy("cid").agg(F.min(place).alias("first"), F.count("*").alias("n"), F.first("halves").alias("halves"))
    distinct = kept(distinct, "distinct")
    halves = distinct.select("cid", F.explode("halves").alias("half"))
    shared = kept(halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half"))
    some = halves.join(small_side(shared, shared.count(), sent_rows), "half", "left_semi").select("cid").distinct()
    chosen = kept(distinct.join(some, "cid", "left_semi").select("cid", "first"))
    # their words, read again where each first stands
    wanted = small_side(chosen.select("cid", F.col("first.id").alias("want_id"), F.col("first.line").alias("want_line"), F.col("first.row").alias("want_row")), chosen.count(), sent_rows)
    lines = docs.select("id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    lines = lines.join(wanted, F.col("id").eqNullSafe(F.col("want_id")) & (F.col("row") == F.col("want_row")) & (F.col("line") == F.col("want_line")))
    # numbered in the order in which they stand, so that the earliest is the least
    lines = lines.select("cid", "text", "want_id", "want_line", "want_row").dropDuplicates(["cid"]).orderBy("want_id", "want_line", "want_row")
    lines = kept(lines.withColumn("rank", F.monotonically_increasing_id()))
    near = kept_lines(neighbourhoods(lines), lines.count(), sent_rows, rounds, finish_rows)
    # verified on the words themselves
    words = lines.select("rank", "cid", F.split(F.trim(F.regexp_replace(F.lower("text"), r"[\s\x1c-\x1f\x85\p{Z}]+", " ")), " ").alias("words_a"), F.struct(F.col("want_id").alias("id"), F.col("want_line").alias("line"), F.col("want_row").alias("row")).alias("at"))
    pairs = near.join(words.select("rank", "cid", "words_a"), "rank")
    pairs = pairs.join(words.select(F.col("rank").alias("early"), F.col("words_a").alias("words_b"), "at"), "early")
    near = one_edit(pairs).select("cid", F.col("at").alias("early"))
    # back to every occurrence
    keep = distinct.select("cid", "first", "n").join(near, "cid", "left").where("early IS NOT NULL OR n > 1")
    keep = keep.select("cid", F.coalesce("early", "first").alias("keep"), F.when(F.col("early").isNull(), 0).otherwise(1).alias("edits"))
    found = seen.select("id", "row", "line", "cid").join(keep, "cid").where(F.struct("id", "line", "row") > F.col("keep"))
    return found.select(F.col("id").alias(id_col), "row", "line", F.col("keep.id").alias("keep_id"), F.col("keep.line").alias("keep_line"), "edits")


def drop_lines(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df, its text without the lines in `found`; rows whose lines with words are all gone are dropped. Where most documents lose
    lines, most texts have to meet theirs, so texts shuffle once, at every size."""
    gid, grow, lines = unused(df, "gone_id"), unused(df, "gone_row"), unused(df, "gone_lines")
    gone = found.select(F.col(f"`{id_col}`").alias(gid), F.col("row").alias(grow), "line").groupBy(gid, grow).agg(F.collect_set("line").alias(lines))
    text = F.col(f"`{text_col}`")
    marked = df.join(gone.hint("merge"), (row_key(id_col, text_col) == F.col(grow)) & F.col(f"`{id_col}`").eqNullSafe(F.col(gid)), "left")
    left = F.array_join(F.filter(F.split(text, "\n", -1), lambda _, i: ~F.array_contains(lines, i)), "\n")
    marked = marked.withColumn(text_col, F.when(F.col(lines).isNull(), text).otherwise(left))
    return marked.where(F.col(lines).isNull() | text.rlike(r"\S")).select(*[F.col(f"`{c}`") for c in df.columns])
