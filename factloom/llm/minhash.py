"""Near-duplicate documents by MinHash with tensored banding, verified on full shingle sets.

Each document has two collections of SUBKEYS sub-keys of WIDTH minhashes each; a table key is a pair of one sub-key
from each, so SUBKEYS squared tables come from 2 x SUBKEYS x WIDTH minhashes instead of 2 x WIDTH for every table. With
the default sizes two documents at similarity 0.85 share no key with a chance of about 5e-7 (0.8: about 2e-5).

Only what repeats is spelled out: documents of equal shingle sets are one class from the start; sub-keys that one class
alone has are dropped before pairs of sub-keys are formed. The tables on the diagonal give each class one centre to be
verified against, which joins most copies. Then all tables are searched for buckets in which several components meet; of the
classes in them, pairs from different components are formed by the exact prefix filter (see prefix_pairs) and verified.
Pairs inside one component can't change the result and aren't formed. Components come from alternating large-star
and small-star joins.

Defined cases: null texts and texts without words have the empty set, are linked with nothing and stay; fewer words than a shingle are one
shingle; each row of a repeated id counts by its own text; rows with
null ids are linked with nothing and stay, with component null; texts are taken whole, columns besides id and text don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import kept, modest, row_key, slabs, small_side, tidied, unused, without

SUBKEYS, WIDTH = 16, 3
#: Ids or keys that are sent to every task if there are no more; beyond it the join is a shuffle join.
SENT_ROWS = 500_000
CACHE_WORDS = 150_000
PARITY = 8
P = [f"p{i}" for i in range(PARITY)]
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class WordHashes(dict):
    """64-bit hashes of words, kept while they fit."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[0]
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | None, k: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles (the whole sequence as one if it is shorter)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total = scrambled(total + h[i : len(h) - k + 1 + i])
    return np.unique(total)


def sketch_sets(sets: list[np.ndarray], subkeys: int, width: int) -> np.ndarray:
    """(documents, 2 x subkeys) sub-keys of non-empty sets."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    rng = np.random.default_rng(20240229)
    odd = rng.integers(0, 1 << 63, 2 * subkeys * width, np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rng.integers(0, 1 << 63, 2 * subkeys * width, np.uint64)
    out = np.zeros((len(sets), 2 * subkeys), np.uint64)
    for i in range(2 * subkeys * width):
        out[:, i // width] = scrambled(out[:, i // width] + np.minimum.reduceat((flat ^ shift[i]) * odd[i], starts))
    return out


def signatures(df: DataFrame, id_col: str, text_col: str, k: int, subkeys: int, width: int) -> DataFrame:
    """id, row (hash of id and text), n_shingles, cid (a 128-bit hash of the set; null if empty), subs (sub-keys) of every row."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in tidied(batches):
            texts = batch.column(1)
            for i, j in slabs(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                sets = [shingle_set(t, k, hashes) for t in texts[i:j].to_pylist()]
                full = [n for n, s in enumerate(sets) if len(s)]
                subs: list[list[int] | None] = [None] * len(sets)
                if full:
                    for n, row in zip(full, sketch_sets([sets[n] for n in full], subkeys, width).view(np.int64).tolist(), strict=True):
                        subs[n] = row
                cids = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], batch.column(2)[i:j], pa.array([len(x) for x in sets], pa.int64()), pa.array(cids, pa.binary()), pa.array(subs, pa.list_(pa.int64()))], names=["id", "row", "n_shingles", "cid", "subs"])

    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), row_key(id_col, text_col).alias("row"))
    return modest(rows).mapInArrow(task, "id long, row long, n_shingles long, cid binary, subs array<long>")


def parity(shingles: np.ndarray) -> np.ndarray:
    """For each of 64 x PARITY cells whether an odd number of a set's shingles falls in it, as PARITY longs."""
    cells = np.bincount((shingles & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(cells.astype(np.uint8)).view(np.int64)


def shingle_arrays(df: DataFrame, k: int) -> DataFrame:
    """cid, shingles (sorted), p0, p1, ... (see parity) of every row of id, text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in tidied(batches):
            texts = batch.column(1)
            for i, j in slabs(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                sets = [shingle_set(t, k, hashes) for t in texts[i:j].to_pylist()]
                bits = np.stack([parity(x) for x in sets])
                cids = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.binary()), lists, *(pa.array(b) for b in np.ascontiguousarray(bits.T))], names=["cid", "shingles", *P])

    return modest(df.select("id", "text")).mapInArrow(task, "cid binary, shingles array<long>, " + ", ".join(f"{p} long" for p in P))


def shared_subkeys(classes: DataFrame, sent_rows: int) -> DataFrame:
    """node, first, second: of each class the sub-keys of both collections that another class has too."""
    subs = classes.select("node", F.posexplode("subs").alias("at", "sub"))
    shared = kept(subs.groupBy("sub").agg(F.count("*").alias("n")).where("n > 1").select("sub"))
    again = subs.join(small_side(shared, shared.count(), sent_rows), "sub", "left_semi")
    own = again.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("at", "sub"))).alias("subs"))
    return own


def table_keys(own: DataFrame, subkeys: int, diagonal: bool) -> DataFrame:
    """key and the columns of own but subs: a row for each pair of one sub-key of each collection (on the diagonal: of those with equal place)."""
    rest = [c for c in own.columns if c != "subs"]
    first, second = F.filter("subs", lambda x: x["at"] < subkeys), F.filter("subs", lambda x: x["at"] >= subkeys)
    one = own.select(*rest, second.alias("second"), F.explode(first).alias("a"))
    two = one.select(*rest, "a", F.explode("second").alias("b"))
    if diagonal:
        two = two.where(F.col("a.at") + subkeys == F.col("b.at"))
    return two.select(F.xxhash64("a.sub", "b.sub").alias("key"), *rest)


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, size_a, size_b, common: the sizes of both full sets and of their intersection."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", F.size("set_a").alias("size_a"), F.size("set_b").alias("size_b"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))


def links(tested: DataFrame, percent: int) -> DataFrame:
    return tested.where(F.col("common") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("common")) * percent).select("a", "b")


def components(edges: DataFrame, sent_rows: int = SENT_ROWS) -> DataFrame:
    """node, label of every node but the smallest of each component of the edges (a, b): the smallest that it reaches. Alternates large-star and small-star until the edges stand still."""
    now = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, m = None, 0
    while True:
        n = now.count()
        if n == 0 or (before is not None and n == m and now.join(before, ["a", "b"], "left_anti").isEmpty()):
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        before, m = now, n
        ways = now.select("a", "b").union(now.select(F.col("b"), F.col("a")))
        least = ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = ways.join(small_side(least, 2 * n, sent_rows), F.col("a") == F.col("u")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        small = large.join(small_side(least, n, sent_rows), F.col("a") == F.col("u"))
        now = kept(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("u", "m")).distinct())


def ordered(pairs: DataFrame, tested: DataFrame | None) -> DataFrame:
    """Distinct pairs with a < b that haven't been tested."""
    new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    return new if tested is None else new.join(tested.select("a", "b"), ["a", "b"], "left_anti")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows (with node) and their component's label."""
    return rows.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def contested(own: DataFrame, labels: DataFrame, subkeys: int, sent_rows: int) -> DataFrame:
    """node, label of the classes in a bucket in which several components meet."""
    keyed = table_keys(labelled(own, labels), subkeys, False)
    several = keyed.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    several = kept(several)
    return kept(keyed.join(small_side(several, several.count(), sent_rows), "key", "left_semi").select("node", "label").distinct())


def prefix_pairs(nodes: DataFrame, sets: DataFrame, percent: int, sent_rows: int) -> DataFrame:
    """Pairs of nodes of different labels that may be linked, found exactly: in any order of the shingles, two linked sets
    share one among the first n - ceil(n * percent / 100) + 1 of each, and their bounds on what is left (by position, by
    parity) must allow the link. The order is by how many of the nodes have a
    shingle, rarest first, so what many share is hardly ever looked up."""
    own = sets.join(small_side(nodes, nodes.count(), sent_rows), "node").select("node", "label", F.size("shingles").alias("size"), "shingles", *P)
    spread = own.select("node", F.explode("shingles").alias("s"))
    shared = spread.groupBy("s").agg(F.count("*").alias("n")).where("n > 1")
    known = spread.join(shared, "s").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "s"))).alias("known"))
    rows = own.drop("shingles").join(known, "node")
    alone = F.col("size") - F.size("known")
    prefix = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    rows = rows.where(prefix > alone).select("node", "label", "size", *P, alone.alias("alone"), F.posexplode(F.slice("known", F.lit(1), (prefix - alone).cast("int"))).alias("at", "x"))
    rows = kept(rows.select("node", "label", "size", *P, (F.col("alone") + F.col("at") + 1).alias("at"), F.col("x.s").alias("s")))
    # inside a shingle's group the largest component isn't paired with itself
    counts = rows.groupBy("s", "label").agg(F.count("*").alias("n"))
    major = counts.groupBy("s").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count("*").alias("labels")).where("labels > 1").select("s", "major")
    rows = rows.join(major, "s")
    left = rows.where("label <> major").select("s", F.col("node").alias("a"), F.col("label").alias("label_a"), F.col("size").alias("size_a"), F.col("at").alias("at_a"), *[F.col(p).alias(f"{p}_a") for p in P])
    right = rows.select("s", F.col("node").alias("b"), F.col("label").alias("label_b"), F.col("size").alias("size_b"), F.col("at").alias("at_b"), *[F.col(p).alias(f"{p}_b") for p in P])
    most = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b")) + 1
    room = most * (100 + percent) >= (F.col("size_a") + F.col("size_b")) * percent
    # the parities of two sets differ in no more cells than the sets do in shingles
    differ = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in P), F.lit(0))
    near = differ * (100 + percent) <= (F.col("size_a") + F.col("size_b")) * (100 - percent)
    return left.join(right, "s").where((F.col("label_a") != F.col("label_b")) & room & near).select("a", "b")


def class_components(own: DataFrame, sets: DataFrame, percent: int, subkeys: int, sent_rows: int) -> DataFrame:
    """node, label of the classes that some link reaches (but each component's smallest)."""
    # a first guess from the tables on the diagonal: one centre for each class
    keyed = table_keys(own, subkeys, True).select("key", "node")
    centres = keyed.groupBy("key").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    pairs = keyed.join(centres, "key").groupBy("node").agg(F.min("a").alias("a")).select("a", F.col("node").alias("b"))
    tested = kept(verify(ordered(pairs, None), sets))
    labels = components(links(tested, percent))
    # then both ends of each of those buckets, where they're in another component
    ends = labelled(keyed, labels).groupBy("key").agg(F.min(F.struct("node", "label")).alias("x"), F.max(F.struct("node", "label")).alias("y"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    ends = ends.select("key", F.explode(F.array("x", "y")).alias("e"))
    pairs = labelled(keyed, labels).join(ends, "key").where(F.col("label") != F.col("e.label")).select(F.col("node").alias("a"), F.col("e.node").alias("b"))
    new = kept(verify(ordered(pairs, tested), sets))
    tested = tested.union(new)
    labels = components(links(tested, percent))
    # then all tables, as far as their buckets hold more than one component
    open_ = contested(own, labels, subkeys, sent_rows)
    if open_.isEmpty():
        return labels
    new = kept(verify(ordered(prefix_pairs(open_, sets, percent, sent_rows), tested), sets))
    return components(links(tested.union(new), percent))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80, subkeys: int = SUBKEYS, width: int = WIDTH, sent_rows: int = SENT_ROWS) -> DataFrame:
    """id, n_shingles, component_id, kept, row (hash of id and text) of every row: documents are linked from a similarity of percent / 100."""
    rows = kept(signatures(df, id_col, text_col, k, subkeys, width))
    filled = rows.where("n_shingles > 0 AND id IS NOT NULL")
    classes = filled.groupBy("cid").agg(F.min("id").alias("doc"), F.first("subs").alias("subs"))
    classes = kept(classes.withColumn("node", F.monotonically_increasing_id()))
    rows, plain = rows.drop("subs"), classes.select("node", "cid", "doc")
    own = kept(shared_subkeys(classes, sent_rows))
    near = F.exists("subs", lambda x: x["at"] < subkeys) & F.exists("subs", lambda x: x["at"] >= subkeys)
    own = own.where(near)
    # the full sets of the classes that have table keys in common with others, from a second read of their texts
    wanted = kept(plain.join(own.select("node"), "node", "left_semi"))
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    docs = wanted.select(F.col("doc").alias("id")).distinct()
    some = texts.join(small_side(docs, docs.count(), sent_rows), "id", "left_semi")
    sets = kept(shingle_arrays(some, k).join(wanted.select("cid", "node"), "cid").drop("cid").dropDuplicates(["node"]))
    labels = class_components(own, sets, percent, subkeys, sent_rows)
    # the smallest id of each component, by class
    named = labelled(plain, labels)
    least = named.groupBy("label").agg(F.min("doc").alias("component"))
    of = named.join(least, "label").select(F.col("cid").alias("of"), "component")
    out = rows.join(of, (F.col("cid") == F.col("of")) & F.col("id").isNotNull(), "left")
    component = F.coalesce(F.col("component"), F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), "row")


def keep_one(df: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", sent_rows: int = SENT_ROWS) -> DataFrame:
    """The rows of df that near_duplicates keeps; of identical ids and texts, one row."""
    found = kept(found.select(F.col(f"`{id_col}`").alias("id"), "row", "kept"))
    stay = without(df, kept(found.where("NOT kept").select("id", "row").distinct()), id_col, text_col, sent_rows)
    again = kept(found.where("kept").groupBy("id", "row").agg(F.count("*").alias("n")).where("n > 1").select("id", "row"))
    if again.isEmpty():
        return stay
    aid, arow = unused(df, "again_id"), unused(df, "again_row")
    side = small_side(again.select(F.col("id").alias(aid), F.col("row").alias(arow)), again.count(), sent_rows)
    twice = stay.join(side, (row_key(id_col, text_col) == F.col(arow)) & F.col(f"`{id_col}`").eqNullSafe(F.col(aid)), "left_semi")
    return without(stay, again, id_col, text_col, sent_rows).unionByName(twice.dropDuplicates([id_col, text_col]))
