"""Exact nearest vectors by an inverted file (J8), in whatever number of queries and vectors.

Vectors of unit length stand in cells, each with the pivot that is nearest; inside a cell they are ordered by their angle to
the pivot and packed in blocks of up to BLOCK_ROWS, so a block is a shell around its pivot. No vector of a block is nearer
to a query than the query's angle to the pivot is to the shell's range of angles. Each query first visits the few blocks
with the best bounds; the score of its k-th hit then rules out all other blocks but those whose bound reaches it, which are
visited after. A visit is one matrix product of a block and the queries that ask for it.

Equal vectors are one entry of the index, so that a query near a large group of copies doesn't visit each of them; hits are
spelled out to their copies by id at the end. Columns named in `by` never mix in a block: searches can be confined to some
values of them, or to the query's own, before anything is cut.

Defined cases: null vectors and vectors of length zero have no direction, find nothing and aren't found; a query doesn't
find the vector of its own id; ties go by id; fewer than k vectors are all found; an empty table finds nothing. Ids are unique.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.session import checkpointed, small_side

#: Pivots at most (they are broadcast), rows of a block, queries that share a product, cells and blocks of the first visit.
MAX_PIVOTS, BLOCK_ROWS, TOGETHER, FIRST_CELLS, FIRST_BLOCKS = 4096, 256, 2000, 3, 4
#: Candidates for each pivot.
CANDIDATES = 3
#: What angles and scores may be off by in double precision.
SLACK, EPSILON = 1e-7, 1e-9
#: Rows of a side that is sent to all tasks at most.
SENT_ROWS = 200_000
#: Numbers in the vectors of queries that are sent to all tasks at most (48 MB).
SENT_NUMBERS = 6_000_000


@dataclass
class Index:
    """blocks (by..., cell, block, lo, hi, size, ids, data), copies (rep, id, and the number of each), pivots and each cell's range of angles."""

    blocks: DataFrame
    copies: DataFrame
    pivots: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    by: tuple[str, ...]
    total: int


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Rows of a list column as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), dim or (len(flat) // len(column) if len(column) else 0))


def units(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def spread(rows: np.ndarray, n: int) -> np.ndarray:
    """n of the rows, each the one that is farthest from those before."""
    taken, near = [0], rows @ rows[0]
    while len(taken) < min(n, len(rows)):
        taken.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[taken[-1]])
    return rows[taken]


def build(vectors: DataFrame, by: tuple[str, ...] = (), id_col: str = "vec_id", vector: str = "embedding") -> Index:
    """The index of vectors, kept in the shared folder. There are as many pivots as
    the root of the number of vectors, MAX_PIVOTS at most: of CANDIDATES times as many, whose hashed ids come first, those that stand farthest apart."""
    v = F.col(vector).cast("array<double>")
    own = vectors.select(*by, F.col(id_col).alias("id"), v.alias("v")).where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
    own = own.withColumns({"h1": F.xxhash64("v"), "h2": F.hash("v")})
    reps = checkpointed(own.groupBy(*by, "h1", "h2", "v").agg(F.min("id").alias("id"), F.count("*").alias("times")))
    several = reps.where("times > 1").select(*by, "h1", "h2", F.col("id").alias("rep"))
    copies = checkpointed(own.select(*by, "h1", "h2", "id").join(small_side(several, SENT_ROWS), [*by, "h1", "h2"]).select("rep", "id"))
    n = reps.count()
    cells = min(MAX_PIVOTS, max(1, math.isqrt(n)))
    first = reps.orderBy(F.xxhash64("id"), "id").limit(CANDIDATES * cells).select("v").collect()
    pivots = spread(units(np.array([r["v"] for r in first], np.float64)), cells) if first else np.zeros((0, 0))
    sent = own.sparkSession.sparkContext.broadcast(pivots)
    fields = [f for f in reps.select(*by, "id").schema.fields]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = units(matrix(batch.column(batch.num_columns - 1), sent.value.shape[1]))
            far = angles(u, sent.value)
            cell = far.argmin(1)
            rest = batch.columns[:-1]
            data = pa.Array.from_buffers(pa.binary(), len(u), [None, pa.py_buffer((np.arange(len(u) + 1) * u.shape[1] * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(u))])
            yield pa.RecordBatch.from_arrays([*rest, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(u)), cell]), data], names=[*(f.name for f in fields), "cell", "angle", "unit"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, key, held = TaskContext.get().partitionId() << 32, None, []

        def out() -> Iterator[pa.RecordBatch]:
            nonlocal block
            t = pa.Table.from_batches(held)
            far = t["angle"].to_numpy()
            data = b"".join(t["unit"].to_pylist())
            row = [*([x] for x in key), [block], [far[0]], [far[-1]], [len(far)], [t["id"].to_pylist()], [data]]
            yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(row, kinds, strict=True)], names=[*by, "cell", "block", "lo", "hi", "size", "ids", "data"])
            block += 1

        for batch in batches:
            kinds = [*(batch.schema.field(c).type for c in (*by, "cell")), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.list_(batch.schema.field("id").type), pa.binary()]
            keys = list(zip(*(batch.column(c).to_pylist() for c in (*by, "cell")), strict=True))
            at = 0
            while at < len(keys):
                room = BLOCK_ROWS - sum(b.num_rows for b in held) if keys[at] == key else 0
                if room <= 0 and held:
                    yield from out()
                    held = []
                key, room = keys[at], room if room > 0 else BLOCK_ROWS
                end = at
                while end < len(keys) and end - at < room and keys[end] == key:
                    end += 1
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield from out()

    order = [*by, "cell", "angle", "id"]
    rows = reps.select(*by, "id", "v").mapInArrow(placed, T.StructType([*fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType()), T.StructField("unit", T.BinaryType())]))
    kind = reps.schema["id"].dataType
    schema = T.StructType([*fields[:-1], T.StructField("cell", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("size", T.IntegerType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("data", T.BinaryType())])
    blocks = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(packed, schema))
    lo, hi, total = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf), 0
    for r in blocks.groupBy("cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("size").alias("n")).collect():  # MAX_PIVOTS rows at most
        lo[r["cell"]], hi[r["cell"]], total = r["lo"], r["hi"], total + r["n"]
    return Index(blocks, copies, pivots, lo, hi, tuple(by), total)


def best_of(rows: DataFrame, k: int, *order: Column, by: str = "query_id", salt: str = "id") -> DataFrame:
    """The k first rows of each query. Each of 32 salts of the row's id ranks its own first, so that no task orders all rows of a query."""
    part = rows.withColumn("part__", F.pmod(F.xxhash64(salt), F.lit(32)))
    part = part.withColumn("r__", F.row_number().over(Window.partitionBy(by, "part__").orderBy(*order))).where(F.col("r__") <= k)
    return part.withColumn("r__", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("r__") <= k).drop("part__", "r__")


class Search:
    """The hits of queries (query_id, query, and the columns of `same`) in an index: query_id, vec_id, score, rank; and how many vectors each query was compared with."""

    def __init__(self, index: Index, queries: DataFrame, k: int, min_score: float = -1.0, same: tuple[str, ...] = (), own: Column | None = None) -> None:
        """own: what of query_id is the id of a vector that the query mustn't find."""
        self.index, self.k, self.least, self.same, self.own = index, k, min_score, same, F.col("query_id") if own is None else own
        q = queries.select("query_id", F.col("query").cast("array<double>").alias("v"), *same)
        q = q.where(F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
        self.queries = checkpointed(q.withColumn("n__", F.monotonically_increasing_id()))
        self.shells = index.blocks.select(*same, "cell", "block", "lo", "hi", "size")
        asked = self.queries.count()
        self.groups = max(1, -(-asked // TOGETHER))
        if not len(index.pivots) or not index.total:
            self.visits = None
            return
        # a query's vector would stand in each of its visits: where they are few, all go to each task once and visits have their numbers
        self.sent, self.kind = None, T.BinaryType()
        if asked * index.pivots.shape[1] <= SENT_NUMBERS:
            t = self.queries.select("n__", "v").toArrow()
            ns, vs = t["n__"].to_numpy(), units(matrix(t["v"].combine_chunks(), index.pivots.shape[1]))
            order = np.argsort(ns)
            self.sent, self.kind = queries.sparkSession.sparkContext.broadcast((ns[order], vs[order])), T.LongType()
        start = self.queries.withColumn("kth", F.lit(float(min_score)))
        seen = self._reached(start, FIRST_CELLS)
        near = Window.partitionBy("query_id").orderBy("gap", "block")
        first = checkpointed(seen.withColumn("r", F.row_number().over(near)).where(F.col("r") <= FIRST_BLOCKS).select("query_id", "asks", "kth", "block", "size"))
        found = checkpointed(self._scored(first))
        kth = best_of(found, k + 1, F.desc("score"), F.asc("rep"), salt="rep").groupBy("query_id").agg(F.when(F.count("*") > k, F.min("score")).alias("found"))
        again = self.queries.join(kth.hint("merge"), "query_id", "left").withColumn("kth", F.greatest(F.coalesce("found", F.lit(float(min_score))), F.lit(float(min_score)))).drop("found")
        more = self._reached(again, None).join(first.select("query_id", "block").hint("merge"), ["query_id", "block"], "left_anti").select("query_id", "asks", "kth", "block", "size")
        more = checkpointed(more)
        self.found = found.unionByName(self._scored(more))
        self.visits = first.unionByName(more)

    def _reached(self, queries: DataFrame, cells: int | None) -> DataFrame:
        """The blocks whose bound reaches the query's kth score: of its nearest `cells`, or of all."""
        at = queries.sparkSession.sparkContext.broadcast((self.index.pivots, self.index.lo, self.index.hi))  # MAX_PIVOTS vectors at most
        kind, same, numbered = queries.schema["query_id"].dataType, self.same, self.sent is not None
        fields = [T.StructField("query_id", kind), *(queries.schema[c] for c in same), T.StructField("asks", self.kind), T.StructField("kth", T.DoubleType()), T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())]

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, lo, hi = at.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                u = units(matrix(batch.column(batch.schema.get_field_index("v")), pivots.shape[1]))
                kth = batch.column(batch.schema.get_field_index("kth")).to_numpy()
                step = max(1, 4_000_000 // len(pivots))
                for i in range(0, len(u), step):
                    far = angles(u[i : i + step], pivots)
                    gap = np.maximum(np.maximum(lo - far, far - hi), 0.0)
                    ok = np.cos(np.maximum(gap - SLACK, 0.0)) >= kth[i : i + step, None] - EPSILON
                    ok &= np.isfinite(lo)
                    if cells and ok.shape[1] > cells:
                        order = np.argsort(np.where(ok, gap + far * 1e-6, np.inf), axis=1)[:, :cells]
                        few = np.zeros_like(ok)
                        np.put_along_axis(few, order, True, 1)
                        ok &= few
                    row, cell = np.nonzero(ok)
                    for a in range(0, len(row), 10_000):
                        r, c = row[a : a + 10_000], cell[a : a + 10_000]
                        take = pa.array(r + i)
                        data = batch.column(batch.schema.get_field_index("n__")).take(take) if numbered else pa.array([u[x].tobytes() for x in (r + i).tolist()], pa.binary())
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), *(batch.column(batch.schema.get_field_index(s)).take(take) for s in same), data, pa.array(kth[r + i]), pa.array(c.astype(np.int32)), pa.array(far[r, c])], names=[f.name for f in fields])

        pairs = queries.select("query_id", *same, "v", "kth", "n__").mapInArrow(task, T.StructType(fields))
        met = pairs.join(small_side(self.shells, SENT_ROWS), ["cell", *same])
        gap = F.greatest(F.col("lo") - F.col("angle"), F.col("angle") - F.col("hi"), F.lit(0.0))
        reach = F.cos(F.greatest(gap - SLACK, F.lit(0.0))) >= F.col("kth") - EPSILON
        return met.where(reach).select("query_id", "asks", "kth", "block", "size", gap.alias("gap"))

    def _scored(self, visits: DataFrame) -> DataFrame:
        """query_id, rep, score: the k + 1 best of each visited block, not under the query's kth score."""
        k, kind, rep = self.k + 1, visits.schema["query_id"].dataType, self.index.blocks.schema["ids"].dataType.elementType
        asked = visits.groupBy("block", F.pmod(F.xxhash64("query_id"), F.lit(self.groups)).alias("g")).agg(F.collect_list(F.struct("query_id", "asks", "kth")).alias("asked"))
        sent = self.sent

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in range(batch.num_rows):
                    asked, ids = batch.column(0)[n].values, batch.column(1)[n].values
                    data = np.frombuffer(batch.column(2)[n].as_buffer(), np.float64).reshape(len(ids), -1)
                    if sent is None:
                        q = np.frombuffer(b"".join(asked.field("asks").to_pylist()), np.float64).reshape(-1, data.shape[1])
                    else:
                        ns, vs = sent.value
                        q = vs[np.searchsorted(ns, asked.field("asks").to_numpy())]
                    least = asked.field("kth").to_numpy() - EPSILON
                    near = q @ data.T
                    if k < near.shape[1]:
                        least = np.maximum(least, np.partition(near, near.shape[1] - k, 1)[:, near.shape[1] - k] - EPSILON)
                    row, col = np.nonzero(near >= least[:, None])
                    for a in range(0, len(row), 10_000):
                        r, c = row[a : a + 10_000], col[a : a + 10_000]
                        exact = (q[r] * data[c]).sum(1)  # summed row by row, so equal vectors have equal scores
                        yield pa.RecordBatch.from_arrays([asked.field("query_id").take(pa.array(r)), ids.take(pa.array(c)), pa.array(exact)], names=["query_id", "rep", "score"])

        # a shuffle join: what is asked takes far more memory in rows than packed, by which it would be judged small enough to be sent through the driver
        rows = asked.hint("merge").join(self.index.blocks.select("block", "ids", "data"), "block").select("asked", "ids", "data")
        schema = T.StructType([T.StructField("query_id", kind), T.StructField("rep", rep), T.StructField("score", T.DoubleType())])
        return rows.mapInArrow(task, schema).where(F.col("score") >= self.least)

    def hits(self) -> DataFrame:
        if self.visits is None:
            kind = self.index.blocks.schema["ids"].dataType.elementType
            none = self.queries.where("false")
            return none.select("query_id", F.lit(None).cast(kind).alias("vec_id"), F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
        k, order = self.k, (F.desc("score"), F.asc("id"))
        top = best_of(self.found, k + 1, F.desc("score"), F.asc("rep"), salt="rep")
        copies = best_of(self.index.copies, k + 1, F.asc("id"), by="rep").withColumnRenamed("id", "copy")
        spelled = top.join(small_side(copies, SENT_ROWS), "rep", "left").select("query_id", F.coalesce("copy", "rep").alias("id"), "score").where(F.col("id") != self.own)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))  # (k + 1)^2 rows of a query at most
        return spelled.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias("vec_id"), "score", "rank")

    def compared(self) -> DataFrame:
        """query_id, scored and total: how many distinct vectors each query was compared with, of how many."""
        if self.visits is None:
            return self.queries.select("query_id", F.lit(0).cast("long").alias("scored"), F.lit(0).cast("long").alias("total"))
        return self.visits.groupBy("query_id").agg(F.sum("size").alias("scored"), F.lit(self.index.total).cast("long").alias("total"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int, min_score: float = -1.0, same: tuple[str, ...] = ()) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest of vectors (vec_id, embedding) of each query, by an index made for it."""
    return Search(build(vectors, same), queries, k, min_score, same).hits()
