"""Density clustering of vectors: labels, outlier scores, the retry for all-noise results, and the condensed tree.

Every step but the last is a job over cells of bounded size. Pivots (a bounded sample) split the points into cells, cells into
chunks of CHUNK points. A point looks for neighbours in its own block first; that bounds how far away they can be, and by
the triangle inequality most cells are then out of reach. What is left is compared by matrix products, in blocks of BLOCK
points against TOGETHER chunks, so no group grows with the data, and blocks and chunks are sent packed; a product only tells
which pairs may count, within what rounding can change, and those are measured again one by one, so results are exact.

Edges weigh the greatest of their length and of both ends' core distances. The minimum spanning tree grows by rounds: each
component takes its lightest edge to another one, known neighbours first, and only points whose list of neighbours can't rule out
a lighter edge search their cells again. Edges are ordered by weight, then ids, so the tree is unique. Its n - 1 edges
(24 bytes a point, no vectors) make the hierarchy of one clustering run in one task.

Defined cases: fewer than two points are noise; equal points have infinite density; scores that aren't numbers are 0; labels
are numbered by the smallest id of each cluster; null ids or vectors are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.registry import query
from factloom.session import checkpointed, small_side

MIN_CLUSTER, NEIGHBOURS = 2, 16
#: Pivots at most, points of a chunk, points of a block, chunks that a block is compared with in one task at most.
PIVOTS, CHUNK, BLOCK, TOGETHER = 256, 1024, 16384, 128
#: Pairs of a matrix product, pairs that are measured again together, what a sum of products may be off by, rows of a side that is sent to all tasks.
TILE, PIECE, ROUNDING, SENT_ROWS = 1 << 18, 1 << 18, 1e-15, 200_000


def _distances(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Distances of some rows of a at a time to all of b, and where those rows begin."""
    step = max(1, (1 << 21) // max(b.size, 1))
    for i in range(0, len(a), step):
        d = a[i : i + step, None, :] - b[None, :, :]
        yield i, np.sqrt((d * d).sum(2))


def _gaps(a: np.ndarray, norms: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of rows of a (norms: their squared lengths) to b without those lengths, by one matrix product, and what each row's may be off by."""
    far = (b * b).sum(1)
    return np.hstack([-2.0 * a, np.ones((len(a), 1))]) @ np.vstack([b.T, far]), ROUNDING * (a.shape[1] + 4) * (norms + far.max(initial=0.0))


def _exact(a: np.ndarray, b: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """The distances of some pairs, summed as in `_distances`."""
    out = np.empty(len(row))
    for i in range(0, len(row), PIECE):
        d = a[row[i : i + PIECE]] - b[col[i : i + PIECE]]
        out[i : i + PIECE] = np.sqrt((d * d).sum(1))
    return out


def _packed(rows: DataFrame, *by: str) -> DataFrame:
    """One row for each group of bounded size, with each of its other columns (numbers, arrays of doubles) as bytes."""
    others = [c for c in rows.columns if c not in by]

    def pack(t: pa.Table) -> pa.Table:
        flat = {c: t[c].combine_chunks() for c in others}
        data = {c: (x.flatten() if pa.types.is_list(x.type) else x).to_numpy(zero_copy_only=False).tobytes() for c, x in flat.items()}
        return pa.table({c: t[c].slice(0, 1) for c in by} | {c: pa.array([x], pa.binary()) for c, x in data.items()})

    return rows.groupBy(*by).applyInArrow(pack, ", ".join([*(f"{c} {t}" for c, t in rows.select(*by).dtypes), *(f"{c} binary" for c in others)]))


def _unpacked(t: pa.Table, i: int, kinds: dict[str, type]) -> list[np.ndarray]:
    """Columns of row i of a packed table; `v` comes last, by rows."""
    own = [np.frombuffer(t[c][i].as_buffer(), kind) for c, kind in kinds.items()]
    return [*own, np.frombuffer(t["v"][i].as_buffer(), np.float64).reshape(len(own[0]), -1)]


class Cells:
    """The points (id, v) in cells: `points` has their cell, chunk and block; pivots, radii and chunks of each cell are small arrays.
    Chunks are looked through, blocks ask: a block is a part of a large cell, or several small ones whose pivots are close."""

    def __init__(self, points: DataFrame) -> None:
        spark = points.sparkSession
        points = checkpointed(points.where("id IS NOT NULL AND v IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")))
        self.n = points.count()
        wanted = max(1, min(PIVOTS, self.n // CHUNK))
        chosen = points.orderBy(F.xxhash64("id"), "id").limit(wanted).collect()  # PIVOTS points at most
        self.pivots = np.array([r["v"] for r in chosen], float).reshape(len(chosen), len(chosen[0]["v"]) if chosen else 0)
        sent = spark.sparkContext.broadcast(self.pivots)

        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    near = [(d.argmin(1), d.min(1)) for _, d in _distances(np.stack(f["v"]), sent.value)]
                    yield f.assign(cell=np.concatenate([a for a, _ in near]), r=np.concatenate([b for _, b in near]))

        placed = checkpointed(points.mapInPandas(assign, "id long, v array<double>, cell int, r double"))
        sizes = placed.groupBy("cell").agg(F.max("r").alias("r"), F.count("*").alias("n")).collect()  # a row for each pivot
        self.radius, self.chunks, size = np.full(len(self.pivots), -math.inf), np.ones(len(self.pivots), int), np.zeros(len(self.pivots), int)
        for x in sizes:
            self.radius[x["cell"]], self.chunks[x["cell"]], size[x["cell"]] = x["r"], -(-x["n"] // CHUNK), x["n"]
        first, parts = self._dealt(size)
        at = lambda x: F.element_at(F.array(*[F.lit(int(c)) for c in x]), F.col("cell") + 1) if len(x) else F.lit(1)
        part = lambda x: F.pmod(F.xxhash64("id"), at(x)).cast("int")
        self.points = checkpointed(placed.select("id", "v", "cell", part(self.chunks).alias("chunk"), (at(first) + part(parts)).cast("int").alias("block")))
        # chunks that a block looks through in one task
        self.together = min(TOGETHER, max(8, int(self.chunks.sum()) // 6))

    def _dealt(self, size: np.ndarray) -> tuple[list[int], list[int]]:
        """Each cell's first block, and how many it has, with cells taken by way of the nearest pivot that is left."""
        first, parts, block, held = [0] * len(size), [1] * len(size), 0, 0
        left, at = set(range(len(size))), 0
        while left:
            left.discard(at)
            if held and held + size[at] > BLOCK:
                block, held = block + 1, 0
            first[at], parts[at] = block, max(1, -(-int(size[at]) // BLOCK))
            block, held = (block, held + size[at]) if parts[at] == 1 else (block + parts[at], 0)
            rest = sorted(left)
            at = rest[int(np.nan_to_num(((self.pivots[rest] - self.pivots[at]) ** 2).sum(1), nan=math.inf).argmin())] if rest else at
        return first, parts

    def reached(self, v: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Which cells may hold a point within the bound of each row of v."""
        return np.concatenate([d - self.radius <= bound[i : i + len(d), None] * (1 + 1e-9) + 1e-12 for i, d in _distances(v, self.pivots)])

    def compare(self, queries: DataFrame, members: DataFrame, kernel, schema: str) -> DataFrame:
        """kernel(queries, members) for each block of queries (block, id, v, bound and more) and some of the chunks of members (cell, chunk, id, v and more) that it may reach, all packed."""
        chunks, seen = self.chunks, _Seen(self)

        def visit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    row, cell = np.nonzero(seen.reached(np.stack(f["v"]), f["bound"].to_numpy()))
                    yield pd.DataFrame({"block": f["block"].to_numpy()[row], "cell": cell}).drop_duplicates()

        queries = checkpointed(queries)
        met = queries.select("block", "v", "bound").mapInPandas(visit, "block int, cell int").distinct()
        many = F.element_at(F.array(*[F.lit(int(c)) for c in chunks]), F.col("cell") + 1) if len(chunks) else F.lit(1)
        met = checkpointed(met.select("block", "cell", F.explode(F.sequence(F.lit(0), many - 1)).alias("chunk")))
        parts = met.groupBy("block").agg(F.ceil(F.count("*") / self.together).cast("int").alias("parts"))
        met = met.join(parts, "block").select("block", "cell", "chunk", F.pmod(F.xxhash64("cell", "chunk"), F.col("parts")).cast("int").alias("part"))
        left = _packed(queries, "block").join(met.select("block", "part").distinct(), "block")
        # chunks are sent to where they are asked for in one shuffle, if the list of who asks is small
        right = _packed(members, "cell", "chunk").join(small_side(met, SENT_ROWS), ["cell", "chunk"])
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(kernel, schema)


def nearest(cells: Cells, k: int) -> DataFrame:
    """id, near: the k nearest other points of each, as (dist, id) in order."""
    seen = _Seen(cells)

    def own(f: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(f["v"])
        bound, norms = np.full(len(f), math.inf), (v * v).sum(1)
        if len(f) > k:
            step = max(1, TILE // len(f))
            for i in range(0, len(f), step):
                d, off = _gaps(v[i : i + step], norms[i : i + step], v)
                with np.errstate(invalid="ignore"):
                    d = np.partition(d, k, 1)[:, k] + norms[i : i + step] + 2 * off  # itself is one of them
                bound[i : i + step] = np.sqrt(np.maximum(np.nan_to_num(d, nan=math.inf), 0.0))
        return f[["block", "id", "v"]].assign(bound=bound)

    def best(row: np.ndarray, other: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k first of each row by distance, then id."""
        order = np.lexsort((other, dist, row))
        row, other, dist = row[order], other[order], dist[order]
        start = np.r_[0, np.flatnonzero(np.diff(row)) + 1] if len(row) else np.zeros(0, int)
        rank = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)]))
        return row[rank < k], other[rank < k], dist[rank < k]

    def kernel(q: pa.Table, m: pa.Table) -> pa.Table:
        held = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
        ids = np.zeros(0, np.int64)
        if q.num_rows and m.num_rows:
            ids, bound, a = _unpacked(q, 0, {"id": np.int64, "bound": np.float64})
            bound, norms, near, new, n = bound.copy(), (a * a).sum(1), seen.reached(a, bound), [], 0
            for j, cell in enumerate(m["cell"].to_pylist()):
                others, b = _unpacked(m, j, {"id": np.int64})
                mine = np.flatnonzero(near[:, cell])
                step = max(1, TILE // len(b))
                for i in range(0, len(mine), step):
                    rows = mine[i : i + step]
                    gap, off = _gaps(a[rows], norms[rows], b)
                    with np.errstate(invalid="ignore"):
                        row, col = np.nonzero(~(gap > (bound[rows] ** 2 * (1 + 1e-12) - norms[rows] + off)[:, None]))
                    row = rows[row]
                    dist = _exact(a, b, row, col)
                    ok = np.isfinite(dist) & (ids[row] != others[col])
                    new.append((row[ok], others[col[ok]], dist[ok]))
                    n += len(new[-1][0])
                    if n >= PIECE:
                        held, new, n = best(*(np.concatenate(x) for x in zip(held, *new, strict=True))), [], 0
                        full = np.bincount(held[0], minlength=len(a)) == k
                        last = np.r_[np.flatnonzero(np.diff(held[0])), len(held[0]) - 1] if len(held[0]) else np.zeros(0, int)
                        last = last[full[held[0][last]]]
                        bound[held[0][last]] = np.minimum(bound[held[0][last]], held[2][last])
            held = best(*(np.concatenate(x) for x in zip(held, *new, strict=True)))
        return pa.table({"id": ids[held[0]], "other": held[1], "dist": held[2]})

    bounds = cells.points.select("block", "id", "v").groupBy("block").applyInPandas(own, "block int, id long, v array<double>, bound double")
    found = cells.compare(bounds, cells.points.select("cell", "chunk", "id", "v"), kernel, "id long, other long, dist double")
    near = F.slice(F.sort_array(F.collect_list(F.struct("dist", F.col("other").alias("id")))), 1, k)
    return checkpointed(found.groupBy("id").agg(near.alias("near")))


class _Seen:
    """What tasks need of the cells to tell which of them a point may reach."""

    def __init__(self, cells: Cells) -> None:
        self.pivots, self.radius = cells.pivots, cells.radius

    reached = Cells.reached


def _lightest(cells: Cells, need: DataFrame, cores: DataFrame) -> DataFrame:
    """comp, w, lo, hi, other: for each component of the points (block, id, v, core, comp, bound) the lightest edge to another one within the bound."""
    best, seen = "comp long, w double, lo long, hi long, other long", _Seen(cells)

    def first(f: pd.DataFrame) -> pd.DataFrame:
        return f.sort_values(["comp", "w", "lo", "hi"]).drop_duplicates("comp")

    def kernel(q: pa.Table, m: pa.Table) -> pa.Table:
        held = pd.DataFrame({"comp": np.zeros(0, np.int64), "w": np.zeros(0), "lo": np.zeros(0, np.int64), "hi": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})
        if q.num_rows and m.num_rows:
            ids, core, comp, bound, a = _unpacked(q, 0, {"id": np.int64, "core": np.float64, "comp": np.int64, "bound": np.float64})
            names, own = np.unique(comp, return_inverse=True)
            least = np.full(len(names), math.inf)  # the lightest edge of each component so far
            np.minimum.at(least, own, bound)
            norms, near = (a * a).sum(1), seen.reached(a, bound)
            for j, cell in enumerate(m["cell"].to_pylist()):
                others, its_core, its_comp, b = _unpacked(m, j, {"id": np.int64, "core": np.float64, "comp": np.int64})
                mine = np.flatnonzero(near[:, cell])
                step = max(1, TILE // len(b))
                for i in range(0, len(mine), step):
                    rows = mine[i : i + step]
                    gap, off = _gaps(a[rows], norms[rows], b)
                    apart = comp[rows][:, None] != its_comp[None, :]
                    limit = lambda: (least[own[rows]] ** 2 * (1 + 1e-12) - norms[rows] + off)[:, None]  # noqa: B023, E731
                    with np.errstate(invalid="ignore"):
                        hit = ~(gap > limit()) & apart
                        if np.count_nonzero(hit) > PIECE:  # each point's lightest edge here bounds its component's
                            w = np.maximum(np.maximum(gap + (norms[rows] + 2 * off)[:, None], (core[rows] ** 2)[:, None]), (its_core**2)[None, :])
                            w = np.where(apart & np.isfinite(w), w, math.inf).min(1)
                            np.minimum.at(least, own[rows], np.sqrt(np.maximum(w, 0.0)) * (1 + 1e-12))
                            hit = ~(gap > limit()) & apart
                    row, col = np.nonzero(hit)
                    for at in range(0, len(row), PIECE):
                        r, c = rows[row[at : at + PIECE]], col[at : at + PIECE]
                        w = np.maximum(np.maximum(_exact(a, b, r, c), core[r]), its_core[c])
                        ok = np.isfinite(w) & (w <= least[own[r]])
                        r, c, w = r[ok], c[ok], w[ok]
                        new = pd.DataFrame({"comp": comp[r], "w": w, "lo": np.minimum(ids[r], others[c]), "hi": np.maximum(ids[r], others[c]), "other": its_comp[c]})
                        held = first(pd.concat([held, first(new)]))
                        np.minimum.at(least, own[r], w)
        return pa.Table.from_pandas(held, preserve_index=False)

    return cells.compare(need, cells.points.join(cores, "id").select("cell", "chunk", "id", "v", "core", "comp"), kernel, best)


def spanning_tree(cells: Cells, near: DataFrame, min_samples: int) -> DataFrame:
    """lo, hi, w: the minimum spanning tree over all pairs of points by mutual reachability."""
    at = F.least(F.lit(min_samples), F.size("near"))
    whole = F.size("near") >= cells.n - 1
    stats = checkpointed(near.select("id", F.element_at("near", at)["dist"].alias("core"), F.when(whole, F.lit(math.inf)).otherwise(F.element_at("near", -1)["dist"]).alias("far"), "near"))
    core = stats.select("id", "core")
    pairs = stats.select(F.col("id").alias("a"), F.col("core").alias("core_a"), F.explode("near").alias("x")).select("a", "core_a", F.col("x.id").alias("b"), F.col("x.dist").alias("dist"))
    pairs = pairs.join(core.withColumnsRenamed({"id": "b", "core": "core_b"}), "b")
    pairs = checkpointed(pairs.select("a", "b", F.greatest("dist", "core_a", "core_b").alias("w"), F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")))
    comp = cells.points.select("id", F.col("id").alias("comp"))
    tree, taken = None, 0
    first = F.min(F.struct("w", "lo", "hi", "other")).alias("x")
    while taken < cells.n - 1:
        comp = checkpointed(comp)
        known = pairs.join(comp.withColumnsRenamed({"id": "a"}), "a").join(comp.withColumnsRenamed({"id": "b", "comp": "other"}), "b").where("comp <> other")
        known = checkpointed(known.groupBy("comp").agg(first).select("comp", "x.*"))
        # points that may have a lighter edge than their component knows: what isn't in their list is at least `far` away
        need = stats.join(comp, "id").join(known.select("comp", F.col("w").alias("bound")), "comp", "left").withColumn("bound", F.coalesce("bound", F.lit(math.inf)))
        need = checkpointed(need.where((F.greatest("core", "far") <= F.col("bound")) & (F.col("far") < math.inf)).select("id", "core", "comp", "bound"))
        if not need.isEmpty():
            found = _lightest(cells, need.join(cells.points.select("id", "v", "block"), "id").select("block", "id", "core", "comp", "bound", "v"), comp.join(core, "id"))
            known = known.unionByName(found)
        best = checkpointed(known.groupBy("comp").agg(first).select("comp", "x.*"))
        new = checkpointed(best.select("lo", "hi", "w").distinct())
        tree, taken = new if tree is None else tree.unionByName(new), taken + new.count()
        comp = comp.join(joined(best.select("comp", "other")), "comp").select("id", F.col("label").alias("comp"))
    return tree if tree is not None else pairs.select("lo", "hi", "w").where("false")


def joined(links: DataFrame) -> DataFrame:
    """comp, label of components that each point to one other: a pair that points to each other is led by the smaller, and all follow pointers until they stand still."""
    back = links.select(F.col("comp").alias("other"), F.col("other").alias("back"))
    now = links.join(back, "other", "left").select("comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("other")), F.col("comp")).otherwise(F.col("other")).alias("label"))
    while True:
        now = checkpointed(now)
        ahead = now.select(F.col("comp").alias("label"), F.col("label").alias("next"))
        moved = now.join(ahead, "label").select("comp", F.col("next").alias("label"), (F.col("next") != F.col("label")).alias("moved"))
        if moved.where("moved").isEmpty():
            return now
        now = moved.drop("moved")


def condensed(edges: pd.DataFrame, min_size: int) -> pd.DataFrame:
    """parent, child, lam, size: the condensed tree of the edges (lo, hi, w) of a spanning tree. Clusters are numbered from 0 (the root) by falling density level, points are -1 - their place in the sorted ids."""
    edges = edges.sort_values(["w", "lo", "hi"], ignore_index=True)
    ids = np.unique(edges[["lo", "hi"]].to_numpy())
    n = len(ids)
    left, right = np.searchsorted(ids, edges["lo"].to_numpy()), np.searchsorted(ids, edges["hi"].to_numpy())
    top, node = list(range(n)), list(range(n))  # union by root; the node of each root
    kids: list[tuple[int, int]] = []
    size = [1] * n

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(a), root(b)
        kids.append((node[a], node[b]))
        size.append(size[node[a]] + size[node[b]])
        top[b] = a
        node[a] = n + len(kids) - 1
    with np.errstate(divide="ignore"):
        lam = np.concatenate([np.zeros(n), 1.0 / edges["w"].to_numpy(float)])
    rows: list[tuple[int, int, float, int]] = []

    def fall(x: int, parent: int, at: float) -> None:
        stack = [x]
        while stack:
            y = stack.pop()
            if y < n:
                rows.append((parent, -1 - y, at, 1))
            else:
                stack += kids[y - n]

    clusters, stack = 1, [(n + len(kids) - 1, 0)] if kids else []
    while stack:
        x, cluster = stack.pop()
        both, at = kids[x - n], float(lam[x])
        big = [y for y in both if size[y] >= min_size]
        for y in both:
            if len(big) == 2:
                rows.append((cluster, clusters, at, size[y]))
                (stack.append((y, clusters)) if y >= n else rows.append((clusters, -1 - y, at, 1)))
                clusters += 1
            elif y in big and y >= n:
                stack.append((y, cluster))
            else:
                fall(y, cluster, at)
    return pd.DataFrame(rows, columns=["parent", "child", "lam", "size"])


def chosen_clusters(tree: pd.DataFrame) -> set[int]:
    """Clusters by excess of mass: each beats its chosen descendants or gives way to them; the root never counts."""
    birth = dict(zip(tree["child"], tree["lam"], strict=True)) | {0: 0.0}
    mass: dict[int, float] = {}
    for p, lam, size in zip(tree["parent"], tree["lam"], tree["size"], strict=True):
        gain = lam - birth[p] if lam != birth[p] else 0.0
        mass[p] = mass.get(p, 0.0) + gain * size
    below: dict[int, list[int]] = {}
    for p, c in zip(tree["parent"], tree["child"], strict=True):
        if c >= 0:
            below.setdefault(p, []).append(c)
    best, out = dict(mass), set()
    for c in sorted(mass, reverse=True):  # children have greater numbers
        if c == 0:
            continue
        under = sum(best[x] for x in below.get(c, []))
        if c in below and under > mass[c]:
            best[c] = under
        else:
            out.add(c)
    covered, stack = set(), [(0, False)]
    while stack:
        c, under = stack.pop()
        if under:
            covered.add(c)
        stack += [(x, under or c in out) for x in below.get(c, [])]
    return out - covered


def labelled(edges: pd.DataFrame, min_size: int) -> pd.DataFrame:
    """id, label, outlier of the points of one spanning tree."""
    ids = np.unique(edges[["lo", "hi"]].to_numpy())
    tree = condensed(edges, min_size)
    chosen = chosen_clusters(tree)
    parent = {c: p for p, c in zip(tree["parent"], tree["child"], strict=True) if c >= 0}
    death: dict[int, float] = {}
    for p, lam in zip(tree["parent"], tree["lam"], strict=True):
        death[p] = max(death.get(p, 0.0), lam)
    for c in sorted(parent, reverse=True):
        death[parent[c]] = max(death.get(parent[c], 0.0), death.get(c, 0.0))
    home: dict[int, int] = {0: -1}
    for c in sorted(parent):
        home[c] = c if c in chosen else home[parent[c]]
    points = tree[tree["child"] < 0]
    at = -1 - points["child"].to_numpy()
    lam, most = points["lam"].to_numpy(), np.array([death[p] for p in points["parent"]])
    with np.errstate(invalid="ignore", divide="ignore"):
        score = np.nan_to_num(np.where(np.isfinite(lam) & (most > 0), 1.0 - lam / most, 0.0), nan=0.0)
    out = pd.DataFrame({"id": ids[at], "label": [home[p] for p in points["parent"]], "outlier": score}).sort_values("id", ignore_index=True)
    order = {c: i for i, c in enumerate(dict.fromkeys(out.loc[out["label"] >= 0, "label"]))}
    return out.assign(label=[order.get(c, -1) for c in out["label"]])


def density_clusters(points: DataFrame, min_cluster_size: int = MIN_CLUSTER, min_samples: int | None = None) -> DataFrame:
    """id, label (-1: noise), outlier of the points (id, v)."""
    edges, cells = reachability_tree(points, min_samples or min_cluster_size)
    found = edges.withColumn("run", F.lit(0)).groupBy("run").applyInPandas(lambda f: labelled(f, min_cluster_size), "id long, label int, outlier double")
    rest = cells.points.select("id").join(found, "id", "left")
    return rest.select("id", F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("outlier", F.lit(0.0)).alias("outlier"))


def reachability_tree(points: DataFrame, min_samples: int) -> tuple[DataFrame, Cells]:
    """The spanning tree (lo, hi, w) of the points (id, v), and their cells."""
    cells = Cells(points)
    k = max(1, min(max(NEIGHBOURS, min_samples), cells.n - 1))
    return spanning_tree(cells, nearest(cells, k), min_samples), cells


def with_retry(points: DataFrame, min_cluster_size: int = MIN_CLUSTER, min_samples: int | None = None) -> DataFrame:
    """density_clusters with min_samples used; if all is noise and clusters may have two points, once more with min_samples = 1."""
    samples = min_samples or min_cluster_size
    found = checkpointed(density_clusters(points, min_cluster_size, samples))
    if min_cluster_size <= 2 and samples != 1 and found.where("label >= 0").isEmpty() and not found.isEmpty():
        samples, found = 1, density_clusters(points, min_cluster_size, 1)
    return found.withColumn("min_samples", F.lit(samples))


def _points(embeddings: DataFrame) -> DataFrame:
    return embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("K1", "embeddings")
def k1(embeddings):
    """Density clusters of all vectors."""
    return density_clusters(_points(embeddings)).select(F.col("id").alias("vec_id"), "label")


@query("K2", "embeddings")
def k2(embeddings):
    """How far outside of its cluster's density each vector is, strongest first in the report."""
    return density_clusters(_points(embeddings)).select(F.col("id").alias("vec_id"), F.round("outlier", 6).alias("outlier"))


@query("K3", "embeddings")
def k3(embeddings):
    """Clusters with the retry, and which least number of neighbours they took; minimum size as in the first run of a corpus."""
    found = with_retry(_points(embeddings))
    return found.groupBy("min_samples").agg(F.count("*").alias("points"), F.count(F.when(F.col("label") == -1, 1)).alias("noise"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("clusters"))


@query("U3", "embeddings")
def u3(embeddings):
    """The condensed tree of all vectors: clusters, their parents, at which density they part and their size."""
    edges, _ = reachability_tree(_points(embeddings), MIN_CLUSTER)
    tree = edges.withColumn("run", F.lit(0)).groupBy("run").applyInPandas(lambda f: condensed(f, MIN_CLUSTER), "parent long, child long, lam double, size long")
    return tree.where("child >= 0").select("parent", "child", F.round("lam", 6).alias("density"), "size")


@query("K1_core", "embeddings", sql=f"""
    WITH d AS (SELECT a.vec_id, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist) AS k FROM d)
    SELECT vec_id, round(dist, 5) AS core FROM r WHERE k = {MIN_CLUSTER}""")
def k1_core(embeddings):
    """The core distance of every vector."""
    cells = Cells(_points(embeddings))
    return nearest(cells, MIN_CLUSTER).select(F.col("id").alias("vec_id"), F.round(F.element_at("near", MIN_CLUSTER)["dist"], 5).alias("core"))
