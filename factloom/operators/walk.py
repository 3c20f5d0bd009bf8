"""Walks over the graph: neighbours, bounded search, bridges and paths (W), closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.analytics import edge_layers, layers_of
from factloom.operators.quality import ENTITY_KEY_SQL, LABELS_SQL, entity_key, told_apart
from factloom.plans.registry import query
from factloom.session import checkpointed, small_side

BOTH_SQL = "b AS (SELECT DISTINCT src AS node, dst AS other, type FROM edges UNION SELECT dst, src, type FROM edges)"
HOPS, BUDGET, FAN, SEEDS = 5, 20, 6, 5


#: Nodes of a frontier that are sent to all tasks at most.
SENT_NODES = 200_000


def ends(edges: DataFrame) -> DataFrame:
    """node, other, type: every edge from both ends, repeats included; edges are kept in the shared folder."""
    e = checkpointed(edges.select("src", "dst", "type"))
    return e.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type").union(e.select("dst", "src", "type"))


def edges_at(b: DataFrame, nodes: DataFrame) -> DataFrame:
    """What b (node, ...) has of the nodes (node): few are sent to where the edges are, many meet them in a shuffle."""
    return b.join(small_side(nodes.distinct(), SENT_NODES), "node")


def both(edges: DataFrame) -> DataFrame:
    """node, other, type: every edge from both ends."""
    return edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type").union(edges.select("dst", "src", "type")).distinct()


@query("W1", "edges", sql=f"WITH {BOTH_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY type, other) AS k FROM b) SELECT node, other, type FROM r WHERE k <= 12", repeats=True)
def w1(edges):
    """Twelve neighbours of each node. Repeats share a rank, so that each task cuts a node's edges to those that may be among
    the twelve before they are dealt out (Spark does so for a bound on ranks); no task orders all edges of a hub."""
    b = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type").union(edges.select("dst", "src", "type"))
    few = b.withColumn("k", F.dense_rank().over(Window.partitionBy("node").orderBy("type", "other"))).where("k <= 12")
    return few.select("node", "other", "type").distinct()  # already dealt out by node


def ranked_neighbours(frontier: DataFrame, b: DataFrame, scores: DataFrame, visited: DataFrame, k: int = 6) -> DataFrame:
    """node, other, rank: unvisited neighbours of the frontier by score, then id, k of each at most."""
    n = frontier.join(b, "node").join(visited.select(F.col("node").alias("other")), "other", "left_anti").select("node", "other").distinct()
    n = n.join(scores, "other", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "other"))).where(F.col("rank") <= k)


@query("W2", "edges", "nodes", sql=f"""
    WITH {BOTH_SQL}, s AS (SELECT DISTINCT id AS other, 0.3 AS score FROM nodes WHERE label IN ('ExperimentRun', 'Measurement')), n AS (SELECT DISTINCT node, other FROM b WHERE starts_with(node, 'Material:')),
         r AS (SELECT n.*, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY node ORDER BY coalesce(score, 0) DESC, n.other) AS k FROM n LEFT JOIN s USING (other))
    SELECT node, other, k AS rank FROM r WHERE k <= 6""")
def w2(edges, nodes):
    b = both(edges)
    scores = nodes.where(F.col("label").isin("ExperimentRun", "Measurement")).select(F.col("id").alias("other"), F.lit(0.3).alias("score")).distinct()
    frontier = b.where(F.col("node").startswith("Material:")).select("node").distinct()
    return ranked_neighbours(frontier, b, scores, frontier.where("false")).select("node", "other", F.col("rank").cast("long").alias("rank"))


#: Seeds of each query: the documents it hit best, with their scores.
SEEDS_SQL = f"""hs AS (SELECT query_id, 'Document:' || CAST(document_id AS VARCHAR) AS node, max(score) AS score FROM hits GROUP BY 1, 2), sd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS ord FROM hs)"""


def seeds_of(hits: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Scores (query_id, node, score) of all documents that were hit, and the k best of each query with their order (ord)."""
    hs = hits.groupBy("query_id", F.concat(F.lit("Document:"), F.col("document_id").cast("string")).alias("node")).agg(F.max("score").alias("score"))
    ord_ = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node"))
    return hs, hs.withColumn("ord", ord_).where(F.col("ord") <= k)


def walk_sql(hops: int, budget: int, fan: int, k: int) -> str:
    """The walk's levels, one after the other, as CTEs that end in w(query_id, ord, hop, src, type, node)."""
    out = [f"{BOTH_SQL}, {SEEDS_SQL}, bn AS (SELECT node, other, min(type) AS type FROM b GROUP BY 1, 2), v0 AS (SELECT query_id, ord, 0::BIGINT AS hop, NULL::VARCHAR AS src, NULL::VARCHAR AS type, node FROM sd WHERE ord <= {k})"]
    for h in range(1, hops + 1):
        p = f"v{h - 1}"
        out.append(f"""c{h} AS (SELECT f.query_id, f.ord AS po, f.node AS src, bn.type, bn.other AS node, row_number() OVER (PARTITION BY f.query_id, f.node ORDER BY coalesce(hs.score, 0) DESC, bn.other) AS r
            FROM {p} f JOIN bn ON bn.node = f.node LEFT JOIN hs ON hs.query_id = f.query_id AND hs.node = bn.other WHERE f.hop = {h - 1} AND NOT EXISTS (SELECT 1 FROM {p} v WHERE v.query_id = f.query_id AND v.node = bn.other)),
            o{h} AS (SELECT *, row_number() OVER (PARTITION BY query_id, node ORDER BY po, r) AS rep FROM c{h} WHERE r <= {fan}), t{h} AS (SELECT query_id, max(ord) AS n FROM {p} GROUP BY 1),
            n{h} AS (SELECT o.query_id, n + row_number() OVER (PARTITION BY o.query_id ORDER BY po, r) AS ord, src, type, node FROM o{h} o JOIN t{h} USING (query_id) WHERE rep = 1),
            v{h} AS (SELECT * FROM {p} UNION ALL SELECT query_id, ord, {h}, src, type, node FROM n{h} WHERE ord <= {budget})""")
    return ", ".join([*out, f"w AS (SELECT * FROM v{hops})"])


def walk(b: DataFrame, scores: DataFrame, seeds: DataFrame, hops: int = HOPS, budget: int = BUDGET, fan: int = FAN) -> DataFrame:
    """query_id, ord, hop, src, type, node: the trace of each query's walk from its seeds (query_id, node, ord).

    Level by level, each node of the frontier offers its `fan` best neighbours that weren't seen (by score, then id); what
    several offer goes to the first; in the order of their parents, new nodes are taken until the query has `budget` nodes.
    So a query's state is bounded, whatever the graph; a level reads the edges (node, other, type; repeats don't matter)
    once, is one join and is kept in the shared folder.
    """
    seen = seeds.select("query_id", F.col("ord").cast("long").alias("ord"), F.lit(0).cast("long").alias("hop"), F.lit(None).cast("string").alias("src"), F.lit(None).cast("string").alias("type"), "node")
    seen = checkpointed(seen)
    names = scores.select("query_id", F.col("node").alias("other"), "score")
    for hop in range(1, hops + 1):
        frontier = seen.where(F.col("hop") == hop - 1).select("query_id", F.col("ord").alias("po"), F.col("node").alias("at"))
        near = edges_at(b, frontier.select(F.col("at").alias("node"))).groupBy("node", "other").agg(F.min("type").alias("type")).withColumnRenamed("node", "at")
        offers = frontier.join(near, "at")
        offers = offers.join(seen.select("query_id", F.col("node").alias("other")), ["query_id", "other"], "left_anti").join(names, ["query_id", "other"], "left")
        r = F.row_number().over(Window.partitionBy("query_id", "at").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "other"))
        offers = offers.withColumn("r", r).where(F.col("r") <= fan)
        first = offers.groupBy("query_id", "other").agg(F.min(F.struct("po", "r", "at", "type")).alias("x")).select("query_id", "other", "x.*")
        taken = first.join(seen.groupBy("query_id").agg(F.max("ord").alias("n")), "query_id")
        taken = taken.withColumn("ord", F.col("n") + F.row_number().over(Window.partitionBy("query_id").orderBy("po", "r"))).where(F.col("ord") <= budget)
        new = checkpointed(taken.select("query_id", "ord", F.lit(hop).cast("long").alias("hop"), F.col("at").alias("src"), "type", F.col("other").alias("node")))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


@query("W3", "edges", "hits", sql=f"WITH {walk_sql(HOPS, BUDGET, FAN, SEEDS)} SELECT query_id, ord, hop, src, type, node FROM w")
def w3(edges, hits):
    """The walk from each query's five best documents: five hops, twenty nodes, in order."""
    scores, seeds = seeds_of(hits, SEEDS)
    return walk(ends(edges), scores, seeds)


@query("W4", "hits", sql="""
    WITH b AS (SELECT query_id, node_id, max(score) AS score FROM hits GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS k FROM b) SELECT query_id, node_id, score FROM r WHERE k <= 5""")
def w4(hits):
    """Five seeds for each query, in order of their scores."""
    b = hits.groupBy("query_id", "node_id").agg(F.max("score").alias("score"))
    return b.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))).where("k <= 5").select("query_id", "node_id", "score")


@query("W6", "vectors", sql="WITH s AS (SELECT DISTINCT document_id, cluster_id FROM vectors WHERE vec_id % 50 = 0 AND cluster_id >= 0) SELECT vec_id, document_id, cluster_id FROM vectors SEMI JOIN s USING (document_id, cluster_id)")
def w6(vectors):
    """Facts that share a cluster with a seed, in its document."""
    s = vectors.where("vec_id % 50 = 0 AND cluster_id >= 0").select("document_id", "cluster_id")
    return vectors.join(s, ["document_id", "cluster_id"], "left_semi").select("vec_id", "document_id", "cluster_id")


@query("W8", "nodes", sql=f"""
    WITH k AS (SELECT DISTINCT document_id, id, {ENTITY_KEY_SQL} AS entity FROM nodes WHERE label = 'Material'), s AS (SELECT DISTINCT document_id AS scope, entity FROM k WHERE document_id % 50 = 0), c AS (SELECT entity, count(DISTINCT document_id) AS n FROM k GROUP BY 1),
         r AS (SELECT scope, k.*, n, row_number() OVER (PARTITION BY scope, k.entity ORDER BY document_id, id) AS q FROM k JOIN s USING (entity) JOIN c USING (entity) WHERE document_id <> scope)
    SELECT scope, entity, document_id, id, n AS multi_doc_count FROM r WHERE q <= 10""")
def w8(nodes):
    """Where the entities of a document (each whose id is divisible by 50) occur elsewhere, ten places of each. The first eleven places of an entity hold the ten of any scope, so hot entities are cut before they are joined."""
    k = nodes.where("label = 'Material'").select("document_id", "id", entity_key(F.col("label"), F.col("name"), F.col("id")).alias("entity")).distinct()
    s = k.where("document_id % 50 = 0").select(F.col("document_id").alias("scope"), "entity").distinct()
    per = k.groupBy("entity", "document_id").agg(F.min("id").alias("first"), F.count("*").alias("ids"))
    c = per.groupBy("entity").agg(F.count("*").alias("multi_doc_count"))
    order = Window.partitionBy("entity").orderBy("document_id")
    few = per.withColumn("q", F.row_number().over(order)).where("q <= 11").select("entity", "document_id")
    r = s.join(k.join(few, ["entity", "document_id"], "left_semi"), "entity").where("document_id <> scope").join(c, "entity")
    q = F.row_number().over(Window.partitionBy("scope", "entity").orderBy("document_id", "id"))
    return r.withColumn("q", q).where("q <= 10").select("scope", "entity", "document_id", "id", "multi_doc_count")


@query("W9", "edges", "nodes", sql=f"""
    WITH {LABELS_SQL}, n AS (SELECT DISTINCT id, layer FROM nodes JOIN dim_label USING (label)), e AS (SELECT DISTINCT document_id, type, src, dst FROM edges),
         r AS (SELECT e.*, row_number() OVER (PARTITION BY document_id ORDER BY type, src, dst) AS k FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.layer <> b.layer)
    SELECT document_id, type, src, dst FROM r WHERE k <= 24""")
def w9(spark, edges, nodes):
    """Edges between layers, 24 of a document at most."""
    n = layers_of(spark, nodes)
    e = told_apart(edges.select("document_id", "type", "src", "dst"), "src", "document_id", "type", "dst")
    e = e.join(n.withColumnsRenamed({"id": "src", "layers": "a"}), "src").join(n.withColumnsRenamed({"id": "dst", "layers": "b"}), "dst")
    e = e.where((F.col("a") != F.col("b")) | (F.bit_count("a") > 1))  # some layer of the one isn't the other's
    return e.withColumn("k", F.row_number().over(Window.partitionBy("document_id").orderBy("type", "src", "dst"))).where("k <= 24").select("document_id", "type", "src", "dst")


@query("W10", "nodes", sql=f"""
    WITH k AS (SELECT DISTINCT document_id, {ENTITY_KEY_SQL} AS entity FROM nodes WHERE label IN ('Material', 'Process')), f AS (SELECT *, min(document_id) OVER (PARTITION BY entity) AS first_document FROM k)
    SELECT entity, first_document, document_id FROM f WHERE document_id <> first_document""")
def w10(nodes):
    """Bridges between documents that share an entity: from its first document to each other one, so that they stay linear in its documents and connect the same ones as all pairs would."""
    k = nodes.where(F.col("label").isin("Material", "Process")).select("document_id", entity_key(F.col("label"), F.col("name"), F.col("id")).alias("entity")).distinct()
    first = k.groupBy("entity").agg(F.min("document_id").alias("first_document"))
    return k.join(first, "entity").where("document_id <> first_document").select("entity", "first_document", "document_id")


@query("W11", "edges", "hits", sql=f"""
    WITH {BOTH_SQL}, {SEEDS_SQL}, f AS (SELECT query_id, node FROM sd WHERE ord <= 8), n AS (SELECT DISTINCT node, other FROM b),
         p1 AS (SELECT query_id, f.node AS a, n.other AS mid, 1 AS d, f.node || '>' || n.other AS path FROM f JOIN n ON n.node = f.node), p2 AS (SELECT query_id, a, n.other AS mid, 2 AS d, path || '>' || n.other AS path FROM p1 JOIN n ON n.node = p1.mid WHERE n.other <> a),
         p AS (SELECT query_id, a, mid, d, min(path) AS path FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2) GROUP BY ALL), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, a, mid ORDER BY d, path) AS k FROM p) WHERE k = 1),
         m AS (SELECT x.query_id, x.a, y.a AS b, x.d + y.d AS hops, x.path || '|' || y.path AS path FROM r x JOIN r y ON x.query_id = y.query_id AND x.mid = y.mid AND x.a < y.a WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.node = x.a AND n.other = y.a)),
         s AS (SELECT *, row_number() OVER (PARTITION BY query_id, a, b ORDER BY hops, path) AS k FROM m)
    SELECT query_id, a, b, hops::BIGINT AS hops, path FROM s WHERE k = 1""")
def w11(edges, hits):
    """Shortest paths of up to four hops between a query's eight best documents that aren't linked: two frontiers of two hops, with the way to each node, that meet in the middle (path: from both ends to there)."""
    f = seeds_of(hits, 8)[1].select("query_id", "node")
    b = ends(edges).select("node", "other")
    near = lambda way, frm: checkpointed(edges_at(b, way.select(F.col(frm).alias("node"))).distinct().withColumnRenamed("node", "at"))
    step = lambda way, frm, n: way.join(n, F.col(frm) == F.col("at"))
    n = near(f, "node")
    one = step(f, "node", n).select("query_id", F.col("node").alias("a"), F.col("other").alias("mid"), F.lit(1).alias("d"), F.concat_ws(">", "node", "other").alias("path"))
    two = step(one, "mid", near(one, "mid")).where("other <> a").select("query_id", "a", F.col("other").alias("mid"), F.lit(2).alias("d"), F.concat_ws(">", "path", "other").alias("path"))
    reach = one.union(two).groupBy("query_id", "a", "mid").agg(F.min(F.struct("d", "path")).alias("x")).select("query_id", "a", "mid", "x.*")
    reach = checkpointed(reach)
    y = reach.withColumnsRenamed({"a": "b", "d": "d2", "path": "path2"})
    m = reach.join(y, ["query_id", "mid"]).where("a < b").select("query_id", "a", "b", (F.col("d") + F.col("d2")).cast("long").alias("hops"), F.concat_ws("|", "path", "path2").alias("path"))
    m = m.groupBy("query_id", "a", "b").agg(F.min(F.struct("hops", "path")).alias("x")).select("query_id", "a", "b", "x.*")
    return m.join(n, (F.col("a") == F.col("at")) & (F.col("b") == F.col("other")), "left_anti")


@query("W12", "edges", "nodes", sql=f"""
    WITH {LABELS_SQL}, n AS (SELECT DISTINCT id, layer FROM nodes JOIN dim_label USING (label)), e AS (SELECT DISTINCT type, src, dst FROM edges), k AS (SELECT DISTINCT document_id, {ENTITY_KEY_SQL} AS entity FROM nodes WHERE label IN ('Material', 'Process'))
    SELECT 'cross_layer' AS kind, count(*) AS n FROM e JOIN n a ON a.id = src JOIN n b ON b.id = dst WHERE a.layer <> b.layer UNION ALL SELECT 'bridge', count(*) - count(DISTINCT entity) FROM k""")
def w12(spark, edges, nodes):
    """What discovery finds, by kind."""
    cross = edge_layers(spark, edges, nodes).where("from_layer <> to_layer").select(F.lit("cross_layer").alias("kind"))
    return cross.unionByName(w10(nodes).select(F.lit("bridge").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("W13", "edges", "hits", sql=f"""
    WITH {walk_sql(2, BUDGET, FAN, SEEDS)}, q AS (SELECT DISTINCT query_id FROM hits), g AS (SELECT w.query_id, b.node, b.other, b.type FROM w JOIN b ON b.node = w.node), m AS (SELECT query_id, node, min(ord) AS first_order FROM w GROUP BY 1, 2)
    SELECT g.query_id, g.node, g.type, g.other, x.first_order AS node_order, y.first_order AS other_order, y.node IS NOT NULL AS visited,
           EXISTS (SELECT 1 FROM w WHERE w.query_id = g.query_id AND w.type = g.type AND ((w.src = g.node AND w.node = g.other) OR (w.src = g.other AND w.node = g.node))) AS traversed
    FROM g JOIN m x ON x.query_id = g.query_id AND x.node = g.node LEFT JOIN m y ON y.query_id = g.query_id AND y.node = g.other""")
def w13(edges, hits):
    """The neighbourhood of each query's walk, annotated: when each end was first visited, whether the other end was, and whether the walk took the edge."""
    b = ends(edges)
    scores, seeds = seeds_of(hits, SEEDS)
    w = walk(b, scores, seeds, hops=2)
    m = w.groupBy("query_id", "node").agg(F.min("ord").alias("node_order"))
    g = m.join(edges_at(b, m.select("node")).distinct(), "node")
    g = g.join(m.withColumnsRenamed({"node": "other", "node_order": "other_order"}), ["query_id", "other"], "left")
    took = w.where("src IS NOT NULL").select("query_id", "type", F.col("src").alias("node"), F.col("node").alias("other"))
    took = took.union(took.select("query_id", "type", "other", "node")).distinct().withColumn("took", F.lit(True))
    out = g.join(took, ["query_id", "type", "node", "other"], "left")
    return out.select("query_id", "node", "type", "other", "node_order", "other_order", F.col("other_order").isNotNull().alias("visited"), F.coalesce("took", F.lit(False)).alias("traversed"))


@query("W15", "edges", sql=f"""
    WITH {BOTH_SQL}, o AS (SELECT node, other FROM b), t AS (SELECT o.node, p.other FROM o JOIN o p ON p.node = o.other WHERE starts_with(o.node, 'Process:') UNION SELECT node, other FROM o WHERE starts_with(node, 'Process:'))
    SELECT node, count(DISTINCT other) AS measurements FROM t WHERE starts_with(other, 'Measurement:') GROUP BY 1""")
def w15(edges):
    """Measurements within two hops of an entity."""
    e = edges.select("src", "dst")
    b = e.union(e.select("dst", "src")).withColumnsRenamed({"src": "node", "dst": "mid"})
    measured = F.col("node").startswith("Measurement:")
    one = checkpointed(b.where(F.col("node").startswith("Process:")).repartition("mid").distinct())
    far = b.where(measured & F.col("mid").isNotNull())
    own = checkpointed(far.groupBy("node").agg(F.min("mid").alias("mid"), F.max("mid").alias("last")))  # what a measurement hangs on
    direct = one.where(F.col("mid").startswith("Measurement:")).select("node", F.col("mid").alias("other"))
    own = own.join(direct.select(F.col("other").alias("node")).distinct().withColumn("direct", F.lit(True)), "node", "left")
    # measurements that hang on one node alone are as many as that node has, each once; only the others are told apart by themselves
    alone = (F.col("mid") == F.col("last")) & F.col("direct").isNull()
    times = own.where(alone).groupBy("mid").agg(F.count("*").alias("n"))
    counted = one.join(times, "mid").groupBy("node").agg(F.sum("n").alias("n"))
    rest = checkpointed(own.where(~alone).select("node"))
    if not rest.isEmpty():
        several = one.join(far.join(rest, "node").select("mid", F.col("node").alias("other")).distinct(), "mid").select("node", "other").union(direct)
        counted = counted.union(several.distinct().groupBy("node").agg(F.count("*")))
    return counted.groupBy("node").agg(F.sum("n").alias("measurements"))


@query("G23", "nation", "region", "supplier", sql="""
    WITH RECURSIVE e AS (SELECT 'r' || CAST(n_regionkey AS VARCHAR) AS a, 'n' || CAST(n_nationkey AS VARCHAR) AS b FROM nation UNION ALL SELECT 'n' || CAST(s_nationkey AS VARCHAR), 's' || CAST(s_suppkey AS VARCHAR) FROM supplier),
      c(id) AS (SELECT 'r0' UNION SELECT b FROM e JOIN c ON a = id) SELECT id FROM c""")
def g23(nation, region, supplier):
    """What a node reaches along directed edges."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = nation.select(key("r", "n_regionkey").alias("a"), key("n", "n_nationkey").alias("b")).union(supplier.select(key("n", "s_nationkey"), key("s", "s_suppkey")))
    return closure(e, nation.sparkSession.createDataFrame([("r0",)], "id string"))


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """id of everything that the start reaches along (a, b), the start included."""
    seen, frontier = start, start
    while not frontier.isEmpty():
        frontier = checkpointed(frontier.join(edges, F.col("id") == F.col("a")).select(F.col("b").alias("id")).distinct().join(seen, "id", "left_anti"))
        seen = seen.unionByName(frontier)
    return seen


@query("W7", "vectors", "edges", sql=f"""
    WITH {BOTH_SQL}, s AS (SELECT vec_id, document_id, cluster_id FROM vectors WHERE vec_id % 50 = 0), m AS (SELECT v.document_id FROM vectors v SEMI JOIN (SELECT * FROM s WHERE cluster_id >= 0) c USING (document_id, cluster_id)),
         h0 AS (SELECT DISTINCT 'Document:' || CAST(document_id AS VARCHAR) AS node FROM (SELECT document_id FROM s UNION SELECT document_id FROM m)), h1 AS (SELECT DISTINCT other AS node FROM b WHERE node IN (SELECT node FROM h0) AND other NOT IN (SELECT node FROM h0)),
         h2 AS (SELECT DISTINCT other AS node FROM b WHERE node IN (SELECT node FROM h1) AND other NOT IN (SELECT node FROM h0) AND other NOT IN (SELECT node FROM h1))
    SELECT node, 0::BIGINT AS hop FROM h0 UNION ALL SELECT node, 1 FROM h1 UNION ALL SELECT node, 2 FROM h2""")
def w7(vectors, edges):
    """The subgraph around hits: the documents of the found vectors and of their cluster mates, and what is within two edges of them."""
    s = vectors.where("vec_id % 50 = 0").select("document_id", "cluster_id")
    mates = vectors.join(s.where("cluster_id >= 0"), ["document_id", "cluster_id"], "left_semi").select("document_id")
    seeds = s.select("document_id").union(mates).distinct().select(F.concat(F.lit("Document:"), F.col("document_id").cast("string")).alias("node"))
    return within(both(edges), seeds, 2)


def within(b: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """node, hop of everything that the seeds reach in at most so many hops: one join for each hop over edges and frontiers that are kept in the shared folder."""
    b = checkpointed(b.select(F.col("node").alias("at"), "other").distinct())
    seen = frontier = checkpointed(seeds.select("node", F.lit(0).cast("long").alias("hop")))
    for hop in range(1, hops + 1):
        new = frontier.join(b, F.col("node") == F.col("at")).select(F.col("other").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = checkpointed(new.withColumn("hop", F.lit(hop).cast("long")))
        if frontier.isEmpty():
            break
        seen = checkpointed(seen.unionByName(frontier))
    return seen
