"""Clusters of vectors: names, reports, centroids and projection, over given labels (K)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.registry import query
from factloom.session import checkpointed, in_blocks

#: Rows of a side that is sent to every task at a time.
MAX_SENT = 5000
#: Words that name nothing.
STOP = ["the", "and", "with", "for", "from", "that"]
TEXT_SQL = "x AS (SELECT doc_id, source AS cluster, text FROM documents)"


@query("K4", "documents", sql=f"""
    WITH {TEXT_SQL}, w AS (SELECT cluster, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{3,}}')) AS w FROM x), c AS (SELECT cluster, w, count(*) AS n FROM w WHERE w NOT IN {tuple(STOP)} AND NOT regexp_matches(w, '^[0-9]+$') GROUP BY 1, 2),
         r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, w) AS k FROM c) SELECT cluster, string_agg(w, ' · ' ORDER BY k) AS name FROM r WHERE k <= 3 GROUP BY 1""")
def k4(documents):
    return cluster_names(documents.select(F.col("source").alias("cluster"), "text"))


def cluster_names(members: DataFrame) -> DataFrame:
    """cluster, name: its three most frequent words."""
    w = members.select("cluster", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0))).alias("w")).where(~F.col("w").isin(*STOP) & ~F.col("w").rlike("^[0-9]+$"))
    c = w.groupBy("cluster", "w").agg(F.count("*").alias("n"))
    r = c.withColumn("k", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "w"))).where("k <= 3")
    return r.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda s: s["w"]), " · ").alias("name"))


@query("K5", "documents", sql=f"""
    WITH {TEXT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY doc_id) AS k FROM x WHERE trim(text) <> '') SELECT cluster, left(string_agg(left(text, 80), ' · ' ORDER BY k), 220) AS description FROM r WHERE k <= 3 GROUP BY 1""")
def k5(documents):
    """Descriptions from the first three texts."""
    r = documents.where("trim(text) <> ''").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).where("k <= 3")
    parts = F.array_sort(F.collect_list(F.struct("k", F.substring("text", 1, 80).alias("t"))))
    return r.groupBy(F.col("source").alias("cluster")).agg(F.substring(F.array_join(F.transform(parts, lambda s: s["t"]), " · "), 1, 220).alias("description"))


@query("K6", "vectors", "embeddings", sql="SELECT e.vec_id, v.cluster_id, round(v.anomaly_score, 4) AS score, coalesce(v.is_anomaly, false) AS is_anomaly FROM embeddings e LEFT JOIN (SELECT * FROM vectors WHERE collection = 'claims') v USING (vec_id)")
def k6(vectors, embeddings):
    """Labels written back to the points."""
    v = vectors.where("collection = 'claims'").select("vec_id", "cluster_id", "anomaly_score", "is_anomaly")
    return embeddings.select("vec_id").join(v, "vec_id", "left").select("vec_id", "cluster_id", F.round("anomaly_score", 4).alias("score"), F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"))


@query("K7", "vectors", sql="SELECT document_id, count(*) AS points, count(*) FILTER (WHERE cluster_id >= 0) AS labelled, count(*) FILTER (WHERE cluster_id = -1) AS anomalies, count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS clusters FROM vectors GROUP BY 1")
def k7(vectors):
    inside = F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))
    return vectors.groupBy("document_id").agg(F.count("*").alias("points"), F.count(inside).alias("labelled"), F.count(F.when(F.col("cluster_id") == -1, 1)).alias("anomalies"), F.count_distinct(inside).alias("clusters"))


@query("K8", "vectors", sql="SELECT vec_id, document_id, anomaly_score FROM vectors WHERE is_anomaly OR cluster_id = -1 ORDER BY anomaly_score DESC, document_id, vec_id LIMIT 50")
def k8(vectors):
    """The fifty strongest anomalies."""
    return vectors.where("is_anomaly OR cluster_id = -1").orderBy(F.desc("anomaly_score"), "document_id", "vec_id").limit(50).select("vec_id", "document_id", "anomaly_score")


@query("K9", "vectors", "edges", sql="""
    WITH m AS (SELECT 'ExperimentRun:' || CAST(vec_id AS VARCHAR) AS node, cluster_id FROM vectors WHERE cluster_id >= 0 UNION ALL SELECT 'Material:' || CAST(vec_id AS VARCHAR), cluster_id FROM vectors WHERE cluster_id >= 0),
         e AS (SELECT DISTINCT type, src, dst FROM edges), l AS (SELECT type, src, dst, a.cluster_id AS x, b.cluster_id AS y FROM e JOIN m a ON a.node = src JOIN m b ON b.node = dst),
         u AS (SELECT cluster_id, 'member' AS kind, NULL::VARCHAR AS type, node AS src, NULL::VARCHAR AS dst, NULL::INT AS other_cluster FROM m UNION ALL SELECT x, 'internal', type, src, dst, NULL FROM l WHERE x = y UNION ALL SELECT x, 'crossing', type, src, dst, y FROM l WHERE x <> y UNION ALL SELECT y, 'crossing', type, src, dst, x FROM l WHERE x <> y),
         r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, kind ORDER BY type, src, dst) AS k FROM u)
    SELECT cluster_id, kind, type, src, dst, other_cluster FROM r WHERE k <= CASE kind WHEN 'member' THEN 50 ELSE 40 END""")
def k9(vectors, edges):
    """The detail of each cluster: fifty members, forty edges inside and forty to other clusters. A point's label holds for the run and the material of its number."""
    v = vectors.where("cluster_id >= 0")
    m = v.select(F.explode(F.array(*[F.concat(F.lit(f"{x}:"), F.col("vec_id").cast("string")) for x in ("ExperimentRun", "Material")])).alias("node"), "cluster_id")
    e = edges.select("type", "src", "dst").distinct()
    e = e.join(m.withColumnsRenamed({"node": "src", "cluster_id": "x"}), "src").join(m.withColumnsRenamed({"node": "dst", "cluster_id": "y"}), "dst")
    none = F.lit(None)
    row = lambda df, cluster, kind, other: df.select(F.col(cluster).alias("cluster_id"), F.lit(kind).alias("kind"), "type", "src", "dst", other.cast("int").alias("other_cluster"))
    members = row(m.select("cluster_id", none.cast("string").alias("type"), F.col("node").alias("src"), none.cast("string").alias("dst")), "cluster_id", "member", none)
    cross = e.where("x <> y")
    u = members.unionByName(row(e.where("x = y"), "x", "internal", none)).unionByName(row(cross, "x", "crossing", F.col("y"))).unionByName(row(cross, "y", "crossing", F.col("x")))
    u = u.withColumn("part", F.pmod(F.xxhash64("src", "dst"), F.lit(32)))
    order = [F.asc("type"), F.asc("src"), F.asc("dst")]
    few = u.withColumn("k", F.row_number().over(Window.partitionBy("cluster_id", "kind", "part").orderBy(*order))).where("k <= 50")
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("cluster_id", "kind").orderBy(*order)))
    return few.where(F.col("k") <= F.when(F.col("kind") == "member", 50).otherwise(40)).drop("k", "part")


def centroids(vectors: DataFrame) -> DataFrame:
    """cluster_id, centroid: means by dimension."""
    d = vectors.where("cluster_id >= 0").select("cluster_id", F.posexplode("embedding").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return d.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


@query("K10", "vectors", sql="""
    WITH d AS (SELECT vec_id, cluster_id, unnest(generate_series(1, 64)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM vectors), m AS (SELECT cluster_id, i, avg(x) AS m FROM d WHERE cluster_id >= 0 GROUP BY 1, 2),
         s AS (SELECT d.vec_id, m.cluster_id, sqrt(sum((x - m) * (x - m))) AS dist FROM d JOIN m USING (i) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, cluster_id) AS k FROM s)
    SELECT vec_id, cluster_id AS nearest, round(dist, 4) AS distance FROM r WHERE k = 1""")
def k10(vectors):
    """The nearest centroid of every point."""
    square = F.aggregate(F.zip_with("embedding", "centroid", lambda a, b: F.pow(a.cast("double") - b, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
    nearest = lambda part: vectors.select("vec_id", "embedding").join(F.broadcast(part), F.col("cluster_id") >= 0).select("vec_id", F.sqrt(square).alias("dist"), "cluster_id")
    s = in_blocks(checkpointed(centroids(vectors)), "cluster_id", MAX_SENT, nearest)
    best = s.groupBy("vec_id").agg(F.min(F.struct("dist", "cluster_id")).alias("b"))
    return best.select("vec_id", F.col("b.cluster_id").alias("nearest"), F.round("b.dist", 4).alias("distance"))


@query("K11", "vectors", "nodes", sql="""
    SELECT (SELECT count(*) FROM documents) AS documents, count(*) FILTER (WHERE collection = 'chunks') AS chunk_points, count(*) FILTER (WHERE collection = 'claims') AS claim_points, count(*) FILTER (WHERE cluster_id >= 0) AS labelled, count(DISTINCT CASE WHEN cluster_id >= 0 THEN cluster_id END) AS clusters, count(*) FILTER (WHERE is_anomaly) AS anomalies FROM vectors, (SELECT 1 FROM nodes LIMIT 1)""")
def k11(vectors, nodes):
    """The state of clustering over the corpus, in one row."""
    documents = nodes.where("label = 'Document'").agg(F.count_distinct("document_id").alias("documents"))
    inside = F.when(F.col("cluster_id") >= 0, F.col("cluster_id"))
    one = vectors.agg(F.count(F.when(F.col("collection") == "chunks", 1)).alias("chunk_points"), F.count(F.when(F.col("collection") == "claims", 1)).alias("claim_points"), F.count(inside).alias("labelled"), F.count_distinct(inside).alias("clusters"), F.count(F.when(F.col("is_anomaly"), 1)).alias("anomalies"))
    return documents.withColumn("one", F.lit(1)).join(one.withColumn("one", F.lit(1)), "one").drop("one")


def project(vectors: DataFrame, axes: int = 2) -> DataFrame:
    """vec_id, x, y: the first two principal axes. Sums and products are gathered by task (dimensions squared, whatever the rows), so the driver solves a small matrix only; signs make each axis' largest loading positive."""

    def moments(batches):
        n, s, p = 0, 0.0, 0.0
        for b in batches:
            m = np.stack(b["embedding"].to_numpy()).astype(float) if len(b) else np.zeros((0, 1))
            if len(m):
                n, s, p = n + len(m), s + m.sum(0), p + m.T @ m
        if n:
            yield pd.DataFrame({"i": range(len(s)), "n": n, "s": s, "p": list(p)})

    parts = vectors.select("embedding").mapInPandas(moments, "i int, n long, s double, p array<double>")
    d = parts.select("i", "n", "s", F.posexplode("p").alias("j", "v")).groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("v").alias("v")).toPandas().sort_values(["i", "j"])
    dim = int(d["i"].max()) + 1
    mean = (d["s"] / d["n"]).to_numpy().reshape(dim, dim)[:, 0]
    cov = (d["v"] / d["n"]).to_numpy().reshape(dim, dim) - np.outer(mean, mean)
    _, vecs = np.linalg.eigh(cov)
    top = vecs[:, ::-1][:, :axes]
    top = top * np.sign(top[np.abs(top).argmax(0), range(axes)])
    dots = [F.aggregate(F.zip_with("embedding", F.array(*[F.lit(float(x)) for x in top[:, a]]), lambda u, v: u * v), F.lit(0.0), lambda s, z: s + z) - float(mean @ top[:, a]) for a in range(axes)]
    return vectors.select("vec_id", dots[0].alias("x"), dots[1].alias("y"))


@query("K12", "vectors")
def k12(vectors):
    return project(vectors).select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("K13", "vectors", "documents")
def k13(vectors, documents):
    """Points of the map with the name and the size of their cluster and its share of anomalies; names are a cluster's most frequent words."""
    size = vectors.groupBy("cluster_id").agg(F.count("*").alias("members"), F.count(F.when(F.col("is_anomaly"), 1)).alias("anomalies"))
    texts = vectors.where("cluster_id >= 0").select("cluster_id", F.col("document_id").alias("doc_id")).distinct().join(documents.select("doc_id", "text"), "doc_id")
    names = cluster_names(texts.select(F.col("cluster_id").alias("cluster"), "text")).withColumnRenamed("cluster", "cluster_id")
    labels = vectors.select("vec_id", "cluster_id", "is_anomaly").join(size.join(names, "cluster_id", "left"), "cluster_id")
    return project(vectors).join(labels, "vec_id").select("vec_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "cluster_id", "name", "members", "anomalies", "is_anomaly")


@query("K14", "vectors", "nodes", sql="""
    WITH s AS (SELECT document_id, count(*) AS nameless FROM nodes WHERE label = 'Measurement' AND name IS NULL GROUP BY 1), v AS (SELECT document_id, count(*) AS noise FROM vectors WHERE cluster_id = -1 GROUP BY 1)
    SELECT document_id, coalesce(nameless, 0) AS structural, coalesce(noise, 0) AS noise FROM s FULL JOIN v USING (document_id)""")
def k14(vectors, nodes):
    """Structural anomalies and noise, by document."""
    s = nodes.where("label = 'Measurement' AND name IS NULL").groupBy("document_id").agg(F.count("*").alias("s"))
    v = vectors.where("cluster_id = -1").groupBy("document_id").agg(F.count("*").alias("v"))
    return s.join(v, "document_id", "full").select("document_id", F.coalesce("s", F.lit(0)).cast("long").alias("structural"), F.coalesce("v", F.lit(0)).cast("long").alias("noise"))


@query("K15", "vectors", sql="SELECT collection, count(*) FILTER (WHERE cluster_id = -1 OR is_anomaly) AS noise FROM vectors GROUP BY 1")
def k15(vectors):
    return vectors.groupBy("collection").agg(F.count(F.when((F.col("cluster_id") == -1) | F.col("is_anomaly"), 1)).alias("noise"))
