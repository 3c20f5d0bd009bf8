"""Access rules, coverage, risks, activity, confidence and audits (A)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import ontology as O
from factloom.operators.quality import ENTITY_KEY_SQL, LABELS_SQL, both_ways, entity_key, told_apart
from factloom.operators.units import BASE_SQL, SPREAD, in_base_units, spread
from factloom.plans.registry import query

#: Domains of a document by what its name contains; the first rule wins.
DOMAINS = (("hydromet", ("src0_", "leach")), ("ecology", ("src1_", "environment")), ("waste", ("src2_", "tailings")))
WEIGHTS = {"source_reliability": 0.30, "extraction_confidence": 0.25, "corroboration": 0.20, "consistency": 0.15, "recency": 0.10}
DOMAIN_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(file_name), '{w}')" for w in ws) + f" THEN '{d}'" for d, ws in DOMAINS) + " ELSE 'other' END"
ACCESS_SQL = f"access(role, level) AS ({O.values_sql([(r, x) for r, xs in O.ROLES.items() for x in xs])})"
L4 = ", ".join(f"'{x}'" for x in O.LAYERS["L4"])


def domain(name: Column) -> Column:
    out = F.lit("other")
    for d, words in reversed(DOMAINS):
        out = F.when(F.lower(name).rlike("|".join(words)), d).otherwise(out)
    return out


@query("A1", "registry", sql=f"""
    WITH {ACCESS_SQL}, r AS (SELECT DISTINCT role FROM access)
    SELECT role, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM access a WHERE a.role = r.role AND a.level = coalesce(classification, '{O.LEVELS[0]}'))) AS visible, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM access a WHERE a.role = r.role AND a.level = coalesce(classification, '{O.LEVELS[0]}'))) AS hidden
    FROM registry CROSS JOIN r GROUP BY 1""")
def a1(spark, registry):
    """Documents that each role sees and doesn't: counted by level first, so that roles multiply a handful of rows."""
    access = O.role_access(spark)
    levels = registry.groupBy(F.coalesce("classification", F.lit(O.LEVELS[0])).alias("level")).agg(F.count("*").alias("n"))
    pairs = levels.select("level", "n", F.explode(F.array(*map(F.lit, O.ROLES))).alias("role")).join(F.broadcast(access.withColumn("ok", F.lit(1))), ["role", "level"], "left")
    return pairs.groupBy("role").agg(F.coalesce(F.sum(F.when(F.col("ok") == 1, F.col("n"))), F.lit(0)).alias("visible"), F.coalesce(F.sum(F.when(F.col("ok").isNull(), F.col("n"))), F.lit(0)).alias("hidden"))


@query("A2", "registry", sql=f"""
    WITH al(alias, level) AS ({O.values_sql(O.LEVEL_ALIASES)}), r AS (SELECT id, lower(trim(coalesce(CASE id % 4 WHEN 0 THEN ' Public ' WHEN 1 THEN 'strict' ELSE classification END, '{O.LEVELS[0]}'))) AS raw FROM registry)
    SELECT id, CASE WHEN raw IN ({", ".join(f"'{x}'" for x in O.LEVELS)}) THEN raw ELSE coalesce(level, '{O.LEVELS[0]}') END AS level FROM r LEFT JOIN al ON alias = raw""")
def a2(registry):
    given = F.when(F.col("id") % 4 == 0, " Public ").when(F.col("id") % 4 == 1, "strict").otherwise(F.col("classification"))
    return registry.select("id", classification(given).alias("level"))


def classification(given: Column) -> Column:
    raw = F.lower(F.trim(F.coalesce(given, F.lit(O.LEVELS[0]))))
    aliases = F.create_map(*[F.lit(x) for kv in O.LEVEL_ALIASES.items() for x in kv])
    return F.when(raw.isin(*O.LEVELS), raw).otherwise(F.coalesce(aliases[raw], F.lit(O.LEVELS[0])))


@query("A4", "registry", sql=f"SELECT id, {DOMAIN_SQL} AS domain FROM registry")
def a4(registry):
    return registry.select("id", domain(F.col("file_name")).alias("domain"))


@query("A5", "registry", "nodes", sql=f"""
    WITH d AS (SELECT id, {DOMAIN_SQL} AS domain FROM registry), f AS (SELECT document_id, count(DISTINCT id) AS facts FROM nodes WHERE label IN ({L4}) GROUP BY 1),
         c AS (SELECT domain, count(*) AS documents, coalesce(sum(facts), 0)::BIGINT AS facts FROM d LEFT JOIN f ON f.document_id = d.id GROUP BY 1), k(domain) AS (VALUES ('hydromet'), ('ecology'), ('waste'), ('other')),
         z AS (SELECT domain, coalesce(documents, 0) AS documents, coalesce(facts, 0) AS facts FROM k LEFT JOIN c USING (domain))
    SELECT domain, documents, facts, round(CASE WHEN sum(facts) OVER () > 0 THEN 100.0 * facts / sum(facts) OVER () ELSE 100.0 * documents / greatest(sum(documents) OVER (), 1) END, 1) AS pct FROM z""")
def a5(spark, registry, nodes):
    return domain_coverage(spark, registry, nodes)


def domain_coverage(spark, registry: DataFrame, nodes: DataFrame) -> DataFrame:
    """domain, documents, facts and the share of all facts (of all documents, where there is no fact)."""
    facts = nodes.where(F.col("label").isin(*O.LAYERS["L4"])).select("document_id", "id").distinct().groupBy("document_id").agg(F.count("*").alias("facts"))
    d = registry.select("id", domain(F.col("file_name")).alias("domain")).join(facts, F.col("id") == F.col("document_id"), "left")
    c = d.groupBy("domain").agg(F.count("*").alias("documents"), F.coalesce(F.sum("facts"), F.lit(0)).alias("facts"))
    names = spark.createDataFrame([(x,) for x, _ in DOMAINS] + [("other",)], "domain string")
    z = names.join(c, "domain", "left").select("domain", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("facts", F.lit(0)).alias("facts"))
    all_ = Window.partitionBy(F.lit(0))  # a row for each domain
    share = F.when(F.sum("facts").over(all_) > 0, 100.0 * F.col("facts") / F.sum("facts").over(all_)).otherwise(100.0 * F.col("documents") / F.greatest(F.sum("documents").over(all_), F.lit(1)))
    return z.select("domain", "documents", "facts", F.round(share, 1).alias("pct"))


#: Documents that must disagree for a contradiction to count among the risks.
MANY_SOURCES = 12


@query("A6", "vectors", "readings", sql=f"""
    WITH {BASE_SQL}, a AS (SELECT document_id, vec_id, anomaly_score, row_number() OVER (PARTITION BY document_id ORDER BY anomaly_score DESC, vec_id) AS k FROM vectors WHERE is_anomaly),
         s AS (SELECT document_id, cluster_id, count(*) AS n FROM vectors WHERE cluster_id >= 0 AND collection = 'claims' GROUP BY 1, 2 HAVING count(*) <= 2),
         c AS (SELECT parameter, mat, min(document_id) AS document_id FROM rb WHERE base IS NOT NULL GROUP BY parameter, mat, dimension HAVING count(DISTINCT document_id) >= {MANY_SOURCES} AND (max(base) - min(base)) / greatest(abs(min(base)), abs(max(base)), 1e-9) > {SPREAD}),
         z AS (SELECT 'anomaly' AS kind, 2 AS severity, document_id, CAST(vec_id AS VARCHAR) AS item FROM a WHERE k <= 3 UNION SELECT 'sparse', 1, document_id, CAST(cluster_id AS VARCHAR) FROM s UNION SELECT 'contradiction', 3, document_id, parameter || ':' || mat FROM c)
    SELECT kind, severity::BIGINT AS severity, document_id, item FROM z ORDER BY severity DESC, document_id, item LIMIT 24""")
def a6(vectors, readings):
    """The 24 gravest risks: values that many sources contradict each other on, three anomalies of a document at most, clusters of little evidence."""
    return risk_zones(vectors, contradictions(readings))


def contradictions(readings: DataFrame, sources: int = MANY_SOURCES) -> DataFrame:
    """document_id (the first) and item of what at least so many documents give conflicting values for."""
    g = in_base_units(readings).where("base IS NOT NULL").groupBy("parameter", "mat", "dimension").agg(F.min("base").alias("lo"), F.max("base").alias("hi"), F.count_distinct("document_id").alias("documents"), F.min("document_id").alias("document_id"))
    return g.where((F.col("documents") >= sources) & (spread(F.col("lo"), F.col("hi")) > SPREAD)).select("document_id", F.concat_ws(":", "parameter", "mat").alias("item"))


def risk_zones(vectors: DataFrame, conflicts: DataFrame, most: int = 24) -> DataFrame:
    """kind, severity, document_id, item of the gravest risks, each once: conflicts (document_id, item), anomalies, clusters of one or two facts."""
    k = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("anomaly_score"), "vec_id"))
    row = lambda df, kind, severity, item: df.select(F.lit(kind).alias("kind"), F.lit(severity).cast("long").alias("severity"), "document_id", F.col(item).cast("string").alias("item"))
    a = row(vectors.where("is_anomaly").withColumn("k", k).where("k <= 3"), "anomaly", 2, "vec_id")
    s = row(sparse_clusters(vectors.where("collection = 'claims'")), "sparse", 1, "cluster_id")
    return row(conflicts, "contradiction", 3, "item").unionByName(a).unionByName(s).distinct().orderBy(F.desc("severity"), "document_id", "item").limit(most)


def sparse_clusters(vectors: DataFrame) -> DataFrame:
    c = vectors.where("cluster_id >= 0").groupBy("document_id", "cluster_id").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    return c.where("n <= 2")


@query("A7", "vectors", sql="SELECT document_id, cluster_id, count(*) AS n, min(vec_id) AS first FROM vectors WHERE cluster_id >= 0 GROUP BY 1, 2 HAVING count(*) <= 2")
def a7(vectors):
    return sparse_clusters(vectors)


@query("A8", "registry", sql="SELECT id, file_name FROM registry ORDER BY upload_date DESC, id LIMIT 8")
def a8(registry):
    return registry.orderBy(F.desc("upload_date"), "id").limit(8).select("id", "file_name")


@query("A9", "conversations", sql="""
    WITH t AS (SELECT conv_id, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS user_messages, max(turn) AS last FROM conversations GROUP BY 1)
    SELECT conv_id, messages, user_messages, last FROM t ORDER BY last DESC, conv_id LIMIT 5""")
def a9(conversations):
    """The five threads that were active last."""
    t = conversations.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count(F.when(F.col("role") == "user", 1)).alias("user_messages"), F.max("turn").alias("last"))
    return t.orderBy(F.desc("last"), "conv_id").limit(5)


@query("A10", "conversations", sql="SELECT conv_id, turn, role FROM conversations c WHERE turn < coalesce((SELECT min(turn) FROM conversations d WHERE d.conv_id = c.conv_id AND role = 'assistant'), 1000000)")
def a10(conversations):
    """Messages left after each thread is deleted from its first answer onward."""
    anchor = conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.min("turn").alias("anchor"))
    return conversations.join(anchor, "conv_id", "left").where("anchor IS NULL OR turn < anchor").select("conv_id", "turn", "role")


@query("A11", "conversations", sql="SELECT conv_id, left(arg_min(text, turn) FILTER (WHERE role = 'user'), 55) AS title FROM conversations GROUP BY 1")
def a11(conversations):
    """Titles from the first user message."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    return conversations.groupBy("conv_id").agg(F.substring(F.when(F.count(F.when(F.col("role") == "user", 1)) > 0, first), 1, 55).alias("title"))


@query("A12", "nodes", "edges", sql="""
    WITH m AS (SELECT e.dst AS mat, n.parameter, max(n.numeric_value) AS v FROM edges e JOIN edges p ON p.src = e.src AND p.type = 'PRODUCED_MEASUREMENT' JOIN nodes n ON n.id = p.dst WHERE e.type = 'USES_MAT' GROUP BY 1, 2)
    SELECT mat, coalesce(CAST(max(v) FILTER (WHERE parameter = 'O') AS VARCHAR), 'н/д') AS open_value, coalesce(CAST(max(v) FILTER (WHERE parameter = 'F') AS VARCHAR), 'н/д') AS final_value FROM m GROUP BY 1""")
def a12(nodes, edges):
    return comparison(nodes, edges)


def comparison(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For each material the greatest measured value of each parameter two hops away; what is missing is н/д."""
    e = edges.select("type", "src", "dst").distinct()
    pairs = e.where("type = 'USES_MAT'").select("src", F.col("dst").alias("mat")).join(e.where("type = 'PRODUCED_MEASUREMENT'").select("src", F.col("dst").alias("m")), "src")
    values = nodes.where("label = 'Measurement'").groupBy("id", "parameter").agg(F.max("numeric_value").alias("v"))
    wide = pairs.join(values, F.col("m") == F.col("id")).groupBy("mat").pivot("parameter", ["O", "F"]).agg(F.max("v"))
    return wide.select("mat", F.coalesce(F.col("O").cast("string"), F.lit("н/д")).alias("open_value"), F.coalesce(F.col("F").cast("string"), F.lit("н/д")).alias("final_value"))


@query("A13", "nodes", "edges", sql="""
    WITH m AS (SELECT e.dst AS mat, n.parameter, max(n.numeric_value) AS v FROM edges e JOIN edges p ON p.src = e.src AND p.type = 'PRODUCED_MEASUREMENT' JOIN nodes n ON n.id = p.dst WHERE e.type = 'USES_MAT' GROUP BY 1, 2),
         w AS (SELECT mat, max(v) FILTER (WHERE parameter = 'O') AS o, max(v) FILTER (WHERE parameter = 'F') AS f FROM m GROUP BY 1)
    SELECT count(*) AS materials, coalesce(sum(CAST(o IS NULL AS INT) + CAST(f IS NULL AS INT)), 0)::BIGINT AS gaps FROM w""")
def a13(nodes, edges):
    """Materials compared and cells that are missing."""
    gap = sum(((F.col(c) == "н/д").cast("long") for c in ("open_value", "final_value")), F.lit(0))
    return comparison(nodes, edges).agg(F.count("*").alias("materials"), F.coalesce(F.sum(gap), F.lit(0)).alias("gaps"))


@query("A14", "conversations", sql="SELECT conv_id, turn, regexp_matches(lower(text), 'compar|versus| vs |сравн|than') AS comparing FROM conversations")
def a14(conversations):
    return conversations.select("conv_id", "turn", F.lower("text").rlike("compar|versus| vs |сравн|than").alias("comparing"))


@query("A15", "nodes", "edges", "part", sql="""
    WITH m AS (SELECT e.dst AS mat, n.parameter, max(n.numeric_value) AS v FROM edges e JOIN edges p ON p.src = e.src AND p.type = 'PRODUCED_MEASUREMENT' JOIN nodes n ON n.id = p.dst WHERE e.type = 'USES_MAT' GROUP BY 1, 2),
         w AS (SELECT mat, max(v) FILTER (WHERE parameter = 'O') AS o FROM m GROUP BY 1)
    SELECT mat, coalesce(CAST(o AS VARCHAR), CAST(p_size AS VARCHAR)) AS open_value FROM w JOIN part ON mat = 'Material:' || CAST(p_partkey AS VARCHAR)""")
def a15(nodes, edges, part):
    """Gaps filled from another table; known cells stay."""
    fill = part.select(F.concat(F.lit("Material:"), F.col("p_partkey").cast("string")).alias("mat"), F.col("p_size").cast("string").alias("other"))
    return comparison(nodes, edges).join(fill, "mat").select("mat", F.when(F.col("open_value") == "н/д", F.col("other")).otherwise(F.col("open_value")).alias("open_value"))


def composite(components: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """The weighted mean of the components, four decimals; a missing one counts as 0."""
    return F.round(sum((F.coalesce(components[k], F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0)) / sum(weights.values()), 4)


def components(base: Column, verified: Column, confidence: Column, documents: Column, conflicts: Column, years: Column) -> dict[str, Column]:
    return {
        "source_reliability": F.least(F.coalesce(base, F.lit(0.5)) + F.when(verified, 0.10).otherwise(0.0), F.lit(1.0)),
        "extraction_confidence": confidence,
        "corroboration": 1 - F.exp(-0.7 * documents),
        "consistency": 1 / (1 + conflicts),
        "recency": F.pow(F.lit(0.5), F.greatest(years, F.lit(0)) / 8),
    }


@query("A16", "lineitem", sql="""
    SELECT l_orderkey, l_linenumber, round((0.30 * least(0.9 + CASE WHEN l_returnflag = 'A' THEN 0.1 ELSE 0 END, 1.0) + 0.25 * l_discount * 10 + 0.20 * (1 - exp(-0.7 * (l_linenumber % 4))) + 0.15 / (1 + l_linenumber % 3) + 0.10 * power(0.5, (l_linenumber % 9) / 8.0)) / 1.0, 4) AS confidence FROM lineitem""")
def a16(lineitem):
    n = F.col("l_linenumber")
    parts = components(F.lit(0.9), F.col("l_returnflag") == "A", F.col("l_discount") * 10, n % 4, n % 3, n % 9)
    return lineitem.select("l_orderkey", "l_linenumber", composite(parts).alias("confidence"))


@query("A17", "nodes", sql=f"""
    WITH k AS (SELECT {ENTITY_KEY_SQL} AS entity, document_id, confidence FROM nodes WHERE label = 'Material'), c AS (SELECT entity, count(DISTINCT document_id) AS docs, max(confidence) AS conf FROM k GROUP BY 1)
    SELECT entity, docs, round(1 - exp(-0.7 * docs), 4) AS corroboration, round(CAST(least(0.5 + CASE WHEN docs > 3 THEN 0.10 ELSE 0 END, 1.0) AS DOUBLE), 4) AS reliability, round(conf, 4) AS extraction FROM c""")
def a17(nodes):
    """Confidence components of the materials."""
    k = nodes.where("label = 'Material'").select(entity_key(F.col("label"), F.col("name"), F.col("id")).alias("entity"), "document_id", "confidence")
    c = k.groupBy("entity").agg(F.count_distinct("document_id").alias("docs"), F.max("confidence").alias("conf"))
    p = components(F.lit(None).cast("double"), F.col("docs") > 3, F.col("conf"), F.col("docs"), F.lit(0), F.lit(0))
    return c.select("entity", "docs", F.round(p["corroboration"], 4).alias("corroboration"), F.round(p["source_reliability"], 4).alias("reliability"), F.round(p["extraction_confidence"], 4).alias("extraction"))


@query("A18", "nodes", sql="""
    WITH c(label, cap) AS (VALUES ('Expert', 8), ('Measurement', 8), ('Document', 20), ('Material', 12)), r AS (SELECT label, id, cap, row_number() OVER (PARTITION BY label ORDER BY id) AS k FROM (SELECT DISTINCT label, id FROM nodes) JOIN c USING (label))
    SELECT label, id FROM r WHERE k <= cap""")
def a18(spark, nodes):
    """Entities for a synthesis: a fixed number of each label."""
    caps = spark.createDataFrame([("Expert", 8), ("Measurement", 8), ("Document", 20), ("Material", 12)], "label string, cap int")
    r = nodes.select("label", "id").join(F.broadcast(caps), "label").distinct().withColumn("part", F.pmod(F.xxhash64("id"), F.lit(256)))
    # parts of a label are cut first, so that no task orders all of its ids
    r = r.withColumn("k", F.row_number().over(Window.partitionBy("label", "part").orderBy("id"))).where("k <= cap").drop("k")
    return r.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy("id"))).where("k <= cap").select("label", "id")


@query("A19", "nodes", "registry", sql=f"WITH {LABELS_SQL} SELECT label, geography, layer, count(DISTINCT document_id) AS documents FROM nodes JOIN dim_label USING (label) JOIN registry r ON r.id = document_id GROUP BY 1, 2, 3")
def a19(spark, nodes, registry):
    """Source groups by label, geography and layer."""
    r = registry.select(F.col("id").alias("doc"), "geography")
    return nodes.join(F.broadcast(O.labels(spark)), "label").join(r, F.col("document_id") == F.col("doc")).groupBy("label", "geography", "layer").agg(F.count_distinct("document_id").alias("documents"))


COVERAGE_SQL = f"""cov AS (SELECT {ENTITY_KEY_SQL.replace("ELSE id END", "ELSE nodes.id END")} AS entity, bool_or(coalesce(geography = 'domestic', false)) AS d, bool_or(coalesce(geography = 'foreign', false)) AS f FROM nodes JOIN registry r ON r.id = document_id WHERE label = 'Material' GROUP BY 1)"""


@query("A20", "nodes", "registry", sql=f"WITH {COVERAGE_SQL} SELECT entity, CASE WHEN d AND f THEN 'both' WHEN d THEN 'domestic only' WHEN f THEN 'foreign only' ELSE 'unknown' END AS coverage FROM cov")
def a20(nodes, registry):
    return technology_coverage(nodes, registry)


def technology_coverage(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """Whether an entity occurs in domestic documents, foreign ones or both."""
    r = registry.select(F.col("id").alias("doc"), "geography")
    k = nodes.where("label = 'Material'").join(r, F.col("document_id") == F.col("doc"))
    has = lambda g: F.bool_or(F.coalesce(F.col("geography") == g, F.lit(False)))
    cov = k.groupBy(entity_key(F.col("label"), F.col("name"), F.col("id")).alias("entity")).agg(has("domestic").alias("d"), has("foreign").alias("f"))
    return cov.select("entity", F.when(F.col("d") & F.col("f"), "both").when(F.col("d"), "domestic only").when(F.col("f"), "foreign only").otherwise("unknown").alias("coverage"))


@query("A21", "nodes", sql="SELECT label, name, count(*) AS n FROM nodes WHERE name IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def a21(nodes):
    """Evidence that occurs more than once."""
    return nodes.where("name IS NOT NULL").groupBy("label", "name").agg(F.count("*").alias("n")).where("n > 1")


@query("A22", "edges", "nodes", sql="""
    SELECT DISTINCT e.dst AS document, n.id AS expert, n.name FROM edges e JOIN nodes n ON n.id = e.src WHERE e.type = 'AUTHORED' AND n.label = 'Expert'""")
def a22(edges, nodes):
    """Experts beside each document."""
    x = nodes.where("label = 'Expert'").select(F.col("id").alias("expert"), "name").distinct()
    return both_ways(edges.where("type = 'AUTHORED'")).where("dir = 'in'").join(x, F.col("other") == F.col("expert")).select(F.col("node").alias("document"), "expert", "name").distinct()


@query("A26", "edges", "nodes", sql=f"""
    WITH {LABELS_SQL}, n AS (SELECT DISTINCT id, layer FROM nodes JOIN dim_label USING (label)), ge AS (SELECT DISTINCT type, src, dst FROM edges), t AS (SELECT a.layer AS x, b.layer AS y FROM ge JOIN n a ON a.id = src JOIN n b ON b.id = dst)
    SELECT layer, count(*) AS touched FROM (SELECT x AS layer FROM t UNION ALL SELECT y FROM t WHERE y <> x) GROUP BY 1""")
def a26(spark, edges, nodes):
    """Edges that touch each layer."""
    t = edges_by_layers(spark, edges, nodes)
    # edges count once for each layer of either end: once for each pair of layers that has it
    has = lambda c: (F.col(c).bitwiseAND(F.col("x.bit")) != 0).cast("long")
    times = has("a") * F.bit_count("b") + has("b") * (F.bit_count("a") - has("a"))
    x = F.explode(F.array(*(F.struct(F.lit(k).alias("layer"), F.lit(1 << int(k[1:])).cast("long").alias("bit")) for k in O.LAYERS)))
    return t.withColumn("x", x).withColumn("times", times).where("times > 0").groupBy(F.col("x.layer").alias("layer")).agg(F.sum(F.col("n") * F.col("times")).alias("touched"))


def layers_of(spark, nodes: DataFrame) -> DataFrame:
    """id and layers of each node with a known label: a bit for each layer, by its number."""
    bit = F.expr("shiftleft(1L, CAST(substr(layer, 2) AS INT))")
    return nodes.select("id", "label").join(F.broadcast(O.labels(spark)), "label").groupBy("id").agg(F.bit_or(bit).alias("layers"))


def edges_by_layers(spark, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """a, b and n: how many distinct edges have these layers (bits) at either end; edges without a layer at one end aren't counted."""
    n = layers_of(spark, nodes)
    e = told_apart(edges.select("type", "src", "dst"), "src", "type", "dst")
    # edges of one target from the same layers are counted before they look for its layers
    t = e.join(n.withColumnRenamed("id", "src"), "src").groupBy("dst", F.col("layers").alias("a")).agg(F.count("*").alias("n"))
    return t.join(n.withColumnsRenamed({"id": "dst", "layers": "b"}), "dst").groupBy("a", "b").agg(F.sum("n").alias("n"))


def edge_layers(spark, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    n = nodes.join(F.broadcast(O.labels(spark)), "label").select("id", "layer").distinct()
    e = edges.select("type", "src", "dst").distinct()
    return e.join(n.withColumnsRenamed({"id": "src", "layer": "from_layer"}), "src").join(n.withColumnsRenamed({"id": "dst", "layer": "to_layer"}), "dst")


@query("A28", "events", sql="SELECT event_type, count(*) AS calls, round(sum(value), 2) AS tokens, round(avg(CAST(value > 50 AS INT)), 6) AS cached_share FROM events GROUP BY 1")
def a28(events):
    """Usage by kind of call."""
    return events.groupBy("event_type").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 2).alias("tokens"), F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("cached_share"))


#: What says where a fact comes from.
PROVENANCE = ("DATA_SOURCE_FOR", "CONTEXT_FOR", "ABOUT", "PRODUCED_MEASUREMENT")
LOST_SQL = "given AS (SELECT * FROM edges WHERE type <> 'PRODUCED_MEASUREMENT' OR src IN (SELECT 'ExperimentRun:' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'O'))"


def without_provenance(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """The facts (document_id, id) that no edge of the four kinds, in either direction, ties to where they come from."""
    tied = edges.where(F.col("type").isin(*PROVENANCE)).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return facts.select("document_id", "id").distinct().join(tied, "id", "left_anti").select("document_id", "id")


@query("A31", "nodes", "edges", "orders", sql=f"WITH {LOST_SQL} SELECT n.document_id, n.id FROM (SELECT DISTINCT document_id, id FROM nodes WHERE label = 'Measurement') n WHERE NOT EXISTS (SELECT 1 FROM given e WHERE (e.dst = n.id OR e.src = n.id) AND e.type IN {PROVENANCE})")
def a31(nodes, edges, orders):
    """Measurements without provenance, where the runs of open orders don't say what they produced."""
    done = orders.where("o_orderstatus <> 'O'").select(F.concat(F.lit("ExperimentRun:"), F.col("o_orderkey").cast("string")).alias("src"))
    given = edges.where("type <> 'PRODUCED_MEASUREMENT'").unionByName(edges.where("type = 'PRODUCED_MEASUREMENT'").join(done, "src", "left_semi").select(*edges.columns))
    return without_provenance(nodes.where("label = 'Measurement'"), given)


@query("A32", "nodes", sql="SELECT document_id, id, round(confidence, 4) AS confidence FROM nodes WHERE confidence < 0.6")
def a32(nodes):
    return nodes.where("confidence < 0.6").select("document_id", "id", F.round("confidence", 4).alias("confidence"))


MEASURED_SQL = """ms AS (SELECT e.dst AS mat, n.parameter, n.unit, n.numeric_value AS v, n.document_id FROM edges e JOIN edges p ON p.src = e.src AND p.type = 'PRODUCED_MEASUREMENT' JOIN nodes n ON n.id = p.dst WHERE e.type = 'USES_MAT')"""


def measured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """mat, parameter, unit, v, document_id of the measurements of runs that use a material."""
    use = edges.where("type = 'USES_MAT'").select("src", F.col("dst").alias("mat"))
    made = edges.where("type = 'PRODUCED_MEASUREMENT'").select("src", F.col("dst").alias("m"))
    return use.join(made, "src").join(nodes.where("label = 'Measurement'"), F.col("m") == F.col("id")).select("mat", "parameter", "unit", F.col("numeric_value").alias("v"), "document_id")


@query("A37", "edges", "nodes", sql="""
    WITH r AS (SELECT DISTINCT id FROM nodes WHERE label = 'ExperimentRun'), t AS (SELECT src, bool_or(type = 'USES_MAT') AS m, bool_or(type = 'OPERATES_PROC') AS o, bool_or(type = 'PRODUCED_MEASUREMENT') AS p FROM edges GROUP BY 1),
         mp AS (SELECT DISTINCT m.dst AS mat, p.dst AS proc FROM edges m JOIN edges p ON p.src = m.src WHERE m.type = 'USES_MAT' AND p.type = 'OPERATES_PROC'), np AS (SELECT count(DISTINCT id) AS n FROM nodes WHERE label = 'Process')
    SELECT 'run' AS kind, id, concat_ws(',', CASE WHEN m IS NOT TRUE THEN 'material' END, CASE WHEN o IS NOT TRUE THEN 'process' END, CASE WHEN p IS NOT TRUE THEN 'result' END) AS lacks, NULL::BIGINT AS pairs FROM r LEFT JOIN t ON src = id WHERE m IS NOT TRUE OR o IS NOT TRUE OR p IS NOT TRUE
    UNION ALL SELECT 'material', id, 'process', n - count(proc) FROM (SELECT DISTINCT id FROM nodes WHERE label = 'Material') LEFT JOIN mp ON mat = id, np GROUP BY id, n HAVING n > count(proc)""")
def a37(edges, nodes):
    """Runs that lack a material, a process or a result, and how many processes no run has tried on each material; the pairs themselves aren't spelled out."""
    has = lambda t: F.bool_or(F.col("type") == t)
    t = edges.groupBy("src").agg(has("USES_MAT").alias("m"), has("OPERATES_PROC").alias("o"), has("PRODUCED_MEASUREMENT").alias("p"))
    lacks = F.concat_ws(",", *(F.when(~F.coalesce(c, F.lit(False)), name) for c, name in (("m", "material"), ("o", "process"), ("p", "result"))))
    runs = nodes.where("label = 'ExperimentRun'").select("id").distinct().join(t, F.col("id") == F.col("src"), "left").select(F.lit("run").alias("kind"), "id", lacks.alias("lacks"), F.lit(None).cast("long").alias("pairs")).where("lacks <> ''")
    of = lambda t, name: edges.where(F.col("type") == t).select("src", F.col("dst").alias(name)).distinct()
    tried = of("USES_MAT", "id").join(of("OPERATES_PROC", "proc"), "src").groupBy("id").agg(F.count_distinct("proc").alias("n"))
    every = nodes.where("label = 'Process'").agg(F.count_distinct("id").alias("processes"))
    left = nodes.where("label = 'Material'").select("id").distinct().join(tried, "id", "left").join(F.broadcast(every), F.lit(True)).withColumn("pairs", F.col("processes") - F.coalesce("n", F.lit(0)))  # one row
    return runs.unionByName(left.where("pairs > 0").select(F.lit("material").alias("kind"), "id", F.lit("process").alias("lacks"), "pairs"))


SIDES = ("Material", "ExperimentRun", "Expert")
SIDES_SQL = f"SELECT label, id, bool_or(coalesce(geography = 'domestic', false)) AS d, bool_or(coalesce(geography = 'foreign', false)) AS f FROM nodes JOIN registry r ON r.id = document_id WHERE label IN {SIDES} GROUP BY 1, 2"


@query("A38", "nodes", "registry", sql=f"WITH cov AS ({SIDES_SQL.replace('SELECT label, id', 'SELECT label, nodes.id')}) SELECT label, id, CASE WHEN d THEN 'domestic only' WHEN f THEN 'foreign only' ELSE 'no geography' END AS side FROM cov WHERE NOT (d AND f)")
def a38(nodes, registry):
    """What the literature covers from one side only, or from documents without geography."""
    r = registry.select(F.col("id").alias("document_id"), "geography")
    has = lambda g: F.bool_or(F.coalesce(F.col("geography") == g, F.lit(False)))
    cov = nodes.where(F.col("label").isin(*SIDES)).join(r, "document_id").groupBy("label", "id").agg(has("domestic").alias("d"), has("foreign").alias("f"))
    return cov.where("NOT (d AND f)").select("label", "id", F.when(F.col("d"), "domestic only").when(F.col("f"), "foreign only").otherwise("no geography").alias("side"))


@query("A40", "nodes", "edges", sql=f"WITH {MEASURED_SQL} SELECT parameter, max(v) FILTER (WHERE mat = 'Material:1') AS m1, max(v) FILTER (WHERE mat = 'Material:2') AS m2, max(v) FILTER (WHERE mat = 'Material:3') AS m3 FROM ms WHERE mat IN ('Material:1', 'Material:2', 'Material:3') GROUP BY 1")
def a40(nodes, edges):
    """A parameter table for three entities."""
    chosen = {f"Material:{i}": f"m{i}" for i in (1, 2, 3)}
    m = measured(nodes, edges.where((F.col("type") != "USES_MAT") | F.col("dst").isin(*chosen)))
    return m.groupBy("parameter").pivot("mat", list(chosen)).agg(F.max("v")).withColumnsRenamed(chosen)


@query("A41", "edges", "nodes", sql=f"WITH {LABELS_SQL}, n AS (SELECT DISTINCT id, layer FROM nodes JOIN dim_label USING (label)), ge AS (SELECT DISTINCT type, src, dst FROM edges) SELECT count(*) AS edges, count(*) FILTER (WHERE a.layer <> b.layer) AS cross_layer FROM ge JOIN n a ON a.id = src JOIN n b ON b.id = dst", repeats=True)
def a41(spark, edges, nodes):
    """Edges, and those between layers: once for each pair of layers that their ends have."""
    pairs = F.bit_count("a").cast("long") * F.bit_count("b")
    same = F.bit_count(F.col("a").bitwiseAND(F.col("b"))).cast("long")
    total = lambda n: F.coalesce(F.sum(F.col("n") * n), F.lit(0)).cast("long")
    return edges_by_layers(spark, edges, nodes).agg(total(pairs).alias("edges"), total(pairs - same).alias("cross_layer"))
