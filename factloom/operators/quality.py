"""Graph quality: dedupe, ontology rules, completeness and views of the graph (G)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import ontology as O
from factloom.plans.registry import query
from factloom.session import checkpointed

LABELS_SQL = f"dim_label(label, layer) AS ({O.values_sql([(x, k) for k, xs in O.LAYERS.items() for x in xs])})"
RULES_SQL = f"dim_rule(type, from_label, to_label) AS ({O.values_sql([(t, a, b) for t, (xs, ys) in O.REL_RULES.items() for a in xs for b in ys])})"
ALIAS_SQL = f"dim_alias(alias, canonical) AS ({O.values_sql(O.REL_ALIASES)})"
#: Corpus-wide nodes: one row for each id.
GRAPH_SQL = "g AS (SELECT id, min(label) AS label, min(name) AS name FROM nodes GROUP BY id), ge AS (SELECT DISTINCT type, src, dst FROM edges)"


PROPS = ("name", "numeric_value", "unit", "parameter", "confidence")


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: the first label (by document, then label), and of each property the last value that is given."""
    at = F.struct("document_id", "label")
    later = [F.max(F.when(F.col(p).isNotNull(), F.struct("document_id", "label", p)))[p].alias(p) for p in PROPS]
    return nodes.where("id <> '' AND label <> ''").groupBy("id").agg(F.min(at)["label"].alias("label"), *later)


def told_apart(rows: DataFrame, by: str, *keys: str, first: Column | None = None) -> DataFrame:
    """One row for each value of `by` and keys (the first by `first`): dealt out and sorted by `by` once, for repeats and for the look-up of `by` that follows."""
    n = F.row_number().over(Window.partitionBy(by, *keys).orderBy(F.lit(0) if first is None else first))
    return rows.repartition(by).withColumn("n__", n).where("n__ = 1").drop("n__")


def dedupe_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges both of whose ends are nodes, each with the first document that has it."""
    ids = nodes.select("id").distinct()
    e = told_apart(edges.where("type <> '' AND src <> '' AND dst <> ''").select("type", "src", "dst", "document_id"), "src", "type", "dst", first=F.asc_nulls_last("document_id"))
    return e.join(ids, F.col("src") == F.col("id"), "left_semi").join(ids, F.col("dst") == F.col("id"), "left_semi")


def _last_sql(prop: str) -> str:
    return f"max(CASE WHEN {prop} IS NOT NULL THEN {{'document_id': document_id, 'label': label, 'p': {prop}}} END).p AS {prop}"


@query("G1", "nodes", "edges", sql=f"""
    WITH n AS (SELECT id, min({{'document_id': document_id, 'label': label}}).label AS label, {", ".join(map(_last_sql, PROPS))} FROM nodes WHERE id <> '' AND label <> '' GROUP BY id),
         e AS (SELECT type, src, dst, min(document_id) AS document_id FROM edges WHERE type <> '' AND src <> '' AND dst <> '' AND src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY ALL)
    SELECT 'node' AS kind, label AS what, id AS src, NULL::VARCHAR AS dst, name, CAST(numeric_value AS DOUBLE) AS numeric_value, unit, round(CAST(confidence AS DOUBLE), 4) AS confidence, NULL::BIGINT AS document_id FROM n
    UNION ALL SELECT 'edge', type, src, dst, NULL, NULL, NULL, NULL, document_id FROM e""", repeats=True)
def g1(nodes, edges):
    """The graph without repeats: nodes with merged properties and edges."""
    kept = checkpointed(dedupe_nodes(nodes))
    none = lambda t: F.lit(None).cast(t)
    n = kept.select(F.lit("node").alias("kind"), F.col("label").alias("what"), F.col("id").alias("src"), none("string").alias("dst"), "name", F.col("numeric_value").cast("double").alias("numeric_value"), "unit", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), none("long").alias("document_id"))
    e = dedupe_edges(edges, kept).select(F.lit("edge").alias("kind"), F.col("type").alias("what"), "src", "dst", none("string").alias("name"), none("double").alias("numeric_value"), none("string").alias("unit"), none("double").alias("confidence"), "document_id")
    return n.unionByName(e)


def canonical_type(edge_type: Column, from_label: Column | None = None) -> Column:
    upper = F.upper(F.trim(edge_type))
    out = upper
    for alias, name in O.REL_ALIASES.items():
        out = F.when(upper == alias, name).otherwise(out)
    uses = F.lit("USES_MAT") if from_label is None else F.when(from_label == "TechnologySolution", "USES_MATERIAL_TS").otherwise("USES_MAT")
    return F.when(upper == "USES_MATERIAL", uses).otherwise(out)


def sanitise(spark, nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with known labels and some content, and edges of canonical type that the rules allow between them."""
    n = dedupe_nodes(nodes.where(informative())).join(F.broadcast(O.labels(spark)), "label")
    ends = n.select("id", "label")
    e = edges.select("type", "src", "dst").repartition("src").join(ends.withColumnsRenamed({"id": "src", "label": "from_label"}), "src")
    e = e.withColumn("type", canonical_type(F.col("type"), F.col("from_label"))).distinct()  # still dealt out by src
    e = e.join(ends.withColumnsRenamed({"id": "dst", "label": "to_label"}), "dst")
    return n, e.join(F.broadcast(O.relation_rules(spark)), ["type", "from_label", "to_label"], "left_semi")


@query("G2", "nodes", "edges", sql=f"""
    WITH {LABELS_SQL}, {RULES_SQL}, {ALIAS_SQL}, n AS (SELECT DISTINCT id, label FROM nodes WHERE label IN (SELECT label FROM dim_label) AND (label <> 'Measurement' OR numeric_value IS NOT NULL)),
    e AS (SELECT DISTINCT coalesce(canonical, type) AS type, src, dst, a.label AS fl, b.label AS tl FROM edges JOIN n a ON a.id = src JOIN n b ON b.id = dst LEFT JOIN dim_alias ON alias = type)
    SELECT e.type, count(*) AS edges FROM e JOIN dim_rule r ON r.type = e.type AND from_label = fl AND to_label = tl GROUP BY 1""")
def g2(spark, nodes, edges):
    return sanitise(spark, nodes, edges)[1].groupBy("type").agg(F.count("*").alias("edges"))


@query("G3", "events", sql=f"""
    WITH p AS (SELECT event_id, trim(coalesce(json_extract_string(props, '$.k'), event_type)) AS raw, CAST(value AS VARCHAR) || ' %' AS num FROM events)
    SELECT event_id, CASE WHEN lower(raw) IN (SELECT * FROM (VALUES {", ".join("('" + x + "')" for x in O.PLACEHOLDERS)})) THEN NULL ELSE raw END AS cleaned, round(TRY_CAST(replace(replace(num, ',', '.'), ' %', '') AS DOUBLE), 4) AS number FROM p""")
def g3(events):
    """Cleaned values: placeholders to null, numbers from text with comma or percent."""
    raw = F.trim(F.coalesce(F.get_json_object("props", "$.k"), "event_type"))
    number = F.concat(F.col("value").cast("string"), F.lit(" %"))
    return events.select("event_id", clean_text(raw).alias("cleaned"), F.round(clean_number(number), 4).alias("number"))


def clean_text(c: Column) -> Column:
    return F.when(~F.lower(F.trim(c)).isin(*O.PLACEHOLDERS), F.trim(c))


def clean_number(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit(","), F.lit(".")), r"\s*%$", "").try_cast("double")


def informative() -> Column:
    """Whether a node says something: a number for measurements, a name of two characters or more for the others."""
    return F.when(F.col("label") == "Document", True).when(F.col("label") == "Measurement", F.col("numeric_value").isNotNull()).otherwise(F.coalesce(F.length(F.trim("name")) >= 2, F.lit(False)))


@query("G4", "nodes", sql="SELECT label, count(*) FILTER (WHERE CASE WHEN label = 'Document' THEN true WHEN label = 'Measurement' THEN numeric_value IS NOT NULL ELSE coalesce(length(trim(name)) >= 2, false) END) AS kept, count(*) AS n FROM nodes GROUP BY 1")
def g4(nodes):
    return nodes.groupBy("label").agg(F.count(F.when(informative(), 1)).alias("kept"), F.count("*").alias("n"))


@query("G5", "edges", sql=f"WITH {ALIAS_SQL} SELECT coalesce(canonical, upper(trim(type))) AS canonical_type, count(*) AS n FROM edges LEFT JOIN dim_alias ON alias = upper(trim(type)) GROUP BY 1")
def g5(edges):
    return edges.groupBy(canonical_type(F.col("type")).alias("canonical_type")).agg(F.count("*").alias("n"))


@query("G6", "edges", sql=f"WITH d(type, what) AS ({O.values_sql(O.relation_texts())}), t AS (SELECT DISTINCT type FROM edges) SELECT type, coalesce(what, 'Связь типа ' || type) AS description FROM t LEFT JOIN d USING (type)")
def g6(spark, edges):
    d = spark.createDataFrame(list(O.relation_texts().items()), "type string, what string")
    return edges.select("type").distinct().join(F.broadcast(d), "type", "left").select("type", F.coalesce("what", F.concat(F.lit("Связь типа "), "type")).alias("description"))


@query("G7", "nodes", sql="""
    SELECT label, count(*) AS n, round(avg((CAST(name IS NOT NULL AS INT) + CAST(numeric_value IS NOT NULL AS INT) + CAST(unit IS NOT NULL AS INT) + CAST(parameter IS NOT NULL AS INT) + CAST(confidence IS NOT NULL AS INT)) / 5.0), 6) AS filled FROM nodes GROUP BY 1""")
def g7(nodes):
    """Completeness of the expected fields, by label."""
    fields = ("name", "numeric_value", "unit", "parameter", "confidence")
    filled = sum((F.col(c).isNotNull().cast("int") for c in fields), F.lit(0)) / len(fields)
    return nodes.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(filled), 6).alias("filled"))


@query("G8", "nodes", "edges", sql=f"""
    WITH {LABELS_SQL}, n AS (SELECT DISTINCT id FROM nodes JOIN dim_label USING (label) WHERE layer IN ('L1', 'L4')), e AS (SELECT DISTINCT type, src, dst FROM edges)
    SELECT type, count(*) AS n FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY 1""", repeats=True)
def g8(nodes, edges):
    """Edges inside two layers: those of one target are counted by type before they look for it."""
    ids = nodes.where(F.col("label").isin(*O.LAYERS["L1"], *O.LAYERS["L4"])).select("id").distinct()
    e = told_apart(edges.select("type", "src", "dst"), "src", "type", "dst").join(ids, F.col("src") == F.col("id"), "left_semi")
    e = e.groupBy("dst", "type").agg(F.count("*").alias("n")).join(ids, F.col("dst") == F.col("id"), "left_semi")
    return e.groupBy("type").agg(F.sum("n").alias("n"))


@query("G9", "nodes", sql="SELECT DISTINCT id, label FROM nodes WHERE contains(lower(concat_ws(' ', id, label, name, unit, parameter)), '12') ORDER BY id, label LIMIT 200")
def g9(nodes):
    """Nodes by a substring of id, label and values."""
    return nodes.where(F.lower(F.concat_ws(" ", "id", "label", "name", "unit", "parameter")).contains("12")).select("id", "label").distinct().orderBy("id", "label").limit(200)


@query("G10", "nodes", "edges", sql=f"WITH {LABELS_SQL}, {GRAPH_SQL} SELECT ge.type, layer, count(*) AS n FROM ge JOIN g ON g.id = src JOIN dim_label USING (label) GROUP BY 1, 2")
def g10(spark, nodes, edges):
    """Edges by type and by the layer they start from."""
    n = dedupe_nodes(nodes).join(F.broadcast(O.labels(spark)), "label").select("id", "layer")
    return edges.select("type", "src", "dst").distinct().join(n, F.col("src") == F.col("id")).groupBy("type", "layer").agg(F.count("*").alias("n"))


def both_ways(edges: DataFrame) -> DataFrame:
    """node, other, type, dir of every distinct edge, once from each end."""
    e = edges.select("type", "src", "dst").distinct()
    return e.select(F.col("src").alias("node"), F.col("dst").alias("other"), "type", F.lit("out").alias("dir")).unionByName(e.select(F.col("dst").alias("node"), F.col("src").alias("other"), "type", F.lit("in").alias("dir")))


@query("G11", "edges", sql="""
    WITH ge AS (SELECT DISTINCT type, src, dst FROM edges), b AS (SELECT src AS node, dst AS other, 1 AS o, 0 AS i FROM ge UNION ALL SELECT dst, src, 0, 1 FROM ge)
    SELECT node, sum(o)::BIGINT AS outgoing, sum(i)::BIGINT AS incoming, count(DISTINCT other) AS neighbours FROM b GROUP BY 1""")
def g11(edges):
    """Outgoing, incoming and distinct neighbours of every node."""
    return both_ways(edges).groupBy("node").agg(F.count(F.when(F.col("dir") == "out", 1)).alias("outgoing"), F.count(F.when(F.col("dir") == "in", 1)).alias("incoming"), F.count_distinct("other").alias("neighbours"))


@query("G12", "edges", sql="""
    WITH ge AS (SELECT DISTINCT type, src, dst FROM edges), d AS (SELECT src, dst FROM ge WHERE type = 'AUTHORED')
    SELECT d.src, d.dst, ge.type, ge.src AS other_src, ge.dst AS other_dst FROM d JOIN ge ON ge.src = d.src OR ge.dst = d.src WHERE NOT (ge.type = 'AUTHORED' AND ge.src = d.src AND ge.dst = d.dst)""")
def g12(edges):
    """All other edges that touch the author of each authored edge."""
    e = checkpointed(edges.select("type", "src", "dst").distinct())
    d = e.where("type = 'AUTHORED'").select("src", "dst")
    ends = e.select(F.col("src").alias("end"), "type", F.col("src").alias("other_src"), F.col("dst").alias("other_dst")).union(e.where("src <> dst").select("dst", "type", "src", "dst"))
    # few edges touch an author: the others go before they meet authored edges; pairs are made where both are, and not dealt out again
    ends = ends.join(d.select(F.col("src").alias("end")).distinct(), "end", "left_semi")
    own = (F.col("type") == "AUTHORED") & (F.col("other_src") == F.col("src")) & (F.col("other_dst") == F.col("dst"))
    return d.join(ends, (F.col("src") == F.col("end")) & ~own).select("src", "dst", "type", "other_src", "other_dst")


@query("G14", "nodes", sql=f"""
    WITH {LABELS_SQL}, c AS (SELECT document_id, layer, count(*) AS n FROM nodes JOIN dim_label USING (label) GROUP BY 1, 2), l AS (SELECT DISTINCT layer FROM dim_label), d AS (SELECT DISTINCT document_id FROM nodes)
    SELECT document_id, layer, coalesce(n, 0) AS nodes, CASE WHEN n IS NULL THEN 'empty' WHEN n < 3 THEN 'partial' ELSE 'done' END AS status FROM d CROSS JOIN l LEFT JOIN c USING (document_id, layer)""")
def g14(spark, nodes):
    """Nodes and status of all six layers, for each document."""
    c = nodes.join(F.broadcast(O.labels(spark)), "label").groupBy("document_id", "layer").agg(F.count("*").alias("n"))
    d = nodes.select("document_id").distinct().select("document_id", F.explode(F.array(*map(F.lit, O.LAYERS))).alias("layer"))
    return d.join(c, ["document_id", "layer"], "left").select("document_id", "layer", F.coalesce("n", F.lit(0)).cast("long").alias("nodes"), F.when(F.col("n").isNull(), "empty").when(F.col("n") < 3, "partial").otherwise("done").alias("status"))


@query("G15", "edges", sql="WITH k AS (SELECT type, src, dst, max(document_id) AS seq FROM edges GROUP BY 1, 2, 3) SELECT type, src, dst, seq FROM k ORDER BY seq DESC, type, src, dst LIMIT 12")
def g15(edges):
    """The last twelve distinct edges."""
    return edges.groupBy("type", "src", "dst").agg(F.max("document_id").alias("seq")).orderBy(F.desc("seq"), "type", "src", "dst").limit(12)


@query("G16", "nodes", sql=f"""
    WITH {LABELS_SQL} SELECT document_id, {", ".join(f"count(*) FILTER (WHERE layer = '{k}') AS {k}" for k in O.LAYERS)} FROM nodes JOIN dim_label USING (label) GROUP BY 1""")
def g16(spark, nodes):
    """Nodes of each layer, a row for each document."""
    joined = nodes.join(F.broadcast(O.labels(spark)), "label")
    return joined.groupBy("document_id").pivot("layer", list(O.LAYERS)).count().fillna(0)


@query("G18", "nodes", sql="""
    WITH r AS (SELECT document_id, id, row_number() OVER (PARTITION BY id ORDER BY document_id) AS k FROM (SELECT DISTINCT document_id, id FROM nodes))
    SELECT CASE WHEN k = 1 THEN id ELSE CAST(document_id AS VARCHAR) || ':' || id END AS id, document_id FROM r""")
def g18(nodes):
    """Corpus-wide ids: the first document keeps an id, later ones prefix it."""
    return rekeyed(nodes.select("document_id", "id").distinct()).select("new_id", "document_id").withColumnRenamed("new_id", "id")


def rekeyed(nodes: DataFrame) -> DataFrame:
    first = nodes.groupBy("id").agg(F.min("document_id").alias("first_doc"))
    keyed = nodes.join(first, "id")
    return keyed.withColumn("new_id", F.when(F.col("document_id") == F.col("first_doc"), F.col("id")).otherwise(F.concat(F.col("document_id").cast("string"), F.lit(":"), "id")))


def entity_key(label: Column, name: Column, node_id: Column) -> Column:
    """Canonical key: label and slug of the name, 48 characters; the id of what has no name."""
    slug = F.substring(F.regexp_replace(F.lower(F.trim(name)), r"[^\p{L}\p{N}]+", "-"), 1, 48)
    return F.when(label.isin("Material", "Process", "Expert", "Organization", "Location") & (slug != ""), F.concat(F.lower(label), F.lit(":"), slug)).otherwise(node_id)


ENTITY_KEY_SQL = "CASE WHEN label IN ('Material', 'Process', 'Expert', 'Organization', 'Location') AND regexp_replace(lower(trim(name)), '[^\\p{L}\\p{N}]+', '-', 'g') <> '' THEN lower(label) || ':' || left(regexp_replace(lower(trim(name)), '[^\\p{L}\\p{N}]+', '-', 'g'), 48) ELSE id END"


@query("G19", "nodes", sql=f"SELECT label, {ENTITY_KEY_SQL} AS entity, count(*) AS n FROM nodes GROUP BY 1, 2")
def g19(nodes):
    return nodes.groupBy("label", entity_key(F.col("label"), F.col("name"), F.col("id")).alias("entity")).agg(F.count("*").alias("n"))


@query("G20", "nodes", sql=f"""
    WITH k AS (SELECT {ENTITY_KEY_SQL} AS entity, document_id FROM nodes WHERE label IN ('Material', 'Process', 'Expert'))
    SELECT entity, count(DISTINCT document_id) AS documents, array_to_string(list_sort(list_distinct(list(document_id)))[:20], ',') AS first_ids FROM k GROUP BY 1 HAVING count(DISTINCT document_id) >= 2""")
def g20(nodes):
    """Entities of several documents, and the first twenty where they occur: ranked and cut in parts, then together, before ids are collected."""
    k = nodes.where(F.col("label").isin("Material", "Process", "Expert")).select(entity_key(F.col("label"), F.col("name"), F.col("id")).alias("entity"), "document_id").distinct()
    docs = k.groupBy("entity").agg(F.count("*").alias("documents")).where("documents >= 2")
    part = k.withColumn("part", F.pmod(F.xxhash64("document_id"), F.lit(32)))
    few = part.withColumn("r", F.row_number().over(Window.partitionBy("entity", "part").orderBy("document_id"))).where("r <= 20")
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("entity").orderBy("document_id"))).where("r <= 20")
    ids = few.groupBy("entity").agg(F.array_join(F.array_sort(F.collect_list("document_id")).cast("array<string>"), ",").alias("first_ids"))
    return docs.join(ids, "entity").select("entity", "documents", "first_ids")


#: Facets of the graph filter, each a condition on nodes (n) with their document (r); None: not set.
FACETS = {
    "geography": "geography = 'foreign'",
    "language": "lang IN ('en', 'de')",
    "years": "year(material_date) BETWEEN 2000 AND 2018",
    "numeric": "label = 'Measurement' AND numeric_value BETWEEN 10 AND 20",
    "confidence": "confidence >= 0.6",
    "keyword": "label IN ('Material', 'Process') AND lower(name) LIKE '%a%'",
}
#: Facets on single nodes also keep what is one edge away from those.
PULLED = ("numeric", "confidence", "keyword")
#: Facets on the documents of nodes.
ON_DOCUMENTS = ("geography", "language", "years")
TYPES, RELATIONS = ("ExperimentRun", "Measurement", "Material", "Process"), ("USES_MAT", "PRODUCED_MEASUREMENT", "OPERATES_PROC")


def _facet_sql() -> str:
    parts = [f"f_{k} AS (SELECT DISTINCT id FROM x WHERE {c})" for k, c in FACETS.items()]
    parts += [f"k_{k} AS (SELECT id FROM f_{k}" + (f" UNION SELECT other FROM b JOIN f_{k} ON node = id" if k in PULLED else "") + ")" for k in FACETS]
    return ", ".join(parts)


@query("G21", "nodes", "edges", "registry", sql=f"""
    WITH x AS (SELECT n.id, n.label, n.name, n.numeric_value, n.confidence, r.geography, r.lang, r.material_date FROM nodes n JOIN registry r ON r.id = n.document_id), b AS (SELECT src AS node, dst AS other FROM edges WHERE type IN {RELATIONS} UNION SELECT dst, src FROM edges WHERE type IN {RELATIONS}), {_facet_sql()}
    SELECT DISTINCT id FROM x WHERE label IN {TYPES} {" ".join(f"AND id IN (SELECT id FROM k_{k})" for k in FACETS)}""", repeats=True)
def g21(nodes, edges, registry):
    """The advanced filter: nodes of some types that pass every facet; facets on single nodes keep their neighbours (one edge of some types) too."""
    bit = {name: 1 << i for i, name in enumerate((*FACETS, "type"))}
    conditions = {name: F.expr(c) for name, c in FACETS.items()} | {"type": F.col("label").isin(*TYPES)}
    passed = lambda *names: sum((F.when(conditions[name], bit[name]).otherwise(0) for name in names), F.lit(0))
    # facets are told as bits on either side, before nodes and documents meet; nodes that can't count at all don't
    r = registry.select(F.col("id").alias("document_id"), passed(*ON_DOCUMENTS).alias("theirs"))
    x = nodes.select("document_id", "id", passed(*(name for name in bit if name not in ON_DOCUMENTS)).alias("own")).where("own > 0").join(r, "document_id")
    x = checkpointed(x.groupBy("id").agg(F.bit_or(F.col("own").bitwiseOR(F.col("theirs"))).alias("passed")))  # one row for each id: which facets it passes itself
    pulled = sum(bit[name] for name in PULLED)
    e = edges.where(F.col("type").isin(*RELATIONS)).select("src", "dst")
    b = e.union(e.select("dst", "src")).withColumnsRenamed({"src": "id", "dst": "other"})
    near = b.join(x, "id").select(F.col("other").alias("id"), F.col("passed").bitwiseAND(pulled).alias("near")).where("near > 0").groupBy("id").agg(F.bit_or("near").alias("near"))
    every = sum(bit.values())
    own = x.where(F.col("passed").bitwiseAND(every - pulled) == every - pulled).join(near, "id", "left")
    return own.where(F.col("passed").bitwiseOR(F.coalesce("near", F.lit(0))) == every).select("id")


@query("G22", "registry", sql="""
    SELECT CASE WHEN regexp_matches(lower(file_name), 'patent|src1_') THEN 'patent' WHEN regexp_matches(lower(file_name), 'handbook|src2_') THEN 'handbook' WHEN regexp_matches(lower(file_name), 'report|src3_') THEN 'report'
           WHEN regexp_matches(lower(file_name), 'article|src4_') THEN 'article' ELSE 'other' END AS category, count(*) AS documents FROM registry GROUP BY 1""")
def g22(registry):
    """Documents of each category, by words of the file name, first rule first."""
    name, out = F.lower("file_name"), F.lit("other")
    for category, words in reversed((("patent", "patent|src1_"), ("handbook", "handbook|src2_"), ("report", "report|src3_"), ("article", "article|src4_"))):
        out = F.when(name.rlike(words), category).otherwise(out)
    return registry.groupBy(out.alias("category")).agg(F.count("*").alias("documents"))


@query("G24", "edges", sql="""
    WITH t AS (SELECT DISTINCT type, src, dst FROM edges), c AS (SELECT node, count(*) AS links FROM (SELECT src AS node FROM t UNION ALL SELECT dst FROM t) WHERE starts_with(node, 'Measurement:') GROUP BY 1), s AS (SELECT node, row_number() OVER (ORDER BY links DESC, node) <= 15 AS shown FROM c),
         m AS (SELECT DISTINCT type, CASE WHEN a.shown IS NULL OR a.shown THEN src ELSE 'super:Measurement' END AS src, CASE WHEN b.shown IS NULL OR b.shown THEN dst ELSE 'super:Measurement' END AS dst FROM t LEFT JOIN s a ON a.node = src LEFT JOIN s b ON b.node = dst),
         p AS (SELECT *, CASE type WHEN 'PRODUCED_MEASUREMENT' THEN 0 WHEN 'USES_MAT' THEN 1 WHEN 'OPERATES_PROC' THEN 2 ELSE 3 END AS pr FROM m), f AS (SELECT *, row_number() OVER (PARTITION BY starts_with(dst, 'super:') OR starts_with(src, 'super:') ORDER BY pr, type, src, dst) AS k FROM p)
    SELECT type, src, dst FROM f WHERE NOT (starts_with(dst, 'super:') OR starts_with(src, 'super:')) OR k <= 18 ORDER BY pr, type, src, dst LIMIT 150""")
def g24(edges):
    """The compact graph: of many nodes of the text layer (here: measurements) the fifteen with most edges stay and the others become one, which keeps eighteen edges; a hundred and fifty edges in all, by priority."""
    e = edges.select("type", "src", "dst").distinct()
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).where(F.col("node").startswith("Measurement:"))
    shown = ends.groupBy("node").agg(F.count("*").alias("links")).orderBy(F.desc("links"), "node").limit(15).select("node", F.lit(True).alias("shown"))
    for end in ("src", "dst"):
        own = F.broadcast(shown.withColumnRenamed("node", end))  # fifteen rows
        e = e.join(own, end, "left").withColumn(end, F.when(F.col(end).startswith("Measurement:") & F.col("shown").isNull(), "super:Measurement").otherwise(F.col(end))).drop("shown")
    priority = F.when(F.col("type") == "PRODUCED_MEASUREMENT", 0).when(F.col("type") == "USES_MAT", 1).when(F.col("type") == "OPERATES_PROC", 2).otherwise(3)
    e = e.distinct().withColumn("pr", priority)
    order = ("pr", "type", "src", "dst")
    fan = F.col("src").startswith("super:") | F.col("dst").startswith("super:")
    few = e.where(fan).orderBy(*order).limit(18).unionByName(e.where(~fan))
    return few.orderBy(*order).limit(150).select("type", "src", "dst")


@query("G26", "nodes", sql="WITH u AS (SELECT document_id, id, 1 AS round FROM nodes WHERE label <> 'Material' UNION ALL SELECT document_id, id, 2 FROM nodes) SELECT round::BIGINT AS round, count(*) AS n FROM (SELECT document_id, id, min(round) AS round FROM u GROUP BY 1, 2) GROUP BY 1")
def g26(nodes):
    """Nodes that each round of merging layer graphs added (first seen stays)."""
    u = nodes.where("label <> 'Material'").select("document_id", "id", F.lit(1).alias("round")).unionByName(nodes.select("document_id", "id", F.lit(2).alias("round")))
    first = u.groupBy("document_id", "id").agg(F.min("round").cast("long").alias("round"))
    return first.groupBy("round").agg(F.count("*").alias("n"))


@query("G27", "customer", "nation", "region", sql="SELECT DISTINCT v AS value FROM (SELECT n_name AS v FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT c_mktsegment FROM customer) ORDER BY 1")
def g27(customer, nation, region):
    """All values of a filter list."""
    return nation.select(F.col("n_name").alias("value")).union(region.select("r_name")).union(customer.select("c_mktsegment")).distinct().orderBy("value")


@query("G13", "edges", "events", sql="""
    WITH k AS (SELECT document_id, type, src, dst, row_number() OVER (ORDER BY document_id, type, src, dst) - 1 AS n FROM (SELECT DISTINCT document_id, type, src, dst FROM edges WHERE type = 'AUTHORED')), s AS (SELECT count(*) AS total FROM k),
         e AS (SELECT k.document_id, type, src, dst, event_id, event_type AS comment, CAST(user_id AS VARCHAR) AS editor, floor(epoch(ts))::BIGINT AS edited FROM events, s JOIN k ON n = event_id % total),
         h AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY edited DESC, event_id DESC) AS k FROM e), l AS (SELECT *, row_number() OVER (PARTITION BY document_id, type, src, dst ORDER BY edited DESC, event_id DESC) AS q FROM e)
    SELECT 'patch' AS kind, document_id, type, src, dst, event_id, comment, editor, edited FROM l WHERE q = 1 UNION ALL SELECT 'history', document_id, type, src, dst, event_id, comment, editor, edited FROM h WHERE k <= 200""")
def g13(edges, events):
    """Edits of relations: the last comment, editor and time of each edge, and the last two hundred edits of each document. An event edits the edge of its number."""
    e = edges.where("type = 'AUTHORED'").select("document_id", "type", "src", "dst").distinct().orderBy("document_id", "type", "src", "dst")
    numbered = numbered_rows(checkpointed(e), "n", ("document_id", "type", "src", "dst"))
    total = numbered.count()
    if not total:
        return events.select(F.lit("patch").alias("kind")).where("false")
    said = events.select("event_id", F.col("event_type").alias("comment"), F.col("user_id").cast("string").alias("editor"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("edited"), (F.col("event_id") % total).alias("n"))
    return edited(said.join(numbered, "n").drop("n"))


def numbered_rows(df: DataFrame, name: str, order: tuple[str, ...]) -> DataFrame:
    """df with the place of each row in the order: ranked inside ranges of a sort, after the counts of the ranges before."""
    part = df.repartitionByRange(*order).withColumn("part__", F.spark_partition_id())
    part = checkpointed(part)
    sizes = part.groupBy("part__").agg(F.count("*").alias("size__"))  # a row for each range
    before = F.sum("size__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part__", F.coalesce(before, F.lit(0)).alias("before__"))
    own = F.row_number().over(Window.partitionBy("part__").orderBy(*order)) - 1
    return part.withColumn(name, own).join(F.broadcast(sizes), "part__").withColumn(name, (F.col(name) + F.col("before__")).cast("long")).drop("part__", "before__")


def edited(edits: DataFrame, history: int = 200) -> DataFrame:
    """kind, the edge, comment, editor, edited: the last edit of each edge (patch) and the last edits of each document (history)."""
    key = ["document_id", "type", "src", "dst"]
    shown = [*key, "event_id", "comment", "editor", "edited"]
    last = edits.groupBy(*key).agg(F.max(F.struct("edited", "event_id", "comment", "editor")).alias("x")).select(F.lit("patch").alias("kind"), *key, "x.event_id", "x.comment", "x.editor", "x.edited")
    best = [F.desc("edited"), F.desc("event_id")]
    part = edits.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(16)))
    few = part.withColumn("k", F.row_number().over(Window.partitionBy("document_id", "part").orderBy(*best))).where(F.col("k") <= history)
    few = few.withColumn("k", F.row_number().over(Window.partitionBy("document_id").orderBy(*best))).where(F.col("k") <= history)
    return last.unionByName(few.select(F.lit("history").alias("kind"), *shown))


@query("G17", "lines", sql="SELECT doc_id, regexp_extract(CAST(doc_id AS VARCHAR) || ':p:' || CAST(pos AS VARCHAR), ':p:([0-9]+)$', 1)::BIGINT AS idx, line FROM lines WHERE trim(line) <> ''")
def g17(lines):
    """A document's paragraphs, numbered by their ids."""
    node = F.concat(F.col("doc_id").cast("string"), F.lit(":p:"), F.col("pos").cast("string"))
    return lines.where("trim(line) <> ''").select("doc_id", F.regexp_extract(node, ":p:([0-9]+)$", 1).cast("long").alias("idx"), "line")
