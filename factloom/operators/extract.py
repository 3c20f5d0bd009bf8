"""Text to typed nodes and edges: layers, dictionaries, measurements, bridges and metadata (E)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import ontology as O
from factloom.operators.text import CHUNK, chunk_sql, chunks
from factloom.plans.registry import query

NUMBER = r"(\d+(?:[.,]\d+)?)\s*(mg|kg|km|cm|mm|°C|%|g|m|s|h)\b"


@query("E1", "documents", sql=f"""
    WITH RECURSIVE {chunk_sql(CHUNK)}, p AS (SELECT doc_id, idx, kind, CAST(doc_id AS VCHAR) || CASE kind WHEN 'heading' THEN ':h:' ELSE ':p:' END || CAST(idx AS VCHAR) AS id FROM chunked),
         n AS (SELECT *, lag(id) OVER (PARTITION BY doc_id ORDER BY idx) AS prev FROM p WHERE kind <> 'heading'), h AS (SELECT *, last_value(CASE WHEN kind = 'heading' THEN id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM p),
         l AS (SELECT doc_id, 'lang:' || coalesce(lang, 'und') AS lang FROM documents)
    SELECT doc_id, CASE kind WHEN 'heading' THEN 'HAS_HEADER' ELSE 'HAS_PARAGRAPH' END AS type, 'doc:' || CAST(doc_id AS VCHAR) AS src, id AS dst, idx FROM p
    UNION ALL SELECT doc_id, 'NEXT_PARAGRAPH', prev, id, idx FROM n WHERE prev IS NOT NULL UNION ALL SELECT doc_id, 'STRUCTURING', head, id, idx FROM h WHERE kind <> 'heading' AND head IS NOT NULL
    UNION ALL SELECT doc_id, 'TAGGED_WITH', id, lang, idx FROM p JOIN l USING (doc_id) WHERE kind <> 'heading' UNION ALL SELECT doc_id, 'HAS_LANG', 'doc:' || CAST(doc_id AS VCHAR), lang, NULL FROM l""".replace("VCHAR", "VARCHAR"))
def e1(documents):
    """Edges of the paragraph layer: chunks packed to 1200 characters, headings, order, the heading above, and the language."""
    return paragraph_layer(chunks(documents.select("doc_id", "text")), documents.select("doc_id", "lang"))


def paragraph_layer(parts: DataFrame, langs: DataFrame) -> DataFrame:
    """doc_id, type, src, dst, idx of the chunks (doc_id, idx, kind) and of the documents' languages."""
    doc, head = F.concat(F.lit("doc:"), F.col("doc_id").cast("string")), F.col("kind") == "heading"
    name = F.concat(F.col("doc_id").cast("string"), F.when(head, ":h:").otherwise(":p:"), F.col("idx").cast("string"))
    upto = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("doc_id", head).orderBy("idx")
    p = parts.select("doc_id", F.col("idx").cast("long").alias("idx"), "kind").withColumn("id", name)
    p = p.withColumns({"above": F.last(F.when(head, F.col("id")), ignorenulls=True).over(upto), "prev": F.lag("id").over(own)})
    lang = F.concat(F.lit("lang:"), F.coalesce("lang", F.lit("und"))).alias("lang")
    p = p.join(langs.select("doc_id", lang), "doc_id")
    edge = lambda kind, src, dst: F.struct(F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"))
    has = F.when(head, edge("HAS_HEADER", doc, F.col("id"))).otherwise(edge("HAS_PARAGRAPH", doc, F.col("id")))
    body = F.array(edge("NEXT_PARAGRAPH", F.col("prev"), F.col("id")), edge("STRUCTURING", F.col("above"), F.col("id")), edge("TAGGED_WITH", F.col("id"), F.col("lang")))
    edges = F.concat(F.array(has), F.when(head, F.array_except(F.array(has), F.array(has))).otherwise(F.filter(body, lambda e: e["src"].isNotNull())))
    out = p.select("doc_id", F.explode(edges).alias("e"), "idx").select("doc_id", "e.type", "e.src", "e.dst", "idx")
    return out.unionByName(langs.select("doc_id", F.lit("HAS_LANG").alias("type"), doc.alias("src"), lang.alias("dst"), F.lit(None).cast("long").alias("idx")))


@query("E2", "registry", sql="""
    WITH d AS (SELECT id, CAST(id AS VARCHAR) AS k, coalesce(classification, 'открытый') AS level FROM registry)
    SELECT id AS document_id, 'node' AS kind, 'SecurityRole' AS what, 'role:' || level AS src, NULL::VARCHAR AS dst, level AS status, NULL::DOUBLE AS confidence FROM d UNION ALL SELECT id, 'node', 'VerificationStatus', 'verification:' || k, NULL, 'preliminary', 0.5 FROM d
    UNION ALL SELECT id, 'node', 'AuditTrail', 'audit:' || k, NULL, NULL, NULL FROM d UNION ALL SELECT id, 'edge', 'GOVERNED_BY', 'doc:' || k, 'role:' || level, NULL, NULL FROM d UNION ALL SELECT id, 'edge', 'WRITES_LOG', 'verification:' || k, 'audit:' || k, NULL, NULL FROM d""")
def e2(registry):
    """Nodes and edges of the validation layer."""
    key = lambda p: F.concat(F.lit(p), F.col("id").cast("string"))
    level = F.coalesce("classification", F.lit("открытый"))
    role, none, text = F.concat(F.lit("role:"), level), F.lit(None).cast("double"), F.lit(None).cast("string")
    row = lambda kind, what, src, dst, status, conf: F.struct(F.lit(kind).alias("kind"), F.lit(what).alias("what"), src.alias("src"), dst.alias("dst"), status.alias("status"), conf.alias("confidence"))
    rows = F.array(
        row("node", "SecurityRole", role, text, level, none),
        row("node", "VerificationStatus", key("verification:"), text, F.lit("preliminary"), F.lit(0.5)),
        row("node", "AuditTrail", key("audit:"), text, text, none),
        row("edge", "GOVERNED_BY", key("doc:"), role, text, none),
        row("edge", "WRITES_LOG", key("verification:"), key("audit:"), text, none),
    )
    return registry.select(F.col("id").alias("document_id"), F.explode(rows).alias("r")).select("document_id", "r.*")


TERMS_SQL = "terms AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}]{6,}')) AS term FROM benchmark)"


@query("E3", "documents", "benchmark", sql=f"WITH {TERMS_SQL}, t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS term FROM documents) SELECT doc_id, term FROM t JOIN terms USING (term)")
def e3(documents, benchmark):
    return dictionary_mentions(documents.select("doc_id", "text"), dictionary(benchmark))


def dictionary(texts: DataFrame) -> DataFrame:
    """term: the distinct long words of the texts."""
    return texts.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{6,}"), F.lit(0))).alias("term")).distinct()


def dictionary_mentions(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, term: each term that a document says as a whole word, once; words are made distinct inside a row before they shuffle."""
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))).alias("term"))
    return words.join(terms, "term").select("doc_id", "term").distinct()


@query("E4", "part", sql="SELECT lower(w) AS term, max(p_partkey) AS node FROM (SELECT p_partkey, p_name AS w FROM part UNION ALL SELECT p_partkey, p_brand FROM part UNION ALL SELECT p_partkey, p_type FROM part) WHERE length(w) >= 3 GROUP BY 1")
def e4(part):
    """A term dictionary from nodes: the last node that has a term wins."""
    t = part.select("p_partkey", F.explode(F.array("p_name", "p_brand", "p_type")).alias("w")).where("length(w) >= 3")
    return t.groupBy(F.lower("w").alias("term")).agg(F.max("p_partkey").alias("node"))


#: Words after which a process or a material is named (the corpus' languages), and the shape of a formula.
HEADS = {"process": ("process", "method", "technology", "процесс", "метод", "технология", "the", "der", "la"), "material": ("material", "alloy", "материал", "сплав", "of", "von", "de")}
FORMULA = r"(?:[A-Z][a-z]?[0-9]*){2,}"


def heads_pattern(kind: str) -> str:
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{'|'.join(HEADS[kind])}) ((?:[\p{{L}}\p{{N}}]+ ?){{1,4}})"


@query("E5", "documents", sql=" UNION ALL ".join(
    [f"SELECT doc_id, '{k}' AS kind, term FROM (SELECT DISTINCT doc_id, trim(lower(unnest(regexp_extract_all(text, '{heads_pattern(k)}', 1)))) AS term FROM documents)" for k in HEADS]
    + [f"SELECT doc_id, 'formula', term FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{FORMULA}')) AS term FROM documents) WHERE regexp_matches(term, '[0-9]')"]))
def e5(documents):
    """Generic mentions when there is no dictionary: up to four words after a word for processes or materials, and chemical formulas."""
    def named(kind: str) -> Column:
        terms = F.transform(F.regexp_extract_all("text", F.lit(heads_pattern(kind)), F.lit(1)), lambda t: F.trim(F.lower(t)))
        return F.transform(F.array_distinct(terms), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("term")))

    found = [named(k) for k in HEADS]
    formulas = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(FORMULA), F.lit(0))), lambda t: t.rlike("[0-9]"))
    found.append(F.transform(formulas, lambda t: F.struct(F.lit("formula").alias("kind"), t.alias("term"))))
    return documents.select("doc_id", F.explode(F.concat(*found)).alias("m")).select("doc_id", "m.kind", "m.term")


@query("E6", "lines", "notes", sql=f"""
    WITH t AS (SELECT 'text' AS part, doc_id, pos, line FROM lines UNION ALL SELECT 'note', doc_id, pos, line FROM notes), m AS (SELECT part, doc_id, pos, regexp_extract_all(line, '{NUMBER}', 1) AS v, regexp_extract_all(line, '{NUMBER}', 2) AS u FROM t),
         x AS (SELECT part, doc_id, pos, unnest(generate_series(1, len(v))) AS k, unnest(v) AS v, unnest(u) AS unit FROM m)
    SELECT part, doc_id, pos, k - 1 AS match, CAST(replace(v, ',', '.') AS DOUBLE) AS value, unit, part || ':' || CAST(doc_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR) || ':' || CAST(k - 1 AS VARCHAR) AS id, 0.35::DOUBLE AS confidence FROM x""")
def e6(lines, notes):
    """Measurements in the lines of texts and in notes."""
    columns = lambda df, part: df.select(F.lit(part).alias("part"), "doc_id", "pos", "line")
    return measurements(columns(lines, "text").unionByName(columns(notes, "note")))


def measurements(lines: DataFrame) -> DataFrame:
    """part, doc_id, pos, match, value, unit, id, confidence of every number with a unit."""
    pairs = F.arrays_zip(F.regexp_extract_all("line", F.lit(NUMBER), F.lit(1)).alias("v"), F.regexp_extract_all("line", F.lit(NUMBER), F.lit(2)).alias("u"))
    m = lines.select("part", "doc_id", "pos", F.posexplode(pairs).alias("match", "m"))
    value = F.replace(F.col("m.v"), F.lit(","), F.lit(".")).cast("double")
    name = F.concat_ws(":", "part", F.col("doc_id").cast("string"), F.col("pos").cast("string"), F.col("match").cast("string"))
    return m.select("part", "doc_id", "pos", F.col("match").cast("long").alias("match"), value.alias("value"), F.col("m.u").alias("unit"), name.alias("id"), F.lit(0.35).alias("confidence"))


ENTITY = "struct<id:string,tmp_id:string,label:string,props:string>"
LINK = "struct<type:string,from:string,to:string>"
PARSED_SQL = """pj AS (SELECT document_id, CAST(regexp_extract(raw, '(?s)(\\{.*\\})', 1) AS JSON) AS j FROM payloads), pn AS (SELECT document_id, unnest(CAST(j -> '$.nodes' AS JSON[])) AS x, unnest(generate_series(1, CAST(json_array_length(j, '$.nodes') AS BIGINT))) AS k FROM pj),
    pnode AS (SELECT document_id, k - 1 AS seq, coalesce(nullif(x ->> '$.id', ''), nullif(x ->> '$.tmp_id', '')) AS id, x ->> '$.label' AS label, CASE WHEN json_type(x, '$.props') = 'OBJECT' THEN x ->> '$.props.lang' END AS lang, CASE WHEN json_type(x, '$.props') = 'OBJECT' THEN x ->> '$.props.file' END AS file FROM pn),
    pl AS (SELECT document_id, unnest(CAST(j -> '$.edges' AS JSON[])) AS x FROM pj), pedge AS (SELECT document_id, x ->> '$.type' AS type, x ->> '$.from' AS src, x ->> '$.to' AS dst FROM pl)"""


def parsed(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (document_id, seq, id, label, props) and edges (document_id, type, src, dst) of model payloads: from the first brace to the last; nodes need an id (or a temporary one) and a label, edges a type and both ends; properties that aren't an object go."""
    inner = F.regexp_extract("raw", r"(?s)(\{.*\})", 1)
    j = payloads.select("document_id", F.from_json(inner, f"nodes array<{ENTITY}>, edges array<{LINK}>").alias("j"))
    n = j.select("document_id", F.posexplode("j.nodes").alias("seq", "x"))
    key = F.coalesce(F.nullif(F.col("x.id"), F.lit("")), F.nullif(F.col("x.tmp_id"), F.lit("")))
    props = F.when(F.col("x.props").startswith("{"), F.from_json("x.props", "map<string,string>"))
    nodes = n.select("document_id", F.col("seq").cast("long").alias("seq"), key.alias("id"), F.col("x.label").alias("label"), props.alias("props")).where("id IS NOT NULL AND label <> ''")
    e = j.select("document_id", F.explode("j.edges").alias("x"))
    return nodes, e.select("document_id", "x.type", F.col("x.from").alias("src"), F.col("x.to").alias("dst")).where("type <> '' AND src <> '' AND dst <> ''")


@query("E7", "payloads", sql=f"""
    WITH {PARSED_SQL} SELECT document_id, 'node' AS kind, label AS what, id AS src, NULL::VARCHAR AS dst, coalesce(lang, file) AS prop FROM pnode WHERE id IS NOT NULL AND label <> '' UNION ALL SELECT document_id, 'edge', type, src, dst, NULL FROM pedge WHERE type <> '' AND src <> '' AND dst <> ''""")
def e7(payloads):
    """Model payloads parsed and made regular."""
    nodes, edges = parsed(payloads)
    n = nodes.select("document_id", F.lit("node").alias("kind"), F.col("label").alias("what"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst"), F.coalesce(F.col("props")["lang"], F.col("props")["file"]).alias("prop"))
    return n.unionByName(edges.select("document_id", F.lit("edge").alias("kind"), F.col("type").alias("what"), "src", "dst", F.lit(None).cast("string").alias("prop")))


META_SQL = """mj AS (SELECT document_id, CAST(raw AS JSON) AS j FROM metas), ma AS (SELECT document_id, trim(unnest(CAST(j -> '$.authors' AS VARCHAR[]))) AS name FROM mj),
    mn AS (SELECT document_id, 'Expert' AS label, 'expert:' || name AS id, name FROM ma WHERE name <> '' UNION ALL SELECT document_id, 'Organization', 'org:' || (j ->> '$.organization'), j ->> '$.organization' FROM mj WHERE j ->> '$.organization' <> '' UNION ALL SELECT document_id, 'Location', 'location:' || (j ->> '$.location'), j ->> '$.location' FROM mj WHERE j ->> '$.location' <> '')"""


def meta_nodes(metas: DataFrame) -> DataFrame:
    """document_id, label, id, name of the authors, the organization and the location in flat metadata; blank ones go."""
    m = metas.select("document_id", F.from_json("raw", "authors array<string>, organization string, location string").alias("m"))
    item = lambda label, prefix, name: F.struct(F.lit(label).alias("label"), F.concat(F.lit(prefix), name).alias("id"), name.alias("name"))
    all_ = F.concat(F.transform(F.col("m.authors"), lambda a: item("Expert", "expert:", F.trim(a))), F.array(item("Organization", "org:", F.col("m.organization")), item("Location", "location:", F.col("m.location"))))
    return m.select("document_id", F.explode(F.filter(all_, lambda x: x["name"] != "")).alias("x")).select("document_id", "x.*")


@query("E8", "metas", sql=f"""
    WITH {META_SQL} SELECT document_id, 'node' AS kind, label AS what, id AS src, NULL::VARCHAR AS dst FROM mn UNION ALL SELECT document_id, 'edge', CASE label WHEN 'Expert' THEN 'AUTHORED' WHEN 'Organization' THEN 'BELONGS_TO' ELSE 'ISSUED_AT' END,
           CASE label WHEN 'Expert' THEN id ELSE 'doc:' || CAST(document_id AS VARCHAR) END, CASE label WHEN 'Expert' THEN 'doc:' || CAST(document_id AS VARCHAR) ELSE id END FROM mn""")
def e8(metas):
    """Nodes and edges from flat metadata."""
    n = meta_nodes(metas)
    doc, expert = F.concat(F.lit("doc:"), F.col("document_id").cast("string")), F.col("label") == "Expert"
    kind = F.when(expert, "AUTHORED").when(F.col("label") == "Organization", "BELONGS_TO").otherwise("ISSUED_AT")
    e = n.select("document_id", F.lit("edge").alias("kind"), kind.alias("what"), F.when(expert, F.col("id")).otherwise(doc).alias("src"), F.when(expert, doc).otherwise(F.col("id")).alias("dst"))
    return n.select("document_id", F.lit("node").alias("kind"), F.col("label").alias("what"), F.col("id").alias("src"), F.lit(None).cast("string").alias("dst")).unionByName(e)


@query("E9", "payloads", "metas", sql=f"""
    WITH {PARSED_SQL}, {META_SQL}, u AS (SELECT id, label, 0 AS part, document_id, coalesce(lang, file) AS name FROM pnode WHERE id IS NOT NULL AND label <> '' UNION ALL SELECT id, label, 1, document_id, name FROM mn),
         f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY part, document_id, label) AS k FROM u), l AS (SELECT id, name, row_number() OVER (PARTITION BY id ORDER BY part DESC, document_id DESC, name DESC) AS k FROM u WHERE name IS NOT NULL)
    SELECT f.id, label, l.name, n FROM f JOIN (SELECT id, count(*) AS n FROM u GROUP BY 1) c USING (id) LEFT JOIN l ON l.id = f.id AND l.k = 1 WHERE f.k = 1""")
def e9(payloads, metas):
    """Payloads of several parts merged in order: the first label of an id stays, later properties win."""
    nodes, _ = parsed(payloads)
    a = nodes.select("id", "label", F.lit(0).alias("part"), "document_id", F.coalesce(F.col("props")["lang"], F.col("props")["file"]).alias("name"))
    b = meta_nodes(metas).select("id", "label", F.lit(1).alias("part"), "document_id", "name")
    return merged_parts(a.unionByName(b))


def merged_parts(parts: DataFrame) -> DataFrame:
    """id, label, name, n of parts (id, label, part, document_id, name)."""
    first = F.min_by("label", F.struct("part", "document_id", "label")).alias("label")
    later = F.max(F.when(F.col("name").isNotNull(), F.struct("part", "document_id", "name")))["name"].alias("name")
    return parts.groupBy("id").agg(first, later, F.count("*").alias("n"))


@query("E13", "nodes", sql="""
    WITH d AS (SELECT document_id, id, label, name, unit, numeric_value, parameter, CASE WHEN regexp_matches(name, '[А-Яа-яЁё]') THEN name END AS name_ru, CASE WHEN regexp_matches(name, '[A-Za-z]') AND NOT regexp_matches(name, '[А-Яа-яЁё]') THEN name END AS name_en, nullif(regexp_extract(name, '\b(?:[A-Z][a-z]?[0-9]+)+\b'), '') AS formula FROM nodes)
    SELECT document_id, id, name_ru, name_en, formula, label || coalesce(': ' || name, '') || coalesce(', ' || parameter || ' = ' || CAST(CAST(numeric_value AS BIGINT) AS VARCHAR) || ' ' || unit, '') AS description,
           round(least(0.95, 0.55 + 0.07 * (CAST(name IS NOT NULL AS INT) + CAST(unit IS NOT NULL AS INT) + CAST(parameter IS NOT NULL AS INT) + CAST(numeric_value IS NOT NULL AS INT) + CAST(formula IS NOT NULL AS INT))), 4)::DOUBLE AS confidence FROM d""")
def e13(nodes):
    """Nodes enriched: names by script, a formula, a description, and the confidence by the number of filled fields."""
    cyrillic = F.col("name").rlike("[А-Яа-яЁё]")
    formula = F.nullif(F.regexp_extract("name", r"\b(?:[A-Z][a-z]?[0-9]+)+\b", 0), F.lit(""))
    d = nodes.withColumns({"name_ru": F.when(cyrillic, F.col("name")), "name_en": F.when(F.col("name").rlike("[A-Za-z]") & ~cyrillic, F.col("name")), "formula": formula})
    value = F.concat(F.lit(", "), "parameter", F.lit(" = "), F.col("numeric_value").cast("long").cast("string"), F.lit(" "), "unit")
    description = F.concat("label", F.coalesce(F.concat(F.lit(": "), "name"), F.lit("")), F.coalesce(value, F.lit("")))
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("name", "unit", "parameter", "numeric_value", "formula")), F.lit(0))
    return d.select("document_id", "id", "name_ru", "name_en", "formula", description.alias("description"), F.round(F.least(F.lit(0.95), 0.55 + 0.07 * filled), 4).alias("confidence"))


@query("E14", "customer", sql="SELECT c_custkey, split_part(c_name, '#', 1) || ' ' || left(split_part(c_name, '#', 2), 1) || '.' AS short_name FROM customer")
def e14(customer):
    """Short names from full ones."""
    return customer.select("c_custkey", F.concat(F.split_part("c_name", F.lit("#"), F.lit(1)), F.lit(" "), F.substring(F.split_part("c_name", F.lit("#"), F.lit(2)), 1, 1), F.lit(".")).alias("short_name"))


@query("E15", "nodes", "registry", sql="SELECT n.document_id, n.id, CASE WHEN label = 'Document' THEN file_name ELSE coalesce(name, file_name) END AS name FROM nodes n JOIN registry r ON r.id = n.document_id WHERE label IN ('Document', 'Measurement')")
def e15(nodes, registry):
    """Document metadata on nodes: it overwrites document nodes and fills others."""
    r = registry.select(F.col("id").alias("doc"), "file_name")
    n = nodes.where(F.col("label").isin("Document", "Measurement")).join(r, F.col("document_id") == F.col("doc"))
    return n.select("document_id", "id", F.when(F.col("label") == "Document", F.col("file_name")).otherwise(F.coalesce("name", "file_name")).alias("name"))


#: Other names of the two kinds of geography.
GEO_ALIASES = {"domestic": ("domestic", "ru", "россия", "российская", "de", "локальная"), "foreign": ("foreign", "зарубежная", "зарубежный", "world", "en", "fr", "es")}


def geography(raw: Column) -> Column:
    low, out = F.lower(F.trim(raw)), F.lit(None).cast("string")
    for name, aliases in GEO_ALIASES.items():
        out = F.when(low.isin(*aliases), name).otherwise(out)
    return out


@query("E16", "registry", sql=f"""
    WITH a(alias, geo) AS ({", ".join([f"VALUES {', '.join(f'({w!r}, {k!r})' for k, ws in GEO_ALIASES.items() for w in ws)}"])}),
         r AS (SELECT id, source, geo, TRY_CAST(left(CASE id % 4 WHEN 0 THEN 'soon' WHEN 1 THEN CAST(material_date AS VARCHAR) || 'T00:00' ELSE CAST(material_date AS VARCHAR) END, 10) AS DATE) AS d FROM registry LEFT JOIN a ON alias = lower(trim(coalesce(geography, lang))))
    SELECT id, geo AS geography, CAST(d AS VARCHAR) AS material_date, array_to_string(list_filter([geo, 'geo:' || geo, CAST(year(d) AS VARCHAR), source], lambda x: x IS NOT NULL), ',') AS tags FROM r""")
def e16(registry):
    """Upload metadata made regular: geography by its aliases (or by the language), ISO dates, tags."""
    given = F.when(F.col("id") % 4 == 0, "soon").when(F.col("id") % 4 == 1, F.concat(F.col("material_date").cast("string"), F.lit("T00:00"))).otherwise(F.col("material_date").cast("string"))
    return upload_metadata(registry.select("id", "source", F.coalesce("geography", "lang").alias("geography"), given.alias("material_date")))


def upload_metadata(raw: DataFrame) -> DataFrame:
    """id, geography, material_date, tags of raw metadata; dates that aren't ISO are none."""
    r = raw.select("id", "source", geography(F.col("geography")).alias("geography"), F.try_to_date(F.substring("material_date", 1, 10), "yyyy-MM-dd").alias("d"))
    tags = F.array("geography", F.concat(F.lit("geo:"), "geography"), F.year("d").cast("string"), "source")
    return r.select("id", "geography", F.col("d").cast("string").alias("material_date"), F.array_join(F.filter(tags, lambda x: x.isNotNull()), ",").alias("tags"))


@query("E17", "registry", "nodes", sql="""
    SELECT document_id, id, label FROM nodes WHERE label IN ('Material', 'Document') AND document_id % 3 <> 0 UNION ALL SELECT document_id, id, label FROM nodes WHERE label = 'Material' AND document_id % 3 = 0
    UNION ALL SELECT id, 'Document:' || CAST(id AS VARCHAR), 'Document' FROM registry WHERE id NOT IN (SELECT document_id FROM nodes WHERE label = 'Document' AND document_id % 3 <> 0)""")
def e17(registry, nodes):
    """Payloads with the Document node that each must have, added where it is missing (here: of every third document)."""
    given = nodes.where("label = 'Material' OR (label = 'Document' AND document_id % 3 <> 0)").select("document_id", "id", "label")
    return with_documents(given, registry.select("id"))


def with_documents(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    has = nodes.where("label = 'Document'").select(F.col("document_id").alias("id")).distinct()
    missing = documents.join(has, "id", "left_anti").select(F.col("id").alias("document_id"), F.concat(F.lit("Document:"), F.col("id").cast("string")).alias("id"), F.lit("Document").alias("label"))
    return nodes.unionByName(missing)


@query("E18", "documents", "benchmark", "registry", "payloads", "metas", sql=f"""
    WITH RECURSIVE {chunk_sql(CHUNK)}, {TERMS_SQL}, {PARSED_SQL}, {META_SQL}, p AS (SELECT doc_id, idx, kind, text, CAST(doc_id AS VARCHAR) || CASE kind WHEN 'heading' THEN ':h:' ELSE ':p:' END || CAST(idx AS VARCHAR) AS id FROM chunked),
         t AS (SELECT DISTINCT doc_id, id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS term FROM p WHERE kind <> 'heading'), m AS (SELECT doc_id, id, term FROM t JOIN terms USING (term)),
         u AS (SELECT doc_id AS document_id, id, CASE kind WHEN 'heading' THEN 'HeadingContext' ELSE 'TextParagraph' END AS label FROM p UNION ALL SELECT DISTINCT doc_id, 'Material:' || term, 'Material' FROM m UNION ALL SELECT document_id, id, label FROM pnode WHERE id IS NOT NULL AND label <> '' UNION ALL SELECT document_id, id, label FROM mn
               UNION ALL SELECT id, 'role:' || coalesce(classification, 'открытый'), 'SecurityRole' FROM registry UNION ALL SELECT id, 'Document:' || CAST(id AS VARCHAR), 'Document' FROM registry),
         n AS (SELECT document_id, id, min(label) AS label FROM u GROUP BY 1, 2),
         e AS (SELECT DISTINCT doc_id AS document_id, 'DATA_SOURCE_FOR' AS type, id AS src, 'Material:' || term AS dst FROM m UNION SELECT doc_id, CASE kind WHEN 'heading' THEN 'HAS_HEADER' ELSE 'HAS_PARAGRAPH' END, 'Document:' || CAST(doc_id AS VARCHAR), id FROM p
               UNION SELECT document_id, type, src, dst FROM pedge UNION SELECT id, 'GOVERNED_BY', 'Document:' || CAST(id AS VARCHAR), 'role:' || coalesce(classification, 'открытый') FROM registry
               UNION SELECT document_id, CASE label WHEN 'Expert' THEN 'AUTHORED' WHEN 'Organization' THEN 'BELONGS_TO' ELSE 'ISSUED_AT' END, CASE label WHEN 'Expert' THEN id ELSE 'Document:' || CAST(document_id AS VARCHAR) END, CASE label WHEN 'Expert' THEN 'Document:' || CAST(document_id AS VARCHAR) ELSE id END FROM mn),
         r(type, from_label, to_label) AS ({O.values_sql([(t, a, b) for t, (xs, ys) in O.REL_RULES.items() for a in xs for b in ys])})
    SELECT e.document_id, e.type, e.src, e.dst FROM e JOIN n a ON a.document_id = e.document_id AND a.id = src JOIN n b ON b.document_id = e.document_id AND b.id = dst JOIN r ON r.type = e.type AND from_label = a.label AND to_label = b.label""")
def e18(spark, documents, benchmark, registry, payloads, metas):
    """The full compose: model payloads, metadata, validation layer, paragraphs and dictionary facts in one graph, bridged and checked against the rules; its edges."""
    parts = chunks(documents.select("doc_id", "text"))
    head = F.col("kind") == "heading"
    p = parts.select(F.col("doc_id").alias("document_id"), "kind", "text", F.concat(F.col("doc_id").cast("string"), F.when(head, ":h:").otherwise(":p:"), F.col("idx").cast("string")).alias("id"))
    doc = lambda c: F.concat(F.lit("Document:"), F.col(c).cast("string"))
    said = dictionary_mentions(p.where("kind <> 'heading'").select(F.struct("document_id", "id").alias("doc_id"), "text"), dictionary(benchmark)).select("doc_id.*", F.concat(F.lit("Material:"), "term").alias("term"))
    model, links = parsed(payloads)
    meta = meta_nodes(metas)
    role = F.concat(F.lit("role:"), F.coalesce("classification", F.lit("открытый")))
    node = lambda df, key, label, of="document_id": df.select(F.col(of).alias("document_id"), key.alias("id"), label.alias("label"))
    nodes = node(p, F.col("id"), F.when(head, "HeadingContext").otherwise("TextParagraph")).unionByName(node(said, F.col("term"), F.lit("Material"))).unionByName(model.select("document_id", "id", "label")).unionByName(meta.select("document_id", "id", "label"))
    nodes = with_documents(nodes.unionByName(node(registry, role, F.lit("SecurityRole"), "id")), registry.select("id"))
    nodes = nodes.groupBy("document_id", "id").agg(F.min("label").alias("label"))
    edge = lambda df, kind, src, dst, of="document_id": df.select(F.col(of).alias("document_id"), kind.alias("type"), src.alias("src"), dst.alias("dst"))
    expert = F.col("label") == "Expert"
    edges = edge(said, F.lit("DATA_SOURCE_FOR"), F.col("id"), F.col("term")).unionByName(edge(p, F.when(head, "HAS_HEADER").otherwise("HAS_PARAGRAPH"), doc("document_id"), F.col("id"))).unionByName(links)
    edges = edges.unionByName(edge(registry, F.lit("GOVERNED_BY"), doc("id"), role, "id"))
    edges = edges.unionByName(edge(meta, F.when(expert, "AUTHORED").when(F.col("label") == "Organization", "BELONGS_TO").otherwise("ISSUED_AT"), F.when(expert, F.col("id")).otherwise(doc("document_id")), F.when(expert, doc("document_id")).otherwise(F.col("id")))).distinct()
    e = edges.join(nodes.withColumnsRenamed({"id": "src", "label": "from_label"}), ["document_id", "src"]).join(nodes.withColumnsRenamed({"id": "dst", "label": "to_label"}), ["document_id", "dst"])
    return e.join(F.broadcast(O.relation_rules(spark)), ["type", "from_label", "to_label"], "left_semi").select("document_id", "type", "src", "dst")
