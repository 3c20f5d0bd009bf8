"""The document registry, the entity graph and the vectors, derived from the given tables.

Each is one SELECT in the common dialect of Spark and DuckDB (or one for each, where they differ), so a query and
its oracle start from the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
_N = "(SELECT count(*) FROM documents)"
_NODE = "CAST(NULL AS DOUBLE) AS numeric_value, CAST(NULL AS STRING) AS unit, CAST(NULL AS STRING) AS parameter"

#: name: SQL, or (Spark's SQL, DuckDB's SQL)
FIXTURES: dict[str, str | tuple[str, str]] = {
    "registry": """
        SELECT doc_id AS id, source || '_' || CAST(doc_id AS STRING) || CASE doc_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.exe' ELSE '.md' END AS file_name, source, lang,
               CASE doc_id % 5 WHEN 0 THEN 'открытый' WHEN 1 THEN 'внутренний' WHEN 2 THEN 'конфиденциальный' WHEN 3 THEN 'строго' END AS classification,
               'org' || CAST(doc_id % 7 AS STRING) AS organization,
               CASE WHEN doc_id % 11 = 0 THEN NULL WHEN lang = 'de' THEN 'domestic' ELSE 'foreign' END AS geography,
               DATE '2000-01-01' + CAST(doc_id % 9000 AS INT) AS material_date, DATE '2020-01-01' + CAST(doc_id * 7 % 1000 AS INT) AS upload_date,
               n_chars AS size_bytes, CASE doc_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'processing' ELSE 'ready' END AS status
        FROM documents""",
    "lines": (
        "SELECT doc_id, CAST(pos AS BIGINT) AS pos, line FROM documents LATERAL VIEW posexplode(split(text, '\\n', -1)) AS pos, line",
        "SELECT doc_id, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL",
    ),
    "nodes": f"""
        SELECT DISTINCT l_orderkey % {_N} AS document_id, 'Material:' || CAST(l_partkey AS STRING) AS id, 'Material' AS label, p_name AS name, {_NODE}, 0.55 + 0.07 * (p_size % 5) AS confidence FROM lineitem JOIN part ON l_partkey = p_partkey
        UNION ALL SELECT DISTINCT l_orderkey % {_N}, 'Process:' || p_type, 'Process', p_type, {_NODE}, CAST(NULL AS DOUBLE) FROM lineitem JOIN part ON l_partkey = p_partkey
        UNION ALL SELECT o_orderkey % {_N}, 'ExperimentRun:' || CAST(o_orderkey AS STRING), 'ExperimentRun', o_orderpriority, {_NODE}, CAST(NULL AS DOUBLE) FROM orders
        UNION ALL SELECT l_orderkey % {_N}, 'Measurement:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING), 'Measurement', CAST(NULL AS STRING), l_quantity, l_returnflag, l_linestatus, 1 - l_discount * 5 FROM lineitem
        UNION ALL SELECT DISTINCT o_orderkey % {_N}, 'Expert:' || CAST(o_custkey AS STRING), 'Expert', c_name, {_NODE}, CAST(NULL AS DOUBLE) FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT doc_id, 'Document:' || CAST(doc_id AS STRING), 'Document', source, {_NODE}, CAST(NULL AS DOUBLE) FROM documents""",
    "edges": f"""
        SELECT DISTINCT l_orderkey % {_N} AS document_id, 'USES_MAT' AS type, 'ExperimentRun:' || CAST(l_orderkey AS STRING) AS src, 'Material:' || CAST(l_partkey AS STRING) AS dst FROM lineitem
        UNION ALL SELECT DISTINCT l_orderkey % {_N}, 'OPERATES_PROC', 'ExperimentRun:' || CAST(l_orderkey AS STRING), 'Process:' || p_type FROM lineitem JOIN part ON l_partkey = p_partkey
        UNION ALL SELECT DISTINCT l_orderkey % {_N}, 'PRODUCED_MEASUREMENT', 'ExperimentRun:' || CAST(l_orderkey AS STRING), 'Measurement:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) FROM lineitem
        UNION ALL SELECT DISTINCT o_orderkey % {_N}, 'AUTHORED', 'Expert:' || CAST(o_custkey AS STRING), 'Document:' || CAST(o_orderkey % {_N} AS STRING) FROM orders
        UNION ALL SELECT DISTINCT o_orderkey % {_N}, 'LIVES_IN', 'Expert:' || CAST(o_custkey AS STRING), 'Location:' || CAST(c_nationkey AS STRING) FROM orders JOIN customer ON o_custkey = c_custkey""",
    "vectors": f"""
        SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 'chunks' WHEN 1 THEN 'claims' ELSE 'entities' END AS collection, vec_id % {_N} AS document_id, embedding,
               CASE WHEN vec_id % 17 = 0 THEN -1 ELSE label END AS cluster_id, vec_id % 17 = 0 AS is_anomaly, CAST(vec_id * 37 % 1000 AS DOUBLE) / 1000 AS anomaly_score FROM embeddings""",
    # points of the vector index, some 48 to a document, and which paragraphs each fact is drawn from
    "points": f"""
        SELECT *, document_id % 4 AS folder FROM (SELECT vec_id AS point_id, CASE vec_id % 3 WHEN 0 THEN 'chunks' WHEN 1 THEN 'claims' ELSE 'entities' END AS collection, vec_id % (SELECT 1 + CAST(floor(count(*) / 48) AS BIGINT) FROM embeddings) AS document_id, embedding,
               CASE WHEN vec_id % 17 = 0 THEN -1 ELSE label END AS cluster_id, substr(d.text, 1, 400) AS text FROM embeddings LEFT JOIN documents d ON doc_id = vec_id % {_N}) AS p""",
    "links": "SELECT c.document_id, c.point_id AS src, f.point_id AS dst FROM points c JOIN points f ON c.document_id = f.document_id AND c.collection = 'chunks' AND f.collection = 'claims' AND (c.point_id + f.point_id) % 5 = 0",
    # quotes of nodes from their document's text: whole, begun and gone on otherwise, with words in between, second after one that isn't there
    "quoted": """
        SELECT doc_id AS document_id, 'Material:q' || CAST(doc_id AS STRING) AS node_id, 'Material' AS label, 0 AS n, substr(text, 41, 60) AS snippet FROM documents
        UNION ALL SELECT doc_id, 'Expert:q' || CAST(doc_id AS STRING), 'Expert', 0, substr(text, 1, 30 + doc_id % 4 * 25) || ' something that was never said' FROM documents
        UNION ALL SELECT doc_id, 'TechnologySolution:q' || CAST(doc_id AS STRING), 'TechnologySolution', 0, replace(substr(text, 200, 90), ' ', ' zzz ') FROM documents
        UNION ALL SELECT doc_id, 'Measurement:q' || CAST(doc_id AS STRING), 'Measurement', 0, 'qqq www eee ' || CAST(doc_id AS STRING) FROM documents
        UNION ALL SELECT doc_id, 'Measurement:q' || CAST(doc_id AS STRING), 'Measurement', 1, replace(substr(text, 300, 12), 'e', 'E') FROM documents
        UNION ALL SELECT doc_id, 'Claim:q' || CAST(doc_id AS STRING), 'Claim', 0, substr(text, 500, 9 + doc_id % 8) FROM documents""",
    "quoted_edges": """
        SELECT doc_id AS document_id, 'USES_MAT' AS type, 'ExperimentRun:q' || CAST(doc_id AS STRING) AS src, 'Claim:q' || CAST(doc_id AS STRING) AS dst, substr(text, 120, 40) AS quote FROM documents WHERE length(text) > 160
        UNION ALL SELECT doc_id, 'DATA_SOURCE_FOR', CAST(doc_id AS STRING) || ':p:0', 'Material:q' || CAST(doc_id AS STRING), 'none' FROM documents WHERE doc_id % 3 = 0""",
    # measurements of materials in several units, standards with limits that may be open, and which measurement is judged by which
    "readings": f"""
        SELECT DISTINCT l_orderkey % {_N} AS document_id, 'Measurement:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) AS id, 'Material:' || CAST(l_partkey % 97 AS STRING) AS mat, CASE l_linenumber % 4 WHEN 0 THEN 'load' WHEN 1 THEN 'heat' WHEN 2 THEN 'speed' ELSE 'yield' END AS parameter,
               CASE l_linenumber % 4 WHEN 0 THEN CASE l_orderkey % 3 WHEN 0 THEN 'mg/l' WHEN 1 THEN 'g/m3' ELSE 'кг/м³' END WHEN 1 THEN CASE l_orderkey % 4 WHEN 0 THEN '°C' WHEN 1 THEN 'K' WHEN 2 THEN 'MPa' ELSE 'cubits' END WHEN 2 THEN CASE l_orderkey % 2 WHEN 0 THEN 'km/h' ELSE 'm s^-1' END END AS unit,
               CAST(l_quantity AS DOUBLE) AS v, CAST(year(l_shipdate) AS INT) AS year FROM lineitem""",
    "standards": """
        SELECT 'Standard:' || CAST(p_partkey AS STRING) AS standard_id, CASE p_partkey % 3 WHEN 0 THEN 'load' WHEN 1 THEN 'heat' ELSE 'speed' END AS parameter, CASE p_partkey % 3 WHEN 0 THEN 'g/m3' WHEN 1 THEN 'K' ELSE 'km/h' END AS unit,
               CASE WHEN p_size % 5 > 0 THEN CAST(p_size * 2 AS DOUBLE) END AS lo, CASE WHEN p_size % 9 > 0 AND p_size > 4 THEN CAST(p_size * 2 + p_partkey % 4 AS DOUBLE) END AS hi FROM part WHERE p_size % 5 > 0 OR p_size < 3""",
    "evaluated": "SELECT DISTINCT 'Measurement:' || CAST(l_orderkey AS STRING) || ':' || CAST(l_linenumber AS STRING) AS src, 'Standard:' || CAST(p_partkey AS STRING) AS dst FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_suppkey % 2 = 0",
    # names of the parts: one that some share, or nearly, one that others share, and what kind of thing they are
    "part_terms": """
        SELECT CAST(p_partkey AS BIGINT) AS entity_id, substr(md5(CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING)), 1, 12) || CASE WHEN p_partkey % 7 = 0 THEN 'x' ELSE '' END AS term FROM part
        UNION ALL SELECT CAST(p_partkey AS BIGINT), 'G' || substr(md5('b' || CAST(CAST(floor((p_partkey + 1) / 4) AS BIGINT) AS STRING)), 1, 11) FROM part WHERE p_partkey % 10 <> 0
        UNION ALL SELECT CAST(p_partkey AS BIGINT), p_name || ' ' || p_brand FROM part WHERE p_partkey % 9 = 0 UNION ALL SELECT CAST(p_partkey AS BIGINT), ' ' FROM part""",
    "hits": f"""
        SELECT turn AS query_id, conv_id, conv_id % {_N} AS document_id, 'n' || CAST(conv_id * 7 % 50 AS STRING) AS node_id, CAST((conv_id * 31 + turn * 17) % 97 AS DOUBLE) / 97 AS score, role AS factor, text FROM conversations""",
    # loose files of each document
    "files": """
        SELECT doc_id AS file_id, CASE doc_id % 3 WHEN 0 THEN 'csv' WHEN 1 THEN 'json' ELSE 'xml' END AS ext, CASE doc_id % 3
               WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN '\ufeff' ELSE '' END || replace('id~name~lang' || CASE WHEN doc_id % 5 = 0 THEN '\r\n' ELSE '\n' END || CAST(doc_id AS STRING) || '~' || coalesce(source, '') || '~' || coalesce(lang, '') || '\n' || CAST(n_chars AS STRING) || '~chars, all~' || '\n', '~', CASE doc_id % 4 WHEN 0 THEN ';' WHEN 1 THEN ',' WHEN 2 THEN '|' ELSE '\t' END)
               WHEN 1 THEN '{"id": ' || CAST(doc_id AS STRING) || ', "source": "' || coalesce(source, '') || '"}' ELSE '<doc>\n' || coalesce(text, '') || '\n</doc>' END AS content FROM documents""",
    # notes of the runs, in words
    "notes": """
        SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS pos, 'Run ' || CAST(l_orderkey AS STRING) || ' took ' || replace(CAST(l_quantity AS STRING), '.', ',') || ' kg at ' || CAST(l_suppkey AS STRING) || ' °C with ' || CAST(l_discount AS STRING) || '% off' AS line FROM lineitem""",
    # what a model said about each document, and the metadata that came with it
    "payloads": """
        SELECT id AS document_id, 'Here it is: {"nodes": [{"id": "Document:' || CAST(id AS STRING) || '", "label": "Document", "props": {"file": "' || file_name || '"}}, {"tmp_id": "m' || CAST(id % 50 AS STRING) || '", "label": "' || CASE WHEN id % 4 = 0 THEN '' ELSE 'Material' END || '", "props": {"lang": "' || coalesce(lang, '') || '"}}, {"label": "Process"}, {"id": "p' || CAST(id % 9 AS STRING) || '", "label": "Process", "props": "none"}], '
               || '"edges": [{"type": "ABOUT", "from": "Document:' || CAST(id AS STRING) || '", "to": "m' || CAST(id % 50 AS STRING) || '"}, {"type": "' || CASE WHEN id % 3 = 0 THEN '' ELSE 'USES_MAT' END || '", "from": "p' || CAST(id % 9 AS STRING) || '", "to": "m' || CAST(id % 50 AS STRING) || '"}, {"type": "LOST", "from": "x"}]} Anything else?' AS raw FROM registry""",
    "metas": """
        SELECT id AS document_id, '{"authors": ["' || source || ' A.", " ", "' || organization || ' Team"], "organization": "' || organization || '"' || CASE WHEN geography IS NULL THEN '' ELSE ', "location": "' || geography || '"' END || '}' AS raw FROM registry""",
    # what users ask: the first sentence of each of their turns
    "requests": (
        "SELECT conv_id * 100 + turn AS query_id, conv_id, turn, CASE turn WHEN 0 THEN substring_index(text, '.', 1) WHEN 2 THEN 'уточни ' || substring_index(substring_index(text, '.', 1), ' ', 3) WHEN 4 THEN substring_index(text, ' ', 2) WHEN 6 THEN 'Thanks!' ELSE text END AS text FROM conversations WHERE role = 'user'",
        "SELECT conv_id * 100 + turn AS query_id, conv_id, turn, CASE turn WHEN 0 THEN split_part(text, '.', 1) WHEN 2 THEN 'уточни ' || array_to_string(string_split(split_part(text, '.', 1), ' ')[:3], ' ') WHEN 4 THEN array_to_string(string_split(text, ' ')[:2], ' ') WHEN 6 THEN 'Thanks!' ELSE text END AS text FROM conversations WHERE role = 'user'",
    ),
    # search plans with facets, and the state of a viewer's filters, for each query
    "plans": """
        SELECT CAST(p_partkey AS BIGINT) AS query_id, p_brand AS text, CASE p_partkey % 7 WHEN 0 THEN '{}' WHEN 1 THEN NULL ELSE
               '{"query_facets": {"materials": ["' || p_name || '", " "], "processes": ["' || p_type || '"], "geography": ' || CASE p_partkey % 3 WHEN 0 THEN '["domestic", "Oslo"]' WHEN 1 THEN '["foreign"]' ELSE '[]' END
               || ', "years": ["about ' || CAST(1990 + p_size % 30 AS STRING) || '", "2010", "none"], "numeric_min": ' || CAST(p_size AS STRING) || ', "numeric_param": "' || CASE WHEN p_partkey % 2 = 0 THEN 'F' ELSE '' END || '", "conditions": []}}' END AS plan FROM part""",
    "views": """
        SELECT CAST(p_partkey AS BIGINT) AS query_id, CAST(p_size AS DOUBLE) / 100 AS min_score, CASE WHEN p_partkey % 2 = 0 THEN '.md' END AS extension, CASE WHEN p_partkey % 3 = 0 THEN substr(lower(p_name), 1, 2) END AS keyword FROM part""",
}


def needed(sql: str) -> list[str]:
    """Fixtures that SQL mentions, by way of others too, in order of their definition."""
    found = {name for name in FIXTURES if re.search(rf"\b{name}\b", sql)}
    for name in reversed(FIXTURES):
        if name in found:
            found |= {x for x in FIXTURES if x != name and re.search(rf"\b(FROM|JOIN) {x}\b", FIXTURES[name][1] if isinstance(FIXTURES[name], tuple) else FIXTURES[name])}
    return [name for name in FIXTURES if name in found]


def oracle(sql: str) -> str:
    """DuckDB SQL with the fixtures that it mentions in front."""
    parts = [f"{name} AS ({FIXTURES[name] if isinstance(FIXTURES[name], str) else FIXTURES[name][1]})" for name in needed(sql)]
    sql = sql.strip()
    if not parts:
        return sql
    recursive = re.match(r"WITH\s+RECURSIVE\s+", sql)
    rest = re.match(r"WITH\s+(RECURSIVE\s+)?", sql)
    head = f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}"
    return f"{head}, {sql[rest.end():]}" if rest else f"{head} {sql}"


def table(spark: SparkSession, sf_dir: str, name: str, repeats: bool = False) -> DataFrame:
    """A given table or a fixture; with repeats, rows of a fixture aren't told apart, for what does so itself."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = FIXTURES[name] if isinstance(FIXTURES[name], str) else FIXTURES[name][0]
    sql = sql.replace("SELECT DISTINCT", "SELECT") if repeats else sql
    used = {b: table(spark, sf_dir, b) for b in (*BASE, *FIXTURES) if re.search(rf"\b(FROM|JOIN) {b}\b", sql)}
    sql = sql.replace("{", "{{").replace("}", "}}") if used else sql
    for b in used:
        sql = re.sub(rf"\b(FROM|JOIN) {b}\b", rf"\1 {{{b}}}", sql)
    return spark.sql(sql, **used)
