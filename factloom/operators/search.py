"""Retrieval over vectors, tokens and the graph, for many queries at once (R)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom import ontology as O
from factloom.operators import ivf, postings
from factloom.operators.ivf import best_of
from factloom.operators.text import tokens
from factloom.plans.registry import query
from factloom.session import checkpointed, in_blocks, small_side

#: Words of small talk.
GREETING = "hello hi hey heya hiya yo sup howdy greetings привет здравствуй здравствуйте салют хай".split() + ["добрый день", "доброе утро", "добрый вечер", "доброй ночи", "good morning", "good evening", "good afternoon", "good night"]
THANKS = ["thanks", "thank you", "thx", "ty", "спасибо", "благодарю", "мерси"]
ACK = ["ok", "okay", "ок", "окей", "ага", "понятно", "ясно", "cool", "nice"]
META = r"^(?:who are you|what are you|what(?: is|s) your name|кто ты|что ты(?: такое)?|как тебя зовут|ты кто|what can you do|how can you help|help me|чем можешь помочь|что умеешь|как ты работаешь|помоги|расскажи о себе)$"
DOMAIN = r"(?i)\b(?:nickel|cobalt|copper|iron|material|process|technology|alloy|temperature|pressure|document|graph|fact|cluster|what is|how does)\b"
MAX_SENT_QUERIES = 5000
MAX_SENT_LISTED = 50_000


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, min_score: float = -1.0) -> DataFrame:
    """query_id, vec_id, score, rank: the k nearest vectors of each query by score, then id, found exactly by an inverted file."""
    return ivf.top_k(vectors, queries, k, min_score)


COS_SQL = """q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS query FROM vectors WHERE vec_id % 50 = 0),
    sc AS (SELECT query_id, vec_id, document_id, collection, cluster_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), query) AS score FROM vectors JOIN q ON vec_id <> query_id)"""


def _queries(vectors):
    return vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


@query("R1", "vectors", sql=f"WITH {COS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM sc WHERE collection = 'chunks') SELECT query_id, vec_id, round(score, 4) AS score FROM r WHERE k <= 5")
def r1(vectors):
    return vector_top_k(vectors.where("collection = 'chunks'"), _queries(vectors), 5).select("query_id", "vec_id", F.round("score", 4).alias("score"))


TOK_SQL = """dt AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda t: length(t) >= 2)) AS w FROM documents),
    qt AS (SELECT item_id AS query_id, unnest(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda t: length(t) >= 4)))[:16]) AS w FROM benchmark)"""


def token_search(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, overlap, score: documents by shared tokens (an inverted index), the k best of each query."""
    q = queries.select("query_id", F.explode(F.slice(F.filter(tokens(F.col("text")), lambda t: F.length(t) >= 4), 1, 16)).alias("w"))
    d = docs.select("id", F.explode(tokens(F.col("text"))).alias("w"))
    score = F.least(F.lit(1.0), 0.35 + 0.15 * F.col("overlap"))
    return postings.top_k(d, q, k).select("query_id", "id", "overlap", score.alias("score"))


@query("R2", "documents", "benchmark", sql=f"""
    WITH {TOK_SQL}, c AS (SELECT query_id, doc_id AS id, count(*) AS overlap FROM dt JOIN qt USING (w) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, id) AS k FROM c)
    SELECT query_id, id, overlap, least(1.0, 0.35 + 0.15 * overlap)::DOUBLE AS score FROM r WHERE k <= 5""")
def r2(documents, benchmark):
    return token_search(documents.select(F.col("doc_id").alias("id"), "text"), benchmark.select(F.col("item_id").alias("query_id"), "text"), 5)


@query("R3", "nodes", "part", sql="""
    WITH e AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(name), '[\\p{L}\\p{N}_]+')) AS w FROM nodes WHERE label = 'Process' AND length(name) > 0), q AS (SELECT DISTINCT p_partkey AS query_id, unnest(regexp_extract_all(lower(p_type), '[\\p{L}\\p{N}_]+')) AS w FROM part)
    SELECT query_id, id, count(*) AS overlap FROM e JOIN q USING (w) WHERE query_id % 50 = 0 GROUP BY 1, 2""")
def r3(nodes, part):
    """Entities of one label by shared words."""
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    e = nodes.where("label = 'Process'").select("id", words("name").alias("w")).distinct()
    q = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), words("p_type").alias("w")).distinct()
    return e.join(q, "w").groupBy("query_id", "id").agg(F.count("*").alias("overlap"))


def merge_hits(hits: DataFrame) -> DataFrame:
    """One row for each query, document and node: the best score and all factors, sorted."""
    return hits.groupBy("query_id", "document_id", "node_id").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("factor")), ",").alias("factors"))


@query("R7", "hits", sql="SELECT query_id, document_id, node_id, max(score) AS score, string_agg(DISTINCT factor, ',' ORDER BY factor) AS factors FROM hits GROUP BY 1, 2, 3")
def r7(hits):
    return merge_hits(hits)


@query("J8", "vectors", sql=f"WITH {COS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM sc) SELECT query_id, vec_id, k AS rank, round(score, 4) AS score FROM r WHERE k <= 10")
def j8(vectors):
    """The ten nearest of all vectors."""
    return vector_top_k(vectors, _queries(vectors), 10).select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"), F.round("score", 4).alias("score"))


#: Scores of what hangs together with a hit, and how many members of a cluster come along.
BRIDGE, CLUSTER, MEMBERS = 0.75, 0.55, 6
#: Each collection's layer and what a hit by its vectors is called.
CHUNKS, CLAIMS, ENTITIES = "chunks", "claims", "entities"
BY_VECTOR, BY_WORD = {CHUNKS: "l3_embedding", CLAIMS: "l4_embedding", ENTITIES: "entity_embedding"}, {CHUNKS: "l3_keyword", ENTITIES: "entity_keyword"}
HIT = ["query_id", "document_id", "node_id", "score", "factor"]


def limits(limit: int) -> dict[str, int]:
    """How many hits of each collection a search for `limit` hits takes."""
    return {CHUNKS: max(6, limit), CLAIMS: max(4, limit // 2 + 3), ENTITIES: limit}


def vector_hits(index: ivf.Index, points: DataFrame, queries: DataFrame, limit: int, min_score: float, same: tuple[str, ...] = ()) -> DataFrame:
    """The nearest points of each collection, and its rank there, for queries (query_id, self_id, query, and the columns of same): one search, in which a query asks each collection by itself."""
    ask = F.explode(F.array(*(F.struct(F.col("query_id").alias("q"), F.col("self_id").alias("own"), F.lit(c).alias("collection")) for c in (CHUNKS, CLAIMS, ENTITIES))))
    q = queries.select("query", *same, ask.alias("query_id")).withColumn("collection", F.col("query_id.collection"))
    cut = limits(limit)
    found = ivf.Search(index, q, max(cut.values()), min_score, ("collection", *same), own=F.col("query_id.own")).hits()
    found = found.select(F.col("query_id.q").alias("query_id"), F.col("query_id.collection").alias("collection"), F.col("vec_id").alias("node_id"), "score", "rank")
    found = found.where(reduce(Column.__or__, ((F.col("collection") == c) & (F.col("rank") <= n) for c, n in cut.items())))
    own = points.select(F.col("point_id").alias("node_id"), "document_id")
    factor = F.create_map(*(F.lit(x) for kv in BY_VECTOR.items() for x in kv))[F.col("collection")]
    return found.join(own, "node_id").select(*HIT[:4], factor.alias("factor"), "collection")


def word_hits(words: DataFrame, asked_words: DataFrame, collection: str, cut: int, same: tuple[str, ...] = ()) -> DataFrame:
    """Points (id, document_id, collection, w, and the columns of same) by the number of words that they share with a query (query_id, self_id, w): the best `cut`."""
    c = words.where(F.col("collection") == collection).join(asked_words, ["w", *same]).where("id <> self_id").groupBy("query_id", "document_id", "id").agg(F.count("*").alias("overlap"))
    score = F.least(F.lit(1.0), 0.35 + 0.15 * F.col("overlap"))
    top = best_of(c, cut, F.desc("overlap"), F.asc("id"))
    return top.select("query_id", "document_id", F.col("id").alias("node_id"), score.alias("score"), F.lit(BY_WORD[collection]).alias("factor"))


def point_words(points: DataFrame) -> DataFrame:
    return points.where(F.col("collection").isin(*BY_WORD)).select(F.col("point_id").alias("id"), "document_id", "collection", "folder", F.explode(tokens(F.col("text"))).alias("w"))


def topped_up(found: DataFrame, words: DataFrame, asked_words: DataFrame, collection: str, cut: int, same: tuple[str, ...] = ()) -> DataFrame:
    """The vector hits of a collection; queries with fewer than `cut` get hits by words as well, merged by point, the best `cut` of all."""
    own = found.where(F.col("collection") == collection).drop("collection")
    full = own.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= cut).select("query_id")
    more = word_hits(words, asked_words.join(full, "query_id", "left_anti"), collection, cut, same)
    merged = merge_hits(own.unionByName(more))
    return best_of(merged, cut, F.desc("score"), F.asc("node_id"), salt="node_id")


def bridged(l3: DataFrame, links: DataFrame) -> DataFrame:
    """Facts linked to a paragraph that was found, at a share of the best paragraph's score in the document."""
    best = l3.withColumn("best", F.max("score").over(Window.partitionBy("query_id", "document_id")))  # a few hits of a query
    ends = links.select("document_id", F.col("src").alias("node_id"), F.col("dst").alias("fact"))
    met = best.join(ends, ["document_id", "node_id"]).select("query_id", "document_id", F.col("fact").alias("node_id"), (F.col("best") * BRIDGE).alias("score")).distinct()
    return met.withColumn("factor", F.lit("l4_graph_bridge"))


def clustered(found: DataFrame, points: DataFrame) -> DataFrame:
    """For each document and cluster of a query's facts up to MEMBERS facts of it that aren't found yet, the smallest ids first, at a share of the best fact's score."""
    facts = points.where((F.col("collection") == CLAIMS) & (F.col("cluster_id") >= 0)).select("document_id", F.col("point_id").alias("node_id"), "cluster_id")
    seeds = found.join(facts, ["document_id", "node_id"]).groupBy("query_id", "document_id", "cluster_id").agg(F.max("score").alias("best"))
    unseen = seeds.join(facts, ["document_id", "cluster_id"]).join(found.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    k = F.row_number().over(Window.partitionBy("query_id", "document_id", "cluster_id").orderBy("node_id"))
    return unseen.withColumn("k", k).where(F.col("k") <= MEMBERS).select("query_id", "document_id", "node_id", (F.col("best") * CLUSTER).alias("score"), F.lit("l4_cluster").alias("factor"))


def merged_hits(*parts: DataFrame) -> DataFrame:
    """Hits of several sources by point: the best score, all factors."""
    every = reduce(DataFrame.unionByName, (p.withColumn("factor", F.explode(F.split("factors", ","))).drop("factors") if "factors" in p.columns else p for p in parts))
    return merge_hits(every.select(*HIT))


def two_factor(found: DataFrame, points: DataFrame, links: DataFrame, words: DataFrame, asked_words: DataFrame, limit: int, same: tuple[str, ...] = ()) -> DataFrame:
    """Paragraphs by vectors, topped up by words; facts by vectors; facts linked to those paragraphs; the other facts of their clusters in the document. The best `limit` of all."""
    l3 = topped_up(found, words, asked_words, CHUNKS, limits(limit)[CHUNKS], same)
    l4 = found.where(F.col("collection") == CLAIMS).drop("collection")
    seen = merged_hits(l3, l4, bridged(l3, links))
    return best_of(merged_hits(seen, clustered(seen, points)), limit, F.desc("score"), F.asc("node_id"), salt="node_id")


def query_words(queries: DataFrame, *same: str) -> DataFrame:
    """The first sixteen words of each query."""
    return queries.select("query_id", "self_id", *same, F.explode(F.slice(tokens(F.col("text")), 1, 16)).alias("w"))


def unified(index: ivf.Index, points: DataFrame, links: DataFrame, queries: DataFrame, limit: int, min_score: float, same: tuple[str, ...] = ()) -> DataFrame:
    """Two-factor search and entity search, merged by point: the best `limit` of each query (query_id, self_id, query, text, and the columns of same, to which its points are confined)."""
    asked_words, words = query_words(queries, *same), point_words(points)
    found = checkpointed(vector_hits(index, points, queries, limit, min_score, same))
    entities = topped_up(found, words, asked_words, ENTITIES, limit, same)
    return best_of(merged_hits(two_factor(found, points, links, words, asked_words, limit, same), entities), limit, F.desc("score"), F.asc("node_id"), salt="node_id")


def point_queries(points: DataFrame) -> DataFrame:
    return points.where("point_id % 50 = 0").select(F.col("point_id").alias("query_id"), F.col("point_id").alias("self_id"), F.col("embedding").alias("query"), F.regexp_extract("text", r"^\S+ \S+", 0).alias("text"))


QUERY_SQL = "SELECT point_id AS query_id, point_id AS self_id, CAST(embedding AS DOUBLE[]) AS query, regexp_extract(text, '^\\S+ \\S+') AS text FROM points WHERE point_id % 50 = 0"


def search_sql(k: int, least: float, queries: str = QUERY_SQL, p: str = "", scope: str = "true") -> str:
    """The parts of the composed searches for the oracle, under names that begin with p: k hits in all, vectors from `least` on, points within the scope."""
    cut = limits(k)
    vector = lambda c, n: f"SELECT query_id, document_id, node_id, score, '{BY_VECTOR[c]}' AS factor FROM (SELECT *, row_number() OVER (PARTITION BY query_id, collection ORDER BY score DESC, node_id) AS k FROM {p}sc WHERE score >= {least}) WHERE collection = '{c}' AND k <= {n}"
    merged = lambda x: f"SELECT query_id, document_id, node_id, max(score) AS score, string_agg(DISTINCT factor, ',' ORDER BY factor) AS factors FROM ({x}) GROUP BY 1, 2, 3"
    apart = lambda x: f"SELECT query_id, document_id, node_id, score, unnest(string_split(factors, ',')) AS factor FROM {p}{x}"
    best = lambda x, n: f"SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS k FROM ({x})) WHERE k <= {n}"
    words = "unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda t: length(t) >= 2))) AS w"
    topped = lambda c, name, n: f"""{p}{name}_v AS ({vector(c, n)}), {p}{name}_w AS (SELECT query_id, document_id, node_id, least(1.0, 0.35 + 0.15 * overlap) AS score, '{BY_WORD[c]}' AS factor FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, node_id) AS k
             FROM (SELECT query_id, document_id, point_id AS node_id, count(*) AS overlap FROM {p}pw pt JOIN {p}qw q USING (w) WHERE {scope} AND collection = '{c}' AND point_id <> self_id AND query_id NOT IN (SELECT query_id FROM {p}{name}_v GROUP BY 1 HAVING count(*) >= {n}) GROUP BY 1, 2, 3)) WHERE k <= {n}),
         {p}{name} AS ({best(merged(f"SELECT * FROM {p}{name}_v UNION ALL SELECT * FROM {p}{name}_w"), n)})"""  # noqa: E731
    return f"""{p}q AS ({queries}), {p}sc AS (SELECT query_id, point_id AS node_id, document_id, collection, list_cosine_similarity(CAST(embedding AS DOUBLE[]), query) AS score FROM points pt JOIN {p}q q ON point_id <> self_id AND {scope}),
         {p}pw AS (SELECT point_id, document_id, collection, folder, {words} FROM points), {p}qw AS (SELECT * EXCLUDE (query, text), {words} FROM {p}q),
         {topped(CHUNKS, "l3", cut[CHUNKS])}, {p}l4 AS ({vector(CLAIMS, cut[CLAIMS])}),
         {p}bridge AS (SELECT DISTINCT query_id, document_id, dst AS node_id, best * {BRIDGE} AS score, 'l4_graph_bridge' AS factor FROM (SELECT *, max(score) OVER (PARTITION BY query_id, document_id) AS best FROM {p}l3) h JOIN links USING (document_id) WHERE src = h.node_id),
         {p}seen AS ({merged(f"{apart('l3')} UNION ALL SELECT * FROM {p}l4 UNION ALL SELECT * FROM {p}bridge")}),
         {p}facts AS (SELECT document_id, point_id AS node_id, cluster_id FROM points WHERE collection = '{CLAIMS}' AND cluster_id >= 0), {p}seed AS (SELECT query_id, document_id, cluster_id, max(score) AS best FROM {p}seen JOIN {p}facts USING (document_id, node_id) GROUP BY 1, 2, 3),
         {p}members AS (SELECT query_id, document_id, f.node_id, best * {CLUSTER} AS score, 'l4_cluster' AS factor, row_number() OVER (PARTITION BY query_id, document_id, cluster_id ORDER BY f.node_id) AS k FROM {p}seed sd JOIN {p}facts f USING (document_id, cluster_id) WHERE NOT EXISTS (SELECT 1 FROM {p}seen s WHERE s.query_id = sd.query_id AND s.node_id = f.node_id)),
         {p}two AS ({best(merged(f"{apart('seen')} UNION ALL SELECT query_id, document_id, node_id, score, factor FROM {p}members WHERE k <= {MEMBERS}"), k)}), {topped(ENTITIES, "ent", k)}, {p}uni AS ({best(merged(f"{apart('two')} UNION ALL {apart('ent')}"), k)})"""


@query("R8", "points", "links", sql=f"WITH {search_sql(8, 0.2)} SELECT query_id, document_id, node_id, round(score, 4) AS score FROM bridge")
def r8(points, links):
    """Facts linked to the paragraphs that were found, at 0.75 of the best paragraph's score in the document."""
    q, words = point_queries(points), point_words(points)
    found = checkpointed(vector_hits(ivf.build(points, ("collection",), "point_id"), points, q, 8, 0.2))
    return bridged(topped_up(found, words, query_words(q), CHUNKS, 8), links).select("query_id", "document_id", "node_id", F.round("score", 4).alias("score"))


@query("R9", "points", sql=f"""
    WITH {search_sql(8, 0.2)}, seed9 AS (SELECT query_id, document_id, cluster_id, max(score) AS best FROM l4 JOIN facts USING (document_id, node_id) GROUP BY 1, 2, 3),
         m AS (SELECT query_id, document_id, f.node_id, best * {CLUSTER} AS score, row_number() OVER (PARTITION BY query_id, document_id, cluster_id ORDER BY f.node_id) AS k FROM seed9 JOIN facts f USING (document_id, cluster_id) WHERE NOT EXISTS (SELECT 1 FROM l4 s WHERE s.query_id = seed9.query_id AND s.node_id = f.node_id))
    SELECT query_id, document_id, node_id, round(score, 4) AS score FROM m WHERE k <= {MEMBERS}""".replace("FROM l4 JOIN facts", "FROM l4 JOIN facts"))
def r9(points):
    """Up to six other facts of each document and cluster in which the nearest facts are, at 0.55 of the best one's score."""
    l4 = vector_hits(ivf.build(points, ("collection",), "point_id"), points, point_queries(points), 8, 0.2).where(F.col("collection") == CLAIMS)
    return clustered(checkpointed(l4), points).select("query_id", "document_id", "node_id", F.round("score", 4).alias("score"))


SHOWN = "query_id, document_id, node_id, round(score, 4) AS score, factors"


@query("R10", "points", "links", sql=f"WITH {search_sql(8, 0.2)} SELECT {SHOWN} FROM two")
def r10(points, links):
    """Two-factor search, eight hits."""
    q, words = point_queries(points), point_words(points)
    found = checkpointed(vector_hits(ivf.build(points, ("collection",), "point_id"), points, q, 8, 0.2))
    return two_factor(found, points, links, words, query_words(q), 8).withColumn("score", F.round("score", 4))


def allowed(points: DataFrame, registry: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """The points of documents of the given levels."""
    ok = registry.where(F.coalesce("classification", F.lit(O.LEVELS[0])).isin(*levels)).select(F.col("id").alias("document_id"))
    return points.join(ok, "document_id", "left_semi")


@query("R12", "points", "links", "registry", sql=f"""
    WITH all_points AS (SELECT * FROM points), ok AS (SELECT id FROM registry WHERE coalesce(classification, '{O.LEVELS[0]}') IN ('{O.LEVELS[0]}', '{O.LEVELS[1]}')), seen_points AS (SELECT * FROM all_points WHERE document_id IN (SELECT id FROM ok)),
         {search_sql(10, 0.2).replace("FROM points", "FROM seen_points")}
    SELECT {SHOWN}, (SELECT count(*) FROM seen_points p WHERE p.collection = '{CHUNKS}') AS n_chunks, (SELECT count(*) FROM seen_points p WHERE p.collection = '{CLAIMS}') AS n_claims, (SELECT count(*) FROM seen_points p WHERE p.collection = '{ENTITIES}') AS n_entities FROM uni""")
def r12(points, links, registry):
    """Unified search over the three collections, ten hits, and how many points each has; access comes before every cut."""
    seen = checkpointed(allowed(points, registry, O.LEVELS[:2]))
    found = unified(ivf.build(seen, ("collection",), "point_id"), seen, links, point_queries(seen), 10, 0.2)
    counts = seen.agg(*(F.count_if(F.col("collection") == c).alias(f"n_{c}") for c in (CHUNKS, CLAIMS, ENTITIES)))
    return found.withColumn("score", F.round("score", 4)).crossJoin(F.broadcast(counts))  # one row


def intent(text: Column) -> Column:
    """greeting, thanks, ack, meta, or null for what needs the corpus."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))
    kind = F.when(clean.isin(*GREETING), "greeting").when(clean.isin(*THANKS), "thanks").when(clean.isin(*ACK), "ack").when(clean.rlike(META), "meta")
    return F.when((clean != "") & ~text.rlike(DOMAIN) & (F.size(F.split(clean, " ")) <= 6), kind)


@query("R17", "conversations", sql=f"""
    WITH c AS (SELECT conv_id, turn, text, trim(regexp_replace(regexp_replace(lower(trim(text)), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM (SELECT conv_id, turn, CASE turn WHEN 0 THEN 'Hello!' WHEN 1 THEN 'Кто ты?' WHEN 2 THEN 'thanks' ELSE text END AS text FROM conversations))
    SELECT conv_id, turn, CASE WHEN clean <> '' AND NOT regexp_matches(text, '{DOMAIN}') AND len(string_split(clean, ' ')) <= 6 THEN
      CASE WHEN clean IN ({", ".join(f"'{x}'" for x in GREETING)}) THEN 'greeting' WHEN clean IN ({", ".join(f"'{x}'" for x in THANKS)}) THEN 'thanks' WHEN clean IN ({", ".join(f"'{x}'" for x in ACK)}) THEN 'ack' WHEN regexp_matches(clean, '{META}') THEN 'meta' END END AS intent FROM c""")
def r17(conversations):
    said = F.when(F.col("turn") == 0, "Hello!").when(F.col("turn") == 1, "Кто ты?").when(F.col("turn") == 2, "thanks").otherwise(F.col("text"))
    return conversations.select("conv_id", "turn", said.alias("said")).select("conv_id", "turn", intent(F.col("said")).alias("intent"))


@query("R23", "hits", "registry", sql=f"SELECT query_id, node_id, document_id, score FROM hits LEFT JOIN registry r ON r.id = document_id WHERE r.id IS NULL OR coalesce(classification, '{O.LEVELS[0]}') = '{O.LEVELS[0]}'")
def r23(hits, registry):
    """Hits that a viewer may see."""
    hidden = registry.where(F.coalesce("classification", F.lit(O.LEVELS[0])) != O.LEVELS[0]).select(F.col("id").alias("document_id"))
    return hits.join(hidden, "document_id", "left_anti").select("query_id", "node_id", "document_id", "score")


@query("R25", "hits", sql="SELECT query_id, node_id, round(max(score) + 0.1 * (count(DISTINCT factor) - 1), 6) AS score FROM hits GROUP BY 1, 2")
def r25(hits):
    """A bonus for each further source that found a node."""
    return hits.groupBy("query_id", "node_id").agg(F.round(F.max("score") + 0.1 * (F.count_distinct("factor") - 1), 6).alias("score"))


@query("R28", "hits", "registry", sql="""
    WITH d AS (SELECT DISTINCT query_id, document_id FROM hits), r AS (SELECT d.*, file_name, CAST(coalesce(material_date, upload_date) AS VARCHAR) AS dated, row_number() OVER (PARTITION BY query_id ORDER BY document_id) AS k FROM d JOIN registry ON id = document_id)
    SELECT query_id, document_id, file_name, dated FROM r WHERE k <= 8""")
def r28(hits, registry):
    """Sources behind the hits, eight for a query."""
    r = hits.select("query_id", "document_id").distinct().join(registry, F.col("id") == F.col("document_id"))
    r = r.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy("document_id"))).where("k <= 8")
    return r.select("query_id", "document_id", "file_name", F.coalesce("material_date", "upload_date").cast("string").alias("dated"))


@query("R29", "edges", sql="""
    WITH b AS (SELECT src AS node, dst AS other FROM edges WHERE type = 'USES_MAT' UNION SELECT dst, src FROM edges WHERE type = 'USES_MAT'), r AS (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY other) AS k FROM b)
    SELECT node, string_agg(other, ',' ORDER BY other) AS snippets FROM r WHERE k <= 8 GROUP BY 1""")
def r29(edges):
    """Up to eight neighbours of every node, as evidence."""
    e = edges.where("type = 'USES_MAT'").select("src", "dst")
    b = e.select(F.col("src").alias("node"), F.col("dst").alias("other")).union(e.select("dst", "src")).distinct()
    r = b.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy("other"))).where("k <= 8")
    return r.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("snippets"))


@query("R30", "conversations", sql="""
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS d FROM conversations)
    SELECT conv_id, string_agg(role || ': ' || left(text, 2000), chr(10) ORDER BY turn) AS history FROM r WHERE a <= 2 OR d <= 8 GROUP BY 1""")
def r30(conversations):
    """The conversation window: the first two turns and the last eight."""
    up, down = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    r = conversations.withColumns({"a": F.row_number().over(up), "d": F.row_number().over(down)}).where("a <= 2 OR d <= 8")
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), F.substring("text", 1, 2000)).alias("line"))))
    return r.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("history"))


#: What continues the question before.
CONTINUED = ["подумай еще", "подумай ещё", "уточни", "продолжи", "разверни", "расскажи подробнее", "еще раз", "ещё раз", "дополни", "переформулируй", "уточни ответ", "поясни", "объясни подробнее", "а про"]
ASKED_SQL = "qs AS (SELECT item_id AS query_id, lower(trim(text)) AS q, list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda t: t <> '') AS ts FROM benchmark WHERE item_id % 50 = 0)"
SCORE_SQL = "CASE WHEN contains(low, q) THEN 1.0 WHEN len(list_filter(CASE WHEN len(ts) > 4 THEN ts[:3] ELSE ts END, lambda t: NOT contains(low, t))) = 0 THEN 0.7 WHEN len(list_filter(ts, lambda t: contains(low, t))) > 0 THEN 0.4 END::DOUBLE"


def asked(queries: DataFrame) -> DataFrame:
    """query_id, q, ts: the queries (query_id, text) in lower case and their words; blank ones go."""
    q = queries.select("query_id", F.lower(F.trim("text")).alias("q"))
    return q.select("query_id", "q", F.filter(F.split("q", r"\s+"), lambda t: t != "").alias("ts")).where("q <> ''")


def keyword_score(low: Column, q: Column, ts: Column) -> Column:
    """1.0 for the phrase, 0.7 for all primary words (the first three of more than four), 0.4 for one word, null otherwise."""
    primary = F.when(F.size(ts) > 4, F.slice(ts, 1, 3)).otherwise(ts)
    return F.when(low.contains(q), 1.0).when(F.forall(primary, lambda t: low.contains(t)), 0.7).when(F.exists(ts, lambda t: low.contains(t)), 0.4)


def scored(texts: DataFrame, queries: DataFrame, score) -> DataFrame:
    """query_id, id, score: each query of a stated set against every text (id, low), in blocks of queries; score is a function of low, q and ts. Texts without score go."""
    hit = lambda part: texts.join(F.broadcast(part), F.length("low") > 0).select("query_id", "id", score(F.col("low"), F.col("q"), F.col("ts")).alias("score")).where("score IS NOT NULL")
    return in_blocks(queries, "query_id", MAX_SENT_QUERIES, hit)


@query("R4", "documents", "benchmark", sql=f"""
    WITH {ASKED_SQL}, s AS (SELECT query_id, doc_id AS id, {SCORE_SQL} AS score FROM (SELECT doc_id, lower(text) AS low FROM documents WHERE text <> '') JOIN qs ON true), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s WHERE score IS NOT NULL)
    SELECT query_id, id, score FROM r WHERE k <= 10""")
def r4(documents, benchmark):
    """Keyword search, ten documents for each query."""
    texts = documents.select(F.col("doc_id").alias("id"), F.lower("text").alias("low"))
    q = asked(benchmark.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text"))
    return best_of(scored(texts, q, keyword_score), 10, F.desc("score"), F.asc("id"))


@query("R5", "documents", "benchmark", sql=f"""
    WITH {ASKED_SQL}, x AS (SELECT query_id, doc_id AS id, list_filter(list_filter(ts, lambda t: length(t) >= 3)[:6], lambda t: contains(low, t)) AS met FROM (SELECT doc_id, lower(text) AS low FROM documents WHERE text <> '') JOIN qs ON true),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS k FROM x WHERE len(met) > 0)
    SELECT query_id, id, met[1] AS token, 0.5::DOUBLE AS score FROM r WHERE k <= 12""")
def r5(documents, benchmark):
    """Substring seeds: texts that contain one of a query's first six tokens, and the first such token."""
    texts = documents.select(F.col("doc_id").alias("id"), F.lower("text").alias("low"))
    q = asked(benchmark.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text"))
    first = lambda low, _, ts: F.get(F.filter(F.slice(F.filter(ts, lambda t: F.length(t) >= 3), 1, 6), lambda t: low.contains(t)), F.lit(0))
    found = best_of(scored(texts, q, first), 12, F.asc("id"))
    return found.select("query_id", "id", F.col("score").alias("token"), F.lit(0.5).alias("score"))


@query("R6", "documents", "benchmark", "lines", sql=f"""
    WITH {TOK_SQL}, c AS (SELECT query_id, doc_id, count(*) AS overlap FROM dt JOIN qt USING (w) GROUP BY 1, 2), listed AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, doc_id) AS k FROM c) WHERE k <= 5),
         qs AS (SELECT item_id AS query_id, lower(trim(text)) AS q, list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda t: t <> '') AS ts FROM benchmark), s AS (SELECT query_id, doc_id, pos, {SCORE_SQL} AS score FROM (SELECT doc_id, pos, lower(line) AS low FROM lines WHERE line <> '') JOIN listed USING (doc_id) JOIN qs USING (query_id)),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, pos) AS k FROM s WHERE score IS NOT NULL), t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, pos) AS n FROM r WHERE k <= 3)
    SELECT query_id, doc_id, pos, score FROM t WHERE n <= 12""")
def r6(documents, benchmark, lines):
    """Keyword seeds in listed documents: of each three lines at most, twelve for a query. The five documents that share most words with it are listed."""
    listed = token_search(documents.select(F.col("doc_id").alias("id"), "text"), benchmark.select(F.col("item_id").alias("query_id"), "text"), 5).select("query_id", F.col("id").alias("doc_id"))
    q = asked(benchmark.select(F.col("item_id").alias("query_id"), "text"))
    s = lines.join(small_side(listed, MAX_SENT_LISTED), "doc_id").join(small_side(q, MAX_SENT_LISTED), "query_id")  # five rows for each query
    s = s.select("query_id", "doc_id", "pos", keyword_score(F.lower("line"), F.col("q"), F.col("ts")).alias("score")).where("score IS NOT NULL AND line <> ''")
    few = s.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "pos"))).where("k <= 3")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id", "pos")
    return few.withColumn("n", F.row_number().over(best)).where("n <= 12").select("query_id", "doc_id", "pos", "score")


@query("R26", "documents", "benchmark", sql=f"""
    WITH {ASKED_SQL}, s AS (SELECT query_id, doc_id AS id, CASE WHEN len(list_filter(list_filter(ts, lambda t: length(t) >= 3)[:4], lambda t: contains(low, t))) > 0 THEN 0.8 ELSE 0.45 END::DOUBLE AS score FROM (SELECT doc_id, lower(text) AS low FROM documents WHERE text <> '') JOIN qs ON true),
         r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM s) SELECT query_id, id, score FROM r WHERE k <= 20""")
def r26(documents, benchmark):
    """Layer scan: a base score, more where one of a query's first four tokens occurs; twenty for a query."""
    texts = documents.select(F.col("doc_id").alias("id"), F.lower("text").alias("low"))
    q = asked(benchmark.where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text"))
    base = lambda low, _, ts: F.when(F.exists(F.slice(F.filter(ts, lambda t: F.length(t) >= 3), 1, 4), lambda t: low.contains(t)), 0.8).otherwise(0.45)
    return best_of(scored(texts, q, base), 20, F.desc("score"), F.asc("id"))


@query("R11", "vectors", "nodes", "part", sql=f"""
    WITH {COS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM sc WHERE collection = 'entities'), v AS (SELECT query_id, 'Process:' || p_type AS node_id, score, 'vector' AS factor FROM r JOIN part ON p_partkey = vec_id WHERE k <= 4),
         e AS (SELECT DISTINCT id, unnest(regexp_extract_all(lower(name), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM nodes WHERE label = 'Process' AND length(name) > 0), p AS (SELECT query_id, unnest(list_distinct(regexp_extract_all(lower(p_type), '[\\p{{L}}\\p{{N}}_]+'))) AS w FROM q JOIN part ON p_partkey = query_id),
         o AS (SELECT query_id, id, count(*) AS overlap FROM e JOIN p USING (w) GROUP BY 1, 2), ro AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, id) AS k FROM o), t AS (SELECT query_id, id AS node_id, least(1.0, 0.35 + 0.15 * overlap)::DOUBLE AS score, 'token' AS factor FROM ro WHERE k <= 4),
         u AS (SELECT * FROM v UNION ALL SELECT * FROM t)
    SELECT query_id, node_id, round(max(score), 4) AS score, string_agg(DISTINCT factor, ',' ORDER BY factor) AS factors FROM u GROUP BY 1, 2""")
def r11(vectors, nodes, part):
    """Entity search: the nearest entity vectors and the entities that share most words with the query, merged by node."""
    kind = part.select(F.col("p_partkey").cast("long").alias("part"), "p_type")
    q = _queries(vectors)
    v = vector_top_k(vectors.where("collection = 'entities'"), q, 4).join(kind, F.col("vec_id") == F.col("part")).select("query_id", F.concat(F.lit("Process:"), "p_type").alias("node_id"), "score", F.lit("vector").alias("factor"))
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("w")
    e = nodes.where("label = 'Process'").select("id", "name").distinct().select("id", words("name"))
    asked_words = q.join(kind, F.col("query_id") == F.col("part")).select("query_id", words("p_type"))
    t = postings.top_k(e, asked_words, 4).select("query_id", F.col("id").alias("node_id"), F.least(F.lit(1.0), 0.35 + 0.15 * F.col("overlap")).alias("score"), F.lit("token").alias("factor"))
    merged = v.unionByName(t).groupBy("query_id", "node_id").agg(F.max("score").alias("score"), F.array_join(F.array_sort(F.collect_set("factor")), ",").alias("factors"))
    return merged.select("query_id", "node_id", F.round("score", 4).alias("score"), "factors")


PHRASE_SQL = """qs AS (SELECT query_id, q, string_split(q, ' ') AS ts FROM (SELECT vec_id AS query_id, regexp_extract(lower(trim(text)), '^[^\\s]+ [^\\s]+ [^\\s]+') AS q FROM vectors JOIN documents ON doc_id = document_id WHERE vec_id % 50 = 0) WHERE q <> '')"""


def phrases(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """The words of a vector query: the first three of its document."""
    own = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("document_id").alias("doc_id"))
    text = F.regexp_extract(F.lower(F.trim("text")), r"^[^\s]+ [^\s]+ [^\s]+", 0)
    return asked(own.join(documents, "doc_id").select("query_id", text.alias("text")))


@query("R13", "vectors", "documents", sql=f"""
    WITH {COS_SQL}, {PHRASE_SQL}, v AS (SELECT query_id, vec_id AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM sc WHERE score >= 0.4),
         f AS (SELECT query_id, doc_id AS id, {SCORE_SQL} AS score FROM (SELECT doc_id, lower(text) AS low FROM documents WHERE text <> '') JOIN qs ON query_id NOT IN (SELECT query_id FROM v)), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM f WHERE score IS NOT NULL)
    SELECT query_id, 'vector' AS mode, id, round(score, 4) AS score FROM v WHERE k <= 5 UNION ALL SELECT query_id, 'keyword', id, score FROM fr WHERE k <= 5""")
def r13(vectors, documents):
    """Vector search, and keyword search for the queries that no vector answers."""
    v = checkpointed(vector_top_k(vectors, _queries(vectors), 5, 0.4).select("query_id", F.lit("vector").alias("mode"), F.col("vec_id").alias("id"), F.round("score", 4).alias("score")))
    rest = phrases(vectors, documents).join(v.select("query_id").distinct(), "query_id", "left_anti")
    texts = documents.select(F.col("doc_id").alias("id"), F.lower("text").alias("low"))
    k = best_of(scored(texts, rest, keyword_score), 5, F.desc("score"), F.asc("id"))
    return v.unionByName(k.select("query_id", F.lit("keyword").alias("mode"), "id", "score"))


#: Stages of the cascade: what is recorded, and the least score of vectors where they are searched. Fixed value: hits of a query.
SCOPED, RETRY, KEYWORD, KEYWORD_ALL, SUBSTRING = ("", 0.35), ("global_retry", 0.05), "graph_keyword", "graph_keyword_global", "substring"
ANSWERS = 9
CASCADE_SQL = "SELECT v.point_id * 10 + n AS query_id, v.point_id AS self_id, CAST(v.embedding AS DOUBLE[]) AS query, regexp_extract(v.text, '^\\S+ \\S+') AS text, o.folder FROM points o JOIN (SELECT 0 AS n UNION ALL SELECT 1) ON true JOIN points v ON v.point_id = o.point_id + n WHERE o.point_id % 50 = 0"


def cascade_queries(points: DataFrame) -> DataFrame:
    """Every fiftieth point as a query, and the point after it as its variant; both search the first one's folder. query_id is ten times the point's id and the variant's number."""
    first = points.where("point_id % 50 = 0").select(F.col("point_id").alias("at"), "folder", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    said = points.select(F.col("point_id").alias("self_id"), F.col("embedding").alias("query"), F.regexp_extract("text", r"^\S+ \S+", 0).alias("text"))
    return first.join(said, F.col("self_id") == F.col("at") + F.col("n")).select((F.col("self_id") * 10 + F.col("n")).alias("query_id"), "self_id", "query", "text", "folder", (F.col("at")).alias("asked"), F.col("n").alias("variant"))


def keyword_hits(points: DataFrame, queries: DataFrame, scoped: bool, kind: str) -> DataFrame:
    """Points whose text has a query's words (or parts of its first six), the best ANSWERS of each query."""
    q = asked(queries.select("query_id", "text")).join(queries.select("query_id", "folder"), "query_id")
    texts = points.where(F.length("text") > 0).select(F.col("point_id").alias("id"), "document_id", F.col("folder").alias("its"), F.lower("text").alias("low"))
    part = F.exists(F.slice(F.filter("ts", lambda t: F.length(t) >= 3), 1, 6), lambda t: F.col("low").contains(F.substring(t, 1, 3)))
    score = keyword_score(F.col("low"), F.col("q"), F.col("ts")) if kind != SUBSTRING else F.when(part, 0.5)
    hit = lambda block: texts.join(F.broadcast(block), (F.col("its") == F.col("folder")) if scoped else F.lit(True)).select("query_id", "document_id", F.col("id").alias("node_id"), score.alias("score")).where("score IS NOT NULL")
    found = best_of(in_blocks(q, "query_id", MAX_SENT_QUERIES, hit), ANSWERS, F.desc("score"), F.asc("node_id"), salt="node_id")
    return found.withColumn("factors", F.lit(kind))


def cascade(points: DataFrame, links: DataFrame, queries: DataFrame, limit: int = ANSWERS) -> DataFrame:
    """Each query's hits of the first stage, and in it of the first variant, that finds any: unified search in its folder, then everywhere from a lower score on, keywords in its folder and everywhere, parts of words.
    A stage runs for the queries that are left, and none if none is."""
    index = ivf.build(points, ("collection", "folder"), "point_id")
    stages = [
        (SCOPED[0], lambda q: unified(index, points, links, q, limit, SCOPED[1], ("folder",))),
        (RETRY[0], lambda q: unified(index, points, links, q, limit, RETRY[1])),
        (KEYWORD, lambda q: keyword_hits(points, q, True, KEYWORD)),
        (KEYWORD_ALL, lambda q: keyword_hits(points, q, False, KEYWORD)),
        (SUBSTRING, lambda q: keyword_hits(points, q, False, SUBSTRING)),
    ]
    left, out = checkpointed(queries), []
    for name, stage in stages:
        hits = stage(left).join(left.select("query_id", "asked", "variant"), "query_id")
        hits = checkpointed(hits.withColumn("first", F.min("variant").over(Window.partitionBy("asked"))).where("variant = first").drop("first").withColumn("fallback", F.lit(name)))
        out.append(hits)
        left = checkpointed(left.join(hits.select("asked").distinct(), "asked", "left_anti"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, out)


def by_factor(hits: DataFrame, points: DataFrame) -> DataFrame:
    """Which part of the answer each hit belongs to, and the clusters of all facts among a query's hits."""
    has = lambda *fs: reduce(Column.__or__, (F.array_contains(F.split("factors", ","), f) for f in fs))
    own = hits.join(points.select(F.col("point_id").alias("node_id"), "collection", "cluster_id"), "node_id")
    clusters = F.array_join(F.transform(F.array_sort(F.collect_set(F.when((F.col("collection") == CLAIMS) & (F.col("cluster_id") >= 0), F.col("cluster_id"))).over(Window.partitionBy("asked"))), lambda c: c.cast("string")), ",")
    return own.select(
        F.col("asked").alias("query_id"), "variant", "fallback", "document_id", "node_id", F.round("score", 4).alias("score"), "factors", (F.col("collection") == CHUNKS).alias("is_l3"), has("l4_embedding").alias("is_l4"), (F.col("collection") == ENTITIES).alias("is_entity"), has("l4_cluster", "l4_graph_bridge").alias("is_cluster"), clusters.alias("clusters")
    )


WORDS_SQL = "words AS (SELECT query_id, asked, variant, folder, q, list_filter(regexp_split_to_array(q, '\\s+'), lambda t: t <> '') AS ts FROM (SELECT query_id, query_id // 10 - query_id % 10 AS asked, query_id % 10 AS variant, folder, lower(trim(text)) AS q FROM near_q) WHERE q <> '')"


def _stage_sql(n: int, rows: str) -> str:
    """The rows of stage n for the queries that the ones before left."""
    before = "".join(f" AND query_id // 10 - query_id % 10 NOT IN (SELECT query_id // 10 - query_id % 10 FROM s{k})" for k in range(1, n))
    return f"s{n} AS (SELECT query_id, document_id, node_id, score, factors FROM ({rows}) WHERE true{before})"


def _words_sql(score: str, kind: str, scope: str) -> str:
    return f"SELECT query_id, document_id, node_id, score, '{kind}' AS factors FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS k FROM (SELECT query_id, document_id, point_id AS node_id, {score} AS score FROM (SELECT *, lower(text) AS low FROM points WHERE text <> '') pt JOIN words q ON {scope}) WHERE score IS NOT NULL) WHERE k <= {ANSWERS}"


PART_SQL = "CASE WHEN len(list_filter(list_filter(ts, lambda t: length(t) >= 3)[:6], lambda t: contains(low, t[:3]))) > 0 THEN 0.5 END"


@query("R14", "points", "links", sql=f"""
    WITH {search_sql(ANSWERS, SCOPED[1], CASCADE_SQL, "near_", "pt.folder = q.folder")}, {search_sql(ANSWERS, RETRY[1], CASCADE_SQL, "far_")}, {WORDS_SQL},
         {_stage_sql(1, "SELECT * FROM near_uni")}, {_stage_sql(2, "SELECT * FROM far_uni")}, {_stage_sql(3, _words_sql(SCORE_SQL, KEYWORD, "pt.folder = q.folder"))}, {_stage_sql(4, _words_sql(SCORE_SQL, KEYWORD, "true"))}, {_stage_sql(5, _words_sql(PART_SQL, SUBSTRING, "true"))},
         every AS ({" UNION ALL ".join(f"SELECT *, '{name}' AS fallback FROM s{n}" for n, name in enumerate((SCOPED[0], RETRY[0], KEYWORD, KEYWORD_ALL, SUBSTRING), 1))}), one AS (SELECT *, query_id // 10 - query_id % 10 AS asked, query_id % 10 AS variant, min(query_id % 10) OVER (PARTITION BY query_id // 10 - query_id % 10) AS first FROM every),
         h AS (SELECT one.*, collection, cluster_id, string_split(factors, ',') AS fs FROM one JOIN points ON point_id = node_id WHERE variant = first), c AS (SELECT asked, array_to_string(list_sort(list_distinct(list(cluster_id))), ',') AS clusters FROM h WHERE collection = '{CLAIMS}' AND cluster_id >= 0 GROUP BY 1)
    SELECT asked AS query_id, variant, fallback, document_id, node_id, round(score, 4) AS score, factors, collection = '{CHUNKS}' AS is_l3, list_contains(fs, 'l4_embedding') AS is_l4, collection = '{ENTITIES}' AS is_entity, list_contains(fs, 'l4_cluster') OR list_contains(fs, 'l4_graph_bridge') AS is_cluster, coalesce(clusters, '') AS clusters FROM h LEFT JOIN c USING (asked)""")
def r14(points, links):
    """The retrieval cascade, nine hits of each query."""
    return by_factor(cascade(points, links, cascade_queries(points)), points)


KNOWN_SQL = "known AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{L}]{6,}')) AS w FROM benchmark)"
CLEAN_SQL = "trim(regexp_replace(regexp_replace(lower(trim(text)), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
CHAT_SQL = f"""(clean <> '' AND NOT regexp_matches(text, '{DOMAIN}') AND len(string_split(clean, ' ')) <= 6 AND (clean IN ({", ".join(f"'{x}'" for x in GREETING + THANKS + ACK)}) OR regexp_matches(clean, '{META}')))"""


def with_known(requests: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The requests with `known`: whether one of their words is a term of the dictionary."""
    words = requests.select("query_id", F.explode(tokens(F.col("text"))).alias("w"))
    terms = benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{6,}"), F.lit(0))).alias("w")).distinct()
    known = words.join(terms, "w", "left_semi").select("query_id").distinct().withColumn("known", F.lit(True))
    return requests.join(known, "query_id", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def threshold(text: Column, known: Column) -> Column:
    """The least score of a hit: small talk nearly nothing passes, one or two words need more than known terms do, others none."""
    n = F.size(tokens(text))
    return F.when(intent(text).isNotNull(), 0.99).when(n <= 2, F.when(known, 0.35).otherwise(0.45))


@query("R15", "requests", "benchmark", sql=f"""
    WITH {KNOWN_SQL}, c AS (SELECT query_id, text, {CLEAN_SQL} AS clean, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= 2)) AS ts FROM requests),
         k AS (SELECT DISTINCT query_id FROM (SELECT query_id, unnest(ts) AS w FROM c) JOIN known USING (w))
    SELECT query_id, CASE WHEN {CHAT_SQL} THEN 0.99 WHEN len(ts) <= 2 THEN CASE WHEN query_id IN (SELECT query_id FROM k) THEN 0.35 ELSE 0.45 END END::DOUBLE AS threshold FROM c""")
def r15(requests, benchmark):
    return with_known(requests, benchmark).select("query_id", threshold(F.col("text"), F.col("known")).alias("threshold"))


@query("R16", "requests", "hits", sql=f"""
    WITH c AS (SELECT query_id, conv_id, turn, text, {CLEAN_SQL} AS clean FROM requests), t AS (SELECT query_id AS turn, conv_id, max(score) AS top FROM hits GROUP BY 1, 2)
    SELECT c.query_id, {CHAT_SQL} OR top IS NULL OR (len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '')) <= 3 AND top < 0.42) AS rejected FROM c LEFT JOIN t ON t.turn = c.turn AND t.conv_id = c.conv_id""")
def r16(requests, hits):
    """The confidence gate: small talk, queries without hits and short queries with weak hits are rejected."""
    top = hits.groupBy(F.col("query_id").alias("hit_turn"), F.col("conv_id").alias("hit_conv")).agg(F.max("score").alias("top"))
    q = requests.join(top, (F.col("turn") == F.col("hit_turn")) & (F.col("conv_id") == F.col("hit_conv")), "left")
    words = F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != ""))
    return q.select("query_id", (intent(F.col("text")).isNotNull() | F.col("top").isNull() | ((words <= 3) & (F.col("top") < 0.42))).alias("rejected"))


@query("R18", "requests", "conversations", "benchmark", sql=f"""
    WITH {KNOWN_SQL}, p AS (SELECT conv_id, turn, last_value(CASE WHEN role = 'user' AND trim(text) <> '' THEN text END IGNORE NULLS) OVER w AS pu, last_value(CASE WHEN role = 'assistant' AND trim(text) <> '' THEN text END IGNORE NULLS) OVER w AS pa FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
         c AS (SELECT query_id, text, trim(text) AS q, {CLEAN_SQL} AS clean, list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: w <> '') AS ws, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) >= 2)) AS ts,
                      left(trim(regexp_replace(pu, '\\s+', ' ', 'g')), 500) AS pu, left(trim(regexp_replace(pa, '\\s+', ' ', 'g')), 500) AS pa FROM requests JOIN p USING (conv_id, turn)),
         k AS (SELECT DISTINCT query_id FROM (SELECT query_id, unnest(ts) AS w FROM c) JOIN known USING (w)),
         f AS (SELECT *, q <> '' AND ({" OR ".join(f"contains(lower(q), '{m}')" for m in CONTINUED)}) AS continued FROM c),
         g AS (SELECT *, q <> '' AND NOT continued AND ({CHAT_SQL} OR (len(ws) <= 3 AND (query_id IN (SELECT query_id FROM k) OR len(ws) <= 2))) AS standalone FROM f)
    SELECT query_id, continued, standalone, CASE WHEN q = '' OR standalone THEN q WHEN continued AND pu IS NOT NULL THEN left(trim(regexp_replace(pu || ' ' || q || coalesce(' ' || left(pa, 200), ''), '\\s+', ' ', 'g')), 600) WHEN len(ws) <= 3 AND pu IS NOT NULL THEN left(trim(regexp_replace(pu || ' ' || q, '\\s+', ' ', 'g')), 600) ELSE q END AS effective FROM g""")
def r18(requests, conversations, benchmark):
    """What a turn asks for: it continues the question before, stands alone, or is short and needs that question's words."""
    squeezed = lambda c, n: F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, n)
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda role: squeezed(F.last(F.when((F.col("role") == role) & (F.trim("text") != ""), F.col("text")), ignorenulls=True).over(w), 500)
    prior = conversations.select("conv_id", "turn", before("user").alias("pu"), before("assistant").alias("pa"))
    q, n = F.trim("text"), F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda x: x != ""))
    c = with_known(requests, benchmark).join(prior, ["conv_id", "turn"])
    c = c.withColumn("continued", (q != "") & reduce(lambda a, b: a | b, (F.lower(q).contains(m) for m in CONTINUED)))
    c = c.withColumn("standalone", (q != "") & ~F.col("continued") & (intent(F.col("text")).isNotNull() | ((n <= 3) & (F.col("known") | (n <= 2)))))
    effective = F.when((q == "") | F.col("standalone"), q).when(F.col("continued") & F.col("pu").isNotNull(), squeezed(F.concat_ws(" ", "pu", q, F.substring("pa", 1, 200)), 600)).when((n <= 3) & F.col("pu").isNotNull(), squeezed(F.concat_ws(" ", "pu", q), 600)).otherwise(q)
    return c.select("query_id", "continued", "standalone", effective.alias("effective"))


FACETS = "query_facets struct<materials:array<string>,processes:array<string>,geography:array<string>,years:array<string>,numeric_min:double,numeric_param:string,conditions:array<string>>"
FACETS_SQL = """f AS (SELECT query_id, text, list_filter(list_transform(coalesce(CAST(j -> '$.materials' AS VARCHAR[]), []), lambda x: trim(x)), lambda x: x <> '') AS materials, list_filter(list_transform(coalesce(CAST(j -> '$.processes' AS VARCHAR[]), []), lambda x: trim(x)), lambda x: x <> '') AS processes,
    list_filter(list_transform(coalesce(CAST(j -> '$.geography' AS VARCHAR[]), []), lambda x: trim(x)), lambda x: x <> '') AS geography, list_filter(list_transform(coalesce(CAST(j -> '$.conditions' AS VARCHAR[]), []), lambda x: trim(x)), lambda x: x <> '') AS conditions,
    list_filter(list_transform(coalesce(CAST(j -> '$.years' AS VARCHAR[]), []), lambda y: TRY_CAST(regexp_extract(y, '(?:19|20)[0-9]{2}') AS INT)), lambda y: y IS NOT NULL) AS years, CAST(j ->> '$.numeric_min' AS DOUBLE) AS numeric_min, nullif(trim(j ->> '$.numeric_param'), '') AS numeric_param
    FROM (SELECT query_id, text, CAST(plan AS JSON) -> '$.query_facets' AS j FROM plans))"""


def facets(plans: DataFrame) -> DataFrame:
    """query_id, text and the facets of each plan: lists without blanks, the years that are meant, the numeric bound."""
    x = F.from_json("plan", FACETS)["query_facets"]
    full = lambda c: F.filter(F.transform(F.coalesce(x[c], F.expr("cast(array() as array<string>)")), lambda v: F.trim(v)), lambda v: v != "").alias(c)
    years = F.filter(F.transform(F.coalesce(x["years"], F.expr("cast(array() as array<string>)")), lambda y: F.regexp_extract(y, "(?:19|20)[0-9]{2}", 0).try_cast("int")), lambda y: y.isNotNull())
    return plans.select("query_id", "text", full("materials"), full("processes"), full("geography"), full("conditions"), years.alias("years"), x["numeric_min"].alias("numeric_min"), F.nullif(F.trim(x["numeric_param"]), F.lit("")).alias("numeric_param"))


@query("R20", "plans", sql=f"WITH {FACETS_SQL} SELECT query_id, array_to_string(materials, '|') AS materials, array_to_string(processes, '|') AS processes, array_to_string(geography, '|') AS geography, list_min(years) AS year_min, list_max(years) AS year_max, numeric_min, numeric_param FROM f")
def r20(plans):
    """The facets of search plans."""
    f, line = facets(plans), lambda c: F.array_join(c, "|").alias(c)
    return f.select("query_id", line("materials"), line("processes"), line("geography"), F.array_min("years").alias("year_min"), F.array_max("years").alias("year_max"), "numeric_min", "numeric_param")


@query("R21", "plans", sql=f"""
    WITH {FACETS_SQL} SELECT query_id, left(trim(regexp_replace(concat_ws(' ', trim(text), nullif(array_to_string(materials[:3], ' '), ''), nullif(array_to_string(processes[:3], ' '), ''), nullif(array_to_string(conditions[:3], ' '), ''),
           nullif(array_to_string(list_transform(geography[:2], lambda g: CASE g WHEN 'domestic' THEN 'Россия' WHEN 'foreign' THEN 'зарубежная практика' ELSE g END), ' '), ''), numeric_param), '\\s+', ' ', 'g')), 800) AS query FROM f""")
def r21(plans):
    """Queries with the words of their facets: three of each group, two places."""
    head = lambda c, n: F.slice(c, 1, n)
    place = lambda g: F.when(g == "domestic", "Россия").when(g == "foreign", "зарубежная практика").otherwise(g)
    text = F.concat_ws(" ", F.trim("text"), head("materials", 3), head("processes", 3), head("conditions", 3), F.transform(head("geography", 2), place), "numeric_param")
    return facets(plans).select("query_id", F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 800).alias("query"))


@query("R22", "hits", "nodes", "registry", "plans", sql=f"""
    WITH {FACETS_SQL}, h AS (SELECT DISTINCT query_id, document_id FROM hits), x AS (SELECT h.query_id, n.document_id, n.id, n.label, lower(coalesce(n.name, '')) AS blob, n.numeric_value, n.parameter, r.geography AS place, year(r.material_date) AS y FROM h JOIN nodes n USING (document_id) LEFT JOIN registry r ON r.id = n.document_id),
         p AS (SELECT x.*, (label <> 'Material' OR len(materials) = 0 OR len(list_filter(materials, lambda m: contains(blob, lower(m)))) > 0) AND (label <> 'Process' OR len(processes) = 0 OR len(list_filter(processes, lambda m: contains(blob, lower(m)))) > 0)
              AND (label NOT IN ('Document', 'Expert') OR len(geography) = 0 OR coalesce(list_contains(geography, place), false)) AND (label <> 'Document' OR y IS NULL OR len(years) = 0 OR y BETWEEN list_min(years) AND list_max(years))
              AND (label <> 'Measurement' OR numeric_min IS NULL OR (numeric_param IS NOT NULL AND NOT contains(lower(parameter), lower(numeric_param))) OR numeric_value IS NULL OR numeric_value >= numeric_min) AS ok FROM x JOIN f ON f.query_id = x.query_id + 1),
         m AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS any_ok FROM p) SELECT query_id, document_id, id FROM m WHERE ok OR NOT any_ok""")
def r22(hits, nodes, registry, plans):
    """The soft filter: nodes of the found documents that pass the tests of their label; all of them, if none of a query passes."""
    r = registry.select(F.col("id").alias("document_id"), F.col("geography").alias("place"), F.year("material_date").alias("y"))
    f = facets(plans).drop("text").withColumn("query_id", F.col("query_id") - 1)
    h = hits.select("query_id", "document_id").distinct()
    x = h.join(nodes, "document_id").join(r, "document_id", "left").join(f, "query_id")
    has = lambda c: F.exists(c, lambda m: F.lower(F.coalesce("name", F.lit(""))).contains(F.lower(m)))
    label = F.col("label")
    tests = (
        (label != "Material") | (F.size("materials") == 0) | has("materials"),
        (label != "Process") | (F.size("processes") == 0) | has("processes"),
        ~label.isin("Document", "Expert") | (F.size("geography") == 0) | F.coalesce(F.array_contains("geography", F.col("place")), F.lit(False)),
        (label != "Document") | F.col("y").isNull() | (F.size("years") == 0) | F.col("y").between(F.array_min("years"), F.array_max("years")),
        (label != "Measurement") | F.col("numeric_min").isNull() | F.coalesce(~F.lower("parameter").contains(F.lower("numeric_param")), F.lit(False)) | F.col("numeric_value").isNull() | (F.col("numeric_value") >= F.col("numeric_min")),
    )
    p = x.select("query_id", "document_id", "id", reduce(lambda a, b: a & b, tests).alias("ok"))
    some = p.where("ok").select("query_id").distinct().withColumn("any_ok", F.lit(True))
    return p.join(F.broadcast(some), "query_id", "left").where("ok OR any_ok IS NULL").select("query_id", "document_id", "id")  # a row for each query


@query("R24", "hits", "registry", "views", sql="""
    SELECT h.query_id, node_id, document_id, score FROM hits h JOIN views v ON v.query_id = h.query_id + 1 LEFT JOIN registry r ON r.id = document_id
    WHERE (factor = 'system' OR score >= min_score) AND (factor = 'assistant' OR extension IS NULL OR coalesce(ends_with(lower(file_name), extension), false)) AND (keyword IS NULL OR contains(lower(text), keyword))""")
def r24(hits, registry, views):
    """A viewer's filters: least score of hits not found by keyword, document kind of hits that aren't entities, a word in the text."""
    v = views.withColumn("query_id", F.col("query_id") - 1)
    x = hits.join(v, "query_id").join(registry.select(F.col("id").alias("document_id"), F.lower("file_name").alias("file")), "document_id", "left")
    kind = (F.col("factor") == "assistant") | F.col("extension").isNull() | F.coalesce(F.col("file").endswith(F.col("extension")), F.lit(False))
    word = F.col("keyword").isNull() | F.lower("text").contains(F.col("keyword"))
    return x.where(((F.col("factor") == "system") | (F.col("score") >= F.col("min_score"))) & kind & word).select("query_id", "node_id", "document_id", "score")


@query("R27", "vectors", sql="""
    WITH s AS (SELECT DISTINCT document_id, cluster_id FROM vectors WHERE vec_id % 50 = 0 AND cluster_id >= 0)
    SELECT vec_id, round(CASE WHEN is_anomaly AND anomaly_score > 0.8 THEN 0.85 WHEN is_anomaly AND anomaly_score > 0.5 THEN 0.72 WHEN is_anomaly THEN 0.48 WHEN (document_id, cluster_id) IN (SELECT document_id, cluster_id FROM s) THEN 0.55 ELSE 0 END + CASE WHEN vec_id % 50 = 0 THEN 0.25 ELSE 0 END, 4)::DOUBLE AS score FROM vectors""")
def r27(vectors):
    """Ranking that favours anomalies, seeds and what shares a cluster with a seed in its document."""
    s = vectors.where("vec_id % 50 = 0 AND cluster_id >= 0").select("document_id", "cluster_id").distinct().withColumn("mate", F.lit(True))
    v = vectors.join(s, ["document_id", "cluster_id"], "left")
    noise = F.when(F.col("is_anomaly") & (F.col("anomaly_score") > 0.8), 0.85).when(F.col("is_anomaly") & (F.col("anomaly_score") > 0.5), 0.72).when(F.col("is_anomaly"), 0.48).when(F.col("mate"), 0.55).otherwise(0.0)
    return v.select("vec_id", F.round(noise + F.when(F.col("vec_id") % 50 == 0, 0.25).otherwise(0.0), 4).alias("score"))
