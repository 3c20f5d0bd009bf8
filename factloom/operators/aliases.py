"""Alias groups (A33, R19): entities that share a name, directly, by way of others, or by names that are nearly the same.

Entities and their terms are the two sides of a graph, so entities with a common term hang together through it and no pairs
of entities are formed. Near terms become edges between terms. They are found by their pieces of three characters: two sets
with a Jaccard similarity of `least` share l of the few rarest pieces of either (the prefix filter, longer by l - 1), so they
have a combination of l pieces in common, and each pair that does is verified. There are only so many pieces; single ones would
pair a share of all terms. Components are found by letting every node point to the smallest one around it, from both sides in turn, until nothing changes.

Defined cases: null and blank terms connect nothing; an entity without terms is a group of its own; terms are compared
trimmed and in lower case; ties go to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.registry import query
from factloom.session import checkpointed, small_side

#: Characters of a piece, and the least similarity of near terms.
PIECE, LEAST = 3, 0.8
#: Fixed value: terms that an expansion adds at most.
ADDED = 12
#: Rows of counted pieces that are sent to all tasks at most.
SENT_PIECES = 200_000


def plain(term: Column) -> Column:
    return F.lower(F.trim(term))


def pieces(term: Column) -> Column:
    """The distinct pieces of a term, shorter ones whole."""
    n = F.length(term) - PIECE + 1
    return F.when(n < 1, F.array(term)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(term, i, F.lit(PIECE)))))


def shared_pieces(n: Column, least: float) -> Column:
    """How many of their rarest pieces two terms must share to be compared, by the size of the smaller one: more where terms
    are short, since pieces of three characters soon repeat, fewer where there are many to combine."""
    wanted = F.when(n < 4, 1).when(n < 8, 2).when(n <= 16, 3).when(n <= 64, 2).otherwise(1)
    return F.least(wanted, F.ceil(n * least - 1e-9)).cast("int")


def combined(items: Column, l: Column) -> Column:  # noqa: E741
    """Hashes of all combinations of l (1 to 3) of the items, in their order."""
    after = lambda i: F.slice(items, i + 2, F.size(items))
    one = F.transform(items, lambda x: F.xxhash64(F.lit(1), x))
    two = F.flatten(F.transform(items, lambda x, i: F.transform(after(i), lambda y: F.xxhash64(F.lit(2), x, y))))
    three = F.flatten(F.flatten(F.transform(items, lambda x, i: F.transform(after(i), lambda y, j: F.transform(after(i + j + 1), lambda z: F.xxhash64(F.lit(3), x, y, z))))))
    return F.when(l == 1, one).when(l == 2, two).otherwise(three)


def meetings(terms: DataFrame, least: float) -> DataFrame:
    """a, b (a < b), n, m: distinct terms (term) with as many pieces n and m that may be so similar; once for each combination that they share."""
    sets = checkpointed(terms.select("term").distinct().where("term <> ''").select("term", pieces(F.col("term")).alias("set")))
    flat = sets.select("term", F.explode("set").alias("piece"))
    times = small_side(flat.groupBy("piece").agg(F.count("*").alias("times")), SENT_PIECES)
    ranked = flat.join(times, "piece").groupBy("term").agg(F.array_sort(F.collect_list(F.struct("times", "piece"))).alias("ranked"))
    n = F.size("ranked")
    own = ranked.select("term", n.alias("n"), F.transform("ranked", lambda x: x["piece"]).alias("ranked"))
    # the smaller one of a pair has between this and n pieces
    sizes = F.sequence(F.greatest(F.ceil(F.col("n") * least - 1e-9), F.lit(1)).cast("int"), F.col("n"))
    each = own.withColumn("l", F.explode(F.array_distinct(F.transform(sizes, lambda k: shared_pieces(k, least)))))
    first = F.slice("ranked", 1, F.least(F.col("n") - F.ceil(F.col("n") * least - 1e-9).cast("int") + F.col("l"), F.col("n")))
    keys = each.select("term", "n", F.explode(combined(first, F.col("l"))).alias("key"))
    other = keys.select("key", F.col("term").alias("b"), F.col("n").alias("m"))
    return keys.withColumnRenamed("term", "a").join(other.hint("merge"), "key").where((F.col("a") < F.col("b")) & (F.least("n", "m") >= F.greatest("n", "m") * least - 1e-9))


def near_terms(terms: DataFrame, least: float = LEAST) -> DataFrame:
    """a, b (a < b) and similarity of the distinct terms (term) whose pieces are so similar."""
    common = F.size(F.array_intersect(pieces(F.col("a")), pieces(F.col("b"))))  # seen again from the terms, before pairs that met several times are made one
    return meetings(terms, least).select("a", "b", (common / (F.col("n") + F.col("m") - common)).alias("similarity")).where(F.col("similarity") >= least - 1e-9).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, the smallest node that it is connected with, of all nodes of the edges (a, b).

    In each round, every node's larger neighbours are tied to the smallest node around it, then every node's smaller
    neighbours; stars are left, and rounds grow with the logarithm of the longest path."""
    now, before = checkpointed(edges.select("a", "b").where("a <> b").distinct()), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        now = checkpointed(down.join(small, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(small.select("a", F.col("m").alias("b"))).distinct())
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots).distinct()


def alias_groups(entities: DataFrame, least: float = LEAST) -> DataFrame:
    """entity_id, group_id (the smallest entity it hangs together with) and members of all entities (entity_id, term)."""
    own = checkpointed(entities.select("entity_id", plain(F.col("term")).alias("term")).distinct())
    named = own.where("term <> ''")
    near = near_terms(named, least).select(F.concat(F.lit("t"), "a").alias("a"), F.concat(F.lit("t"), "b").alias("b"))
    edges = named.select(F.concat(F.lit("e"), F.col("entity_id").cast("string")).alias("a"), F.concat(F.lit("t"), "term").alias("b")).unionByName(near)
    roots = components(edges)
    of = own.select("entity_id").distinct().join(roots, F.col("node") == F.concat(F.lit("e"), F.col("entity_id").cast("string")), "left").select("entity_id", F.coalesce("root", F.concat(F.lit("e"), F.col("entity_id").cast("string"))).alias("root"))
    groups = of.groupBy("root").agg(F.min("entity_id").alias("group_id"), F.count("*").alias("members"))
    return of.join(groups, "root").select("entity_id", "group_id", "members")


def expansions(entities: DataFrame, most: int = ADDED) -> DataFrame:
    """term and expansion: the first `most` other terms, in order, of the entities that have the term. Of each entity its
    most + 1 first terms are enough to know, so an entity of many terms isn't paired with itself."""
    own = entities.select("entity_id", plain(F.col("term")).alias("term")).where("term <> ''").distinct()
    k = F.row_number().over(Window.partitionBy("entity_id").orderBy("term"))
    first = own.withColumn("k", k).where(F.col("k") <= most + 1).groupBy("entity_id").agg(F.collect_list("term").alias("others"))
    met = own.join(first, "entity_id").select("term", F.explode("others").alias("other")).where("term <> other").distinct()
    r = F.row_number().over(Window.partitionBy("term").orderBy("other"))
    return met.withColumn("r", r).where(F.col("r") <= most).groupBy("term").agg(F.array_join(F.array_sort(F.collect_list("other")), ",").alias("expansion"))


@query("A33", "part_terms", sql=f"""
    WITH RECURSIVE o AS (SELECT DISTINCT entity_id, lower(trim(term)) AS term FROM part_terms WHERE trim(term) <> ''), s AS (SELECT term, list_distinct(list_transform(generate_series(1, greatest(length(term) - {PIECE - 1}, 1)), lambda i: substr(term, i, {PIECE}))) AS x FROM (SELECT DISTINCT term FROM o)),
         near AS (SELECT a.term AS a, b.term AS b FROM s a JOIN s b ON a.term < b.term AND len(list_intersect(a.x, b.x)) / (len(a.x) + len(b.x) - len(list_intersect(a.x, b.x))) >= {LEAST}),
         linked AS (SELECT DISTINCT x.entity_id AS a, y.entity_id AS b FROM o x JOIN o y USING (term) UNION SELECT DISTINCT x.entity_id, y.entity_id FROM near JOIN o x ON x.term = near.a JOIN o y ON y.term = near.b UNION SELECT DISTINCT y.entity_id, x.entity_id FROM near JOIN o x ON x.term = near.a JOIN o y ON y.term = near.b),
         r(id, root) AS (SELECT a, a FROM linked UNION SELECT b, root FROM r JOIN linked ON a = r.id), g AS (SELECT id AS entity_id, min(root) AS group_id FROM r GROUP BY 1)
    SELECT entity_id, group_id, count(*) OVER (PARTITION BY group_id) AS members FROM g QUALIFY count(*) OVER (PARTITION BY group_id) > 1""")
def a33(part_terms):
    """Entities that may be the same, with their group."""
    return alias_groups(part_terms).where("members > 1")


@query("R19", "part_terms", sql=f"""
    WITH o AS (SELECT DISTINCT entity_id, lower(trim(term)) AS term FROM part_terms WHERE trim(term) <> ''), p AS (SELECT DISTINCT x.term, y.term AS other FROM o x JOIN o y USING (entity_id) WHERE x.term <> y.term)
    SELECT term, array_to_string(list_sort(list(other))[:{ADDED}], ',') AS expansion FROM p GROUP BY 1""")
def r19(part_terms):
    """Terms expanded by those that share an entity with them, twelve at most."""
    return expansions(part_terms)
