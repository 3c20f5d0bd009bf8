"""The k best rows of each query by the number of words that they share with it, then by id: exact, without pairing frequent words' rows with all queries that have them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.ivf import best_of
from factloom.session import checkpointed


def ranked_words(own: DataFrame, words: DataFrame) -> DataFrame:
    """query_id, w, pos, m: the words of queries that some row has, numbered from the rarest, and how many they are."""
    df = own.groupBy("w").agg(F.count("*").alias("df"))
    known = words.join(df, "w")
    each = Window.partitionBy("query_id")  # the words of one query
    return known.select("query_id", "w", F.row_number().over(each.orderBy("df", "w")).alias("pos"), F.count("*").over(each).alias("m"))


def candidates(own: DataFrame, words: DataFrame, k: int) -> DataFrame:
    """query_id, id, have, done: all rows (id, w) that can be among a query's k best, and how many of its `done` rarest words they have.

    The rarer half of a query's words and each word's k smallest ids give k rows and so a bound, the k-th number of shared words.
    What reaches the bound b lacks at most m - b of the m words, so it has one of the m - b + 1 rarest. Where b is 1 the last word needn't be paired:
    a row that has no other is beaten by the word's k smallest ids, unless it is one of them; where no bound is found all rows are among those.
    """
    half = F.floor(F.col("m") / 2)
    heads = best_of(own.withColumnRenamed("w", "query_id"), k, F.asc("id")).withColumnRenamed("query_id", "w")
    rare = own.join(words.where(F.col("pos") <= half), "w").select("query_id", "id", "pos", "m")
    least = heads.join(words.where(F.col("pos") > half), "w").select("query_id", "id", "pos", "m")
    seeds = checkpointed(rare.unionByName(least))
    top = best_of(seeds.groupBy("query_id", "id").agg(F.count("*").alias("n")), k, F.desc("n"), F.asc("id"))
    bound = top.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("n")).otherwise(0).alias("bound"))
    prefix = F.when(F.col("bound") <= 1, F.col("m") - 1).otherwise(F.col("m") - F.col("bound") + 1)
    bounds = checkpointed(words.select("query_id", "m").distinct().join(bound, "query_id").select("query_id", "bound", F.greatest(half, prefix).cast("int").alias("done")))
    more = own.join(words.join(bounds, "query_id").where((F.col("pos") > half) & (F.col("pos") <= F.col("done"))), "w").select("query_id", "id", "pos", "m", "bound", "done")
    first = seeds.join(bounds, "query_id").where((F.col("pos") <= half) | (F.col("pos") > F.col("done")))
    met = first.unionByName(more).groupBy("query_id", "id").agg(F.count_if(F.col("pos") <= F.col("done")).alias("have"), *(F.first(c).alias(c) for c in ("m", "bound", "done")))
    return met.where(F.col("have") + F.col("m") - F.col("done") >= F.col("bound")).select("query_id", "id", "have", "done")


def top_k(postings: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, overlap, for postings (id, w) and queries (query_id, w). Repeated rows count once; nulls match nothing."""
    asked = queries.where("w IS NOT NULL").select("query_id", "w").distinct()
    own = checkpointed(postings.where("id IS NOT NULL").join(asked.select("w").distinct(), "w", "left_semi").select("id", "w").distinct())
    words = checkpointed(ranked_words(own, asked))
    found = checkpointed(candidates(own, words, k))
    rest = found.join(words, "query_id").where(F.col("pos") > F.col("done")).select("query_id", "id", "w").join(own, ["id", "w"])
    more = rest.groupBy("query_id", "id").agg(F.count("*").alias("more"))
    total = found.join(more, ["query_id", "id"], "left").select("query_id", "id", (F.col("have") + F.coalesce("more", F.lit(0))).alias("overlap"))
    return best_of(total, k, F.desc("overlap"), F.asc("id"))
