"""Exact duplicates, in two passes around a Bloom filter.

Texts are read once: id and SHA-256 of every row go to the shared folder (40 bytes a row), and both passes read that. Pass
one counts a 64-bit key of each digest (summed up map-side; a key and a count shuffle for each distinct text of a task,
neither texts nor ids do) and sets the bits of the keys that repeat in a Bloom filter of at most BLOOM_BITS bits, in
rows of 4 KB. Pass two probes it: rows that don't hit it are surely unique and go straight through; of the others only
digests are grouped, again summed up map-side. The filter's size is bounded whatever the input is; when it is full,
more unique rows take the second way, and results stay the same.

A bitmap built by each task in place of the counted keys would not shuffle less: to tell one row from two in a cell, a
task has to send at least as many bits as its share of rows needs in sparse form, and Spark's bitmap aggregate has one size.

Groups of copies come back to their rows as one row each, to every task if there are at most SENT_GROUPS of them; beyond that the
groups of HOT_GROUP rows or more still do (there are no more than rows / HOT_GROUP), and the others by a shuffle join, so that no
key of that join is hot.

Defined cases: null counts as the empty text; among repeated rows of one id all that have the greatest id stay; null
ids never stay beside others, and all stay where a group has no other; columns besides id and text don't matter, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import kept, scratch, small_side

#: The filter has BITS_PER_KEY bits for each repeated key, in rows of ROW_BITS; at most BLOOM_BITS (16 MB).
BITS_PER_KEY, ROW_BITS, BLOOM_BITS = 16, 1 << 15, 1 << 27
SENT_GROUPS, HOT_GROUP = 500_000, 1000


def key_of(digest: Column) -> Column:
    return F.xxhash64(digest)


def cells_of(key: Column, bits: int) -> list[Column]:
    """The two cells of a key."""
    return [F.pmod(key, F.lit(bits)), F.pmod(F.xxhash64(key), F.lit(bits))]


def bloom_filter(keys: DataFrame, bits: int) -> DataFrame:
    """bucket, bits: the filter of the keys, in at most bits / ROW_BITS rows of 4 KB."""
    cells = keys.select(F.explode(F.array(*cells_of(F.col("key"), bits))).alias("cell"))
    return cells.groupBy(F.floor(F.col("cell") / ROW_BITS).alias("bucket")).agg(F.expr(f"bitmap_construct_agg(cell % {ROW_BITS})").alias("bits"))


def probed(rows: DataFrame, bloom: DataFrame, bits: int) -> DataFrame:
    """rows with the column `maybe`: whether both cells of the digest's key are set."""
    out, hits = rows, []
    for i, cell in enumerate(cells_of(key_of(F.col("digest")), bits)):
        side = bloom.select(F.col("bucket").alias(f"bucket{i}"), F.col("bits").alias(f"bits{i}"))
        out = out.withColumn(f"cell{i}", cell)
        out = out.join(F.broadcast(side), F.floor(F.col(f"cell{i}") / ROW_BITS) == F.col(f"bucket{i}"), "left")  # at most BLOOM_BITS / 8 bytes
        byte = F.conv(F.hex(F.expr(f"substring(bits{i}, cast(cell{i} % {ROW_BITS} div 8 as int) + 1, 1)")), 16, 10).cast("int")
        hits.append(F.coalesce(F.getbit(byte, (F.col(f"cell{i}") % 8).cast("int")) == 1, F.lit(False)))
    return out.select(*rows.columns, (hits[0] & hits[1]).alias("maybe"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bloom_bits: int = BLOOM_BITS, sent_groups: int = SENT_GROUPS) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 of every row: of equal texts the greatest id stays."""
    at = scratch(df.sparkSession, "digests")
    df.select(F.col(f"`{id_col}`").alias("id"), F.unhex(F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), 256)).alias("digest")).write.parquet(at)
    rows = df.sparkSession.read.parquet(at)
    # pass one: keys that repeat
    repeated = kept(rows.select(key_of(F.col("digest")).alias("key")).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    wanted = 1 << math.ceil(math.log2(max(repeated.count() * BITS_PER_KEY, ROW_BITS)))
    bits = min(max(bloom_bits, ROW_BITS), wanted)
    marked = probed(rows, kept(bloom_filter(repeated, bits)), bits)
    # pass two: groups among the rows that may have copies
    maybe = marked.where("maybe").select("id", "digest")
    groups = maybe.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    groups = kept(groups.withColumnRenamed("digest", "of"))
    out, own = ("id", "keep_id", "group_size", "digest"), (F.coalesce("keep_id", F.when(F.col("group_size").isNull(), F.col("id"))).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    same = F.col("digest") == F.col("of")
    if groups.count() <= sent_groups:
        several = maybe.join(F.broadcast(groups), same, "left").select("id", *own, "digest")
    else:
        hot = groups.where(F.col("group_size") >= HOT_GROUP)
        hot = small_side(hot, hot.count(), sent_groups)
        common = maybe.join(hot, same).select(*out)
        rest = maybe.join(hot.select("of"), same, "left_anti").join(groups, same, "left").select("id", *own, "digest")
        several = common.unionByName(rest)
    single = marked.where(~F.col("maybe")).select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    return single.unionByName(several).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
