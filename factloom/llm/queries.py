"""The thin queries over the training-data operators: whole tables in, the columns of each contract out."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, decontam, exactdup, langid, license, linedup, minhash, pieces, resample, secrets, urltree, variants, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model learned where crc32(doc_id) mod 3 isn't 1, applied to every document."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    both = bpe.encode(docs, path, back="decoded")
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), k=3, percent=85).drop("row")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge_urls(table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows of one doc_id, the one that covers most of the item."""
    found = decontam.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.groupBy("doc_id", "item_id").agg(*(F.max(c).alias(c) for c in ("n_items", "matched", "n_windows", "coverage")))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license.scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("places", lambda x: x["base"])
    starts = F.transform(base, lambda x: x["start"])
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda x: x["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("places", lambda x: x["score"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"), joined(F.col("places")).alias("labels"), score.alias("score")
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"))
    written = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linedup.duplicate_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.col("line").cast("long").alias("line"), F.col("keep_id").alias("keep_doc_id"), F.col("keep_line").cast("long").alias("keep_line"), F.col("edits").cast("long").alias("edits"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twentieth of documents that is most like the benchmark's texts, with noise."""
    found = resample.resample(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    both = pieces.encode(table(spark, sf_dir, "documents", "doc_id", "text"), path, out=None, packed="ids", back="decoded", checked=True)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_language_id, op2_bpe, op3_minhash, op4_warc, op5_url_filter, op6_exact_dedup, op7_decontamination, op8_license, op9_secrets, op10_line_dedup, op11_resampling, op12_sentencepiece, op13_spelling)
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
             f AS (SELECT *, strlen(html) >= 100 AND page_id > min(page_id) OVER (PARTITION BY html) AS again, min(page_id) OVER (PARTITION BY html) AS first FROM p)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
               CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM f""",
    "op6_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
