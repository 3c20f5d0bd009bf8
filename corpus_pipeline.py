"""The corpus pipeline: five stages, each over all rows that the stage before kept.

Defined cases, for every stage: null and empty texts are without language, so none is left after the first stage (the other
stages keep them); rows are told apart by id and text, so null and repeated ids don't mix, and of rows equal in both, near-dedup
keeps one; texts are taken whole, whatever their length; an empty table stays empty; extra columns pass through,
whatever their names, but `token_ids`, `n_tokens` and `round_trip`, which the last stage sets. A stage's result has to be
written before the next stage is called: each stage begins by removing the tables that the one before it in the same run kept
for itself. Nothing else is removed: not what operators kept outside the pipeline, nor what another run keeps; where stages
are called one by one and it can't be told which run a call belongs to, nothing is.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import bpe, decontam, langid, linedup, minhash
from factloom.llm.common import Run, new_folder, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: A language of less probability is as good as none.
MIN_LANGUAGE_SCORE = 0.5
#: Runs of stages called one by one, by folder, with the number of stages each has begun.
_begun: dict[str, list[list[Run | int]]] = {}


def of_a_run(number: int, stage: Stage) -> Stage:
    """The stage, called by itself: the first begins a run, the others go on with the run whose stage before was called, if there is one alone."""

    def called(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        known = _begun.setdefault(sf_dir, [])
        before = [r for r in known if r[1] == number] if number else []
        if len(before) != 1:
            known.append(one := [Run(spark), number])
        else:
            one = before[0]
        one[1] = number + 1
        if number + 1 == len(STAGES):
            known.remove(one)
        one[0].clear()
        with one[0]:
            return stage(spark, docs, sf_dir)

    return called



def columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null or letterless text, or no language of probability MIN_LANGUAGE_SCORE. Learns from the labelled rows of docs."""
    lang, score = unused(docs, "lang_pred"), unused(docs, "lang_score")
    found = langid.predict(docs, langid.fit(docs), lang_out=lang, score_out=score)
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*columns(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that stand earlier, and documents of which nothing is left."""
    out = linedup.drop_lines(docs, linedup.duplicate_lines(docs))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked at a similarity of 0.8 over five-word shingles."""
    return minhash.keep_one(docs, minhash.near_duplicates(docs, k=5, percent=80))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item."""
    return decontam.drop_leaks(docs, decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text in place of it, and whether decoding them gives the text back."""
    path, back, own = public_tokenizers.path("byte_bpe_50k.json"), unused(docs, "decoded"), ("text", "token_ids", "n_tokens", "round_trip")
    both = bpe.encode(docs, path, back=back)
    rest = columns(docs.drop(*own))
    return both.select(*rest, "token_ids", F.size("token_ids").cast("long").alias("n_tokens"), (F.col(back) == F.coalesce("text", F.lit(""))).alias("round_trip"))


PLAIN: list[tuple[str, Stage]] = [("language_id", language), ("line_dedup", lines), ("near_dedup", near_duplicates), ("decontamination", decontamination), ("bpe", tokens)]
STAGES: list[tuple[str, Stage]] = [(name, of_a_run(i, stage)) for i, (name, stage) in enumerate(PLAIN)]
#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = Run(spark)
    for name, stage in PLAIN[:-1]:
        at = new_folder(spark, f"pipeline-{name}")
        with own:
            stage(spark, docs, sf_dir).write.parquet(at)
        own.clear()
        docs = spark.read.parquet(at)
    return PLAIN[-1][1](spark, docs, sf_dir)
