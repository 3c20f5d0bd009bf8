import numpy as np
import public_tokenizers
import pytest
from test_llm_operators import brute_components, brute_lines, brute_windows, naive_bayes
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    columns = docs.columns
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf).cache()
        assert now.columns == columns and now.count(), name
    texts = [r["text"] for r in now.collect()]
    assert len(set(texts)) == len(texts)
    assert not any(b in t for b in bench for t in texts)
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    assert last.count() == now.count() and last.where("NOT round_trip").count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0, name


def odd(spark, tmp_path):
    """Documents with nulls, blanks, long, repeated and tied rows and columns of names that the stages use, and a benchmark."""
    rng = np.random.default_rng(8)
    words = {"aa": [f"{a}{b}ka" for a in "bcdfg" for b in "aeiou"], "zz": [f"{a}{b}sch" for a in "mnprt" for b in "aeiou"]}
    make = lambda lang, n: " ".join(words[lang][k] for k in rng.integers(0, 25, n))
    item = make("aa", 14)
    texts = [(i, "\n".join(make(lang, 9) for _ in range(4)), lang) for i, lang in enumerate(["aa", "zz"] * 6)]
    again = texts[2][1].split("\n")
    texts += [(20, None, "aa"), (21, "", "zz"), (22, " \n ", None), (23, "12 34", "aa"), (24, make("zz", 30_000), "zz"), (25, f"{make('aa', 6)} {item} {make('aa', 5)}", "aa"), (26, texts[0][1], "aa"), (27, again[1], "zz"), (28, again[0] + "\n" + make("aa", 8), None)]
    texts += [(29, texts[4][1].replace(texts[4][1].split()[3], "bukaka", 1), "aa"), (30, make("aa", 40) + " xx", "aa")]
    rows = [(i, t, lang, "src", len(t or ""), "p", 0.1, 7, "g", [1], "d") for i, t, lang in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, lang_score double, gone_row int, gone_id string, token_ids array<int>, decoded string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return texts, [item]


def test_pipeline_by_brute_force(spark, tmp_path):
    texts, items = odd(spark, tmp_path)
    learn = [(t, lang) for _, t, lang in texts if t is not None and lang is not None]
    lettered = [(i, t) for i, t, _ in texts if t and any(map(str.isalpha, t))]
    now = [x for x, (_, p) in zip(lettered, naive_bayes(learn, [t for _, t in lettered]), strict=True) if p >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    gone = {(i, n) for i, n, *_ in brute_lines(now)}
    now = [(i, "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)) for i, t in now]
    now = [(i, t) for i, t in now if t.strip()]
    alone = {i for i, _, _, stays in brute_components(now, 5, 80) if stays}
    now = [(i, t) for i, t in now if i in alone]
    held = lambda t, item: len({w for w, _ in brute_windows(item)} & {w for w, _ in brute_windows(t)}) >= 0.5 * len(brute_windows(item))
    now = [(i, t) for i, t in now if not any(held(t, item) for item in items)]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "lang_pred", "lang_score", "gone_row", "gone_id", "decoded", "token_ids", "n_tokens", "round_trip"]
    got = {r["doc_id"]: (r["token_ids"], r["n_tokens"], r["round_trip"], r["n_chars"], r["lang_pred"]) for r in out.collect()}
    want = {i: (ids := library.encode(t, add_special_tokens=False).ids, len(ids), True, len(t), "p") for i, t in now}
    assert got == want and 25 not in got and 24 in got and 26 not in got and 27 not in got


def test_stages_tell_odd_rows_apart(spark, tmp_path):
    odd(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    twice = docs.unionByName(docs.where("doc_id < 3").withColumn("doc_id", docs["doc_id"].cast("long") * 0 + 1)).unionByName(docs.where("doc_id IN (20, 21, 25)").selectExpr("CAST(NULL AS LONG) AS doc_id", *docs.columns[1:]))
    twice.unionByName(twice.where("doc_id = 5")).write.parquet(f"{tmp_path}/twice.parquet")
    rows = spark.read.parquet(f"{tmp_path}/twice.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == docs.columns and kept.exceptAll(rows.where("false")).count() <= rows.count(), name
        n = {"blank": kept.where("text IS NULL OR trim(text) = ''").count(), "leak": kept.where("doc_id <=> 25 OR (doc_id IS NULL AND length(text) > 5)").count(), "five": kept.where("doc_id = 5").count()}
        if name == "language_id":
            assert n == {"blank": 0, "leak": 2, "five": 2}
        if name == "line_dedup":
            assert n["blank"] >= 4 and n["five"] == 2  # rows equal in id and text stand at one place
        if name == "near_dedup":
            assert n["blank"] >= 4 and n["five"] == 1
        if name == "decontamination":
            assert n["blank"] >= 4 and n["leak"] == 0 and n["five"] == 2


def test_a_stage_removes_nothing_but_its_own_runs_tables(spark, sf, monkeypatch):
    from factloom.llm import common, exactdup

    monkeypatch.setattr(corpus_pipeline, "_begun", {})
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mine = exactdup.exact_duplicates(docs.select("doc_id", "text"))
    stages = [s for _, s in corpus_pipeline.STAGES]
    first = stages[0](spark, docs, sf)
    other = stages[0](spark, docs, "another")  # a second pipeline in the same driver
    lines = stages[1](spark, docs.limit(30), "another")
    tables = corpus_pipeline._begun["another"][0][0].tables
    assert tables and first.count() == other.count()
    near = stages[2](spark, docs.limit(30), "another")  # removes what line dedup kept
    assert near.count() <= 30 and mine.count() == docs.count()
    with pytest.raises(Exception, match="(?i)exist|not found|no such file"):
        lines.count()
    again, twice = stages[0](spark, docs, sf), stages[1](spark, docs.limit(30), sf)  # two runs of one folder: nothing is removed
    assert again.count() == first.count() and twice.count() <= 30
    with common.Run(spark) as run:
        own = common.kept(docs.limit(5))
    outside = common.kept(docs.limit(5))
    run.clear()
    assert outside.count() == 5
    with pytest.raises(Exception, match="(?i)exist|not found|no such file"):
        own.count()
