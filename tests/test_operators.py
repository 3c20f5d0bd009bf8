"""Operators on small hand-made frames, where SQL has no oracle or the rule is easier to see."""

import numpy as np
from pyspark.sql import functions as F

from factloom.operators import analytics, cluster, quality, search, tables, text, walk


def test_chunks_keep_all_characters_and_stay_small(spark):
    long = " ".join(f"word{i}" for i in range(900))
    docs = spark.createDataFrame([(1, f"# Title\n{long}\nshort one\nanother\n| a | b |\nend"), (2, ""), (3, None)], "doc_id long, text string")
    got = text.chunks(docs, 200).orderBy("doc_id", "idx").collect()
    assert {r["doc_id"] for r in got} == {1}
    assert [r["kind"] for r in got if r["kind"] != "paragraph"] == ["heading", "table"]
    assert all(len(r["text"]) <= 200 for r in got)
    joined = "".join("".join(r["text"].split()) for r in got)
    assert joined == "".join(docs.first()["text"].split())


def test_mojibake(spark):
    df = spark.createDataFrame([("Ã¤Ã¶",), ("äö",), ("plain",)], "t string")
    assert [r[0] for r in df.select(text.mojibake(F.col("t"))).collect()] == ["äö", "äö", "plain"]


def test_line_kinds(spark):
    lines = ["", "2021 г.", "12", "Рис. 1. Схема", "1.2. Results", "ALL CAPS", "short label", "This is a sentence.", "the thing from there"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [r[0] for r in df.select(text.line_kind(F.col("line"))).collect()] == ["blank", "header_meta", "header_meta", "figure_caption", "heading", "heading", "diagram_label", "body", "body"]


def test_intents(spark):
    said = ["hello", "привет", "Привет!", "What is nickel leaching?", "hello, tell me about the copper process", "who are you", "кто ты?", "thanks", ""]
    df = spark.createDataFrame([(x,) for x in said], "t string")
    assert [r[0] for r in df.select(search.intent(F.col("t"))).collect()] == ["greeting", "greeting", "greeting", None, None, "meta", "meta", "thanks", None]


def test_confidence(spark):
    parts = analytics.components(F.lit(0.9), F.lit(True), F.lit(0.8), F.lit(2), F.lit(0), F.lit(4))
    assert spark.range(1).select(analytics.composite(parts)).first()[0] == 0.8714


def test_dedupe_keeps_the_first_label_and_the_last_properties(spark):
    schema = "document_id long, id string, label string, name string, numeric_value double, unit string, parameter string, confidence double"
    nodes = spark.createDataFrame([(2, "a", "X", "late", None, None, None, 0.5), (1, "a", "Y", "early", 3.0, "kg", None, 0.7), (3, "a", "X", None, None, "g", None, None), (1, "b", "X", "m", None, None, None, None), (1, "", "X", "blank", None, None, None, None)], schema)
    once = quality.dedupe_nodes(nodes)
    columns = ["id", "label", "name", "numeric_value", "unit", "parameter", "confidence"]
    want = [("a", "Y", "late", 3.0, "g", None, 0.5), ("b", "X", "m", None, None, None, None)]
    assert sorted(map(tuple, once.select(*columns).collect())) == want
    again = quality.dedupe_nodes(once.selectExpr("1L AS document_id", "*"))
    assert sorted(map(tuple, again.select(*columns).collect())) == want


def test_upsert_and_patch(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, s string, v int")
    new = spark.createDataFrame([(2, "c", 2), (3, "d", 1), (1, "old", 0)], "id int, s string, v int")
    assert sorted(map(tuple, tables.upsert(base, new, "id", "v").collect())) == [(1, "a", 1), (2, "c", 2), (3, "d", 1)]
    changes = spark.createDataFrame([(1, None, ["s"])], "id int, s string, set_ array<string>")
    assert sorted(map(tuple, tables.patch(base, changes, "id").collect()), key=str) == [(1, None, 1), (2, "b", 1)]


def test_walk_respects_hops_and_budget(spark):
    b = walk.both(spark.createDataFrame([("a", "b", "t"), ("b", "c", "t"), ("c", "d", "t"), ("a", "x", "s"), ("a", "y", "s")], "src string, dst string, type string"))
    seeds = spark.createDataFrame([("a",)], "node string")
    assert sorted(map(tuple, walk.within(b, seeds, 2).collect())) == [("a", 0), ("b", 1), ("c", 2), ("x", 1), ("y", 1)]
    scores = spark.createDataFrame([(1, "y", 0.9), (1, "x", 0.1)], "query_id long, node string, score double")
    start = spark.createDataFrame([(1, "a", 1)], "query_id long, node string, ord int")
    got = sorted((r["ord"], r["hop"], r["src"], r["node"]) for r in walk.walk(b, scores, start, hops=3, budget=4, fan=3).collect())
    assert got == [(1, 0, None, "a"), (2, 1, "a", "y"), (3, 1, "a", "x"), (4, 1, "a", "b")]
    got = {r["node"] for r in walk.walk(b, scores, start, hops=2, budget=20, fan=1).collect()}
    assert got == {"a", "y"}  # y leads nowhere else


def test_projection_variance(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 5)) * [5, 2, 1, 0.5, 0.1]
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id int, embedding array<float>")
    p = cluster.project(df).toPandas()
    assert p["x"].var() > p["y"].var() > 1 and abs(p["x"].mean()) < 1e-6


def test_vector_search_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1200, 4))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS query")
    monkeypatch.setattr(search, "MAX_SENT_QUERIES", 5)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = unit @ unit.T
    np.fill_diagonal(score, -2)
    want = [(q, int(v), r + 1) for q in range(0, 1200, 50) for r, v in enumerate(np.argsort(-score[q])[:3])]
    assert sorted((r["query_id"], r["vec_id"], r["rank"]) for r in search.vector_top_k(df, queries, 3).collect()) == sorted(want)


def test_no_level_denies_all(spark):
    docs = spark.createDataFrame([(1, None), (2, "строго")], "id int, classification string").withColumn("upload_date", F.current_date())
    assert tables.scan_registry(docs, ()).count() == 0
    assert tables.scan_registry(docs, ("открытый",)).count() == 1
