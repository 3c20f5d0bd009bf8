"""What a reviewer found to grow faster than the input, second part: shapes of plans and odd rows."""

from pyspark.sql import functions as F

from factloom.operators import analytics, langprofile, points, quality, tables, units, walk


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pieces_are_counted_by_text(spark):
    """each piece of each text was a row of its own."""
    docs = spark.createDataFrame([(1, "abab 𝒳ß"), (2, None), (3, "")], "doc_id long, text string")
    found = langprofile.ranked(docs)
    assert "Generate" not in plan(found)
    got = [(r["piece"], r["r"], r["n"]) for r in found.orderBy("r").collect()]
    want = [" a", " ab", " 𝒳", " 𝒳ß", "a", "ab", "b", "𝒳", "ß", "ß "]
    assert {p for p, _, _ in got} >= set(want) and got[:3] == [("a", 1, got[0][2]), ("ab", 2, got[0][2]), ("b", 3, got[0][2])] and len(got) == got[0][2]


def test_facets_are_told_in_one_pass(spark):
    """nodes were put together once for each facet."""
    nodes = spark.createDataFrame([(1, "m", "Material", "abc", None, 0.9), (1, "r", "ExperimentRun", "x", None, None), (1, "q", "Measurement", None, 15.0, None), (1, "z", "Process", "xyz", None, None)], "document_id long, id string, label string, name string, numeric_value double, confidence double")
    edges = spark.createDataFrame([("USES_MAT", "r", "m"), ("PRODUCED_MEASUREMENT", "r", "q"), ("OTHER", "z", "m")], "type string, src string, dst string")
    registry = spark.sql("SELECT 1L AS id, 'foreign' AS geography, 'en' AS lang, DATE '2010-01-01' AS material_date")
    found = quality.g21(nodes, edges, registry)
    assert [r["id"] for r in found.collect()] == ["r"]
    assert "LeftSemi" not in plan(found)


def test_measurements_of_one_run_are_counted_by_run(spark):
    """every process met every measurement of its runs, pair by pair."""
    rows = [("r1", "Process:a"), ("r1", "Process:b"), ("r1", "Measurement:1"), ("r1", "Measurement:2"), ("r2", "Process:a"), ("r2", "Measurement:2"), ("Measurement:3", "Process:b")]
    e = spark.createDataFrame([("t", s, d) for s, d in rows + rows[:2]], "type string, src string, dst string")
    count = lambda x: {r["node"]: r["measurements"] for r in walk.w15(x).collect()}
    assert count(e) == {"Process:a": 2, "Process:b": 3}
    alone = e.where("src = 'r1'")
    assert count(alone) == {"Process:a": 2, "Process:b": 2}
    assert plan(walk.w15(alone)).count("Union") < plan(walk.w15(e)).count("Union")


def test_walks_read_edges_at_the_frontier(spark):
    """all edges were put together from both ends before the first step."""
    edges = spark.createDataFrame([("t", "x", "Document:1"), ("t", "x", "Document:2"), ("t", "x", "Document:2")], "type string, src string, dst string")
    hits = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8)], "query_id long, document_id long, score double")
    found = walk.w11(edges, hits)
    assert [tuple(r) for r in found.collect()] == [(1, "Document:1", "Document:2", 2, "Document:1>x|Document:2>x")]
    b = walk.ends(edges)
    assert "Aggregate" not in plan(b) and "Union" in plan(b)


def test_edges_are_told_apart_once(spark):
    """repeats of edges went before and after their ends were looked up."""
    nodes = spark.createDataFrame([(1, "r", "ExperimentRun", "run", None), (1, "m", "Material", "ore", None)], "document_id long, id string, label string, name string, numeric_value double").selectExpr("*", "CAST(NULL AS STRING) AS unit", "CAST(NULL AS STRING) AS parameter", "1D AS confidence")
    edges = spark.createDataFrame([("USES_MATERIAL", "r", "m"), ("USES_MAT", "r", "m"), ("USES_MAT", "r", "m"), ("USES_MAT", "m", "r")], "type string, src string, dst string")
    found = quality.sanitise(spark, nodes, edges)[1]
    assert [(r["type"], r["src"], r["dst"]) for r in found.collect()] == [("USES_MAT", "r", "m")]
    assert plan(found).count("Aggregate [") == 3  # one for the edges, and the nodes at either end


def test_readings_are_judged_by_distinct_values(spark):
    """readings were put together five times, and each met the cells of all limits by itself."""
    readings = spark.createDataFrame([(d, f"r{d}", "load", float(d % 3), "mg/l") for d in range(30)], "document_id long, id string, parameter string, v double, unit string")
    standards = spark.createDataFrame([("s", "load", "mg/l", 1.0, 1.0), ("t", "load", "mg/l", 2.0, None)], "standard_id string, parameter string, unit string, lo double, hi double")
    evaluated = spark.createDataFrame([("r0", "t"), ("r1", None), ("r2", "s"), ("r2", "t")], "src string, dst string")
    found = units.violations(readings, standards, evaluated)
    got = sorted((r["id"], r["standard_id"], r["how"]) for r in found.collect())
    assert got == sorted([("r0", "t", "edge"), ("r2", "s", "edge"), *((f"r{d}", None, "range") for d in range(3, 30, 3))])
    assert "cell__" not in plan(found)
    x = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), (None, 3, 1.0)], "key string, id long, x double")
    assert sorted(r["id"] for r in units.covered(x, x.selectExpr("'a' AS key", "0D AS lo", "9D AS hi").distinct(), "key", how="left_anti").collect()) == [2, 3]


EDGES = [(1, "t", "r", "m"), (2, "t", "r", "m"), (1, "t", "m", "d"), (1, "t", "r", "gone"), (1, "u", "two", "two"), (1, "u", "r", "r")]
LABELLED = [(1, "r", "ExperimentRun"), (2, "r", "ExperimentRun"), (1, "m", "Material"), (1, "d", "Document"), (1, "two", "Material"), (1, "two", "Expert")]


def test_edges_between_layers_are_put_together_once(spark):
    """edges between layers were found first and all edges put together again to meet them."""
    edges, nodes = spark.createDataFrame(EDGES, "document_id long, type string, src string, dst string"), spark.createDataFrame(LABELLED, "document_id long, id string, label string")
    found = walk.w9(spark, edges, nodes)
    assert sorted(map(tuple, found.collect())) == [(1, "t", "m", "d"), (1, "t", "r", "m"), (1, "u", "two", "two"), (2, "t", "r", "m")]
    assert "LeftSemi" not in plan(found)


def test_edges_are_counted_by_target_before_its_layers(spark):
    """F32: every edge met the layers of its target."""
    edges, nodes = spark.createDataFrame(EDGES, "document_id long, type string, src string, dst string"), spark.createDataFrame(LABELLED, "document_id long, id string, label string")
    found = analytics.a26(spark, edges, nodes)
    assert {r["layer"]: r["touched"] for r in found.collect()} == {"L1": 5, "L2": 4, "L4": 2}
    assert plan(found).count("RepartitionByExpression") == 1


def test_unmarked_edges_are_one_row(spark):
    """every edge was dealt out twice to meet the nodes that go."""
    nodes = spark.createDataFrame([("ExperimentRun:1",), ("ExperimentRun:2",), ("x",)], "id string")
    edges = spark.createDataFrame([("ExperimentRun:1", "x"), ("x", "ExperimentRun:1"), ("ExperimentRun:12", "x"), ("ExperimentRun:2", "x"), ("x", "x"), ("x", "x")], "src string, dst string")
    found = tables.s19(nodes, edges)
    assert {r["kind"]: r["n"] for r in found.collect()} == {"nodes": 2, "edges": 4}
    assert "src__" in plan(found)
    assert {r["kind"]: r["n"] for r in tables.s19(nodes, edges.limit(0)).collect()} == {"nodes": 2, "edges": 0}


def test_edges_are_dealt_out_once_for_repeats_and_sources(spark):
    """edges were dealt out for their repeats, then again by source."""
    edges = spark.createDataFrame([(None, "t", "r", "m"), (3, "t", "r", "m"), (2, "t", "r", "m"), (1, "t", "r", "lost"), (1, "", "r", "m")], "document_id long, type string, src string, dst string")
    found = quality.dedupe_edges(edges, spark.createDataFrame([("r",), ("m",)], "id string"))
    assert [tuple(r[c] for c in ("document_id", "type", "src", "dst")) for r in found.collect()] == [(2, "t", "r", "m")]
    assert plan(found).count("RepartitionByExpression") == 1


def test_vectors_are_kept_by_content(spark, tmp_path):
    """words and the vector of a content were made and written again for each of its points."""
    rows = spark.createDataFrame([("c", 1, f"p{i}", "L", "L1", "red fox" if i % 2 else "blue jay") for i in range(20)] + [("c", 1, "p0", "K", "L1", "a b")], "collection string, document_id long, point_id string, label string, layer string, text string")
    plain = lambda rows: rows.select("key", F.array(F.lit(1.0).cast("float")).alias("vector"))
    for embed in (points.hashed, plain):
        store = points.PointStore(spark, str(tmp_path / embed.__name__), embed)
        store.apply(rows)
        assert store.cache().count() == 3 and "vector" not in store._alive().columns
        got = {r["point_id"]: (r["label"], r["text"], r["tokens"], r["vector"] is not None) for r in store.points().collect()}
        assert len(got) == 20 and got["p0"] == ("K", "a b", [], True) and got["p1"] == ("L", "red fox", ["fox", "red"], True)
