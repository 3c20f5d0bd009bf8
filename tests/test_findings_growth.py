"""What a reviewer found to grow faster than the input."""

from factloom.operators import analytics, bridge, quality


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_edges_of_an_author_are_cut_before_they_meet(spark):
    """each authored edge met all edges of its author, which is their square."""
    edges = spark.createDataFrame([(1, "AUTHORED", "x", f"d{i:03}") for i in range(40)] + [(1, "LIVES_IN", "x", "here"), (1, "AUTHORED", "x", "x"), (1, "AUTHORED", "y", "d000"), (1, "ABOUT", "z", "y")], "document_id long, type string, src string, dst string")
    e = {(r["type"], r["src"], r["dst"]) for r in edges.collect()}
    want = {(s, d, *x) for t, s, d in e if t == "AUTHORED" for x in sorted(x for x in e if s in x[1:] and x != (t, s, d))[:12]}
    found = quality.g12(edges)
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)
    assert "windowspecdefinition(src" not in plan(found)


def test_ids_of_a_label_are_cut_in_parts(spark):
    """one task put all ids of a label in order."""
    nodes = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'Expert' ELSE 'Document' END AS label", "lpad(CAST(id AS STRING), 5, '0') AS id")
    found = analytics.a18(spark, nodes)
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted([("Document", f"{i:05}") for i in range(31) if i % 3][:20] + [("Expert", f"{i:05}") for i in range(0, 24, 3)])
    assert "windowspecdefinition(label" in plan(found) and "part" in plan(found)


def test_nodes_meet_matches_before_they_are_told_apart(spark):
    """all nodes and all edges between runs and verifications were dealt out three times."""
    matches = spark.createDataFrame([(1, "Material:a", "1:p:0"), (2, "Material:b", "2:p:0")], "document_id long, node_id string, para_id string")
    nodes = spark.createDataFrame([(1, "Material:a", "Material"), (1, "Material:a", "Material"), (2, "Material:b", "Material"), (2, "Material:c", "Material"), (1, "r1", "ExperimentRun"), (1, "r2", "ExperimentRun"), (1, "r2", "ExperimentRun"), (1, "v", "VerificationStatus")], "document_id long, id string, label string")
    edges = spark.createDataFrame([(2, "DATA_SOURCE_FOR", "2:p:0", "Material:b"), (1, "HAS_VALIDATION", "r1", "v")], "document_id long, type string, src string, dst string")
    found = bridge.bridge_edges(matches, nodes, edges)
    got = sorted((r["document_id"], r["type"], r["src"], r["dst"], r["bridge"]) for r in found.collect())
    assert got == [(1, "DATA_SOURCE_FOR", "1:p:0", "Material:a", "quote_match"), (1, "HAS_VALIDATION", "r2", "v", "verification_scope")]
    assert "LeftSemi" in plan(found)
