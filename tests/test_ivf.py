"""The inverted file against every query with every vector."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.operators import ivf


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], i % 3) for i, v in rows], "vec_id long, embedding array<double>, folder long").repartition(3)


def brute(rows, asked, k, least=-1.0, same=False):
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v is not None and np.any(v)}
    out = []
    for i in asked:
        if i in unit:
            found = [(float((unit[i] * u).sum()), j) for j, u in unit.items() if j != i and (not same or i % 3 == j % 3)]
            best = sorted((-round(s, 12), j) for s, j in found if s >= least)[:k]
            out += [(i, j, n + 1, round(-s, 7)) for n, (s, j) in enumerate(best)]
    return sorted(out)


@pytest.fixture(scope="module")
def clusters():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(30, 16))
    rows = [(i, centres[i % 30] + 0.2 * rng.normal(size=16)) for i in range(3000)]
    rows[1000:2000] = [(i, rows[5][1]) for i in range(1000, 2000)]  # a third are copies
    return [*rows, (3000, np.zeros(16)), (3001, None), (3002, rows[7][1] * 5)]


@pytest.mark.parametrize(("same", "k", "least"), [((), 5, -1.0), (("folder",), 3, -1.0), ((), 40, 0.9)])
def test_exact_and_pruned(spark, clusters, monkeypatch, same, k, least):
    monkeypatch.setattr(ivf, "BLOCK_ROWS", 50)
    df = frame(spark, clusters)
    asked = [*range(0, 3003, 50), 3001, 3002, 1007]
    q = df.where(F.col("vec_id").isin(asked)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"), "folder")
    search = ivf.Search(ivf.build(df, same), q, k, least, same)
    got = sorted((r["query_id"], r["vec_id"], r["rank"], round(r["score"], 7)) for r in search.hits().collect())
    assert got == brute(clusters, asked, k, least, bool(same))
    share = search.compared().agg(F.avg("scored"), F.first("total")).first()
    assert share[0] < 0.35 * share[1]  # most vectors are never looked at


def test_vectors_without_structure(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8)) for i in range(400)]
    df = frame(spark, rows)
    q = df.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    got = sorted((r["query_id"], r["vec_id"], r["rank"], round(r["score"], 7)) for r in ivf.top_k(df, q, 4).collect())
    assert got == brute(rows, range(0, 400, 7), 4)


def test_nothing_to_find(spark):
    df = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 0.0])])
    q = df.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    assert ivf.top_k(df, q, 3).count() == 0  # alone
    assert ivf.top_k(df.where("false"), q, 3).count() == 0
    assert ivf.top_k(df, q.where("false"), 3).count() == 0
