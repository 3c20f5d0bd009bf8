"""Units, their dimensions, and intervals against comparing everything with everything."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators.units import covered, dimensions, in_base_units, violations


def test_dimensions(spark):
    want = {
        "mg/l": (1e-3, 0, "m:-3,kg:1"), "g/m3": (1e-3, 0, "m:-3,kg:1"), "г/м³": (1e-3, 0, "m:-3,kg:1"), "мг/л": (1e-3, 0, "m:-3,kg:1"), "km/h": (1 / 3.6, 0, "m:1,s:-1"), "m·s^-1": (1, 0, "m:1,s:-1"), "m s⁻¹": (1, 0, "m:1,s:-1"),
        "J/kg/K": (1, 0, "m:2,s:-2,K:-1"), "°C": (1, 273.15, "K:1"), "W/°C": (1, 0, "m:2,kg:1,s:-3,K:-1"), "min": (60, 0, "s:1"), "mm": (1e-3, 0, "m:1"), "мм": (1e-3, 0, "m:1"), "%": (1e-2, 0, ""), "MPa": (1e6, 0, "m:-1,kg:1,s:-2"), "kPa·s": (1e3, 0, "m:-1,kg:1,s:-1"), "cm2": (1e-4, 0, "m:2"), "": (1, 0, ""),
        "cubits": None, "mg/cubits": None, "mg/(l)": None,
    }
    got = {r["unit"]: r for r in dimensions(spark.createDataFrame([(u,) for u in [*want, None, "mg/l"]], "unit string")).collect()}
    assert set(got) == set(want)
    for u, w in want.items():
        if w is None:
            assert got[u]["dimension"] is None
        else:
            assert (got[u]["size"], got[u]["shift"], got[u]["dimension"]) == (pytest.approx(w[0]), pytest.approx(w[1]), w[2]), u
    df = spark.createDataFrame([(1.0, "mg/l"), (1.0, "°C"), (2.0, None), (3.0, "cubits"), (None, "K")], "v double, unit string")
    assert [(r["base"] and round(r["base"], 6), r["dimension"]) for r in in_base_units(df).orderBy("v", "unit").collect()] == [(None, "K:1"), (0.001, "m:-3,kg:1"), (274.15, "K:1"), (2.0, ""), (None, None)]


@pytest.mark.parametrize("whole", [True, False])
def test_intervals(spark, whole):
    rng = random.Random(3)
    num = lambda: float(rng.randrange(-50, 50)) if whole else rng.uniform(-1e3, 1e3)
    points = [(k, i, num()) for k in "ab" for i in range(300)] + [("c", 1, 5.0), ("d", 1, 1.0)]
    intervals = [(rng.choice("abd"), f"s{i}", None if rng.random() < 0.2 else num(), None if rng.random() < 0.2 else num()) for i in range(60)] + [("c", "one", 5.0, 5.0), ("c", "not", 5.1, None), ("e", "none", None, None)]
    p = spark.createDataFrame(points, "key string, id long, x double").repartition(3)
    i = spark.createDataFrame(intervals, "key string, standard string, lo double, hi double")
    inside = lambda x, lo, hi: (lo is None or x >= lo) and (hi is None or x <= hi)
    want = sorted((k, n, s) for k, n, x in points for key, s, lo, hi in intervals if key == k and inside(x, lo, hi))
    met = covered(p, i, "key")
    assert sorted((r["key"], r["id"], r["standard"]) for r in met.collect()) == want
    free = {(r["key"], r["id"]) for r in covered(p, i, "key", how="left_anti").collect()}
    assert free == {(k, n) for k, n, _ in points} - {w[:2] for w in want}
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_violations(spark):
    readings = spark.createDataFrame([(1, "a", "load", 5.0, "mg/l"), (1, "b", "load", 5.0, "g/m3"), (1, "c", "load", 50.0, "mg/l"), (1, "d", "load", 1.0, "K"), (1, "e", "heat", 1.0, "K"), (1, "f", "load", None, "mg/l")], "document_id long, id string, parameter string, v double, unit string")
    standards = spark.createDataFrame([("s", "load", "g/m3", None, 4.0), ("t", "load", "kg/m3", 0.001, None), ("u", "load", "mg/l", 40.0, 45.0)], "standard_id string, parameter string, unit string, lo double, hi double")
    evaluated = spark.createDataFrame([("a", "s"), ("b", "t"), ("d", "s")], "src string, dst string")
    got = sorted((r["id"], r["standard_id"], r["how"]) for r in violations(readings, standards, evaluated).collect())
    assert got == [("a", "s", "edge")]  # c is within t; d and e are of no limit's dimension or parameter
    tight = standards.where(F.col("standard_id") != "t")
    assert sorted((r["id"], r["how"]) for r in violations(readings, tight, evaluated).collect()) == [("a", "edge"), ("c", "range")]
