"""Units by dimension, and limits by interval joins.

A unit is cut into factors (symbol, exponent, above or below the line), each of which a table knows by its size in base
units and its exponents of metre, kilogram, second, kelvin, ampere and mole; the factors' product is the unit's. Units of
one dimension are compared in base units, others can't be.

Defined cases: a unit with an unknown symbol has no dimension and compares with nothing, no unit at all is a pure number;
values without number are left out; offsets (degrees) hold for a unit that is nothing but the degree. Limits may be open on
either side; a limit in another dimension than the value's says nothing about it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.plans.registry import query
from factloom.session import checkpointed, small_side

#: Prefixes and their powers of ten; units by size, offset and exponents of m, kg, s, K, A, mol; those that take prefixes.
PREFIXES = {"": 0, "k": 3, "M": 6, "G": 9, "d": -1, "c": -2, "m": -3, "u": -6, "µ": -6, "n": -9, "к": 3, "М": 6, "Г": 9, "д": -1, "с": -2, "м": -3, "мк": -6, "н": -9}
PREFIXED = {"m": (1, "1,0,0,0,0,0"), "g": (1e-3, "0,1,0,0,0,0"), "s": (1, "0,0,1,0,0,0"), "K": (1, "0,0,0,1,0,0"), "A": (1, "0,0,0,0,1,0"), "mol": (1, "0,0,0,0,0,1"), "l": (1e-3, "3,0,0,0,0,0"), "L": (1e-3, "3,0,0,0,0,0"), "N": (1, "1,1,-2,0,0,0"), "Pa": (1, "-1,1,-2,0,0,0"), "J": (1, "2,1,-2,0,0,0"), "W": (1, "2,1,-3,0,0,0"), "V": (1, "2,1,-3,0,-1,0"), "Hz": (1, "0,0,-1,0,0,0"), "bar": (1e5, "-1,1,-2,0,0,0"), "eq": (1, "0,0,0,0,0,1"), "м": (1, "1,0,0,0,0,0"), "г": (1e-3, "0,1,0,0,0,0"), "с": (1, "0,0,1,0,0,0"), "л": (1e-3, "3,0,0,0,0,0"), "моль": (1, "0,0,0,0,0,1"), "Па": (1, "-1,1,-2,0,0,0"), "Дж": (1, "2,1,-2,0,0,0"), "Вт": (1, "2,1,-3,0,0,0"), "В": (1, "2,1,-3,0,-1,0"), "А": (1, "0,0,0,0,1,0")}
PLAIN = {"min": (60, 0, "0,0,1,0,0,0"), "h": (3600, 0, "0,0,1,0,0,0"), "d": (86400, 0, "0,0,1,0,0,0"), "t": (1000, 0, "0,1,0,0,0,0"), "мин": (60, 0, "0,0,1,0,0,0"), "ч": (3600, 0, "0,0,1,0,0,0"), "сут": (86400, 0, "0,0,1,0,0,0"), "т": (1000, 0, "0,1,0,0,0,0"), "°C": (1, 273.15, "0,0,0,1,0,0"), "°С": (1, 273.15, "0,0,0,1,0,0"), "°F": (5 / 9, 459.67 * 5 / 9, "0,0,0,1,0,0"), "%": (1e-2, 0, "0,0,0,0,0,0"), "ppm": (1e-6, 0, "0,0,0,0,0,0"), "rad": (1, 0, "0,0,0,0,0,0")}
BASES = ("m", "kg", "s", "K", "A", "mol")
FACTOR = r"([/*·×⋅]?)\s*([\p{L}°%µ]+)\s*(?:\^?\s*([-−]?\d+|[⁻]?[¹²³⁴]))?"


def symbols(spark: SparkSession) -> DataFrame:
    """symbol, size, shift and the exponents of the base units: the tables above with every prefix; plain symbols win over prefixed ones, short prefixes over long."""
    known = {s: (float(size), float(shift), exps) for s, (size, shift, exps) in PLAIN.items()}
    for prefix, power in sorted(PREFIXES.items(), key=lambda p: len(p[0])):
        for s, (size, exps) in PREFIXED.items():
            known.setdefault(prefix + s, (size * 10.0**power, 0.0, exps))
    rows = [(s, size, shift, [int(e) for e in exps.split(",")]) for s, (size, shift, exps) in known.items()]
    return spark.createDataFrame(rows, "symbol string, size double, shift double, exps array<int>")


def dimensions(units: DataFrame) -> DataFrame:
    """unit, size, shift, dimension of the distinct units (unit): a value x of the unit is x * size + shift in base units. dimension
    lists base units and exponents, empty for pure numbers, null for what isn't known."""
    spark, u = units.sparkSession, units.select("unit").distinct().where("unit IS NOT NULL")
    part = lambda n: F.regexp_extract_all("unit", F.lit(FACTOR), F.lit(n))
    rest = F.btrim(F.regexp_replace("unit", FACTOR, ""))
    cut = u.select("unit", (rest != "").alias("odd"), F.posexplode_outer(F.arrays_zip(part(1).alias("mark"), part(2).alias("symbol"), part(3).alias("exp"))).alias("at", "f"))
    exp = F.translate(F.translate("f.exp", "⁻−", "--"), "¹²³⁴", "1234")
    power = F.when(F.coalesce("f.exp", F.lit("")) == "", 1).otherwise(exp.cast("int"))
    # what follows a line is below it, up to the end
    below = F.max(F.when(F.col("f.mark") == "/", 1).otherwise(0)).over(_up_to())
    flat = cut.select("unit", "odd", "at", F.col("f.symbol").alias("symbol"), power.alias("power"), below.alias("below"))
    met = flat.join(F.broadcast(symbols(spark)), "symbol", "left").withColumn("power", F.when(F.col("below") == 1, -F.col("power")).otherwise(F.col("power")))
    g = met.groupBy("unit").agg(
        F.bool_or(F.col("odd") | (F.col("symbol").isNotNull() & F.col("size").isNull())).alias("unknown"), F.exp(F.sum(F.col("power") * F.ln("size"))).alias("size"), F.count("symbol").alias("n"), F.max("shift").alias("shift"), F.max("power").alias("top"),
        *(F.sum(F.col("power") * F.col("exps")[i]).alias(b) for i, b in enumerate(BASES)),
    )
    names = F.array_join(F.filter(F.array(*(F.when(F.col(b) != 0, F.concat(F.lit(f"{b}:"), F.col(b).cast("string"))) for b in BASES)), lambda x: x.isNotNull()), ",")
    alone = (F.col("n") == 1) & (F.col("top") == 1)
    return g.select("unit", F.coalesce("size", F.lit(1.0)).alias("size"), F.when(alone, F.col("shift")).otherwise(0.0).alias("shift"), F.when(~F.col("unknown"), names).alias("dimension"))


def _up_to():
    from pyspark.sql import Window

    return Window.partitionBy("unit").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # the factors of one unit


def in_base_units(rows: DataFrame, value: str = "v", unit: str = "unit") -> DataFrame:
    """rows with `base` (the value in base units) and `dimension`; values without unit are pure numbers."""
    d = dimensions(rows.select(F.col(unit).alias("unit"))).select(F.col("unit").alias("unit__"), "size", "shift", "dimension")
    met = rows.join(small_side(d, 200_000), F.col(unit) == F.col("unit__"), "left")
    plain = F.col(unit).isNull()
    base = F.when(plain, F.col(value).cast("double")).when(F.col("dimension").isNotNull(), F.col(value) * F.col("size") + F.col("shift"))
    return met.withColumns({"base": base, "dimension": F.when(plain, "").otherwise(F.col("dimension"))}).drop("unit__", "size", "shift")


#: The units of the fixture, spelled out for the oracle.
UNITS_SQL = "units(unit, size, shift, dimension) AS (VALUES ('mg/l', 1e-3, 0.0, 'm:-3,kg:1'), ('g/m3', 1e-3, 0.0, 'm:-3,kg:1'), ('кг/м³', 1.0, 0.0, 'm:-3,kg:1'), ('°C', 1.0, 273.15, 'K:1'), ('K', 1.0, 0.0, 'K:1'), ('MPa', 1e6, 0.0, 'm:-1,kg:1,s:-2'), ('kJ/(kg·K)', NULL, NULL, NULL), ('km/h', 1000.0 / 3600, 0.0, 'm:1,s:-1'), ('m s^-1', 1.0, 0.0, 'm:1,s:-1'), ('cubits', NULL, NULL, NULL))"
BASE_SQL = f"{UNITS_SQL}, rb AS (SELECT r.*, CASE WHEN r.unit IS NULL THEN v WHEN dimension IS NOT NULL THEN v * size + shift END AS base, CASE WHEN r.unit IS NULL THEN '' ELSE dimension END AS dimension FROM readings r LEFT JOIN units u ON u.unit = r.unit)"


@query("A34", "readings", sql=f"""
    WITH {BASE_SQL} SELECT parameter, count(DISTINCT unit) AS units, count(DISTINCT dimension) AS dimensions, count(*) FILTER (WHERE dimension IS NULL) AS unknown, count(DISTINCT dimension) > 1 AS mixed,
         CASE WHEN count(DISTINCT dimension) = 1 THEN round(min(base), 4) END AS lo, CASE WHEN count(DISTINCT dimension) = 1 THEN round(max(base), 4) END AS hi FROM rb GROUP BY 1""")
def a34(readings):
    """Parameters by the dimensions of their units: mixed ones can't be compared, others are in base units."""
    one = F.count_distinct("dimension") == 1
    g = in_base_units(readings).groupBy("parameter").agg(F.count_distinct("unit").alias("units"), F.count_distinct("dimension").alias("dimensions"), F.count_if(F.col("dimension").isNull()).alias("unknown"), F.when(one, F.round(F.min("base"), 4)).alias("lo"), F.when(one, F.round(F.max("base"), 4)).alias("hi"))
    return g.withColumn("mixed", F.col("dimensions") > 1)


#: Fixed value: relative spread from which values conflict.
SPREAD = 0.5


def spread(lo: Column, hi: Column) -> Column:
    return (hi - lo) / F.greatest(F.abs(lo), F.abs(hi), F.lit(1e-9))


@query("A35", "readings", sql=f"""
    WITH {BASE_SQL} SELECT parameter, mat, dimension, round(min(base), 4) AS lo, round(max(base), 4) AS hi, count(DISTINCT document_id) AS documents FROM rb WHERE base IS NOT NULL GROUP BY 1, 2, 3
    HAVING count(DISTINCT document_id) >= 2 AND (max(base) - min(base)) / greatest(abs(min(base)), abs(max(base)), 1e-9) > {SPREAD}""")
def a35(readings):
    """Values that conflict under like conditions, whatever units they are given in."""
    g = in_base_units(readings).where("base IS NOT NULL").groupBy("parameter", "mat", "dimension").agg(F.min("base").alias("lo"), F.max("base").alias("hi"), F.count_distinct("document_id").alias("documents"))
    g = g.where((F.col("documents") >= 2) & (spread(F.col("lo"), F.col("hi")) > SPREAD))
    return g.withColumns({"lo": F.round("lo", 4), "hi": F.round("hi", 4)})


@query("A39", "readings", sql=f"""
    WITH {BASE_SQL}, k AS (SELECT * FROM rb WHERE base IS NOT NULL), n AS (SELECT parameter, mat, dimension, max(year) AS newest FROM k GROUP BY 1, 2, 3), t AS (SELECT parameter, mat, dimension, newest, max(base) AS nb FROM k JOIN n USING (parameter, mat, dimension) WHERE year = newest GROUP BY 1, 2, 3, 4)
    SELECT DISTINCT parameter, mat, dimension, document_id AS old_document, k.year, newest FROM k JOIN t USING (parameter, mat, dimension) WHERE k.year < newest AND abs(base - nb) / greatest(abs(base), abs(nb), 1e-9) > {SPREAD}""")
def a39(readings):
    """Older sources that conflict with the newest, compared in base units."""
    keys = ["parameter", "mat", "dimension"]
    m = in_base_units(readings).where("base IS NOT NULL")
    n = m.groupBy(*keys).agg(F.max(F.struct("year", "base")).alias("top")).select(*keys, F.col("top.year").alias("newest"), F.col("top.base").alias("nb"))
    old = m.join(n, keys).where(F.col("year") < F.col("newest")).where(spread(F.least("base", "nb"), F.greatest("base", "nb")) > SPREAD)
    return old.select(*keys, F.col("document_id").alias("old_document"), "year", "newest").distinct()


#: What converted limits may be off by, as a share of them.
ROUNDING = 1e-9
#: Levels of the cells that intervals are cut into.
LEVELS = 16


def covered(points: DataFrame, intervals: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """points (keys, x) joined with the intervals (keys, lo, hi; null: open) that they stand in, ends included; or, with how
    "left_anti", the points that stand in none. Each interval is cut into at most two cells of each level of a binary division
    of its keys' range, a point has one cell on each level, and equal cells meet: no pair of another cell is ever formed."""
    keys_ = list(keys)
    if how == "left_anti":  # whether a point stands in one hangs on its keys and x alone
        places = checkpointed(points.select(*keys_, "x").distinct())
        met = covered(places, intervals, *keys).select(*keys_, "x").distinct()
        return points.join(small_side(met, 200_000), [*keys_, "x"], "left_anti")
    ends = points.groupBy(*keys_).agg(F.min("x").alias("from__"), F.max("x").alias("to__"))
    top = (1 << LEVELS) - 1
    scale = F.when(F.col("to__") > F.col("from__"), top / (F.col("to__") - F.col("from__"))).otherwise(F.lit(0.0))
    cell = lambda x: F.floor((F.least(F.greatest(x, F.col("from__")), F.col("to__")) - F.col("from__")) * scale).cast("long")
    levels = F.sequence(F.lit(0), F.lit(LEVELS))
    size = lambda k: F.pow(F.lit(2.0), k)
    p = points.join(small_side(ends, 200_000), keys_).withColumn("at__", cell(F.col("x")))
    p = p.select(*points.columns, F.explode(F.transform(levels, lambda k: F.struct(k.alias("k"), F.floor(F.col("at__") / size(k)).cast("long").alias("c")))).alias("cell__"))
    i = intervals.join(small_side(ends, 200_000), keys_).where("(lo IS NULL OR lo <= to__) AND (hi IS NULL OR hi >= from__) AND (lo IS NULL OR hi IS NULL OR lo <= hi)")
    i = i.withColumns({"a__": F.when(F.col("lo").isNull(), 0).otherwise(cell(F.col("lo"))), "b__": F.when(F.col("hi").isNull(), top).otherwise(cell(F.col("hi"))) + 1})
    left, right = (lambda k: F.ceil(F.col("a__") / size(k)).cast("long")), (lambda k: F.floor(F.col("b__") / size(k)).cast("long"))
    pair = lambda k: F.array(F.when((left(k) < right(k)) & (left(k) % 2 == 1), F.struct(k.alias("k"), left(k).alias("c"))), F.when((left(k) < right(k)) & (right(k) % 2 == 1), F.struct(k.alias("k"), (right(k) - 1).alias("c"))))
    i = i.select(*intervals.columns, F.explode(F.array_distinct(F.filter(F.flatten(F.transform(levels, pair)), lambda c: c.isNotNull()))).alias("cell__"))
    inside = "(lo IS NULL OR x >= lo) AND (hi IS NULL OR x <= hi)"
    return p.join(i, [*keys_, "cell__"]).where(inside).drop("cell__")


def violations(readings: DataFrame, standards: DataFrame, evaluated: DataFrame) -> DataFrame:
    """document_id, id, parameter, standard_id and how: readings (document_id, id, parameter, v, unit) outside the limits of the standard
    (standard_id, parameter, unit, lo, hi) that they are evaluated against (src, dst), and of the others those that no standard
    of their parameter allows. All in base units; a limit of another dimension doesn't count."""
    read = checkpointed(readings.select("document_id", "id", "parameter", "v", "unit"))
    m = in_base_units(read).where("base IS NOT NULL").select("document_id", "id", "parameter", F.col("base").alias("x"), "dimension").repartition("id").distinct()
    both = standards.select("standard_id", "parameter", "unit", F.posexplode(F.array("lo", "hi")).alias("side", "v"))
    limits = in_base_units(both).where("dimension IS NOT NULL").groupBy("standard_id", "parameter", "dimension").agg(F.max(F.when(F.col("side") == 0, F.col("base"))).alias("lo"), F.max(F.when(F.col("side") == 1, F.col("base"))).alias("hi"))
    limits = limits.withColumns({"lo": F.col("lo") - F.abs("lo") * ROUNDING, "hi": F.col("hi") + F.abs("hi") * ROUNDING})
    own = evaluated.select(F.col("src").alias("id"), F.col("dst").alias("standard_id"), F.lit(True).alias("judged")).distinct()
    m = checkpointed(m.join(own, "id", "left"))  # what both ways of judging start from
    out = m.where("judged").join(limits.drop("parameter"), ["standard_id", "dimension"]).where("x < lo OR x > hi").select("document_id", "id", "parameter", "standard_id", F.lit("edge").alias("how"))
    rest = m.where("judged IS NULL").join(limits.select("parameter", "dimension").distinct(), ["parameter", "dimension"], "left_semi")
    free = covered(rest, limits.select("parameter", "dimension", "lo", "hi").distinct(), "parameter", "dimension", how="left_anti")
    return out.unionByName(free.select("document_id", "id", "parameter", F.lit(None).cast("string").alias("standard_id"), F.lit("range").alias("how")))


@query("A36", "readings", "standards", "evaluated", sql=f"""
    WITH {BASE_SQL}, m AS (SELECT DISTINCT document_id, id, parameter, base AS x, dimension FROM rb WHERE base IS NOT NULL),
         l AS (SELECT standard_id, parameter, dimension, (lo * size + shift) - abs(lo * size + shift) * {ROUNDING} AS lo, (hi * size + shift) + abs(hi * size + shift) * {ROUNDING} AS hi FROM standards JOIN units USING (unit) WHERE dimension IS NOT NULL)
    SELECT document_id, id, m.parameter, standard_id, 'edge' AS how FROM m JOIN evaluated e ON e.src = m.id JOIN l ON l.standard_id = e.dst AND l.dimension = m.dimension WHERE x < lo OR x > hi
    UNION ALL SELECT document_id, id, parameter, NULL, 'range' FROM m WHERE id NOT IN (SELECT src FROM evaluated) AND EXISTS (SELECT 1 FROM l WHERE l.parameter = m.parameter AND l.dimension = m.dimension)
         AND NOT EXISTS (SELECT 1 FROM l WHERE l.parameter = m.parameter AND l.dimension = m.dimension AND (lo IS NULL OR x >= lo) AND (hi IS NULL OR x <= hi))""")
def a36(readings, standards, evaluated):
    """Measurements outside the limits of their standards."""
    return violations(readings, standards, evaluated)
