"""URL filters: fixed rules, and path templates judged by the labels that the rules give.

A url that a rule fits gets the rule's verdict. For the rest, each host's paths form a tree of templates: a segment that is
a number, a hash or an id becomes a wildcard at once; a segment of a branch with more than MAX_CHILDREN values of little
support does after counting; and a sibling branch merges with its siblings if the two can't be told apart: their urls go on
alike (two-proportion test on the branch's most common rest) and their labelled rates don't differ (the same test, if
both sides have MIN_SUPPORT labels to tell by; with fewer, they merge only if neither side has any or the siblings have
both labels, for labels of one kind may be of the branch or of the rule). A template's purity is its share of blocked
among urls that rules labelled, smoothed towards that of the branch above it, that towards the one above, and so on to the
host and to all labelled urls. A branch above is evidence only if it, or one above it on the host, has urls of both labels:
where rules label nothing but what they block, the rest of the host goes by all labelled urls. Templates of purity
PURITY or more are rejected. Hosts and branches are counted by aggregation (partial sums before each shuffle), never
collected, whatever the share of one host.

Defined cases: null urls and urls without :// have empty host and path, no rule and are allowed; rows pass one by one, so
repeated page_ids don't matter; paths of any length are told apart whole, and merging goes on down as long as urls enough to merge are that deep; ties
between rules can't occur, for of two rules that fit, one's host is within the other's or one's path starts with the
other's: longest means longest host and path together, then host, then order; of equally common rests the one that sorts
last counts; an empty table gives none; columns besides id and url don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import kept

MAX_CHILDREN, MIN_SUPPORT = 20, 5
SMOOTH, PURITY, Z = 4.0, 0.8, 1.96
#: Rules as (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Shapes of segments that vary.
SHAPES = ((r"^[0-9]+$", "{n}"), (r"^[0-9]+\.(html?|php|aspx?)$", "{n}.$1"), (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "{date}"), (r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "{id}"), (r"^(?=.*[0-9])[0-9a-f]{12,}$", "{hash}"))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule, written host + path, and its verdict; null where none fits."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def shaped(path: Column) -> Column:
    """Segments of a path with variable ones generalised."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/", -1)

    def one(s: Column) -> Column:
        out = F.lit(None).cast("string")
        for pattern, name in SHAPES:
            out = F.coalesce(out, F.when(s.rlike(pattern), F.regexp_replace(s, pattern, name.replace("{", "\\{").replace("}", "\\}")) if "$" in name else F.lit(name)))
        return F.coalesce(out, s)

    return F.transform(parts, one)


def template_counts(pages: DataFrame) -> DataFrame:
    """host, segs, n, good, bad: urls and labelled urls of each path shape (pages: host, segs, label)."""
    return pages.groupBy("host", "segs").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") == "allow", 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("label") == "block", 1).otherwise(0)).alias("bad"))


def differs(x: Column, n: Column, y: Column, m: Column) -> Column:
    """Two-proportion test of x of n against y of m, true if the shares differ; null without cases."""
    pooled = F.try_divide(x + y, n + m)
    apart = F.abs(F.try_divide(x, n) - F.try_divide(y, m))
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1), n) + F.try_divide(F.lit(1), m)))
    return F.when(spread > 0, apart >= Z * spread).otherwise(apart > 0)


def merged_level(now: DataFrame, d: int) -> DataFrame:
    """now (host, segs, template, n, good, bad) with * in place d of the template where its branch merges."""
    here = now.withColumns({"prefix": F.slice("template", 1, d), "seg": F.get("template", F.lit(d)), "rest": F.expr(f"slice(template, {d + 2}, greatest(size(template), 1))")})
    sums = lambda *names: [F.sum(c).alias(f"{c}_{n}") for n in names for c in ("n", "good", "bad")]
    leaves = here.where("seg IS NOT NULL").groupBy("host", "prefix", "seg", "rest").agg(*sums("leaf"))
    # of each branch its sums and its most common rest; of all branches of a place their sums, and the sum of each rest
    branches = leaves.groupBy("host", "prefix", "seg").agg(F.sum("n_leaf").alias("n1"), F.sum("good_leaf").alias("g1"), F.sum("bad_leaf").alias("b1"), F.max(F.struct("n_leaf", "rest")).alias("top"))
    places = branches.groupBy("host", "prefix").agg(F.count("*").alias("kinds"), F.sum("n1").alias("n"), F.sum("g1").alias("g"), F.sum("b1").alias("b"))
    rests = leaves.groupBy("host", "prefix", "rest").agg(F.sum("n_leaf").alias("with_rest"))
    both = branches.withColumns({"rest": F.col("top.rest"), "own": F.col("top.n_leaf")}).join(places, ["host", "prefix"]).join(rests, ["host", "prefix", "rest"])
    n2, g2, b2 = F.col("n") - F.col("n1"), F.col("g") - F.col("g1"), F.col("b") - F.col("b1")
    told = (F.col("g1") + F.col("b1") >= MIN_SUPPORT) & (g2 + b2 >= MIN_SUPPORT)
    unlabelled = (F.col("g1") + F.col("b1") == 0) & (g2 + b2 == 0)
    same_rate = F.when(told, ~F.coalesce(differs(F.col("b1"), F.col("g1") + F.col("b1"), b2, g2 + b2), F.lit(False))).otherwise(unlabelled | ((g2 > 0) & (b2 > 0)))
    same_rest = ~F.coalesce(differs(F.col("own"), F.col("n1"), F.col("with_rest") - F.col("own"), n2), F.lit(True))
    alike = (F.col("n1") >= MIN_SUPPORT) & (n2 >= MIN_SUPPORT) & same_rate & same_rest
    rare = (F.col("kinds") > MAX_CHILDREN) & (F.col("n1") * F.col("kinds") <= F.col("n") * 2)
    star = both.where(rare | alike).select(F.col("host").alias("h2"), F.col("prefix").alias("p2"), F.col("seg").alias("s2"))
    joined = here.join(star, (F.col("host") == F.col("h2")) & (F.col("prefix") == F.col("p2")) & (F.col("seg") == F.col("s2")), "left")
    new = F.when(F.col("s2").isNull(), F.col("template")).otherwise(F.concat("prefix", F.array(F.lit("*")), "rest"))
    return joined.select("host", "segs", "n", "good", "bad", new.alias("template"))


def purities(counts: DataFrame) -> DataFrame:
    """host, segs, template, purity of each path shape."""
    now, d = counts.withColumn("template", F.col("segs")), 0
    while True:  # as long as some host has so many urls that deep that branches could merge
        most = now.where(F.size("template") > d).groupBy("host").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        if not most or most < 2 * MIN_SUPPORT:
            break
        now, d = kept(merged_level(now, d)), d + 1  # a level reads the one before several times
    bad, good = counts.agg(F.coalesce(F.sum("bad"), F.lit(0)), F.coalesce(F.sum("good"), F.lit(0))).first()
    base = bad / (bad + good) if bad else 0.0
    # the sums of each template and of each branch above it: the host's, then a segment more each time, the whole at last
    templates = now.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    above = F.transform(F.sequence(F.lit(0), F.size("template")), lambda k: F.struct(k.alias("level"), F.xxhash64(F.slice("template", F.lit(1), k)).alias("branch")))
    ways = templates.select("host", "template", "good", "bad", F.explode(above).alias("at"))
    sums = ways.groupBy("host", "at").agg(F.sum("good").alias("g"), F.sum("bad").alias("b"))
    path = ways.select("host", "template", "at").join(sums, ["host", "at"]).groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("at.level", "g", "b"))).alias("path"))  # a row for each segment

    def fold(up: Column, x: Column) -> Column:
        seen = up["seen"] | ((x["g"] > 0) & (x["b"] > 0))
        counts_ = seen | (x["level"] == F.size("template"))
        return F.struct(F.when(counts_, (x["b"] + SMOOTH * up["p"]) / (x["g"] + x["b"] + SMOOTH)).otherwise(up["p"]).alias("p"), seen.alias("seen"))

    purity = F.aggregate("path", F.struct(F.lit(float(base)).alias("p"), F.lit(False).alias("seen")), fold, lambda s: s["p"])
    judged = path.select(F.col("host").alias("h4"), F.col("template").alias("t4"), purity.alias("purity"))
    return now.join(judged, (F.col("host") == F.col("h4")) & (F.col("template") == F.col("t4"))).select("host", "segs", "template", "purity")


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """id, host, path, rule, verdict, template, purity of every row."""
    host, path = split_url(F.col(f"`{url_col}`"))
    rows = df.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "label": verdict, "segs": shaped(F.col("path"))})
    judged = purities(kept(template_counts(rows))).select(F.col("host").alias("jh"), F.col("segs").alias("js"), F.array_join("template", "/").alias("template"), "purity")
    out = rows.join(judged, (F.col("host") == F.col("jh")) & (F.col("segs") == F.col("js")), "left")
    method = F.when((F.col("purity") >= PURITY) & (F.col("host") != ""), "block").otherwise("allow")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("label", method).alias("verdict"), "template", "purity")
