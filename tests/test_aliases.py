"""Alias groups against brute force."""

import random

from factloom.operators.aliases import alias_groups, components, expansions, near_terms


def pieces(t):
    return {t[i : i + 3] for i in range(max(len(t) - 2, 1))}


def alike(a, b, least):
    x, y = pieces(a), pieces(b)
    return len(x & y) >= least * len(x | y) - 1e-9


def names(rng, n):
    out = []
    for _ in range(n):
        base = "".join(rng.choices("abcde", k=rng.randrange(1, 14)))
        out += [base, base + rng.choice("abx"), base[:-1], base.upper() + " "]
    return out


def test_near_terms(spark):
    terms = sorted({t.strip().lower() for t in names(random.Random(4), 60)} - {""})
    for least in (0.8, 0.5):
        got = {(r["a"], r["b"]) for r in near_terms(spark.createDataFrame([(t,) for t in [*terms, ""]], "term string"), least).collect()}
        assert got == {(a, b) for a in terms for b in terms if a < b and alike(a, b, least)} and got


def test_groups_and_expansions(spark):
    rng = random.Random(5)
    pool = names(rng, 40)
    rows = [(i, rng.choice(pool)) for i in range(80) for _ in range(rng.randrange(0, 3))] + [(200, None), (201, " "), (202, "lonely name"), (203, "LONELY NAME"), (203, "lonely name")]
    df = spark.createDataFrame(rows, "entity_id long, term string").repartition(3)
    ids, own = sorted({i for i, _ in rows}), {}
    for i, t in rows:
        if t and t.strip():
            own.setdefault(i, set()).add(t.strip().lower())
    at = {i: i for i in ids}

    def top(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in own:
        for j in own:
            if i < j and any(a == b or alike(a, b, 0.8) for a in own[i] for b in own[j]):
                at[max(top(i), top(j))] = min(top(i), top(j))
    # terms connect terms of other entities as well
    want = sorted((i, top(i), sum(top(j) == top(i) for j in ids)) for i in ids)
    assert sorted((r["entity_id"], r["group_id"], r["members"]) for r in alias_groups(df).collect()) == want
    others = {t: sorted({u for s in own.values() if t in s for u in s} - {t})[:2] for s in own.values() for t in s}
    assert {r["term"]: r["expansion"] for r in expansions(df, 2).collect()} == {t: ",".join(u) for t, u in others.items() if u}


def test_long_chains(spark):
    edges = spark.createDataFrame([(f"{i:04}", f"{i + 1:04}") for i in range(300) if i != 150] + [("x", "x")], "a string, b string")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {f"{i:04}": "0000" if i <= 150 else "0151" for i in range(301)}
    assert components(edges.where("false")).count() == 0
