"""What a reviewer found on larger tables."""

import random

from factloom.operators.aliases import meetings, near_terms


def pieces(term):
    return {term[i : i + 3] for i in range(max(1, len(term) - 2))} if len(term) > 2 else {term}


def test_near_terms_of_all_lengths(spark):
    """near terms are all found, whatever the sizes of both and however many pieces they must share."""
    rng, words = random.Random(5), set()
    for n in (*range(1, 20), 62, 66, 69):
        for _ in range(2):
            term = "".join(rng.choices("abcdefgh", k=n))
            words |= {term, term + "x", "y" + term, term + "xyz", term[: n // 2] + "z" + term[n // 2 :], term + term[:3]}
    words = sorted(words)
    for least in (0.8, 0.5):
        want = {}
        for i, a in enumerate(words):
            for b in words[i + 1 :]:
                x, y = pieces(a), pieces(b)
                if len(x & y) / len(x | y) >= least - 1e-9:
                    want[a, b] = round(len(x & y) / len(x | y), 6)
        got = {(r["a"], r["b"]): round(r["similarity"], 6) for r in near_terms(spark.createDataFrame([(w,) for w in words], "term string"), least).collect()}
        assert got == want


def test_terms_of_few_different_pieces_do_not_all_meet(spark):
    """4,000 terms over 4,096 pieces; single rare pieces made some 20,000 pairs of them, and four times as many for twice the terms."""
    rng = random.Random(6)
    terms = spark.createDataFrame([("".join(rng.choices("0123456789abcdef", k=12)),) for _ in range(4000)], "term string")
    assert meetings(terms, 0.8).select("a", "b").distinct().count() < 100
