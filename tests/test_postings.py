"""Shared words: the same best rows as counting all pairs, with few of them as candidates."""

import random
from collections import Counter

import pytest

from factloom.operators import postings


def plain(rows, queries, k):
    words = {}
    for i, w in rows:
        words.setdefault(i, set()).add(w)
    asked = {}
    for q, w in queries:
        if w is not None:
            asked.setdefault(q, set()).add(w)
    return {(q, i, n) for q, ws in asked.items() for i, n in sorted(((i, len(ws & own)) for i, own in words.items() if ws & own), key=lambda x: (-x[1], x[0]))[:k]}


@pytest.mark.parametrize(("seed", "k"), [(1, 1), (2, 3), (3, 10)])
def test_as_all_pairs(spark, seed, k):
    rng = random.Random(seed)
    word = lambda: f"w{min(rng.randrange(1, 40), rng.randrange(1, 40), rng.randrange(1, 40))}"
    rows = [(i, word()) for i in range(200) for _ in range(rng.randrange(6))] + [(i, "all") for i in range(200)] + [(1, "all")]
    queries = [(q, word()) for q in range(40) for _ in range(rng.randrange(8))] + [(q, "all") for q in range(0, 60, 2)] + [(70, "none"), (71, None)]
    got = postings.top_k(spark.createDataFrame(rows, "id long, w string"), spark.createDataFrame(queries, "query_id long, w string"), k)
    assert {tuple(r) for r in got.select("query_id", "id", "overlap").collect()} == plain(rows, queries, k)


def test_frequent_words_are_looked_up(spark):
    """A word of all rows makes no candidates, whether it stands alone or beside a rare one."""
    rows = [(i, "all") for i in range(2000)] + [(i, f"r{i % 100}") for i in range(2000)]
    queries = [(q, "all") for q in range(50)] + [(q, f"r{q}") for q in range(25)]
    own, asked = spark.createDataFrame(rows, "id long, w string"), spark.createDataFrame(queries, "query_id long, w string")
    words = postings.ranked_words(own, asked)
    each = Counter(r["query_id"] for r in postings.candidates(own, words, 5).collect())
    assert max(each[q] for q in range(25)) <= 20 + 5 and {each[q] for q in range(25, 50)} == {5}


def test_empty(spark):
    none = spark.createDataFrame([], "id long, w string")
    asked = spark.createDataFrame([(1, "a")], "query_id long, w string")
    assert postings.top_k(none, asked, 3).isEmpty() and postings.top_k(none, asked.where("false"), 3).isEmpty()
