"""Secrets in text: three fixed patterns, and values in credential context that would be costly to guess.

Guess cost: the least sum, over all ways to cut a value into spans, of what each span costs an attacker in bits: a
word by its rank, a date by the days of the covered years, a repeat by its unit, a keyboard walk by its start and
turns, any other character by brute force over the alphabet that the value uses; each span adds a constant for its place
in the pattern. One programme over the whole value finds the sum in time linear in the value: walks and repeats are
states that a further key or unit prolongs. A value is reported if its cost reaches MIN_BITS.

Words are the listed passwords, then those of the corpus by how often they occur in all documents, outside credential
contexts and between at least MIN_CONTEXTS different pairs of neighbours, cut at rank DICTIONARY (a table of bounded size,
which every task gets). So a secret that is copied from page to page doesn't become a word.

Defined cases: null counts as the empty text; offsets are code points, ends exclusive; spans of one kind don't
overlap, those of different kinds may; spans are sorted by start, then kind in the order of KINDS; of equally frequent words
the one that sorts first has the better rank; rows pass one by one, so repeated ids don't matter; texts are taken whole, a batch of rows or
one very long text at a time; an empty table gives an empty one; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import modest, slabs, tidied

#: The kinds in their order and the patterns of the first three.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS = 12
#: What puts a value in credential context, for the kind guess.
CONTEXT = re.compile(r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth|login)["']?[\x20\t]*(?::=|=>|[:=])[\x20\t]*["']?([^\s"'<>]{8,})""", re.ASCII)
#: Common words in passwords, most common first.
WORDS = "password qwerty dragon monkey letmein football baseball welcome login admin master shadow sunshine princess superman hello freedom whatever charlie michael jordan secret summer winter spring autumn flower access batman trustno starwars test user guest root changeme default example sample token love god pass word the and you that for with this have from your name home work love time year good blue red green black white happy lucky magic power".split()
#: Words of the corpus that are ranked after those, and their letters.
DICTIONARY, SHORTEST_WORD, LONGEST_WORD = 1 << 16, 3, 24
#: Pairs of neighbours that make a word of a run of letters.
MIN_CONTEXTS = 8
#: Rows of a keyboard, along which a walk goes.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
SPAN_BITS, MIN_BITS = 2.0, 40.0
#: Bits of a walk's first key, of each turn, and of how long a walk or a repeat is.
KEY_BITS, TURN_BITS, LENGTH_BITS = math.log2(47), 1.0, 4.0
#: The smallest alphabet that a brute-force character can come from.
LEAST_ALPHABET = 10
LEET = str.maketrans("@4310$57!", "aaeiossti")


Ranks = Mapping[str, int]
LISTED: Ranks = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}


@lru_cache(1)
def steps() -> dict[tuple[str, str], tuple[int, int]]:
    """The direction from a key to each neighbour."""
    place = {c: (x, y) for y, row in enumerate(ROWS) for x, c in enumerate(row)}
    return {(a, b): (u - x, v - y) for a, (x, y) in place.items() for b, (u, v) in place.items() if a != b and abs(x - u) <= 1 and abs(y - v) <= 1}


def alphabet_bits(value: str) -> float:
    n = sum(size for test, size in ((str.islower, 26), (str.isupper, 26), (str.isdigit, 10)) if any(map(test, value)))
    return math.log2(max(n + 33 * any(not c.isalnum() for c in value), LEAST_ALPHABET))


def lowered(value: str) -> str:
    """Lower case, character by character, so that places stay."""
    return value.lower() if value.isascii() else "".join(c if len(c.lower()) > 1 else c.lower() for c in value)


def fixed_spans(value: str, low: str, plain: str, i: int, ranks: Ranks) -> Iterator[tuple[int, float]]:
    """Ends and bits of the words and dates that begin at i."""
    for j in range(i + SHORTEST_WORD, min(len(value), i + LONGEST_WORD) + 1):
        if (rank := ranks.get(low[i:j]) or ranks.get(plain[i:j])) is not None:
            yield j, math.log2(rank + 1) + (value[i:j] != low[i:j]) + 2 * (low[i:j] != plain[i:j])
    if m := DATE.match(value, i):
        yield m.end(), math.log2(200 * (365 if m.end() - i > 4 else 1)) + 2 * any(m.groups())
        if m.end() - i > 4:
            yield i + 4, math.log2(200)


def guess_bits(value: str, ranks: Ranks = LISTED, enough: float = math.inf) -> float:
    """The guess cost of a value in bits, if it is below `enough`; otherwise some number from `enough` on.

    A repeat's unit is brute force, so one that costs `enough` by itself can't be part of less: units need be no longer than
    that. Once every place from which a span can still begin or in which one ends costs `enough`, so does the whole.
    """
    n, low = len(value), lowered(value)
    plain, brute, way = low.translate(LEET), alphabet_bits(value), steps()
    best = [0.0] + [math.inf] * n
    units = int(min(n // 2, enough / math.log2(LEAST_ALPHABET)))
    same = [0] * (units + 1)  # by unit: how many characters up to here equal those a unit before
    repeat = [[math.inf] * (units + 1) for _ in range(units + 1)]  # of the last places, by unit
    walk, turned, far = math.inf, None, 0
    for i in range(n + 1):
        if i:
            best[i] = min(best[i], best[i - 1] + brute)
            now = repeat[i % (units + 1)]
            for u in range(1, min(units, i) + 1):
                same[u] = same[u] + 1 if i > u and value[i - 1] == value[i - 1 - u] else 0
                now[u] = math.inf
                if same[u] >= u:
                    begun = best[i - 2 * u] + u * alphabet_bits(value[i - 2 * u : i - u]) + LENGTH_BITS + SPAN_BITS
                    longer = repeat[(i - u) % (units + 1)][u] if same[u] >= 2 * u else math.inf
                    now[u] = min(begun, longer)
                    best[i] = min(best[i], now[u])
            step = way.get((low[i - 2], low[i - 1])) if i > 1 else None
            first = way.get((low[i - 3], low[i - 2])) if i > 2 else None
            if step is None:
                walk = math.inf
            else:
                walk += TURN_BITS * (step != first)
                if first is not None:  # three keys are the least
                    walk = min(walk, best[i - 3] + KEY_BITS + LENGTH_BITS + TURN_BITS * (step != first) + SPAN_BITS)
                best[i] = min(best[i], walk)
        for j, bits in fixed_spans(value, low, plain, i, ranks) if i < n else ():
            best[j] = min(best[j], best[i] + bits + SPAN_BITS)
            far = max(far, j)
        if best[i] >= enough and min(walk, min(map(min, repeat)), *best[max(i - max(2 * units, 3), 0) : max(far, i) + 1]) >= enough:
            return enough
    return best[n]


def corpus_ranks(df: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> dict[str, int]:
    """LISTED and, after them, the `most` words of df that occur most often, of those with at least MIN_CONTEXTS pairs of
    neighbours. Values in credential context don't count, and a copied text brings no new neighbours, so what is leaked once
    and copied stays out. Neighbours are told apart by one of 64 bits; the bits of a word are joined before they shuffle."""
    plain = F.lower(F.regexp_replace(F.col(f"`{text_col}`"), CONTEXT.pattern, " = "))
    words = F.concat(F.array(F.lit("")), F.regexp_extract_all(plain, F.lit(r"\p{L}+|="), F.lit(0)), F.array(F.lit("")))
    n = F.size("ws") - 2
    own = df.select(words.alias("ws")).where("size(ws) > 2").select(F.explode(F.arrays_zip(F.slice("ws", F.lit(1), n).alias("before"), F.slice("ws", F.lit(2), n).alias("w"), F.slice("ws", F.lit(3), n).alias("after"))).alias("x"))
    own = own.where(F.length("x.w").between(SHORTEST_WORD, LONGEST_WORD))
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(x.before, x.after), 64) as int))")
    counts = own.groupBy(F.col("x.w").alias("w")).agg(F.count("*").alias("n"), F.bit_or(bit).alias("bits")).where(F.bit_count("bits") >= MIN_CONTEXTS)
    top = counts.orderBy(F.desc("n"), "w").limit(most)
    new = [r["w"] for r in top.collect() if r["w"] not in LISTED]  # DICTIONARY rows at most
    return {**LISTED, **{w: len(WORDS) + 1 + i for i, w in enumerate(new)}}


def find_secrets(text: str, ranks: Ranks = LISTED) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span in a text, in order."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_CHARS]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    found += [(m.start(1), m.end(1), 3) for m in CONTEXT.finditer(text) if guess_bits(m[1], ranks, MIN_BITS) >= MIN_BITS]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2]))]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans (array of kind, start, end) of every row; words are ranked over all rows of df."""
    sent = df.sparkSession.sparkContext.broadcast(corpus_ranks(df, text_col))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        ranks = sent.value
        for batch in tidied(batches):
            texts = batch.column(1)
            for i, j in slabs(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                found = [[{"kind": k, "start": a, "end": b} for a, b, k in find_secrets(t or "", ranks)] for t in texts[i:j].to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(found, kind)], names=["id", "spans"])

    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("spans", SPANS)])
    return modest(rows).mapInArrow(task, schema).withColumnRenamed("id", id_col)
