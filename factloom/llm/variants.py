"""Spelling variants: words of the corpus, grouped under a much more frequent word one edit away.

Words stand in a trie of their letters' frequency vectors: level k branches by how many letters of group k a word has. An
inserted, deleted or replaced letter adds at most one to one count and takes at most one from one, so a word's near words
are found by a depth-first search that may spend a surplus of one and a deficit of one; the words of the leaves it reaches
are verified letter by letter. The search goes down for many words together, a level at a time; too wide a front is split
and its parts wait on a stack, so memory is bounded.

The trie is dealt out by its upper levels: as many of them as it takes until no subtrie has more than SUBTRIE words. A word
stands in one subtrie and is sent as a question to those others, behind its own in the order of vectors, that the budgets
let it reach, so each pair is found once. Letters are put in GROUPS groups of about equal frequency, counted over the words.

Defined cases: null text has no words; a null id counts as the empty string; texts and words are taken whole, whatever
their length; rows of one id each count; an empty table gives an empty one; other columns don't matter, whatever their
names; of near words with equal numbers the smallest in code-point order is the form. A subtrie at the full depth holds words of
equal letters alone, and isn't split further.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import Places, kept, modest, slabs, tidied
from factloom.llm.crc import moved

MIN_LETTERS, MIN_TIMES, RATIO = 5, 3, 2
#: One run in so many, told by its CRC, has a letter deleted; None: none has.
SPOIL = 97
#: Fixed value: the letters that make up words (of one byte each in Latin-1).
LETTERS = "A-Za-zÀ-ÿ"
#: Levels of the trie, of four bits each; words of a subtrie; words that search together; width of a front; letters of words verified together.
GROUPS, SUBTRIE, TOGETHER, FRONT, WIDTH = 16, 50_000, 20_000, 1_000_000, 32
#: Distinct words that a task counts before it hands their numbers on.
CACHE_WORDS = 300_000


class Counter(Places):
    """How often a task met each word."""

    def __init__(self) -> None:
        self.fresh()

    def fresh(self) -> None:
        self.clear()
        self.new = []
        self.crc, self.size, self.times = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def met(self, words: Iterator[str]) -> np.ndarray:
        at = np.fromiter(map(self.__getitem__, words), np.int64)
        raw = [w.encode() for w in self.new]
        self.new = []
        self.crc = np.concatenate([self.crc, np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))])
        self.size = np.concatenate([self.size, np.fromiter(map(len, raw), np.int64, len(raw))])
        self.times = np.concatenate([self.times, np.zeros(len(raw), np.int64)])
        return at

    def rows(self, least: int) -> pa.RecordBatch:
        words = [w for w, n in zip(self, self.times.tolist(), strict=True) if n and len(w) >= least]
        times = [n for w, n in zip(self, self.times.tolist(), strict=True) if n and len(w) >= least]
        self.fresh()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(times, pa.int64())], names=["word", "n"])


def words(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = MIN_LETTERS, times: int = MIN_TIMES, spoil: int | None = SPOIL) -> DataFrame:
    """word and n: the words of at least `least` letters that all texts together have at least `times` times."""
    run = re.compile(f"[{LETTERS}]{{{least},}}")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[pa.RecordBatch]:
            seen = Counter()
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
                for i, j in slabs(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                    cut = [run.findall((t or b"").lower().decode()) for t in texts[i:j].to_pylist()]
                    at = seen.met(chain.from_iterable(cut))
                    seen.times += np.bincount(at, minlength=len(seen.times))
                    if spoil:
                        before = np.array([zlib.crc32(f"{x}:".encode()) for x in ids[i:j]], np.uint32)
                        crc = moved(np.repeat(before, [len(c) for c in cut]), seen.size[at]) ^ seen.crc[at]
                        hit = np.flatnonzero(crc % np.uint32(spoil) == 0)
                        seen.times -= np.bincount(at[hit], minlength=len(seen.times))
                        all_words = list(chain.from_iterable(cut))
                        spoilt = [w[:k] + w[k + 1 :] for w, k in ((all_words[x], int(crc[x]) % len(all_words[x])) for x in hit.tolist())]
                        at = seen.met(iter(spoilt))
                        seen.times += np.bincount(at, minlength=len(seen.times))
                    if len(seen) > CACHE_WORDS:
                        yield seen.rows(least)
            yield seen.rows(least)

        yield from tidied(counted())

    rows = modest(df.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.col(f"`{text}`").alias("text")))
    return rows.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def letter_groups(vocabulary: DataFrame, groups: int = GROUPS) -> np.ndarray:
    """The level of each Latin-1 letter: letters by falling frequency over the words, each to the lightest group so far."""
    letters = vocabulary.select(F.explode(F.split("word", "")).alias("letter")).where(F.col("letter") != "")
    counts = {r["letter"]: r["count"] for r in letters.groupBy("letter").count().collect()}  # one row a letter, 90 at most
    level, weight = np.zeros(256, np.int64), [0] * groups
    for c, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        level[ord(c)] = k = weight.index(min(weight))
        weight[k] += n
    return level


def vectors(data: list[bytes], level: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Frequency vectors of words: a count by level (up to 15), four bits each, the first level's highest."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    owner = np.repeat(np.arange(len(data)), sizes)
    counts = np.bincount(owner * groups + level[np.frombuffer(b"".join(data), np.uint8)], minlength=len(data) * groups).reshape(-1, groups)
    return (np.minimum(counts, 15).astype(np.uint64) << (4 * np.arange(groups - 1, -1, -1, dtype=np.uint64))).sum(1, dtype=np.uint64)


def digits(codes: np.ndarray, depth: int, groups: int = GROUPS) -> np.ndarray:
    """The counts of the first `depth` levels."""
    return (codes[:, None] >> (4 * np.arange(groups - 1, groups - 1 - depth, -1, dtype=np.uint64)) & np.uint64(15)).astype(np.int64)


class Trie:
    """A subtrie and its words: for each level the child of each node by count, and for each leaf where its words stand."""

    def __init__(self, data: list[bytes], codes: np.ndarray, groups: int = GROUPS) -> None:
        order = np.argsort(codes, kind="stable")
        self.data, self.order, self.groups = [data[k] for k in order.tolist()], order, groups
        leaves, self.first = np.unique(codes[order], return_index=True)
        self.first = np.append(self.first, len(data))
        self.children = []
        above = np.zeros(len(leaves), np.int64)
        for k in range(groups):
            prefix = leaves >> np.uint64(4 * (groups - 1 - k))
            new = np.concatenate([[True], prefix[1:] != prefix[:-1]])
            node = np.cumsum(new) - 1
            table = np.full((int(above.max(initial=-1)) + 1, 16), -1, np.int32)
            table[above[new], (prefix[new] & np.uint64(15)).astype(np.int64)] = node[new]
            self.children.append(table)
            above = node
        self.letters = Letters(self.data)

    def reached(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Questions and the leaves they reach, depth first in blocks."""
        counts = digits(codes, self.groups, self.groups)
        n = len(codes)
        stack = [(0, np.arange(a, min(a + TOGETHER, n)), np.zeros(min(TOGETHER, n - a), np.int32), np.zeros(min(TOGETHER, n - a), np.int8)) for a in range(0, n, TOGETHER)]
        while stack:
            k, q, node, spent = stack.pop()
            if k == self.groups:
                yield q, node
                continue
            if len(q) > FRONT:
                half = len(q) // 2
                stack += [(k, q[half:], node[half:], spent[half:]), (k, q[:half], node[:half], spent[:half])]
                continue
            flat, base = self.children[k].reshape(-1), node.astype(np.int64) * 16 + counts[q, k]
            c = counts[q, k]
            same = flat[base]
            more = np.flatnonzero((spent & 1 == 0) & (c < 15))  # the leaf has one more: a surplus
            less = np.flatnonzero((spent & 2 == 0) & (c > 0))  # or one less: a deficit
            up, down, stay = flat[base[more] + 1], flat[base[less] - 1], np.flatnonzero(same >= 0)
            more, up, less, down = more[up >= 0], up[up >= 0], less[down >= 0], down[down >= 0]
            at = np.concatenate([stay, more, less])
            took = np.concatenate([spent[stay], spent[more] | 1, spent[less] | 2]).astype(np.int8)
            stack.append((k + 1, q[at], np.concatenate([same[stay], up, down]), took))

    def near(self, asked: "Letters", codes: np.ndarray, own: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Questions and places of words exactly one edit from them; own: the questions are the trie's words, and each pair comes once."""
        for q, leaf in self.reached(codes):
            many = self.first[leaf + 1] - self.first[leaf]
            a = np.repeat(q, many)
            b = np.repeat(self.first[leaf] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            if own:
                a, b = a[a < b], b[a < b]
            for i in range(0, len(a), FRONT):
                x, y = a[i : i + FRONT], b[i : i + FRONT]
                ok = asked.one_edit(x, self.letters, y)
                yield x[ok], y[ok]


class Letters:
    """The letters of words for verification: from the front and from the back, and the first and last two."""

    def __init__(self, data: list[bytes]) -> None:
        self.data, n = data, len(data)
        self.size = np.fromiter(map(len, data), np.int64, n)
        width = int(min(self.size.max(initial=2), WIDTH)) + 1
        self.width, self.long = width, self.size > WIDTH
        self.front, self.back = np.zeros((n, width), np.uint8), np.zeros((n, width), np.uint8)
        cut = [w if len(w) <= WIDTH else w[:2] + w[-2:] for w in data]
        sizes = np.fromiter(map(len, cut), np.int64, n)
        inside = np.arange(width) < sizes[:, None]
        self.front[inside] = np.frombuffer(b"".join(cut), np.uint8)
        self.back[inside] = np.frombuffer(b"".join(w[::-1] for w in cut), np.uint8)
        self.head = self.front[:, 0].astype(np.int32) << 8 | self.front[:, 1]
        self.tail = self.back[:, 0].astype(np.int32) << 8 | self.back[:, 1]

    def one_edit(self, x: np.ndarray, other: "Letters", y: np.ndarray) -> np.ndarray:
        """Which pairs differ by exactly one inserted, deleted or replaced letter: then they share what stands before and what stands behind it."""
        some = np.flatnonzero((np.abs(self.size[x] - other.size[y]) <= 1) & ((self.head[x] == other.head[y]) | (self.tail[x] == other.tail[y])))
        a, b = x[some], y[some]
        ok = np.zeros(len(some), bool)
        long = self.long[a] | other.long[b]
        short = np.flatnonzero(~long)
        width = min(self.width, other.width)
        i, j = a[short], b[short]
        fit = (self.size[i] < width) & (other.size[j] < width)  # else one is wider than all words of the other side
        short, i, j = short[fit], i[fit], j[fit]
        before = self.front[i, :width] != other.front[j, :width]
        after = self.back[i, :width] != other.back[j, :width]
        shared = before.argmax(1) + after.argmax(1)
        m, n = self.size[i], other.size[j]
        ok[short] = before.any(1) & (shared >= np.minimum(m, n) - (m == n))
        rest = np.concatenate([np.flatnonzero(long), np.flatnonzero(~long)[~fit]])
        for k in rest.tolist():
            ok[k] = one_edit(self.data[a[k]], other.data[b[k]])
        return some[ok]


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


def moves(depth: int) -> list[np.ndarray]:
    """What a surplus and a deficit of at most one each can do to the first levels."""
    unit = np.eye(depth, dtype=np.int64)
    return [s - d for s in (np.zeros(depth, np.int64), *unit) for d in (np.zeros(depth, np.int64), *unit) if (s != d).any()]


def depth_of(vocabulary: DataFrame, level: np.ndarray, most: int = SUBTRIE) -> int:
    """How many levels deal out the trie: the fewest that leave no subtrie more than `most` words."""
    sent = level.tolist()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = vectors([w.encode("latin-1") for w in batch.column(0).to_pylist()], np.array(sent))
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64) if not len(codes) else codes.view(np.int64))], names=["code"])

    codes = kept(vocabulary.select("word").mapInArrow(task, "code long").groupBy("code").count(), "vectors")
    for depth in range(1, GROUPS):
        largest = codes.groupBy(F.shiftrightunsigned("code", 4 * (GROUPS - depth)).alias("at")).agg(F.sum("count").alias("n")).agg(F.max("n")).first()[0]
        if not largest or largest <= most:
            return depth
    return GROUPS


def near_pairs(vocabulary: DataFrame, most: int = SUBTRIE) -> DataFrame:
    """Each pair of words (a, n_a, b, n_b) of vocabulary (word, n) one edit apart, once."""
    level = letter_groups(vocabulary)
    depth = depth_of(vocabulary, level, most)
    sent, steps = level.tolist(), moves(depth)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of role 0 for each word in its subtrie, rows of role 1 for the subtries behind it where it asks."""
        place = 16 ** np.arange(depth - 1, -1, -1, dtype=np.uint64)
        for batch in batches:
            codes = vectors([w.encode("latin-1") for w in batch.column(0).to_pylist()], np.array(sent))
            own = digits(codes, depth)
            home = (own.astype(np.uint64) * place).sum(1, dtype=np.uint64)
            rows, at, role = [np.arange(len(codes))], [home], [np.zeros(len(codes), np.int8)]
            for step in steps:
                there = own + step
                key = (np.clip(there, 0, 15).astype(np.uint64) * place).sum(1, dtype=np.uint64)
                ok = np.flatnonzero(((there >= 0) & (there < 16)).all(1) & (key > home))
                rows.append(ok)
                at.append(key[ok])
                role.append(np.ones(len(ok), np.int8))
            rows, at, role = np.concatenate(rows), np.concatenate(at), np.concatenate(role)
            for i in range(0, len(rows), 50_000):
                part = batch.take(pa.array(rows[i : i + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000].view(np.int64)), pa.array(role[i : i + 50_000]), *part.columns], names=["at", "role", "word", "n"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by subtrie, its words first: they become the trie, then the questions stream through it."""
        at, held, trie = None, [], None

        def answers(asked: list[str], n: np.ndarray, codes: np.ndarray, letters: Letters, own: bool) -> Iterator[pa.RecordBatch]:
            for a, b in trie[0].near(letters, codes, own):
                if len(a):
                    words, counts = trie[1], trie[2]
                    yield pa.RecordBatch.from_arrays([pa.array([asked[k] for k in a.tolist()], pa.string()), pa.array(n[a]), pa.array([words[k] for k in b.tolist()], pa.string()), pa.array(counts[b])], names=["a", "n_a", "b", "n_b"])

        def built() -> Iterator[pa.RecordBatch]:
            nonlocal trie, held
            words = [w for ws, _ in held for w in ws]
            if not words:
                trie = None
                return
            counts = np.concatenate([n for _, n in held])
            data = [w.encode("latin-1") for w in words]
            codes = vectors(data, np.array(sent))
            t = Trie(data, codes)
            trie = (t, [words[k] for k in t.order.tolist()], counts[t.order])
            held = []
            yield from answers(trie[1], trie[2], codes[t.order], t.letters, True)

        for batch in tidied(batches):
            key, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, j in runs(key, role):
                if key[i] != at:
                    if held:  # a subtrie that nobody asked
                        yield from built()
                    at, held, trie = key[i], [], None
                words, n = batch.column(2)[i:j].to_pylist(), batch.column(3)[i:j].to_numpy()
                if role[i] == 0:
                    held.append((words, n))
                    continue
                if held:
                    yield from built()
                if trie:
                    data = [w.encode("latin-1") for w in words]
                    yield from answers(words, n, vectors(data, np.array(sent)), Letters(data), False)
        if held:
            yield from built()

    rows = vocabulary.select("word", "n").mapInArrow(dealt, "at long, role byte, word string, n long")
    return rows.repartition("at").sortWithinPartitions("at", "role").mapInArrow(searched, "a string, n_a long, b string, n_b long")


def runs(key: np.ndarray, role: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of one subtrie and role."""
    if len(key):
        cuts = np.flatnonzero((key[1:] != key[:-1]) | (role[1:] != role[:-1])) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True)


def forms(vocabulary: DataFrame, ratio: int = RATIO, most: int = SUBTRIE) -> DataFrame:
    """word, n, n_near (its near words), form (of these the one of most occurrences, if they are at least ratio times its own) and form_n."""
    pairs = near_pairs(vocabulary, most)
    both = F.explode(F.array(*(F.struct(F.col(x).alias("word"), F.struct((-F.col(f"n_{y}")).alias("n"), F.col(y).alias("word")).alias("other")) for x, y in (("a", "b"), ("b", "a")))))
    near = pairs.select(both.alias("p")).select("p.word", F.lit(None).cast("long").alias("n"), "p.other")
    own = vocabulary.select("word", "n", F.lit(None).cast("struct<n:bigint,word:string>").alias("other"))
    best = own.unionByName(near).groupBy("word").agg(F.max("n").alias("n"), F.count("other").alias("n_near"), F.min("other").alias("best"))
    is_form = -F.col("best.n") >= ratio * F.col("n")
    return best.select("word", "n", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n"))


def roots(found: DataFrame) -> DataFrame:
    """word and root of the words that have a form: each round follows twice as many forms as the one before. A form has at
    least twice its word's occurrences, so there are few rounds and no circles."""
    step = kept(found.where("form IS NOT NULL").select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "roots")
    while True:
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("next"), F.col("open").alias("more"))
        live = step.where("open").join(ahead, "root", "left")
        moved_on = live.select("word", F.coalesce("next", "root").alias("root"), F.coalesce("more", F.lit(False)).alias("open"))
        step = kept(step.where("NOT open").unionByName(moved_on), "roots")
        if not step.where("open").limit(1).count():
            return step.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = MIN_LETTERS, times: int = MIN_TIMES, ratio: int = RATIO, spoil: int | None = SPOIL, most: int = SUBTRIE) -> DataFrame:
    """word, form and root; n, n_near and form_n: each word of docs with the more frequent word that it is a variant of, and the last of these."""
    vocabulary = kept(words(docs, id_col, text, least, times, spoil), "words")
    found = kept(forms(vocabulary, ratio, most), "forms")
    return found.join(roots(found), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
