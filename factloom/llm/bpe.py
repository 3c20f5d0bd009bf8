"""Byte-level BPE encoding and decoding by speculation.

A word's tokens are first guessed by greedy longest match over the vocabulary. A guess is right exactly if each token
is what merging makes of its own bytes and no merge would ever fire across a boundary of two neighbours; the latter
depends on the pair alone, so numpy checks all pairs of all new words together. Only words with a failing pair are
merged exactly. Words repeat, so their tokens are kept in a bounded cache while a task runs. Vocabulary, merges and the
trie are flat arrays of a few MB, whatever the corpus; the driver reads the file and broadcasts them.

Defined cases: null text counts as empty and gives no tokens; the strings of added tokens inside a text become those
tokens; very long texts are cut at blanks between letters, where no pre-token can span; rows keep their order and
number; other columns pass through `encode` and `decode` untouched, but one of the output's name, which it replaces.
"""

from __future__ import annotations

import heapq
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import SLAB_CHARS, WordCache, modest, others, slabs, tidied, unused

#: Fixed value: the pattern by which byte-level BPE of this family cuts text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A text is cut, where that is safe, once a piece has this many characters.
PIECE_CHARS = 1 << 20
NEVER = np.iinfo(np.int64).max
#: Words of up to so many bytes are merged together, so many at a time; of longer ones than TOGETHER_BYTES each is guessed by itself.
MATRIX_BYTES, MATRIX_ROWS, TOGETHER_BYTES = 32, 20_000, 128
#: Letters and numbers of later Unicode versions than the library's (16), in which they are of no class.
_LATER = regex.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1"
    "\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff"
    "\U00018cd6-\U00018cda\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
    "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2"
    "\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
    "\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
#: Fixed value: the same pattern for characters below U+0100, with their letters, numbers and blanks written out.
_LETTERS, _NUMBERS, _BLANKS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile("[\0-\xff]*")
_LATIN_WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+")
_CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")
_WORDS = regex.compile(PATTERN)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files of this kind."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def trie_of(words: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The trie of the words: keys (node x 256 + byte) in order, the node each leads to, the id that ends at each node (-1: none)."""
    steps: dict[int, int] = {}
    ends = {}
    for raw, i in words:
        node = 0
        for b in raw:
            node = steps.setdefault(node << 8 | b, len(steps) + 1)
        ends[node] = i
    keys, nodes = np.fromiter(steps, np.int64, len(steps)), np.fromiter(steps.values(), np.int64, len(steps))
    order = np.argsort(keys)
    terms = np.full(len(steps) + 1, -1, np.int64)
    terms[np.fromiter(ends, np.int64, len(ends))] = np.fromiter(ends.values(), np.int64, len(ends))
    return keys[order], nodes[order], terms


class Model(WordCache):
    """Vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_symbols()
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.size = max([*vocab.values(), *self.added.values()]) + 1
        self.added_at = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank_of = np.full(self.size, -1, np.int64)
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        self.made = pairs[:, 2].copy()
        self.left[self.made], self.right[self.made], self.rank_of[self.made] = pairs[:, 0], pairs[:, 1], np.arange(len(pairs))
        keys = pairs[:, 0] * self.size + pairs[:, 1]
        self.pair_rank = np.argsort(keys, kind="stable")
        self.pair_keys = keys[self.pair_rank]
        made = np.flatnonzero(self.rank_of >= 0)
        sound = np.ones(self.size, bool)
        sound[made] = self.apart(self.left[made], self.right[made], self.rank_of[made])
        for t, x, y in zip(self.made.tolist(), pairs[:, 0].tolist(), pairs[:, 1].tolist(), strict=True):
            sound[t] &= sound[x] and sound[y]
        byte_ids = {to_byte[s]: i for s, i in vocab.items() if len(s) == 1}
        self.byte_id = np.array([byte_ids[b] for b in range(256)])
        known = {i: bytes(to_byte[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.added.items()}
        raw = [known.get(i, b"") for i in range(self.size)]
        self.raw, self.raw_at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        self.trie_keys, self.trie_nodes, self.terms = trie_of([(bytes(to_byte[c] for c in s), i) for s, i in vocab.items() if sound[i]])
        self.fresh()

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; NEVER where there is none."""
        if not len(self.pair_keys):
            return np.full(len(a), NEVER)
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge fires across the boundary of each pair (of rank below `before`, if given).

        The parts at the boundary are followed back in time: of the two, the one that was merged last is undone. A merge of
        the two parts fires if it comes before either of them is used up, on the left side strictly.
        """
        x, y = a.astype(np.int64), b.astype(np.int64)
        until_x = np.full(len(x), NEVER) if before is None else before.astype(np.int64)
        until_y = np.full(len(x), NEVER) if before is None else before - 1
        good, live = np.ones(len(x), bool), np.arange(len(x))
        while len(live):
            u, v = x[live], y[live]
            m = self.ranks(u, v)
            fires = (m < until_x[live]) & (m <= until_y[live])
            good[live[fires]] = False
            undo_x = self.rank_of[u] > self.rank_of[v]
            go_on = ~fires & (np.maximum(self.rank_of[u], self.rank_of[v]) >= 0)
            i = live[go_on & undo_x]
            until_x[i], x[i] = self.rank_of[x[i]], self.right[x[i]]
            i = live[go_on & ~undo_x]
            until_y[i], y[i] = self.rank_of[y[i]], self.left[y[i]]
            live = live[go_on]
        return good

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The greedy tokens of all words in a row, and how many each word has: one step takes a byte of every word."""
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        word = np.flatnonzero(np.diff(ends, prepend=0))
        at, end = np.concatenate([[0], ends[:-1]])[word], ends[word]
        node, found, stop = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64), at.copy()
        out, owner = [], []
        while len(word):
            key = node << 8 | text[np.minimum(at, len(text) - 1)]
            k = np.minimum(np.searchsorted(self.trie_keys, key), len(self.trie_keys) - 1)
            go = (self.trie_keys[k] == key) & (at < end)
            node = np.where(go, self.trie_nodes[k], 0)
            at = at + go
            term = self.terms[node]
            whole = go & (term >= 0)
            found, stop = np.where(whole, term, found), np.where(whole, at, stop)
            out.append(found[~go])
            owner.append(word[~go])
            at = np.where(go, at, stop)
            left = go | (at < end)
            word, at, end, node, found, stop = word[left], at[left], end[left], node[left], found[left], stop[left]
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return (np.concatenate(out) if out else owner)[order], np.bincount(owner, minlength=len(words))

    def greedy_one(self, word: bytes) -> list[int]:
        """The same for one long word, byte by byte."""
        keys, nodes, terms = memoryview(self.trie_keys), memoryview(self.trie_nodes), memoryview(self.terms)
        out, at, n = [], 0, len(word)
        while at < n:
            node, found, end, i = 0, -1, at, at
            while i < n:
                key = node << 8 | word[i]
                k = bisect_left(keys, key)
                if k == len(keys) or keys[k] != key:
                    break
                node, i = nodes[k], i + 1
                if terms[node] >= 0:
                    found, end = terms[node], i
            out.append(found)
            at = end
        return out

    def speculated(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """greedy of all words, the long ones among them by themselves."""
        long = [k for k, w in enumerate(words) if len(w) > TOGETHER_BYTES]
        flat, counts = self.greedy([b"" if len(w) > TOGETHER_BYTES else w for w in words] if long else words)
        for k in reversed(long):
            ids = self.greedy_one(words[k])
            before = int(counts[:k].sum())
            flat, counts[k] = np.concatenate([flat[:before], np.array(ids, np.int64), flat[before:]]), len(ids)
        return flat, counts

    def merged(self, words: list[bytes]) -> list[np.ndarray]:
        """Exact merging of many short words at once: in each round every word makes its merge of least rank."""
        n, width = len(words), max(map(len, words)) + 1
        size = np.array([len(w) for w in words])
        ids = np.full((n, width), -1, np.int64)
        filled = np.arange(width) < size[:, None]
        ids[filled] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        rank = np.full((n, width), NEVER)
        inner = filled[:, 1:]
        rank[:, :-1][inner] = self.ranks(ids[:, :-1][inner], ids[:, 1:][inner])
        live, step = np.arange(n), np.arange(width)
        while len(live):
            r = rank[live]
            at = r.argmin(1)
            low = r[np.arange(len(live)), at]
            go = low < NEVER
            live, at, low, r = live[go], at[go], low[go], r[go]
            if not len(live):
                break
            row = np.arange(len(live))
            take = np.minimum(step + (step > at[:, None]), width - 1)
            x, r = np.take_along_axis(ids[live], take, 1), np.take_along_axis(r, take, 1)
            x[:, -1], r[:, -1] = -1, NEVER
            x[row, at] = self.made[low]
            for k in (at - 1, at):
                ok = (k >= 0) & (x[row, np.minimum(k + 1, width - 1)] >= 0)
                i, j = row[ok], k[ok]
                r[i, j] = self.ranks(x[i, j], x[i, j + 1])
                r[row[~ok & (k >= 0)], k[~ok & (k >= 0)]] = NEVER
            ids[live], rank[live] = x, r
        return [row[:k] for row, k in zip(ids, (ids >= 0).sum(1).tolist(), strict=True)]

    def exact(self, word: bytes) -> np.ndarray:
        """Merges by rank, leftmost first, over a linked list with a heap."""
        keys, ranks, made, size = memoryview(self.pair_keys), memoryview(self.pair_rank), memoryview(self.made), self.size

        def rank(a: int, b: int) -> int:
            k = bisect_left(keys, a * size + b)
            return ranks[k] if k < len(keys) and keys[k] == a * size + b else -1

        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        nxt, prev = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := rank(a, b)) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i] = made[r]
            ids[j] = -1
            nxt[i] = nxt[j]
            if nxt[i] < len(ids):
                prev[nxt[i]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] < len(ids) and (r := rank(ids[k], ids[nxt[k]])) >= 0:
                    heapq.heappush(heap, (r, k, ids[k], ids[nxt[k]]))
        return np.array([i for i in ids if i >= 0], np.int64)

    def learn(self, words: list[str]) -> None:
        """Puts the tokens of new words in the cache."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        flat, counts = self.speculated(raw)
        ends = np.cumsum(counts)
        inside = np.ones(max(len(flat) - 1, 0), bool)
        inside[ends[:-1] - 1] = False
        at = np.flatnonzero(inside)
        failed = np.unique(np.searchsorted(ends, at[~self.apart(flat[at], flat[at + 1])], side="right"))
        short = [k for k in failed.tolist() if len(raw[k]) <= MATRIX_BYTES]
        again = {k: self.exact(raw[k]) for k in failed.tolist() if len(raw[k]) > MATRIX_BYTES}
        for i in range(0, len(short), MATRIX_ROWS):
            part = short[i : i + MATRIX_ROWS]
            again |= zip(part, self.merged([raw[k] for k in part]), strict=True)
        if again:  # the failing words' tokens take the place of their guesses
            good = np.ones(len(words), bool)
            good[failed] = False
            flat = np.concatenate([flat[np.repeat(good, counts)], *(again[k] for k in failed.tolist())])
            counts[failed] = [len(again[k]) for k in failed.tolist()]
            order = np.concatenate([np.flatnonzero(good), failed])
            words, counts = [words[k] for k in order.tolist()], counts[order]
        self.keep(words, counts, flat)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end."""
        cut: list[list[list[str] | int]] = []
        for text in texts:
            parts: list[list[str] | int] = []
            for s in self.added_at.split(text) if self.added_at else [text]:
                parts += [self.added[s]] if s in self.added else [find(p) for p in pieces(s)] if s else []
            cut.append(parts)
        self.meet(set().union(*(p for parts in cut for p in parts if not isinstance(p, int))))
        get = self.words.__getitem__
        out, ends, n = [], [], 0
        for parts in cut:
            for p in parts:
                out.append(np.array([p], np.int32) if isinstance(p, int) else self.ids_at(np.fromiter(map(get, p), np.int64, len(p))))
                n += len(out[-1])
            ends.append(n)
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(ends, np.int64)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids, each text's up to its end; bytes that aren't UTF-8 become U+FFFD."""
        starts = self.raw_at
        sizes = (starts[1:] - starts[:-1])[ids]
        until = np.cumsum(sizes)
        text = self.raw[np.repeat(starts[ids] - (until - sizes), sizes) + np.arange(until[-1] if len(until) else 0)].tobytes()
        stops = np.concatenate([[0], until])[ends].tolist()
        return [text[a:b].decode("utf-8", "replace") for a, b in zip([0, *stops], stops, strict=False)]


def find(text: str) -> list[str]:
    """The pre-tokens of a text; the standard library's faster engine does where each character has one byte."""
    if text.isascii() or _LATIN.fullmatch(text):
        return _LATIN_WORDS.findall(text)
    if not _LATER.search(text):
        return _WORDS.findall(text)
    return [text[slice(*m.span())] for m in _WORDS.finditer(_LATER.sub("\uffff", text))]


def pieces(text: str) -> Iterator[str]:
    """The text cut at blanks between letters, about every PIECE_CHARS characters."""
    at = 0
    while len(text) - at > PIECE_CHARS and (m := _CUT.search(text, at + PIECE_CHARS)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


@lru_cache(1)
def model(path: str) -> Model:
    return Model(path)


def _sent(df: DataFrame, path: str) -> Broadcast:
    """The model for the tasks: its arrays, without the cache of words."""
    own = model(path)
    own.fresh()
    return df.sparkSession.sparkContext.broadcast(own)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "token_ids", back: str | None = None) -> DataFrame:
    """df with the column `out`, array<int>: the ids of each whole text; and with the column `back`, if it is named, what those ids decode to."""
    sent = _sent(df, path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sent.value
        for batch in tidied(batches, bpe.fresh):
            texts = batch.column(batch.num_columns - 1)
            rest = batch.select(range(batch.num_columns - 1))
            for i, j in slabs(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), SLAB_CHARS // 2):
                ids, ends = bpe.encode([t or "" for t in texts[i:j].to_pylist()])
                part = rest.slice(i, j - i)
                new = [pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids))]
                if back:
                    new.append(pa.array(bpe.decode(ids, ends), pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, out, *([back] if back else [])])

    kept, fields = others(df, out, *([back] if back else []))
    schema = T.StructType([*fields, T.StructField(out, T.ArrayType(T.IntegerType())), *([T.StructField(back, T.StringType())] if back else [])])
    return modest(df.select(*kept, F.col(f"`{text}`").alias(unused(df, "text__")))).mapInArrow(task, schema)


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the column `out`: the text of each row's ids (null: empty); bytes that aren't UTF-8 become U+FFFD."""
    sent = _sent(df, path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sent.value
        for batch in tidied(batches):
            lists = batch.column(batch.num_columns - 1)
            rest = batch.select(range(batch.num_columns - 1))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for i, j in slabs(sizes.tolist(), SLAB_CHARS // 4):
                texts = bpe.decode(lists[i:j].flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes[i:j]))
                part = rest.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    kept, fields = others(df, out)
    schema = T.StructType([*fields, T.StructField(out, T.StringType())])
    return modest(df.select(*kept, F.col(f"`{ids}`").alias(unused(df, "ids__")))).mapInArrow(task, schema)
