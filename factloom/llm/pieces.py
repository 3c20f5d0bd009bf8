"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies by a score-ordered agenda.

A word starts as its characters. The agenda holds its adjacent pairs of symbols whose concatenation is a piece, ordered by
the piece's score, of equal scores the leftmost first; the first is merged, its neighbours' pairs enter anew, until none
is left. The agendas of many short words are rows of one matrix, advanced together; a longer word has a heap. No piece of
such a vocabulary goes on behind a blank, so texts are cut into words there, and at ASCII characters that no longer piece
holds; words repeat, so their ids are kept in a bounded cache while a task runs. Characters without a piece become bytes,
or the unknown id where the vocabulary has no bytes (one for a run of them).

The sentencepiece library checks this in the Arrow batches: `encode` with `checked` holds the ids of every new word of a
batch against the library's, and fails on a difference; `agreement`, or the column `agrees`, does so for whole texts and
for what they decode to.

Defined cases: null text counts as empty and gives begin and end ids alone; the strings of control pieces inside a text
are ordinary text; the blank's symbol U+2581 in a text counts as a blank, as in the library; very long texts and words are
taken whole; rows keep their order and number, repeated or not; an empty table stays empty; other columns pass through
untouched, but those of the outputs' names, which they replace. Files of another kind (unigram, user-defined or unused
pieces, a character map) raise a ValueError.
"""

from __future__ import annotations

import codecs
import heapq
import re
import struct
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import SLAB_CHARS, WordCache, modest, others, slabs, tidied, unused

#: The blank's symbol; kinds of pieces; the model type of merges; places of fields in the model file.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGES = 2
NEVER = np.iinfo(np.int32).max
#: Words of up to so many characters have their agendas in a matrix, by widths; so many rows at a time.
WIDTHS, MATRIX_ROWS = (6, 8, 10, 12, 16, 24, 32), 20_000


def _single(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("each-byte", _single)  # every byte that isn't part of a character becomes U+FFFD by itself


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of one message of a protocol buffer: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at, value, shift = at + 1, value | (b & 127) << shift, shift + 7
            if b < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield number, data[at : at + size]
        at += size


class Pieces(WordCache):
    """Vocabulary and settings of one model file."""

    most = 200_000

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            parts = list(fields(f.read()))
        pieces, kinds, scores = [], [], []
        for p in (dict(fields(v)) for k, v in parts if k == 1):
            pieces.append(p[1].decode())
            scores.append(struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0])
            kinds.append(p.get(3, NORMAL))
        trainer, norm = (dict(fields(dict(parts).get(k, b""))) for k in (2, 3))
        if trainer.get(3, 1) != MERGES or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or norm.get(2) or not norm.get(5, 1) or trainer.get(24, 0):
            raise ValueError("not a plain model of merges: unigram, user-defined or unused pieces, a character map, or blanks as suffixes")
        self.prefix, self.trim = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.bos, self.eos, self.unk = trainer.get(41, 1), trainer.get(42, 2), kinds.index(UNKNOWN)
        self.bytes = bool(trainer.get(35, 0))
        self.n = len(pieces)
        self.control = np.array(kinds) == CONTROL
        self.byte_id = np.full(256, self.unk, np.int32)
        raw = []
        for i, (p, kind) in enumerate(zip(pieces, kinds, strict=True)):
            if kind == BYTE:
                self.byte_id[int(p[3:5], 16)] = i
            surface = trainer.get(44, " ⁇ ".encode())
            raw.append(b"" if kind == CONTROL else surface if kind == UNKNOWN else bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(BLANK, " ").encode())
        self.is_byte = np.array(kinds) == BYTE
        self.lib: sentencepiece.SentencePieceProcessor | None = None  # set where words are to be checked
        self.raw, self.raw_at = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
        self._pairs(pieces, kinds, scores)
        self.fresh()

    def _pairs(self, pieces: list[str], kinds: list[int], scores: list[float]) -> None:
        """Symbols of characters, and for each pair of symbols that makes a piece its place in the order of scores."""
        known = {p: i for i, (p, kind) in enumerate(zip(pieces, kinds, strict=True)) if kind == NORMAL}
        symbols = known | {c: self.n + k for k, c in enumerate(sorted({c for p in known for c in p} - set(known)))}
        self.size = max(symbols.values(), default=0) + 1
        self.symbol = -1 - np.arange(0x110000, dtype=np.int32)  # characters of no piece stand for themselves
        for s, i in symbols.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        self.symbol[32] = self.symbol[ord(BLANK)]
        order = {x: k for k, x in enumerate(sorted({scores[i] for i in known.values()}, reverse=True))}
        found = [(symbols[p[:k]] * self.size + symbols[p[k:]], order[scores[i]], i) for p, i in known.items() for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        table = np.array(sorted(found), np.int64).reshape(-1, 3)
        self.pair_keys, self.pair_rank, self.pair_made = table[:, 0].copy(), table[:, 1].astype(np.int32), table[:, 2].astype(np.int32)
        sharing = Counter(scores[i] for i in known.values())
        self.piece_of = np.full(len(order), -1, np.int32)  # by rank; -1 where pieces share a score
        for i in known.values():
            if sharing[scores[i]] == 1:
                self.piece_of[order[scores[i]]] = i
        self.char_of = np.zeros(self.size, np.int32)  # characters that are in pieces, but none themselves
        for s, i in symbols.items():
            if i >= self.n:
                self.char_of[i] = ord(s)
        longer = set("".join(p for p in known if len(p) > 1))
        alone = "".join(chr(c) for c in range(128) if chr(c) not in longer and c != 32)
        self.anchor, alone = alone[:1] if self.prefix and not self.trim else "", re.escape(alone)
        whole = any(re.search(f"[^{BLANK}]{BLANK}", p) for p in known)
        self.words_at = re.compile(r"(?s).+" if whole else rf" +[^ {alone}]*|[^ {alone}]+|[{alone}]" if alone else r" +[^ ]*|[^ ]+")

    def place(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair of symbols stands in the table of pairs, and whether it does."""
        key = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) * self.size + b)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return at, self.pair_keys[at] == key

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the piece that each pair of symbols makes; NEVER where there is none."""
        if not len(self.pair_keys):
            return np.full(len(a), NEVER, np.int32)
        at, found = self.place(a, b)
        return np.where(found, self.pair_rank[at], NEVER)

    def agendas(self, chars: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The symbols that the words of at most `width` characters end as, in a row, and how many each has."""
        n, step = len(sizes), np.arange(width + 1)
        filled = step < sizes[:, None]
        ids = np.full((n, width + 1), -1, np.int32)
        ids[filled] = chars
        rank = np.full((n, width + 1), NEVER, np.int32)
        inner = filled[:, 1:]
        rank[:, :-1][inner] = self.ranks(ids[:, :-1][inner], ids[:, 1:][inner])
        left = sizes.copy()
        live = np.arange(n)
        x, r = ids, rank
        while True:
            at = r.argmin(1)  # the first of the agenda: the best score, of those the leftmost
            low = r[np.arange(len(live)), at]
            go = np.flatnonzero(low < NEVER)
            if len(go) < len(live):
                done = np.setdiff1d(np.arange(len(live)), go, assume_unique=True)
                ids[live[done]] = x[done]
                live, at, low, x, r = live[go], at[go], low[go], x[go], r[go]
            if not len(live):
                break
            row = np.arange(len(live))
            piece = self.piece_of[low]
            if (tied := np.flatnonzero(piece < 0)).size:
                piece[tied] = self.pair_made[self.place(x[tied, at[tied]], x[tied, at[tied] + 1])[0]]
            take = np.minimum(step + (step > at[:, None]), width)
            x, r = np.take_along_axis(x, take, 1), np.take_along_axis(r, take, 1)
            x[row, at] = piece
            left[live] -= 1
            r[:, -1] = NEVER
            size = left[live]
            for k in (at - 1, at):
                ok = (k >= 0) & (k + 1 < size)
                i, j = row[ok], k[ok]
                r[i, j] = self.ranks(x[i, j], x[i, j + 1])
                off = (k >= 0) & ~ok
                r[row[off], k[off]] = NEVER
        return ids[step < left[:, None]], left

    def agenda(self, chars: np.ndarray) -> np.ndarray:
        """The same for one long word, by a heap over a linked list."""
        keys, ranks, made, size = memoryview(self.pair_keys), memoryview(self.pair_rank), memoryview(self.pair_made), self.size
        ids = chars.tolist()
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def enter(i: int, j: int) -> None:
            if ids[i] >= 0 and ids[j] >= 0:
                key = ids[i] * size + ids[j]
                k = bisect_left(keys, key)
                if k < len(keys) and keys[k] == key:
                    heapq.heappush(heap, (ranks[k], i, ids[i], ids[j], made[k]))

        for i in range(n - 1):
            enter(i, i + 1)
        gone = bytearray(n)
        while heap:
            _, i, a, b, piece = heapq.heappop(heap)
            j = nxt[i]
            if gone[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], gone[j], nxt[i] = piece, 1, nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
                enter(i, nxt[i])
            if prev[i] >= 0:
                enter(prev[i], i)
        return np.array([x for x, dead in zip(ids, gone, strict=True) if not dead], np.int32)

    def spelled(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of symbols: characters without a piece become bytes or unknown."""
        bare = (symbols < 0) | (symbols >= self.n)
        if not bare.any():
            return symbols, counts
        word = np.repeat(np.arange(len(counts)), counts)
        if not self.bytes:
            return np.where(bare, self.unk, symbols).astype(np.int32), counts
        code = np.where(symbols < 0, -1 - symbols, self.char_of[np.clip(symbols, 0, self.size - 1)])[bare]
        times = np.ones(len(symbols), np.int64)
        times[bare] = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        out = np.repeat(symbols, times)
        data = np.frombuffer("".join(map(chr, code.tolist())).encode("utf-8", "surrogatepass"), np.uint8)
        out[np.repeat(bare, times)] = self.byte_id[data]
        return out, np.bincount(word, times, minlength=len(counts)).astype(np.int64)

    def learn(self, words: list[str]) -> None:
        """Puts the ids of new words in the cache."""
        words = sorted(words, key=len)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = self.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        flats, counts, i = [], [], 0
        for width in WIDTHS:
            end = int(np.searchsorted(sizes, width, side="right"))
            while i < end:
                j = min(i + MATRIX_ROWS, end)
                flat, count = self.agendas(chars[starts[i] : starts[j]], sizes[i:j], width)
                flats.append(flat)
                counts.append(count)
                i = j
        for k in range(i, len(words)):
            flats.append(self.agenda(chars[starts[k] : starts[k + 1]]))
            counts.append(np.array([len(flats[-1])]))
        flat, count = self.spelled(np.concatenate(flats), np.concatenate(counts))
        if self.lib:
            self.check(words, count, flat)
        self.keep(words, count, flat)

    def check(self, words: list[str], counts: np.ndarray, flat: np.ndarray) -> None:
        """Holds the ids of words against the library's. A word with a blank before it is a text of its own; any other one is put behind a character that stands alone."""
        before = self.lib.encode(self.anchor)
        ends, ids = np.cumsum(counts).tolist(), flat.tolist()
        first = [w[0] == " " and len(w) > 1 for w in words]
        texts = [w[1:] if own else self.anchor + w for w, own in zip(words, first, strict=True)]
        for w, own, start, end, theirs in zip(words, first, [0, *ends[:-1]], ends, self.lib.encode(texts, num_threads=1), strict=True):
            if theirs != (ids[start:end] if own else before + ids[start:end]):
                raise ValueError(f"the library has other ids for {w!r}")

    def normal(self, text: str) -> str:
        """The text with blanks for their symbol, as the model wants it to begin and be spaced."""
        if self.trim:  # blanks alone are squeezed, but at the end their symbols go as well
            text = re.sub(" +", " ", text.lstrip(" "))
        if text and self.prefix:
            text = f" {text}"
        if BLANK in text:
            text = text.replace(BLANK, " ")
        return text.rstrip(" ") if self.trim else text

    def encode(self, texts: list[str], bos: bool = True, eos: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end."""
        cut = [self.words_at.findall(self.normal(t)) for t in texts]
        places = self.places(cut)
        out, ends, n, at = [], [], 0, 0
        begin, end = (np.array([i][: int(on)], np.int32) for i, on in ((self.bos, bos), (self.eos, eos)))
        for words in cut:
            ids = self.ids_at(places[at : at + len(words)])
            at += len(words)
            if not self.bytes and len(ids):  # a run of unknown characters is one
                ids = ids[~((ids == self.unk) & (np.concatenate([[-1], ids[:-1]]) == self.unk))]
            out += [begin, ids, end]
            n += len(begin) + len(ids) + len(end)
            ends.append(n)
        return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(ends, np.int64)

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """The texts of ids, each text's up to its end."""
        sizes = self.raw_at[1:] - self.raw_at[:-1]
        sizes, from_ = sizes[ids], self.raw_at[ids]
        control = self.control[ids]
        first = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        inner = np.zeros(len(ends), bool)  # control ids between others part the bytes around them
        seen = np.flatnonzero(~control)
        begin = np.searchsorted(seen, first)
        close = np.searchsorted(seen, ends)
        for k in np.flatnonzero(close > begin).tolist():
            a, b = seen[begin[k]], seen[close[k] - 1]
            inner[k] = control[a : b + 1].any()
            while self.prefix or self.trim:
                if not sizes[a] or self.is_byte[ids[a]] or ids[a] == self.unk or self.raw[from_[a]] != 32:
                    break
                sizes[a], from_[a] = sizes[a] - 1, from_[a] + 1
                if not self.trim or sizes[a] or a == b:
                    break
                a += 1
        until = np.cumsum(sizes)
        text = self.raw[np.repeat(from_ - (until - sizes), sizes) + np.arange(until[-1] if len(until) else 0)].tobytes()
        stops = np.concatenate([[0], until])
        out = []
        for k, (i, j) in enumerate(zip(first.tolist(), np.asarray(ends).tolist(), strict=True)):
            cuts = [i, *(np.flatnonzero(control[i:j]) + i).tolist(), j] if inner[k] else [i, j]
            out.append("".join(text[stops[a] : stops[b]].decode("utf-8", "each-byte") for a, b in zip(cuts, cuts[1:], strict=False)))
        return out


@lru_cache(1)
def model(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(1)
def library(proto: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=proto)


def _column(name: str, values: list[str] | tuple[np.ndarray, np.ndarray], kind: str) -> pa.Array:
    if kind == "text":
        return pa.array(values, pa.string())
    ids, ends = values
    offsets = np.concatenate([[0], ends])
    if kind == "ids":
        return pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(ids, pa.int32()))
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((offsets * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])


def encode(df: DataFrame, path: str, text: str = "text", out: str | None = "token_ids", packed: str | None = None, back: str | None = None, agrees: str | None = None, checked: bool = False, bos: bool = True, eos: bool = True) -> DataFrame:
    """df with columns of each whole text's ids, under the names that are given: `out`, array<int>; `packed`, the ids as
    little-endian unsigned 32-bit integers; `back`, what they decode to; `agrees`, whether the sentencepiece library gives
    the same ids and the same text back. checked: every new word's ids are held against the library's, where the model's
    settings let words be encoded by themselves (a dummy prefix, no trimming, a character that stands alone)."""
    sent = df.sparkSession.sparkContext.broadcast((model(path), open(path, "rb").read()))  # a few MB, of the tokenizer file
    new = [(n, k) for n, k in ((out, "ids"), (packed, "packed"), (back, "text"), (agrees, "agrees")) if n]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, proto = sent.value
        own.lib = library(proto) if checked and own.anchor else None
        for batch in tidied(batches, own.fresh):
            texts = batch.column(batch.num_columns - 1)
            rest = batch.select(range(batch.num_columns - 1))
            for i, j in slabs(pc.fill_null(pc.utf8_length(texts), 0).to_pylist(), SLAB_CHARS // 2):
                whole = [t or "" for t in texts[i:j].to_pylist()]
                ids, ends = own.encode(whole, bos, eos)
                decoded = own.decode(ids, ends) if back or agrees else []
                made = {"ids": (ids, ends), "packed": (ids, ends), "text": decoded}
                columns = [pa.array(same(library(proto), whole, ids, ends, decoded, bos, eos)) if k == "agrees" else _column(n, made[k], k) for n, k in new]
                part = rest.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *(n for n, _ in new)])

    kinds = {"ids": T.ArrayType(T.IntegerType()), "packed": T.BinaryType(), "text": T.StringType(), "agrees": T.BooleanType()}
    kept, old = others(df, *(n for n, _ in new))
    schema = T.StructType([*old, *(T.StructField(n, kinds[k]) for n, k in new)])
    return modest(df.select(*kept, F.col(f"`{text}`").alias(unused(df, "text__")))).mapInArrow(task, schema)


def same(lib: sentencepiece.SentencePieceProcessor, texts: list[str], ids: np.ndarray, ends: np.ndarray, decoded: list[str], bos: bool = True, eos: bool = True) -> list[bool]:
    """Whether the library's ids of each text are these, and its decoding of them."""
    starts = [0, *ends[:-1].tolist()]
    theirs = [lib.encode(t, add_bos=bos, add_eos=eos) for t in texts]
    return [x == ids[a:b].tolist() and lib.decode(x) == d for x, a, b, d in zip(theirs, starts, ends.tolist(), decoded, strict=True)]


def agreement(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """How many of df's rows agree with the library, and how many don't: one row of `agree` and `differ`."""
    checked = encode(df.select(F.col(f"`{text}`").alias("text")), path, out=None, agrees="agrees")
    return checked.agg(F.count_if("agrees").alias("agree"), F.count_if(~F.col("agrees")).alias("differ"))


def decode(df: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the column `out`: the text of each row's ids (null: empty); bytes that aren't UTF-8 become U+FFFD one by one."""
    sent = df.sparkSession.sparkContext.broadcast(model(path))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in tidied(batches):
            lists = batch.column(batch.num_columns - 1)
            rest = batch.select(range(batch.num_columns - 1))
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            for i, j in slabs(sizes.tolist(), SLAB_CHARS // 4):
                texts = own.decode(lists[i:j].flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes[i:j]))
                part = rest.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    kept, old = others(df, out)
    schema = T.StructType([*old, T.StructField(out, T.StringType())])
    return modest(df.select(*kept, F.col(f"`{ids}`").alias(unused(df, "ids__")))).mapInArrow(task, schema)
