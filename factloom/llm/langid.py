"""Language identification: multinomial naive Bayes over hashed character n-grams.

Text is lower-cased and every run of other characters than letters becomes one blank; n-grams of 1 to 3 characters
are hashed to FEATURES buckets. Counting runs on Spark (each task emits sparse sums of its languages and buckets); the
matrix of log-probabilities has FEATURES x languages numbers whatever the corpus, and is broadcast. Scoring gathers
the log-probabilities of a slab's n-grams and sums them by text, so cost is linear in the text.

Defined cases: a text that is null or has no letter gets `und` with score 0; so does every text if nothing could be
learned; ties go to the language that sorts first; texts are scored whole, those beyond PIECE characters piece by piece,
each with the first characters of the next, so that every n-gram counts once; rows pass one by one, so repeated ids and
rows don't matter; columns of df pass through `predict` but those named as its outputs, which it replaces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import modest, others, slabs, tidied, unused

FEATURES = 1 << 16
ORDERS = 3
#: Bound of the labelled sample that a model is fitted on.
TRAIN_ROWS = 20_000
PIECE = 1 << 20
UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


@dataclass
class LanguageModel:
    """langs in order; weights: (languages, FEATURES + 1) log-probabilities, the last column zero; prior: log shares."""

    langs: list[str]
    weights: np.ndarray
    prior: np.ndarray


def plain(text: str) -> str:
    """Lower case with one blank for each run of other characters than letters; a character's case doesn't depend on its neighbours."""
    return _OTHER.sub(" ", text.replace("\u03a3", "\u03c3").lower())


def pieces(text: str, size: int = 0) -> Iterator[tuple[str, int]]:
    """A text's plain form in pieces, and how many characters of each begin n-grams that count: all but the last ORDERS - 1, with which the next piece begins."""
    size = size or PIECE
    if len(text) <= size:
        yield f"{plain(text)} ", 0
        return
    rest = ""
    for at in range(0, len(text), size):
        new = plain(text[at : at + size])
        rest += new[1:] if rest.endswith(" ") and new.startswith(" ") else new
        if at + size < len(text) and len(rest) >= ORDERS:
            yield rest, ORDERS - 1
            rest = rest[1 - ORDERS :]
    yield f"{rest} ", 0


def ngrams(parts: list[tuple[str, int]]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of the n-gram that begins at each character of the pieces (FEATURES where it would leave
    its piece or counts in the next); where each piece begins."""
    sizes = np.array([len(p) for p, _ in parts], np.int64)
    ends = np.cumsum(sizes)
    c = np.frombuffer("".join(p for p, _ in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    again = np.concatenate([np.arange(e - n, e) for e, (_, n) in zip(ends, parts, strict=True)])
    out, h = [], np.zeros(len(c), np.uint32)
    for n in range(1, ORDERS + 1):
        nxt = c if n == 1 else np.concatenate([c[n - 1 :], np.zeros(n - 1, np.uint32)])[: len(c)]
        h = (h + nxt + np.uint32(n)) * np.uint32(2654435761)
        h ^= h >> np.uint32(15)
        ids = ((h * np.uint32(2246822519)) >> np.uint32(16)).astype(np.int32)
        for k in range(n - 1):
            ids[np.maximum(ends - 1 - k, 0)] = FEATURES
        ids[again] = FEATURES
        if n == 1:
            ids[c == 32] = FEATURES
        out.append(ids)
    return out, ends - sizes


def portions(texts: list[str]) -> Iterator[tuple[list[tuple[str, int]], list[int]]]:
    """Pieces of the texts to handle together, and the text of each: all short texts at once, long ones piece by piece."""
    short = [i for i, t in enumerate(texts) if len(t) <= PIECE]
    if short:
        yield [next(pieces(texts[i])) for i in short], short
    for i in sorted(set(range(len(texts))) - set(short)):
        for part in pieces(texts[i]):
            yield [part], [i]


def count_ngrams(df: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, bucket, n: how often each bucket occurs in the texts of each language."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in tidied(batches):
            texts, langs = batch.column(0), batch.column(1).to_pylist()
            for i, j in slabs(pc.utf8_length(texts).to_pylist()):
                part = texts[i:j].to_pylist()
                for name in set(langs[i:j]):
                    own = [t for t, x in zip(part, langs[i:j], strict=True) if x == name]
                    total = sums.setdefault(name, np.zeros(FEATURES + 1, np.int64))
                    for group, _ in portions(own):
                        for ids in ngrams(group)[0]:
                            total += np.bincount(ids, minlength=FEATURES + 1)
        for name, total in sums.items():
            at = np.flatnonzero(total[:FEATURES])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["lang", "bucket", "n"])

    rows = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang))
    counts = modest(rows).mapInArrow(task, "lang string, bucket int, n long")
    return counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS) -> LanguageModel:
    """A model of the labelled rows of df; of more than `rows` of them, of about that many, chosen by a hash of key."""
    labelled = df.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang, key)
    n = labelled.count()
    if n > rows:
        labelled = labelled.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 20)) < int(rows / n * (1 << 20)) + 1)
    docs = labelled.groupBy(lang).agg(F.count("*").alias("n")).collect()  # no more languages than rows of the sample
    langs = sorted(r[0] for r in docs)
    if not langs:
        return LanguageModel([], np.zeros((0, FEATURES + 1)), np.zeros(0))
    share = {r[0]: r[1] for r in docs}
    counts = np.zeros((len(langs), FEATURES))
    table = count_ngrams(labelled, text, lang).toPandas()
    counts[np.searchsorted(langs, table["lang"].to_numpy(str)), table["bucket"].to_numpy()] = table["n"].to_numpy()
    weights = np.log((counts + 1.0) / (counts.sum(1, keepdims=True) + FEATURES))
    prior = np.log(np.array([share[x] for x in langs]) / sum(share.values()))
    return LanguageModel(langs, np.hstack([weights, np.zeros((len(langs), 1))]), prior)


def score(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """For each text the place of its most likely language, and that language's posterior probability."""
    total = np.tile(model.prior, (len(texts), 1))
    for group, owner in portions(texts):
        ids, starts = ngrams(group)
        for k, w in enumerate(model.weights):
            total[owner, k] += sum(np.add.reduceat(w[x], starts) for x in ids)
    best = total.argmax(1)
    return best, 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)


def predict(df: DataFrame, model: LanguageModel, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with the predicted language of every row and its probability."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in tidied(batches):
            texts, rest = batch.column(batch.num_columns - 1), batch.select(range(batch.num_columns - 1))
            for i, j in slabs(pc.fill_null(pc.utf8_length(texts), 0).to_pylist()):
                part = [t or "" for t in texts[i:j].to_pylist()]
                worded = [bool(own.langs) and any(map(str.isalpha, t)) for t in part]
                best, sure = score(part, own) if own.langs else (np.zeros(len(part), int), np.zeros(len(part)))
                names = [own.langs[b] if p else UNKNOWN for b, p in zip(best, worded, strict=True)]
                own_rows = rest.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*own_rows.columns, pa.array(names, pa.string()), pa.array(np.where(worded, sure, 0.0))], names=[*own_rows.schema.names, lang_out, score_out])

    kept, fields = others(df, lang_out, score_out)
    rows = df.select(*kept, F.col(f"`{text}`").alias(unused(df, "text__")))
    schema = T.StructType([*fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    return modest(rows).mapInArrow(task, schema)
