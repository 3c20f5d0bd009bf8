"""Resampling, pieces and spelling variants against brute force and the sentencepiece library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from factloom.llm import pieces, queries, resample, variants

PATH = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "doc_id long, text string, score double, rank string, row int, word string, n int, token_ids string, text__ int"
ODD = [
    "", " ", "  a  b ", "▁a▁▁b", "ａ\xa0b　c\x00d", "\n\n a\n", "ﬁ", "<s> </s> <unk> <0x0A>", " " * 100, "a" * 500, "ab" * 300 + " " * 40 + "x", "日本語🤖👨‍👩‍👧", "don't \t stop\r\n", "\U0010ffff", "é" * 33, "-" * 64,
]


def table(spark, pairs):
    return spark.createDataFrame([(i, t, 0.5, "r", 1, "w", 2, "x", 3) for i, t in pairs], COLUMNS).repartition(3)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_pieces_agree_with_the_library(spark, sf, library):
    rng = random.Random(3)
    made = ["".join(rng.choice(" ▁abcdeéñ日\n\t1ß.,'\"<>0x​🤖") for _ in range(rng.randrange(1, 80))) for _ in range(1000)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    got = pieces.agreement(docs.unionByName(spark.createDataFrame([(t,) for t in ODD + made], "text string")), PATH).first()
    assert got["differ"] == 0 and got["agree"] == docs.count() + len(ODD) + len(made)


def test_pieces_of_odd_rows(spark, library):
    texts = [(1, None), (1, None), (2, ""), (None, "no id"), *((10 + k, t) for k, t in enumerate(ODD)), (99, " ".join(f"word{i % 977}" for i in range(200_000)))]
    df = table(spark, texts)
    got = pieces.encode(df, PATH, back="decoded", packed="packed", agrees="agrees")
    assert [f.name for f in got.schema.fields if f.name not in df.columns] == ["packed", "decoded", "agrees"]
    assert got.columns.count("token_ids") == 1
    for r in got.collect():
        want = library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["token_ids"] == want and bytes(r["packed"]) == np.array(want, "<u4").tobytes() and r["decoded"] == library.decode(want) and r["agrees"]
    assert got.count() == len(texts)
    assert pieces.encode(df.where("false"), PATH).count() == 0
    assert {(r["doc_id"], r["decoded"]) for r in pieces.decode(got.drop("decoded"), PATH).collect()} == {(r["doc_id"], r["decoded"]) for r in got.collect()}


def test_decoding_of_any_ids(library):
    rng = random.Random(4)
    own = pieces.Pieces(PATH)
    lists = [[rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(32000), 28705, 259]) for _ in range(rng.randrange(12))] for _ in range(5000)]
    got = own.decode(np.array([i for x in lists for i in x], np.int32), np.cumsum([len(x) for x in lists]))
    assert got == [library.decode(x) for x in lists]


def test_words_are_checked(library):
    own = pieces.Pieces(PATH)
    own.lib = library
    ids, ends = own.encode([*ODD, "word\nword 12word  word"])
    assert all(pieces.same(library, [*ODD, "word\nword 12word  word"], ids, ends, own.decode(ids, ends)))
    own.fresh()
    own.pair_rank[:] = own.pair_rank[::-1].copy()  # a wrong order of merges
    with pytest.raises(ValueError, match="other ids"):
        own.encode(["several words of ordinary text"])


def test_a_full_cache_begins_anew(library, monkeypatch):
    monkeypatch.setattr(pieces.Pieces, "most", 20)
    own = pieces.Pieces(PATH)
    for k in range(5):
        texts = [f"some words of text {k} {i} and {i % 3}" for i in range(30)]
        ids, ends = own.encode(texts)
        assert all(pieces.same(library, texts, ids, ends, own.decode(ids, ends)))


@pytest.mark.parametrize(("prefix", "trim", "fallback"), [(True, True, True), (False, False, True), (False, True, False), (True, False, False)])
def test_other_settings(tmp_path, prefix, trim, fallback):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.trainer_spec.byte_fallback = prefix, trim, fallback
    if not fallback:
        for p in m.pieces:
            p.type = 1 if p.type == 6 else p.type
    for p in m.pieces[300:400]:
        p.score = -50.0  # ties
    (tmp_path / "m").write_bytes(m.SerializeToString())
    own, lib = pieces.Pieces(str(tmp_path / "m")), sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m"))
    texts = [*ODD, "the theatre of the other weather", "🤖🤖 x 🤖"]
    ids, ends = own.encode(texts)
    assert all(pieces.same(lib, texts, ids, ends, own.decode(ids, ends)))


def test_other_kinds_are_refused(tmp_path):
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.pieces[500].type = 4
    (tmp_path / "m").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError, match="plain model of merges"):
        pieces.Pieces(str(tmp_path / "m"))


def test_op12(spark, sf, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op12_sentencepiece"](spark, sf).collect():
        want = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(want).encode()).hexdigest()


# resampling


def brute_features(text, buckets):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def brute_resample(docs, target, percent=5, min_words=20, buckets=10_000):
    found = [(i, *brute_features(t, buckets)) for i, t in docs]
    s, t = Counter(b for _, _, bs in found for b in bs), Counter(b for x in target for b in brute_features(x, buckets)[1])
    a, b = float(sum(s.values())), float(sum(t.values()))
    gain = {k: math.floor(1000 * math.log((t[k] + 1.0) * (a + buckets) / ((s[k] + 1.0) * (b + buckets)))) for k in s}
    out = []
    for i, n, bs in found:
        weight = sum(gain[k] for k in bs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


def sample_texts():
    rng = random.Random(11)
    vocabulary = ["the", "Of", "and", "ÜBER", "日本", "x" * 80, "b7", "é" * 40, *(f"w{i}" for i in range(40))]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(60)))) for i in range(400)]
    docs += [(7, docs[7][1])] * 3 + [(None, docs[3][1]), (None, docs[8][1]), (500, None), (501, ""), (502, "  ., "), (503, "of the and " * 5000)] + [(600, "same words " * 15)] * 40
    return docs, [" ".join(rng.choices(vocabulary[:12], k=30)) for _ in range(30)]


@pytest.mark.parametrize(("percent", "few"), [(5, 1), (33, 7), (100, 1000), (0, 10)])
def test_resampling(spark, percent, few):
    docs, target = sample_texts()
    got = resample.resample(table(spark, docs), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, few=few)
    assert rows(got.drop("row")) == brute_resample(docs, target, percent)
    out = resample.drawn(table(spark, docs), got)
    ranks = Counter(r[0] for r in brute_resample(docs, target, percent) if r[5])
    assert Counter(r["doc_id"] for r in out.collect()) == ranks and out.columns == table(spark, docs).columns


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resample(table(spark, [(1, "a")]).where("false"), none).count() == 0
    docs, _ = sample_texts()
    assert rows(resample.resample(table(spark, docs), none).drop("row")) == brute_resample(docs, [])


def test_cutoff_is_the_sorted_one(spark):
    rng = random.Random(5)
    keys = [(rng.randrange(40), rng.choice([None, *range(5)]), 1, i) for i in range(3000)]
    df = spark.createDataFrame(keys, "score long, id long, n_features long, number long").repartition(7).cache()
    order = sorted((dict(zip(("score", "id", "n_features", "number"), k, strict=True)) for k in keys), key=resample.place)
    for k in (1, 2, 750, 1499, 3000):
        assert resample.cutoff(df, k, few=3) == order[k - 1]
    assert resample.cutoff(df, 0) is None


def test_op11(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = [(r[0], *r[2:]) for r in brute_resample(docs, target)]
    assert rows(queries.QUERIES["op11_resampling"](spark, sf)) == sorted(want, key=repr)


# spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    times = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            times[w] += 1
    words = {w: n for w, n in times.items() if len(w) >= 5 and n >= 3}
    near = {w: [] for w in words}
    by_cut = {}
    for w in words:  # words one edit apart share a deletion, or one is a deletion of the other
        for c in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_cut.setdefault(c, []).append(w)
    for ws in by_cut.values():
        for a in ws:
            near[a] += [b for b in ws if b not in near[a] and one_edit(a, b)]
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def spelled_texts():
    rng = random.Random(9)
    base = ["recieve", "receive", "colour", "color", "Straße", "strasse", "aaaaa", "baaaa", "naïve", "naive", "×÷×÷×", "x" * 40, "x" * 41, "y" + "x" * 39]
    base += ["".join(rng.choices("abcdeé", k=rng.randrange(4, 8))) for _ in range(60)]
    docs = [(i, " ".join(w[:k] + w[k + 1 :] if rng.random() < 0.2 else w for w, k in ((rng.choice(base), rng.randrange(5)) for _ in range(60)))) for i in range(150)]
    chain = " ".join(["abcdefgh"] * 40 + ["abcdefgi"] * 18 + ["abcdefji"] * 8 + ["abcdekji"] * 3)
    return [*docs, (None, chain), (1, docs[1][1]), (1, docs[1][1]), (7, None), (8, ""), (9, "12 ??"), (10, "z" * 30_000), (10, "z" * 30_000), (11, "z" * 30_000), (12, "z" * 29_999 + " " + "z" * 29_999), (13, "z" * 29_999)]


@pytest.mark.parametrize("most", [50_000, 40, 1])
def test_spelling_variants(spark, most):
    docs = spelled_texts()
    got = variants.spelling_variants(table(spark, docs), most=most)
    want = brute_variants(docs)
    assert rows(got) == want and any(r[1] and r[2] != r[1] for r in want)


def test_spelling_of_nothing(spark):
    assert variants.spelling_variants(table(spark, [(1, "a")]).where("false")).count() == 0
    assert variants.spelling_variants(table(spark, [(1, "word of a few letters")])).count() == 0


def test_narrow_fronts_and_blocks(monkeypatch):
    words = sorted({"".join(random.Random(k).choices("abcd", k=6)) for k in range(400)})
    data = [w.encode() for w in words]
    level = np.arange(256) % 16
    codes = variants.vectors(data, level)
    want = {frozenset((a, b)) for i, a in enumerate(data) for b in data[:i] if one_edit(a, b)}
    for together, front in ((20_000, 1_000_000), (7, 11)):
        monkeypatch.setattr(variants, "TOGETHER", together)
        monkeypatch.setattr(variants, "FRONT", front)
        trie = variants.Trie(data, codes)
        got = [frozenset((trie.data[x], trie.data[y])) for a, b in trie.near(trie.letters, codes[trie.order], True) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_op13(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op13_spelling"](spark, sf)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(got) == brute_variants(docs)
