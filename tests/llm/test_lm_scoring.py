import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.conftest import texts_of

from scorekit.llm import lm_scoring as M


def ppm(train, texts, order):
    """The model by its definition: a dictionary of contexts, symbol after symbol."""
    seen = defaultdict(Counter)
    for t in train:
        data = b"\xff" * order + t + b"\xff"
        for i in range(order, len(data)):
            for d in range(order + 1):
                seen[data[i - d:i]][data[i]] += 1
    scores = []
    for t in texts:
        data, total = b"\xff" * order + t + b"\xff", 0.0
        for i in range(order, len(data)):
            excluded = set()
            for d in range(order, -1, -1):
                counts = {s: c for s, c in seen.get(data[i - d:i], {}).items() if s not in excluded}
                if not counts:
                    continue
                whole = sum(counts.values()) + len(counts)
                if data[i] in counts:
                    total += math.log10(counts[data[i]] / whole)
                    break
                total += math.log10(len(counts) / whole)
                excluded |= set(counts)
            else:
                total += math.log10(1 / (256 - len(excluded)))
        scores.append(total)
    return scores


def words(text):
    return [*text.encode().lower().split(), None]


def brute(pairs, order):
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in pairs]
    train = [t for (_, t), h in zip(pairs, held) if not h]
    counts = Counter(w for t in train for w in words(t))
    n, v = sum(counts.values()), len(counts)
    scores = ppm([t.encode() for t in train], [t.encode() for _, t in pairs], order)
    return [(str(i), h, len(words(t)), sum(w in counts for w in words(t)), n,
             sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words(t)), s)
            for (i, t), h, s in zip(pairs, held, scores)]


def same(df, want):
    got = sorted((str(r[0]), *r[1:]) for r in df.collect())
    want = sorted(want)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("order, chunk, together", [(5, 40_000, 1024), (5, 40_000, 3), (5, 1 << 25, 1024)])
def test_equals_the_definition_on_whole_texts(spark, real_docs, whole_brute, order, chunk, together):
    same(M.score_documents(real_docs, order=order, chunk_bytes=chunk, together=together), whole_brute)


@pytest.fixture(scope="module")
def whole_brute(real_docs):
    return brute(texts_of(real_docs), 5)


@pytest.mark.parametrize("order, chunk, together", [(2, 4000, 2), (3, 1 << 25, 9), (7, 30_000, 2)])
def test_other_orders(spark, real_docs, order, chunk, together):
    docs = real_docs.where("doc_id between 20 and 60")
    same(M.score_documents(docs, order=order, chunk_bytes=chunk, together=together), brute(texts_of(docs), order))


def test_packed_numbers_come_back():
    dice = np.random.default_rng(0)
    for n in (0, 1, 1000):
        x = dice.integers(0, 1 << 63, n).astype(np.uint64) >> dice.integers(0, 64, n).astype(np.uint64)
        assert np.array_equal(M.unpack(M.pack(x)), x)
        assert np.array_equal(M.unpack_sorted(M.pack_sorted(np.sort(x))), np.sort(x))
        y = dice.choice([0.1, -3.5, 1e300], n)
        assert np.array_equal(M.unpack_doubles(M.pack_doubles(y)), y)
    top = np.array([0, (1 << 64) - 1], np.uint64)
    assert np.array_equal(M.unpack_sorted(M.pack_sorted(top)), top)


def test_blocks_change_nothing(spark, real_docs, monkeypatch):
    import scorekit.llm.hashing as H
    docs = real_docs.where("doc_id < 12")
    monkeypatch.setattr(M, "BLOCK", 37)
    monkeypatch.setattr(M, "SETTLE", 100)
    monkeypatch.setattr(H, "BLOCK", 50)
    same(M.score_documents(docs), brute(texts_of(docs), M.ORDER))


def test_probabilities_of_a_context_sum_to_one():
    train = [b"abracadabra", b"cadabra", b"xyz"]
    raw, starts = M._joined(train, 2)
    low = M.low_levels(*np.unique(np.concatenate([g for g, _ in M._grams(raw, starts, 2)]), return_counts=True))
    raw, starts = M._joined(train, 4)
    grams = np.concatenate([g for g, _ in M._grams(raw, starts, 4)])
    for context in (b"dabr", b"zzzz", b"\xff\xff\xff\xff", b"adab", b"zbra"):
        value = int.from_bytes(context, "big")
        asked = np.array([(value << 8) | s for s in range(256)], np.uint64)
        tail = value & 0xFFFFFF
        same_tail = grams[(grams >> np.uint64(8)) & np.uint64(0xFFFFFF) == np.uint64(tail)]
        keys, counts = np.unique(np.concatenate([asked, same_tail]), return_counts=True)
        counts = counts - np.isin(keys, asked)
        p = 10 ** M.log_probabilities(keys, counts.astype(float), low, 4)[np.isin(keys, asked)]
        assert abs(p.sum() - 1) < 1e-9


def test_edge_rows(edge_docs, no_docs):
    from pyspark.sql import functions as F
    same(M.score_documents(edge_docs, chunk_bytes=3000), brute(texts_of(edge_docs), M.ORDER))
    assert M.score_documents(no_docs).count() == 0
    untrained = edge_docs.where("doc_id = 1").withColumn("doc_id", F.lit(10))
    assert zlib.crc32(b"10") % 7 != 2 or M.score_documents(untrained).first()["train_tokens"] == 0


def test_beats_the_word_baseline_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in M.score_documents(docs).collect() if r["held_out"]]
    whole = [r for r in rows if r["n_known"] == r["n_tokens"]]
    assert len(rows) > 100 and sum(r["score"] for r in whole) > sum(r["base_score"] for r in whole)
