import random
import zlib
from collections import Counter, defaultdict

import pytest
from llm.conftest import texts_of

from scorekit.llm import sharding as S


def naive(sizes, capacity):
    bins, out = [], []
    for s in sizes:
        fits = [(r, k) for k, r in enumerate(bins) if r >= s]
        if fits:
            _, k = min(fits)
        else:
            bins.append(capacity)
            k = len(bins) - 1
        bins[k] -= s if bins[k] >= s else bins[k]
        out.append(k)
    return out, len(bins)


@pytest.mark.parametrize("seed", range(4))
def test_best_fit_decreasing_is_the_plain_rule(seed):
    dice = random.Random(seed)
    sizes = sorted((dice.randint(1, 120) for _ in range(300)), reverse=True)
    assert S.best_fit_decreasing(sizes, 100) == naive(sizes, 100)


def check(docs, result, n_shards):
    pairs = texts_of(docs)
    rows = result.collect()
    assert len(rows) == len(pairs)
    raw = {i: t for i, t in [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]}
    for r in rows:
        t = raw[r["doc_id"]]
        assert r["size"] == len((t or "").encode()) + 8 and r["text_crc32"] == zlib.crc32((t or "").encode())
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < n_shards
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shard_of = defaultdict(set)
    for r in rows:
        shard_of[raw[r["doc_id"]] or ""].add(r["shard"])
    assert all(len(s) == 1 for s in shard_of.values())
    load = Counter()
    for r in rows:
        load[r["shard"]] += r["size"]
    return load


def test_laws_on_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    load = check(docs, S.shard_equally(docs, 24), 24)
    mean = sum(load.values()) / 24
    assert len(load) == 24 and max(load.values()) < 1.02 * mean and min(load.values()) > 0.9 * mean


def test_edge_rows_and_empty_table(edge_docs, no_docs):
    check(edge_docs, S.shard_equally(edge_docs, 3), 3)
    assert S.shard_equally(no_docs, 3).count() == 0
    assert S.pack_shards(no_docs, 1000).count() == 0


def test_a_giant_group_does_not_empty_the_other_shards(spark):
    docs = spark.createDataFrame([(i, "same text " * 20 if i < 300 else f"text {i} " + "x" * (i % 50))
                                  for i in range(900)], "doc_id long, text string")
    load = check(docs, S.shard_equally(docs, 8), 8)
    others = sorted(load.values())[:-1]
    assert len(load) == 8 and others[-1] < 1.05 * sum(others) / 7


def test_fixed_capacity_holds_and_bins_are_few(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARDS_PER_CELL", 8)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    result = S.pack_shards(docs, 100_000)
    load = check(docs, result, 10_000)
    assert sorted(load) == list(range(len(load)))
    assert max(load.values()) <= 100_000
    assert len(load) <= 1.3 * sum(load.values()) / 100_000 + 1


def test_slots_over_many_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "SLOT_ROWS", 40)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(docs, S.shard_equally(docs, 4), 4)
