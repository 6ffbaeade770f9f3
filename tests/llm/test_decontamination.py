import random
import re

import numpy as np
import pytest

from scorekit.llm import decontamination as D


def words_of(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def least_edits(item, words):
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(words, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def brute(docs, items, share):
    out = {}
    for i, t in docs:
        w = words_of(t)
        for k, u in items:
            item = words_of(u)
            if item and w:
                e = least_edits(item, w)
                if e <= D.edits_allowed(len(item), share):
                    out[(i, k)] = min(e, out.get((i, k), e))
    return out


def edited(dice, words, n):
    words = list(words)
    for _ in range(n):
        kind, at = dice.randrange(3), dice.randrange(len(words))
        if kind == 0:
            words[at] = f"new{dice.randrange(10**6)}"
        elif kind == 1:
            words.insert(at, f"new{dice.randrange(10**6)}")
        elif len(words) > 1:
            del words[at]
    return words


@pytest.fixture(scope="module")
def corpus():
    """Items of 1 to 60 words and texts that hold them whole, edited up to the limit, or beyond."""
    dice = random.Random(4)
    vocabulary = [f"v{i}" for i in range(3000)]
    text = lambda n: [dice.choice(vocabulary) for _ in range(n)]
    items = [(k, text(n)) for k, n in enumerate([1, 2, 3, 4, 5, 8, 12, 14, 20, 21, 25, 31, 37, 45, 59])]
    docs = []
    for k, item in items:
        allowed = D.edits_allowed(len(item), D.MAX_SHARE)
        for n in {0, 1, allowed // 2, allowed, allowed + 3}:
            for _ in range(3):
                docs.append(text(dice.randint(0, 150)) + edited(dice, item, n) + text(dice.randint(0, 150)))
    docs += [text(200) for _ in range(20)]
    glue = lambda w: " ".join(w).upper().replace(" V1", ",\n V1")
    return ([(i, glue(d)) for i, d in enumerate(docs)], [(k, " ".join(w)) for k, w in items])


def test_finds_what_all_pairs_find(spark, corpus):
    docs, items = corpus
    want = brute(docs, items, D.MAX_SHARE)
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                         spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in got.collect()}
    assert set(found) <= set(want)  # nothing that is no match
    assert len(found) >= 0.95 * len(want)
    assert all(found[k] == want[k] for k in found)
    whole = {k for k, e in want.items() if e == 0}
    assert whole <= set(found)


def test_recall_of_one_window_at_the_greatest_distance():
    dice = random.Random(8)
    hits = tries = 0
    for n in (15, 25, 37, 59):
        size = D.window_size(n)
        walks = D.Walks(size, D.WALKS, D.TABLES, D.SAMPLED)
        for _ in range(50):
            item = [dice.getrandbits(62) for _ in range(n)]
            near = [w if isinstance(w, int) else dice.getrandbits(62) for w in edited(dice, item, n // 5)]
            near += [dice.getrandbits(62) for _ in range(size)]
            start = np.zeros(1, np.int64)
            a, b = (walks.signatures(np.array(w, np.uint64), start)[0] for w in (item, near))
            hits += bool(set(a.tolist()) & set(b.tolist()))
            tries += 1
    assert hits / tries >= 0.9


def test_recall_of_long_items_at_the_greatest_distance(spark):
    dice = random.Random(6)
    text = lambda k: [f"v{dice.randrange(10**6)}" for _ in range(k)]
    items = [(k, text((66, 100, 200, 400, 1000)[k % 5])) for k in range(60)]
    docs = [(k, text(dice.randrange(300)) + edited(dice, w, D.edits_allowed(len(w), D.MAX_SHARE)) + text(dice.randrange(300)))
            for k, w in items]
    glue = lambda rows: [(k, " ".join(w)) for k, w in rows]
    found = D.contaminated(spark.createDataFrame(glue(docs), "doc_id long, text string"),
                           spark.createDataFrame(glue(items), "item_id long, text string")).collect()
    assert all(r["doc_id"] == r["item_id"] and r["edits"] <= 0.2 * r["item_words"] for r in found)
    for n in (66, 100, 200, 400, 1000):
        assert sum(r["item_words"] == n for r in found) >= 11


def test_real_benchmark_against_all_pairs(spark, real_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = sorted(((r["doc_id"], r["text"]) for r in real_docs.collect()), key=lambda r: (len(r[1]), r[0]))
    docs = [*texts[::3], *texts[-4:-1]]  # whole texts, the longest ones too
    docs = list(dict(docs).items())
    want = brute(docs, [tuple(r) for r in items.collect()], D.MAX_SHARE)
    got = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == set(want)


def test_edge_rows(spark, edge_docs, no_docs):
    items = spark.createDataFrame([(1, "same text stands here"), (2, None), (3, ""), (4, "lorem"), (4, "lorem"),
                                   (None, "café ÑANDÚ")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.contaminated(edge_docs, items).collect()}
    assert got == {(9, 1), (10, 1), (16, 4), (11, None)}
    kept = D.drop_contaminated(edge_docs, items)
    assert kept.columns == edge_docs.columns
    assert kept.count() == edge_docs.where("doc_id is null or doc_id not in (9, 10, 11, 16)").count()
    assert D.contaminated(no_docs, items).count() == 0 == D.drop_contaminated(no_docs, items).count()
    none = items.where("false")
    assert D.contaminated(edge_docs, none).count() == 0
    assert D.drop_contaminated(edge_docs, none).count() == edge_docs.count()


def test_window_sizes_are_few_and_never_longer_than_the_item():
    sizes = {D.window_size(n) for n in range(1, 5000)}
    assert len(sizes) < 90
    assert all(n / 1.2 < D.window_size(n) <= n for n in range(1, 5000))


@pytest.mark.parametrize("times", [1, 2, 3])
def test_held_pairs_are_counted_window_by_window(times):
    dice = np.random.default_rng(times)
    words = dice.integers(1, 7, 160).astype(np.uint64)
    origins = np.array([0, 70, 70, 71, 100])  # five texts, one empty and one of a single word
    own = D._pairs(words)
    marked = np.isin(own, np.unique(own)[::2])
    marked[origins[1:] - 1] = False
    at = np.flatnonzero(marked)
    earlier = D._earlier(own, at, times)
    begins = origins[np.searchsorted(origins, at, side="right") - 1]
    for size in (2, 5, 17, 60):
        held = []
        for start in range(len(words)):
            end = min([o for o in origins if o > start] + [len(words)])
            place = np.arange(start, min(start + size, end) - 1)
            inside = own[place][marked[place]]
            held.append(np.minimum(np.unique(inside, return_counts=True)[1], times).sum())
        for least in (1, 2, 3, 8, 15):
            got = D._passing(at, earlier, begins, size, least)
            assert got.tolist() == [start for start, n in enumerate(held) if n >= least]


def test_runs_of_one_word_do_not_pass(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(12)) + " la la")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "la " * 4000), (2, "x " * 9 + " ".join(f"w{i}" for i in range(12)) + " la la la la")],
                                 "doc_id long, text string")
    assert [(r["doc_id"], r["edits"]) for r in D.contaminated(docs, items).collect()] == [(2, 0)]


@pytest.mark.parametrize("bits", [(15, 15), (17, 20), (22, 26)])
def test_bit_table_holds_its_rows_at_every_size(spark, monkeypatch, bits):
    monkeypatch.setattr(D, "LEAST_BITS", bits[0])
    monkeypatch.setattr(D, "MOST_BITS", bits[1])
    dice = np.random.default_rng(bits[0])
    own, others = (dice.integers(0, 1 << 64, 3000, dtype=np.uint64) for _ in range(2))
    rows = spark.createDataFrame([(int(h),) for h in own.view(np.int64)], "hash long")
    table = D.BitTable(D._bit_table(rows, len(own)))
    assert len(table.bits) == 1 << D.table_bits(3000) and table.holds(own).all()
    assert table.bits.sum() == len(np.unique(own >> table.unused))
    assert table.holds(others).mean() < 0.12


def test_bit_tables_grow_with_the_benchmark():
    assert [D.table_bits(n) for n in (0, 10**4, 2**18, 2**18 + 1, 2**22, 10**9)] == [22, 22, 22, 23, 26, 26]


def test_crowded_bit_tables_lose_nothing(spark, corpus, monkeypatch):
    docs, items = (spark.createDataFrame(rows, f"{name} long, text string") for rows, name in zip(corpus, ("doc_id", "item_id")))
    want = sorted(D.contaminated(docs, items).collect())
    monkeypatch.setattr(D, "_bit_table", lambda hashes, numbers: b"\xff" * 4096)  # everything passes
    assert sorted(D.contaminated(docs, items).collect()) == want
