import random
from collections import defaultdict

import xxhash
from llm.conftest import texts_of

from scorekit.llm import simhash as S
from scorekit.llm.components import connected_components


def plain_fingerprint(text, k=3):
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs, max_bits):
    """``(id, fingerprint, least reachable id)`` by looking at all pairs."""
    fps = [(i, plain_fingerprint(t)) for i, t in pairs]
    root = {f: f for _, f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    distinct = list(root)
    for a, f in enumerate(distinct):
        for g in distinct[a + 1:]:
            if (f ^ g).bit_count() <= max_bits:
                root[find(f)] = find(g)
    ids = defaultdict(list)
    for i, f in fps:
        ids[find(f)].append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return sorted(((i, f"{f:016x}", least[find(f)]) for i, f in fps), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def test_equals_all_pairs(real_docs, edge_docs, no_docs):
    for docs in (real_docs, edge_docs):
        assert result(S.near_duplicates(docs)) == plain_components(texts_of(docs), 2)
    assert S.near_duplicates(no_docs).count() == 0
    assert S.keep_one_of_each_group(no_docs).count() == 0


def test_long_texts_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    monkeypatch.setattr(S, "SHINGLES_AT_ONCE", 7)
    assert S.fingerprint(text) == plain_fingerprint(text)


def planted(dice, groups, size, flips):
    out = set()
    for _ in range(groups):
        base = dice.getrandbits(64)
        for _ in range(size):
            f = base
            for b in dice.sample(range(64), dice.randint(0, flips)):
                f ^= 1 << b
            out.add(f)
    return sorted(out)


def components_of(links, nodes):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n
    for a, b in links:
        root[find(a)] = find(b)
    groups = defaultdict(set)
    for n in nodes:
        groups[find(n)].add(n)
    return sorted(map(sorted, groups.values()))


def test_crowded_signatures_lose_no_link(spark):
    dice = random.Random(9)
    for max_bits in (0, 1, 2, 3):
        fps = planted(dice, 6, 60, 3)
        signed = [f - (1 << 64) if f >> 63 else f for f in fps]
        want = components_of([(a, b) for i, a in enumerate(fps) for b in fps[i + 1:]
                              if (a ^ b).bit_count() <= max_bits], fps)
        df = spark.createDataFrame([(s,) for s in signed], "fp long")
        for crowded in (2, 48):
            links = [(r[0] % (1 << 64), r[1] % (1 << 64)) for r in
                     S.linked_fingerprints(df, max_bits, crowded).collect()]
            assert all((a ^ b).bit_count() <= max_bits for a, b in links)
            assert components_of(links, fps) == want, (max_bits, crowded)


def test_one_document_of_each_group_stays(spark, edge_docs):
    kept = S.keep_one_of_each_group(edge_docs)
    assert kept.columns == edge_docs.columns
    want = {str(c) for _, _, c in plain_components(texts_of(edge_docs), 2)}
    got = [str(r["doc_id"]) for r in kept.collect()]
    assert set(got) == want and len(got) == len(set(got))


def test_same_id_in_two_groups_keeps_both(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (1, "quite another text with words")],
                                 "doc_id long, text string")
    assert S.keep_one_of_each_group(docs).count() == 2


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(1000, i) for i in range(500, 560)]
    df = spark.createDataFrame(path + star + [(7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in connected_components(df).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 500 for i in range(500, 560)}, 1000: 500}
