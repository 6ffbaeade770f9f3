import hashlib
import random
from collections import defaultdict

from llm.conftest import texts_of
from pyspark.sql import functions as F

from scorekit.llm import exact_dedup as X


def brute(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[t].append(i)
    out = []
    for t, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        for n, i in enumerate(sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)):
            out.append((i, keep, len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=str)


def test_equals_brute_force(real_docs, edge_docs):
    for docs in (real_docs, edge_docs):
        assert rows(X.exact_duplicates(docs)) == brute(texts_of(docs))


def test_kept_rows_have_all_columns_and_each_text_once(edge_docs, no_docs):
    kept = X.drop_exact_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns
    got = texts_of(kept)
    assert sorted(got, key=str) == sorted({
        (max((i for i, u in texts_of(edge_docs) if u == t), key=lambda i: (i is not None, i or 0)), t)
        for _, t in texts_of(edge_docs)}, key=str)
    assert X.exact_duplicates(no_docs).count() == 0
    assert X.drop_exact_duplicates(no_docs).count() == 0


def test_chunks_cover_the_text_and_follow_the_content():
    dice = random.Random(5)
    data = bytes(dice.randrange(256) for _ in range(200_000))
    gear = X._gear()
    ends = X.cut_points(data, gear)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and max(sizes) <= X.MAX_CHUNK and min(sizes[:-1]) >= X.MIN_CHUNK
    moved = X.cut_points(b"a few bytes before" + data, gear)
    chunks = {data[a:b] for a, b in zip([0, *ends], ends)}
    again = {(b"a few bytes before" + data)[a:b] for a, b in zip([0, *moved], moved)}
    assert len(chunks & again) > 0.9 * len(chunks)


def test_cuts_do_not_depend_on_block_size(monkeypatch):
    data = bytes(random.Random(6).randrange(97, 123) for _ in range(50_000))
    whole = X.cut_points(data, X._gear())
    monkeypatch.setattr(X, "BLOCK", 1000)
    assert X.cut_points(data, X._gear()) == whole


def test_same_hash_of_different_chunks_is_told_apart(spark, monkeypatch):
    described = spark.createDataFrame(
        [(0, "x", [(1, 5, b"a")], 0), (1, "y", [(1, 5, b"b")], 1), (2, "x", [(1, 5, b"a")], 2)],
        "doc_id long, text_sha256 string, chunks array<struct<h:bigint,n_bytes:int,sha:binary>>, row long").withColumn(
        "place", F.lit(None).cast(X.PLACE))
    monkeypatch.setattr(X, "materialize", lambda df, label: described if label == "chunks" else df)
    monkeypatch.setattr(X, "_describe", lambda b: b)
    docs = spark.createDataFrame([(0, "")], "doc_id long, text string")
    r = {x["doc_id"]: x["recipe"] for x in X.chunk_recipes(docs).collect()}
    assert r[0] == r[2] != r[1]


def test_stages_keep_columns_and_move_no_text_to_drop_rows(spark, tmp_path):
    from scorekit.llm import simhash
    rows = [(i % 3, f"text number {i % 2} of some words", i, "a", "b") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place long, _x_id string, _x_sha string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    read = spark.read.parquet(str(tmp_path / "d"))
    kept = X.drop_exact_duplicates(read)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == [(2, "text number 0 of some words", 8, "a", "b"),   # the last such rows
                                                  (2, "text number 1 of some words", 11, "a", "b")]
    plan = kept._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "hashpartitioning" not in plan
    one = simhash.keep_one_of_each_group(read)
    assert sorted(r["place"] for r in one.collect()) == [0, 3] and one.columns == docs.columns  # the first ones
    assert X.drop_exact_duplicates(docs.select("doc_id", "text").unionByName(docs.select("doc_id", "text"))).count() == 2
