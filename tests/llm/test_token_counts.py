import random
from concurrent.futures import ThreadPoolExecutor

import public_tokenizers as P
import pytest
from llm.conftest import texts_of

from scorekit.llm import token_counts as K

FILE = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(FILE)
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def test_pieces_add_up_to_the_librarys_count(library):
    with open(FILE, "rb") as f:
        counter = K.PieceCounter(f.read())
    assert counter.by_piece
    dice = random.Random(2)
    parts = [" ", "  ", "\n", "\t", " \n ", "a", "The", "it's", "'ll", "12", "é", "中", " ", " ", "\u0085",
             "\x1c", "<|endoftext|>", "!?", "-", "😀", "​", "x" * 30, "'", "\r\n", "   "]
    texts = ["".join(dice.choice(parts) for _ in range(dice.randint(0, 12))) for _ in range(3000)]
    assert counter.counts(texts) == [library(t) for t in texts]


def test_counts_cache_and_edge_rows(spark, edge_docs, real_docs, no_docs, tmp_path, library):
    path = str(tmp_path / "cache")
    assert K.count_tokens(no_docs, FILE, path).count() == 0
    for docs in (real_docs, edge_docs):
        rows = K.count_tokens(docs, FILE, path).collect()
        want = sorted((str(i), len(t.encode()), library(t), library(t) > 512) for i, t in texts_of(docs))
        assert sorted((str(r[0]), *r[1:]) for r in rows) == want
    stored = spark.read.parquet(path)
    distinct = {t for d in (real_docs, edge_docs) for _, t in texts_of(d)}
    assert stored.count() == len(distinct) == stored.select("digest").distinct().count()


def test_stored_counts_are_used_and_only_misses_encoded(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    docs = spark.createDataFrame([(1, "one two"), (2, "three")], "doc_id long, text string")
    version = K.fill_cache(docs.where("doc_id = 1"), FILE, path)
    import hashlib
    spark.createDataFrame([(version, hashlib.sha256(b"three").hexdigest(), 77)], K.CACHE_SCHEMA).write.mode("append").parquet(path)
    monkeypatch.setattr(K, "_count_task", lambda f, v: (lambda batches: (_ for _ in batches if 1 / 0)))
    got = {r["doc_id"]: r["n_tokens"] for r in K.count_tokens(docs, FILE, path).collect()}
    assert got == {1: 2, 2: 77}


def test_other_setups_get_whole_texts():
    assert not K.splits_at_spaces({"model": {"type": "BPE"}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}})
    assert not K.splits_at_spaces({"model": {"type": "WordPiece"}, "pre_tokenizer": {"type": "ByteLevel"}})


def test_two_writers_fill_one_cache_at_once(spark, real_docs, tmp_path, library):
    path = str(tmp_path / "cache")
    halves = [real_docs.where("doc_id % 3 < 2"), real_docs.where("doc_id % 3 > 0")]
    with ThreadPoolExecutor(2) as pool:
        for version in pool.map(lambda d: K.fill_cache(d, FILE, path), halves):
            pass
    rows = K.stored_counts(real_docs, version, path).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == sorted((i, library(t)) for i, t in texts_of(real_docs))


def test_second_delivery_encodes_only_what_is_new(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "cache")
    docs = spark.createDataFrame([(i, f"text {i % 5}") for i in range(12)], "doc_id long, text string")
    K.fill_cache(docs.where("doc_id < 3"), FILE, path)
    version = K.fill_cache(docs.where("doc_id >= 3"), FILE, path)
    stored = spark.read.option("recursiveFileLookup", "true").parquet(path)
    assert stored.count() == 5 == stored.select("digest").distinct().count()
    assert K.stored_counts(docs, version, path).count() == 12
