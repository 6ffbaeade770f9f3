import zlib

import numpy as np
from pyspark.sql import functions as F

from scorekit.llm import langid as L


def test_held_out_accuracy_and_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = L.identify_held_out(docs).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r["held_out"]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in out)
    assert right / len(out) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_held_out_text_and_labels_are_not_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = docs.withColumns({"lang": F.when(fold, "xx").otherwise(F.col("lang"))})
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(L.identify_held_out(docs)) == key(L.identify_held_out(other))


def test_vector_is_the_definition():
    p = L.Profiler(64, 3)
    text = "Ab, c"
    letters = [ord(c) for c in " ab c "]
    total = np.zeros(64)
    for i in range(len(letters) - 2):
        g = np.ones(64)
        for back, code in enumerate(reversed(letters[i:i + 3])):
            g = g * np.roll(p.letter(code), back)
        total += g
    assert np.allclose(p.vector(text), total / np.linalg.norm(total), atol=1e-5)


def test_blocks_and_memory_limits_change_nothing(monkeypatch):
    text = "the quick brown fox jumps over the lazy dog " * 50
    whole = L.Profiler().vector(text)
    monkeypatch.setattr(L, "BLOCK", 100)
    monkeypatch.setattr(L, "MEMO_GRAMS", 20)
    assert np.allclose(L.Profiler().vector(text), whole, atol=1e-4)


def test_whole_query_by_its_definition(spark):
    """Sums of the learned texts' vectors, less their mean, and the nearest by cosine."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows, p, sums = docs.collect(), L.Profiler(), {}

    def plain(text):
        letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        if not letters:
            return None
        codes, total = [ord(c) for c in f" {letters} "], np.zeros(L.DIM)
        for i in range(len(codes) - 2):
            total += np.roll(p.letter(codes[i]), 2) * np.roll(p.letter(codes[i + 1]), 1) * p.letter(codes[i + 2])
        return total / np.linalg.norm(total) if total.any() else total

    vectors = [plain(r["text"] or "") for r in rows]
    for r, v in zip(rows, vectors):
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and v is not None:
            sums[r["lang"]] = sums.get(r["lang"], 0) + v
    units = {k: v / np.linalg.norm(v) for k, v in sums.items()}
    mean = sum(units.values()) / len(units)
    units = {k: (v - mean) / np.linalg.norm(v - mean) for k, v in units.items()}
    got = {r["doc_id"]: r for r in L.identify_held_out(docs).collect()}
    for r, v in zip(rows, vectors):
        own = got[r["doc_id"]]
        if v is None:
            assert (own["lang_pred"], own["score"]) == ("und", 0.0)
            continue
        cosine = {k: float(u @ v) for k, u in units.items()}
        assert abs(own["score"] - (1 + max(cosine.values())) / 2) < 1e-4
        assert cosine[own["lang_pred"]] > max(cosine.values()) - 1e-4


def test_numbers_that_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en"), (3, "el gato y el perro", "es"), (5, "½² Ⅷ ③ 12_", None), (6, "ªº ½", None)],
                                 "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in L.identify(docs, L.learn_prototypes(docs)).collect()}
    assert got[5] == "und" and got[6] != "und" and (got[1], got[3]) == ("en", "es")


def test_edge_rows(edge_docs, no_docs):
    rows = L.identify_held_out(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    texts = {r["doc_id"]: r["text"] for r in edge_docs.collect()}
    for r in rows:
        none = not any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert (r["lang_pred"] == "und") == none and (r["score"] == 0 or not none)
    assert L.identify_held_out(no_docs).count() == 0
    unlabelled = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in L.identify_held_out(unlabelled).collect()} == {"und"}
