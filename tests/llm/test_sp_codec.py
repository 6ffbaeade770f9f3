import hashlib
import random

import public_tokenizers as P
import pytest
from llm.conftest import texts_of

from scorekit.llm import sp_codec as C

MODEL = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def codec():
    return C.PrefixTableCodec(C.read_file(MODEL))


def test_random_strings_encode_and_decode_like_the_library(codec, library):
    dice = random.Random(1)
    parts = ["a", "b", "e", "t", "h", " ", "  ", "\n", "▁", "é", "ß", "中", "\x00", "\t", "😀", "the", "ing", "́",
             "1", "0", "�", "_", "-", '"', "=", "aaaa", "    ", "0000"]
    for _ in range(3000):
        text = "".join(dice.choice(parts) for _ in range(dice.randint(0, 14)))
        ids = library.encode(text)
        assert codec.encode(text) == ids, text
        assert codec.documents([text]) == [(" ".join(map(str, ids)), library.decode(ids))], text
    for _ in range(3000):
        ids = [dice.choice([dice.randint(0, 31_999), dice.randint(3, 258), dice.randint(190, 258), 29_871])
               for _ in range(dice.randint(0, 8))]
        assert codec.decode(ids) == library.decode(ids), ids


def test_small_memories_change_nothing(codec, library, real_docs, monkeypatch):
    monkeypatch.setattr(C, "MEMO_WORDS", 50)
    monkeypatch.setattr(C, "MEMO_PAIRS", 40)
    for _, text in texts_of(real_docs)[:20]:
        assert codec.encode(text) == library.encode(text)
        assert codec.documents([text])[0][0] == " ".join(map(str, library.encode(text)))


def test_table_of_whole_texts_equals_the_library(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in C.encoding_digests(docs, MODEL).collect()}
    for i, t in texts_of(docs):
        ids = library.encode(t, add_eos=True)
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                          hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_long_and_odd_words(codec, library):
    dice = random.Random(4)
    texts = ["x" * 5000, "ab" * 3000 + "中文" * 400, "a" * 64, "a" * 65, "▁" * 300, "é中\u0301" * 50, "the \x00 end", "a  b ", " lead"]
    texts += ["".join(dice.choice("abcdeéß中 ") for _ in range(dice.randint(0, 900))) for _ in range(60)]
    for text, (ids, back) in zip(texts, codec.documents(texts)):
        want = library.encode(text)
        assert ids == " ".join(map(str, want)) and back == library.decode(want)


def test_the_hash_table():
    dice = random.Random(2)
    table, plain = C.Numbers(4), {}
    for _ in range(3000):
        key, node = dice.randrange(1 << 50), dice.randrange(1 << 30)
        table.put(key, node)
        plain[key] = node
    import numpy as np
    keys = np.array([*plain, *(k + 1 for k in plain)], dtype=np.int64)
    assert table.get(keys).tolist() == [plain.get(k, -1) for k in keys.tolist()]
    assert all(table.one(k) == plain.get(k, -1) for k in keys.tolist())


def test_documents_equal_the_library(edge_docs, real_docs, no_docs, library):
    for docs in (edge_docs, real_docs):
        want = []
        for i, t in texts_of(docs):
            ids = library.encode(t, add_eos=True)
            want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256(library.decode(ids).encode()).hexdigest()))
        got = [(str(r[0]), *r[1:]) for r in C.encoding_digests(docs, MODEL).collect()]
        assert sorted(got) == sorted(want)
        encoded = C.encode_documents(docs, MODEL)
        for r in encoded.collect():
            assert r["decoded"] == library.decode(r["ids"]) and r["ids"][-1] == 2
        back = sorted((str(r[0]), r[1]) for r in C.decode_documents(encoded, MODEL).collect())
        assert back == sorted((str(r["doc_id"]), r["decoded"]) for r in encoded.collect())
    assert C.encoding_digests(no_docs, MODEL).count() == 0


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        C.PrefixTableCodec(b"")
