"""Language-model scores by prediction by partial matching (PPM) over bytes.

Model: a trie of byte contexts of up to ``order`` bytes with the counts of the symbols that
followed them in the training texts; each text starts after a fixed context and ends with an
end symbol. A symbol is predicted in the longest context that was seen; if that context never
had the symbol, the model escapes to the next shorter one, with probability
``q / (T + q)`` (``q`` different symbols, ``T`` symbols seen there), and the symbols of the
contexts that were escaped from are excluded from the counts of the shorter one. Below the
empty context the rest of the 256 symbols are alike. The score of a text is the sum of the
log10 probabilities of its bytes and its end.

How the trie is held: a probability depends on a *gram* only, the last ``order`` bytes and the
symbol, which is one 64-bit number. Texts are dealt by hash to chunks of about ``CHUNK_BYTES``. A
chunk states its distinct grams and words with their training counts, as one block of sorted,
packed numbers for each of ``PARTS`` parts; grams are dealt to parts by their last three context
bytes, so a part holds every context of three bytes or more that its grams can back off to. The
table of contexts of two bytes and fewer (at most 2**24 numbers, by construction) goes to every
task. A part sums its blocks, computes its grams' probabilities and answers every chunk's block in
the order asked; the answers meet the texts again in the chunk, where they are scored. So texts
are shuffled once (both uses share the exchange), blocks there and back once each, and rows are
``PARTS`` a chunk and kind, whatever the texts hold. A part's blocks of ``TOGETHER`` chunks at most are in one
task: with more chunks, each such set is summed by itself, the sums of a part meet in a second
step (one entry per distinct gram), and the sets are answered from a copy of that table each.

The word baseline of the contract (add-one unigrams) takes the same way: words are known by a
64-bit hash.

Cases: a null text counts as empty (its tokens: the end alone); repeated rows are scored
alike and learned from each; a null id is in the learning fold; without training rows every
symbol has probability 1/256; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401 - as pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorekit.llm.common import held_out, id_and_text, slices
from scorekit.llm.hashing import SPACE, WordHasher, lower_ascii, mix

ORDER = 5                 # bytes of context; a gram of order + 1 bytes must fit 64 bits
CHUNK_BYTES = 16 << 20
BLOCK = 1 << 19           # symbols turned to grams at a time
END = 0xFF                # no byte of UTF-8: ends a text, and fills the context before its start
SYMBOLS = 256
GRAM, WORD = 0, 1
PARTS = 512               # of grams, and as many of words
TOGETHER = 1024           # chunks whose blocks one task of a part holds
SETTLE = 1 << 20          # distinct keys found in slices before they are put together
LOW_CONTEXT = 2           # bytes of the longest context whose counts go to every task
LOW_BYTES, LOW_TOKENS = -1, -2  # keys of totals beside those counts
END_WORD = np.uint64(0)   # stands for the end token among word hashes


# ------------------------------------------------------------------ packed numbers
def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers: how many, the bytes each takes, and these bytes."""
    raw = np.ascontiguousarray(values, dtype=np.uint64)
    width = np.zeros(len(raw), np.uint8)
    rest = raw.copy()
    while rest.any():
        width += rest > 0
        rest >>= np.uint64(8)
    taken = np.arange(8) < width[:, None]
    return struct.pack("<I", len(raw)) + width.tobytes() + raw.view(np.uint8).reshape(-1, 8)[taken].tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, = struct.unpack_from("<I", data)
    width = np.frombuffer(data, np.uint8, n, 4)
    out = np.zeros((n, 8), np.uint8)
    out[np.arange(8) < width[:, None]] = np.frombuffer(data, np.uint8, -1, 4 + n)
    return out.reshape(-1).view(np.uint64)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def pack_doubles(values: np.ndarray) -> bytes:
    """Few different numbers, many times: the numbers and which one each is."""
    distinct, which = np.unique(values, return_inverse=True)
    return struct.pack("<I", len(distinct)) + distinct.tobytes() + pack(which)


def unpack_doubles(data: bytes) -> np.ndarray:
    n, = struct.unpack_from("<I", data)
    return np.frombuffer(data, np.float64, n, 4)[unpack(data[4 + 8 * n:]).astype(np.int64)]


# ------------------------------------------------------------------ grams of a set of texts
def _joined(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each after ``order`` fill bytes and with its end; where each starts."""
    fill = bytes([END]) * order
    raw = np.frombuffer(b"".join(fill + t + b"\xff" for t in texts), dtype=np.uint8)
    sizes = np.fromiter((order + len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    return raw, np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])


def _grams(raw: np.ndarray, starts: np.ndarray, order: int):
    """``grams, text numbers`` block by block; a gram's lowest byte is its symbol."""
    for at in range(0, len(raw), BLOCK):
        end = min(at + BLOCK, len(raw))
        lo = max(0, at - order)
        grams = np.zeros(end - at, dtype=np.uint64)
        if lo == at - order:
            for k in range(order + 1):
                grams = (grams << np.uint64(8)) | raw[lo + k:lo + k + end - at]
        else:  # the first block: fill bytes stand before it
            padded = np.concatenate([np.full(order, END, np.uint8), raw[:end]])
            for k in range(order + 1):
                grams = (grams << np.uint64(8)) | padded[k:k + end]
        place = np.arange(at, end)
        owner = np.searchsorted(starts, place, side="right") - 1
        symbol = place - starts[owner] >= order  # not the fill bytes
        yield grams[symbol], owner[symbol]


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    return distinct, np.bincount(where, weights=np.concatenate(counts), minlength=len(distinct)).astype(np.int64)


def _text_slices(batches, rows: int = 256):
    for batch in slices(batches, rows):
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield batch, texts, np.array(batch.column("held_out").to_pylist(), dtype=bool)


class _Counts:
    """Distinct keys and the sums of their counts, put together now and then so that what is held
    follows the distinct keys."""

    def __init__(self):
        self.keys, self.counts, self.loose = [], [], 0

    def add(self, keys: np.ndarray, learned: np.ndarray) -> None:
        distinct, where = np.unique(keys, return_inverse=True)
        self.keys.append(distinct)
        self.counts.append(np.bincount(where, weights=learned, minlength=len(distinct)).astype(np.int64))
        self.loose += len(distinct)
        if self.loose > SETTLE:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = _summed(self.keys, self.counts)
        self.keys, self.counts, self.loose = [keys], [counts], 0
        return keys, counts


def _spread(x: np.ndarray) -> np.ndarray:
    return mix(x) % np.uint64(PARTS)


def _word_hashes(hasher: WordHasher, raw: np.ndarray, starts: np.ndarray):
    """``hashes, text numbers`` of the words of joined texts."""
    for begin, _, hashes in hasher.words(lower_ascii(raw), SPACE):
        yield np.where(hashes == END_WORD, np.uint64(1), hashes), np.searchsorted(starts, begin, side="right") - 1


def _blocks(kind: int, keys: np.ndarray, counts: np.ndarray):
    """``kind, part, keys, counts`` of a chunk's distinct keys. Every part of words gets a block, an
    empty one too: its answer says how many different words the part has."""
    part = _spread(keys if kind == WORD else (keys >> np.uint64(8)) & np.uint64(0xFFFFFF))
    order = np.argsort(part, kind="stable")  # keys are sorted, and stay so in a part
    keys, counts = keys[order], counts[order]
    edges = np.searchsorted(part[order], np.arange(PARTS + 1, dtype=np.uint64))
    for p, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if kind == WORD or b > a:
            yield kind, p, pack_sorted(keys[a:b]), pack(counts[a:b])


BLOCKS = "chunk int, kind int, part int, keys binary, counts binary"


def _asked(order: int):
    """Blocks of a chunk's grams and words, with the counts that its training texts have."""
    def task(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, grams_of, words_of = WordHasher(), _Counts(), _Counts()
        for _, texts, out in _text_slices(batches):
            raw, starts = _joined(texts, order)
            for grams, owner in _grams(raw, starts, order):
                grams_of.add(grams, ~out[owner])
            for hashes, owner in _word_hashes(hasher, raw, starts):
                words_of.add(hashes, ~out[owner])
            words_of.add(np.full(len(out), END_WORD), ~out)
        for kind, found in ((GRAM, grams_of), (WORD, words_of)):
            rows = list(_blocks(kind, *found.settle()))
            if rows:
                kinds, parts, keys, counts = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array(kinds, pa.int32()), pa.array(parts, pa.int32()),
                     pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
                    names=["chunk", "kind", "part", "keys", "counts"])
    return task


# ------------------------------------------------------------------ probabilities of grams
def low_levels(keys: np.ndarray, counts: np.ndarray) -> dict:
    """Levels of two context bytes and fewer, from the training counts of two context bytes and
    the symbol (sorted keys): the keys of each level and their counts."""
    levels = {}
    for d in range(LOW_CONTEXT, -1, -1):
        short, where = np.unique(keys & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        levels[d] = short, np.bincount(where, weights=counts, minlength=len(short))
    return levels


def log_probabilities(grams: np.ndarray, counts: np.ndarray, low: dict, order: int) -> np.ndarray:
    """log10 probability of each gram.

    ``grams`` (sorted, distinct) hold, for each three-byte context they end on, all grams of the
    corpus with that context; ``counts`` are their training counts (0: not in training).
    ``low`` are the :func:`low_levels` of the corpus.
    """
    levels = dict(low)
    trained = grams[counts > 0]
    for d in range(order, LOW_CONTEXT, -1):
        keys, where = np.unique(trained & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
        levels[d] = keys, np.bincount(where, weights=counts[counts > 0], minlength=len(keys))

    result = np.zeros(len(grams))
    open_ = np.arange(len(grams))  # grams that no context has predicted yet
    above = None                   # contexts of the level above, and what they exclude here
    for d in range(order, -1, -1):
        keys, count = levels[d]
        contexts, where = np.unique(keys >> np.uint64(8), return_inverse=True)
        total = np.bincount(where, weights=count, minlength=len(contexts))
        kinds = np.bincount(where, minlength=len(contexts)).astype(float)
        gram = grams[open_] & np.uint64((1 << 8 * (d + 1)) - 1)
        t, q = _at(contexts, gram >> np.uint64(8), total), _at(contexts, gram >> np.uint64(8), kinds)
        if above is not None:
            longer = (grams[open_] & np.uint64((1 << 8 * (d + 2)) - 1)) >> np.uint64(8)
            t = t - _at(above[0], longer, above[1])
            q = q - _at(above[0], longer, above[2])
        seen = _at(keys, gram, count)
        hit, miss = seen > 0, (seen == 0) & (q > 0)
        result[open_[hit]] += np.log10(seen[hit] / (t[hit] + q[hit]))
        result[open_[miss]] += np.log10(q[miss] / (t[miss] + q[miss]))
        open_ = open_[~hit]
        if d:
            lower = levels[d - 1]
            lost = _at(lower[0], keys & np.uint64((1 << 8 * d) - 1), lower[1])
            above = (contexts, np.bincount(where, weights=lost, minlength=len(contexts)), kinds)
    if len(open_):
        result[open_] += math.log10(1 / (SYMBOLS - len(levels[0][0])))
    return result


def _at(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    """``values`` of the ``wanted`` keys (sorted ``keys``); 0 where there is none."""
    if len(keys) == 0:
        return np.zeros(len(wanted))
    where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[where] == wanted, values[where], 0.0)


class _Part:
    """A part's summed keys and what a chunk is told about each."""

    def __init__(self, kind: int, keys: np.ndarray, counts: np.ndarray, low: dict, order: int):
        self.kind, self.keys = kind, keys
        self.values = log_probabilities(keys, counts.astype(float), low, order) if kind == GRAM else counts
        self.distinct = int((counts > 0).sum()) if kind == WORD else 0

    def answer(self, packed_keys: bytes) -> bytes:
        own = self.values[np.searchsorted(self.keys, unpack_sorted(packed_keys))]
        return pack_doubles(own) if self.kind == GRAM else pack(own)


ANSWERS = "chunk int, kind int, keys binary, answer binary, distinct bigint"


def _answered(part: _Part, asked: pa.Table) -> pa.Table:
    keys = asked.column("keys").to_pylist()
    return pa.table({"chunk": asked.column("chunk"), "kind": asked.column("kind"), "keys": asked.column("keys"),
                     "answer": pa.array([part.answer(k) for k in keys], pa.binary()),
                     "distinct": pa.array(np.full(len(keys), part.distinct, np.int64))})


def _sums_of(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return _summed([unpack_sorted(k) for k in blocks.column("keys").to_pylist()],
                   [unpack(c).astype(np.int64) for c in blocks.column("counts").to_pylist()])


def _answer_part(low, order):
    """All blocks of a part: the answers to them."""
    def task(key, asked):
        return _answered(_Part(key[0].as_py(), *_sums_of(asked), low, order), asked)
    return task


def _sum_part(key, asked):
    """Blocks of a part put together into one."""
    keys, counts = _sums_of(asked)
    return pa.table({"kind": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()),
                     "keys": pa.array([pack_sorted(keys)], pa.binary()), "counts": pa.array([pack(counts)], pa.binary())})


def _answer_set(low, order):
    """The blocks of some chunks, and the part's summed table: the answers to them."""
    def task(key, asked, whole):
        return _answered(_Part(key[0].as_py(), *_sums_of(whole), low, order), asked)
    return task


# ------------------------------------------------------------------ scores of texts
def _scores(order: int, tokens_learned: int):
    def task(docs: pa.Table, answers: pa.Table) -> pa.Table:
        def told(kind, read):
            mine = answers.filter(pa.compute.equal(answers.column("kind"), kind))
            keys = [unpack_sorted(k) for k in mine.column("keys").to_pylist()]
            values = [read(v) for v in mine.column("answer").to_pylist()]
            keys, values = np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0), *values])
            sort = np.argsort(keys)
            return keys[sort], values[sort]

        grams, chance = told(GRAM, unpack_doubles)
        words, known = told(WORD, unpack)
        vocabulary = pa.compute.sum(answers.column("distinct")).as_py() or 0  # every part of words answers
        each = math.log10(tokens_learned + vocabulary + 1)
        hasher, result = WordHasher(), []
        for batch, texts, out in _text_slices(docs.to_batches()):
            n = len(texts)
            raw, starts = _joined(texts, order)
            score, base = np.zeros(n), np.zeros(n)
            tokens, seen = np.ones(n, np.int64), np.zeros(n, np.int64)
            for g, owner in _grams(raw, starts, order):
                distinct, where = np.unique(g, return_inverse=True)
                score += np.bincount(owner, weights=_at(grams, distinct, chance)[where], minlength=n)
            for hashes, owner in _word_hashes(hasher, raw, starts):
                c = _at(words, hashes, known)
                tokens += np.bincount(owner, minlength=n)
                seen += np.bincount(owner, weights=c > 0, minlength=n).astype(np.int64)
                base += np.bincount(owner, weights=np.log10(c + 1), minlength=n)
            c = _at(words, np.array([END_WORD]), known)[0]
            result.append(pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out), pa.array(tokens), pa.array(seen + int(c > 0)),
                 pa.array(base + math.log10(c + 1) - tokens * each), pa.array(score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
        return pa.Table.from_batches(result)
    return task


def _low_counts(batches):
    """Counts of two context bytes with their symbol in training texts, all bytes, training tokens."""
    low, size, tokens = _Counts(), 0, 0
    for _, texts, out in _text_slices(batches):
        size += sum(map(len, texts))
        learned = [t for t, held in zip(texts, out) if not held]
        raw, starts = _joined(learned, LOW_CONTEXT)
        for grams, _ in _grams(raw, starts, LOW_CONTEXT):
            low.add(grams, np.ones(len(grams)))
        inside = np.concatenate([[False], ~SPACE[raw]])
        tokens += int((inside[1:] & ~inside[:-1]).sum()) + len(learned)
    key, count = low.settle()
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate([key.view(np.int64), [LOW_BYTES, LOW_TOKENS]])),
         pa.array(np.concatenate([count, [size, tokens]]))], names=["key", "n"])


def score_documents(docs: DataFrame, modulus: int = 7, remainder: int = 2, order: int = ORDER,
                    id_col: str = "doc_id", text_col: str = "text",
                    chunk_bytes: int = CHUNK_BYTES, together: int = TOGETHER) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    The model learns from the rows whose CRC-32 of the id, modulo ``modulus``, is not
    ``remainder``.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be 2 to 7")
    id_type = docs.schema[id_col].dataType
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", "text", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    # At most 2**24 contexts and symbols, and two totals, come to the driver (sixteen bytes each).
    sums = rows.mapInArrow(_low_counts, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, count = sums.column("key").to_numpy(), sums.column("n").to_numpy()
    size, tokens = (int(count[key == k].sum()) for k in (LOW_BYTES, LOW_TOKENS))
    sort = np.argsort(key)[(key < 0).sum():]
    low = low_levels(key[sort].astype(np.uint64), count[sort].astype(float))

    chunks = max(1, math.ceil(size / chunk_bytes))
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    asked = dealt.groupBy("chunk").applyInArrow(_asked(order), BLOCKS)
    if chunks <= together:
        answers = asked.groupBy("kind", "part").applyInArrow(_answer_part(low, order), ANSWERS)
    else:
        sets = math.ceil(chunks / together)
        # Both readers of ``asked`` use all its columns, so they share one exchange.
        asked = asked.withColumn("set", F.col("chunk") % sets).repartition("kind", "part", "set")
        block = "kind int, part int, keys binary, counts binary"
        whole = (asked.groupBy("kind", "part", "set").applyInArrow(_sum_part, block)
                 .groupBy("kind", "part").applyInArrow(_sum_part, block)
                 .withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(sets - 1)))))
        answers = (asked.groupBy("kind", "part", "set").cogroup(whole.groupBy("kind", "part", "set"))
                   .applyInArrow(_answer_set(low, order), ANSWERS))

    schema = T.StructType([T.StructField("doc_id", id_type), *T._parse_datatype_string(
        "held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double").fields])
    scored = (dealt.groupBy("chunk").cogroup(answers.groupBy("chunk"))
              .applyInArrow(_scores(order, tokens), schema))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("bigint").alias("train_tokens"),
                         "base_score", "score")
