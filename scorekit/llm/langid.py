"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``DIM`` signs (made from its code point by a fixed seed). A
letter n-gram is the product of its letters' vectors, the vector of the letter ``k`` places
before the last rotated by ``k``; a text is the sum (bundle) of its n-grams' vectors, taken to
unit length. A language's prototype is the sum of the vectors of its training texts, less the
mean over languages of these sums' directions, which all languages share. A text's language
is the prototype with the greatest cosine.

Letters are lower-cased; runs of other characters are one separator, which is a letter of its
own here. Training reads text and language of the learning fold only; a prediction reads the
text only. The prototypes come to the driver: one vector per language, and ``MAX_LANGUAGES``
bounds their number (more raises an error).

Cases: a null text or one without a letter is ``und`` with score 0; rows without a language
are not learned from; with no training rows all is ``und``; ties go to the language that sorts
first; repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorekit.llm.common import held_out, schema_like, slices, worker_state

DIM = 512
NGRAM = 3
SEED = 20_011
MAX_LANGUAGES = 4096
UNDETERMINED = "und"
MEMO_GRAMS = 40_000  # n-gram vectors a worker keeps before it starts afresh
BLOCK = 1 << 18      # letters counted at a time: bounds memory for very long texts
NOT_LETTERS = regex.compile(r"\P{L}+")  # letters of any script; no digits, fractions or Roman numerals


class Profiler:
    """Text vectors; keeps the n-gram vectors met so far."""

    def __init__(self, dim: int = DIM, n: int = NGRAM):
        self.dim, self.n = dim, n
        self.letters: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self):
        self.known = np.zeros(0, dtype=np.int64)  # sorted keys
        self.rows = np.zeros(0, dtype=np.int64)   # their rows in vectors
        self.vectors = np.zeros((1024, self.dim), dtype=np.float32)

    def letter(self, code: int) -> np.ndarray:
        v = self.letters.get(code)
        if v is None:
            draw = np.random.Generator(np.random.PCG64([SEED, code]))
            v = self.letters[code] = (draw.integers(0, 2, self.dim) * 2 - 1).astype(np.float32)
        return v

    def gram(self, key: int) -> np.ndarray:
        out = np.ones(self.dim, dtype=np.float32)
        for k in range(self.n):
            out = out * np.roll(self.letter(key >> (21 * k) & 0x1FFFFF), k)
        return out

    def _vectors(self, keys: np.ndarray) -> np.ndarray:
        """Rows of ``vectors`` for sorted distinct ``keys``; makes those that are missing."""
        at = np.searchsorted(self.known, keys)
        here = np.minimum(at, max(len(self.known) - 1, 0))
        missing = keys[self.known[here] != keys] if len(self.known) else keys
        if len(missing):
            if len(self.known) + len(missing) > MEMO_GRAMS:
                self._clear()
                missing = keys
            n = len(self.known)
            if n + len(missing) > len(self.vectors):
                grown = np.zeros((max(2 * len(self.vectors), n + len(missing)), self.dim), dtype=np.float32)
                grown[:n] = self.vectors[:n]
                self.vectors = grown
            for i, key in enumerate(missing.tolist()):
                self.vectors[n + i] = self.gram(key)
            order = np.argsort(np.concatenate([self.known, missing]), kind="stable")
            self.rows = np.concatenate([self.rows, np.arange(n, n + len(missing))])[order]
            self.known = np.concatenate([self.known, missing])[order]
            at = np.searchsorted(self.known, keys)
        return self.rows[at]

    def vector(self, text: str) -> np.ndarray | None:
        """The unit vector of a text; None without a letter."""
        letters = NOT_LETTERS.sub(" ", text.lower()).strip()
        if not letters:
            return None
        codes = np.frombuffer(f" {letters} ".encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
        total = np.zeros(self.dim, dtype=np.float64)
        for at in range(0, max(1, len(codes) - self.n + 1), BLOCK):
            part = codes[at:at + BLOCK + self.n - 1]
            n = len(part) - self.n + 1
            grams = np.zeros(n, dtype=np.int64)
            for k in range(self.n):
                grams = (grams << 21) | part[k:k + n]
            keys, counts = np.unique(grams, return_counts=True)
            total += counts.astype(np.float32) @ self.vectors_of(keys)
        size = np.linalg.norm(total)
        return (total / size).astype(np.float32) if size > 0 else total.astype(np.float32)

    def vectors_of(self, keys: np.ndarray) -> np.ndarray:
        rows = self._vectors(keys)
        return self.vectors[rows]


def _profiler(dim: int, n: int) -> Profiler:
    state = worker_state()
    if (dim, n) != state.get("profiler_kind"):
        state["profiler"], state["profiler_kind"] = Profiler(dim, n), (dim, n)
    return state["profiler"]


def learn_prototypes(docs: DataFrame, dim: int = DIM, n: int = NGRAM, lang_col: str = "lang",
                     text_col: str = "text") -> dict[str, np.ndarray]:
    """One unit vector per language from all rows of ``docs`` that have text and language.

    Each task sums its rows' vectors per language; the sums are added on the executors.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"),
                       F.col(text_col).cast("string").alias("text")).where(
        "lang is not null and text is not null")

    def task(batches):
        profiler = _profiler(dim, n)
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches):
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                v = profiler.vector(text)
                if v is not None:
                    if lang not in sums:
                        sums[lang] = np.zeros(dim)
                    sums[lang] += v
            if len(sums) > MAX_LANGUAGES:
                raise ValueError(f"more than {MAX_LANGUAGES} languages")
        # whole numbers: the same sum in whatever order tasks are added
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()),
             pa.array([np.rint(v * (1 << 20)).astype(np.int64) for v in sums.values()], pa.list_(pa.int64()))],
            names=["lang", "v"])

    partial = rows.mapInArrow(task, "lang string, v array<bigint>")
    sums = (partial.select("lang", F.posexplode("v").alias("k", "x"))
            .groupBy("lang", "k").agg(F.sum("x").alias("x"))
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("k", "x"))).alias("v"))
            .select("lang", "v.x").orderBy("lang").limit(MAX_LANGUAGES + 1).collect())
    if len(sums) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    units = {r["lang"]: _unit(np.array(r["x"], dtype=np.float64)) for r in sums}
    if len(units) > 1:
        mean = np.mean(list(units.values()), axis=0)
        units = {lang: _unit(v - mean) for lang, v in units.items()}
    return units


def _unit(v: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(v)
    return v / size if size > 0 else v


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM, n: int = NGRAM,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; score is ``(1 + cosine) / 2`` (0 for ``und``)."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names], dtype=np.float32)
    rows = docs.select(F.col(id_col).alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def task(batches):
        profiler = _profiler(dim, n)
        for part in slices(batches):
            langs, scores = [], []
            for text in part.column(1).to_pylist():
                v = profiler.vector(text) if names else None
                if v is None:
                    langs.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                cosine = matrix @ v
                best = int(np.argmax(cosine))
                langs.append(names[best])
                scores.append(float(np.clip((1 + float(cosine[best])) / 2, 0, 1)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(task, schema_like(docs, id_col, "lang_pred string, score double"))


def identify_held_out(docs: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Learn from the documents outside the held-out fold, predict all:
    ``doc_id, held_out, lang_pred, score``."""
    fold = held_out(F.col("doc_id"), modulus, remainder)
    prototypes = learn_prototypes(docs.where(~fold))
    return identify(docs, prototypes).select("doc_id", fold.alias("held_out"), "lang_pred", "score")
