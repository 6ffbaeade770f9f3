"""Quality scores by positive-unlabelled learning with a non-negative risk estimate.

Learned from: trusted positives (documents labelled 1 in the learning fold) and unlabelled web
text (documents of the learning fold, whatever their label; it is not looked at). With
the class prior ``pi`` and the logistic loss ``l``, the risk of a scorer ``g`` is

    pi * E_pos[l(g)]  +  max(0, E_unl[l(-g)] - pi * E_pos[l(-g)])

The second term estimates the risk on negatives without having any. It cannot be negative in truth;
where a fit drives the estimate below zero, the step goes the other way until it is not (Kiryo and
others, 2017). ``g`` is linear in the text features below, with an L2 penalty.

The class prior is estimated from the same two sets (Garg and others, 2021): a first fit tells
positives from unlabelled text; its scores of *all* documents of the learning fold, and of the
positives that were kept out of the fit, are counted into ``BINS`` bins by one distributed pass;
above the best threshold nearly all unlabelled text is positive, so the ratio of the two shares
above it is ``pi``. The threshold minimises the ratio with its confidence margin.

Features of a text, all of the whole text: how often each triple of character classes occurs (runs
count once; letters by case, digits, white space, line ends, each ASCII symbol single or repeated),
hashed to ``TRIPLES`` columns, as roots of shares; and soft bins of shares that do not depend on
the language: capitals, symbols, digits, white space, distinct words, repeated neighbours, the most
frequent word, word length.

Fitting uses bounded samples: the ``sample`` positives and ``sample`` unlabelled documents of least
id hash (a documented parameter; all of them if there are fewer; of rows that share an id, the least
text). They reach the driver as ``WIDTH`` float32 numbers each (24 MB a sample at most). The prior's counts and the prediction read every row
and whole text; the weights have a fixed size.

Cases: a null text counts as empty and has no features, so its score is the intercept's; documents
without a label, with a null label or id are unlabelled text only; a document with several labels
counts with the least; without positives every score is 0; without a second class in sight (the
prior is 1) scores are near 1; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorekit.llm.common import held_out, id_and_text, schema_like, slices
from scorekit.llm.hashing import WordHasher, lower_ascii

TRIPLES = 512
KNOTS = np.linspace(0, 1, 11)     # of the soft bins
STATS = 8
WIDTH = TRIPLES + STATS * len(KNOTS)
SAMPLE = 10_000
PRIOR_PART = 4                    # one positive of so many is kept out of the fit, for the prior
BINS = 2000
STEPS, RATE, L2 = 600, 0.05, 1e-5
BLOCK = 1 << 20                   # bytes turned to classes at a time

SPACE_CLASS, LINE_CLASS, LOWER_CLASS, UPPER_CLASS, DIGIT_CLASS, OTHER_CLASS = 1, 2, 3, 4, 5, 6
CLASS = np.full(256, OTHER_CLASS, dtype=np.int64)
CLASS[[9, 11, 12, 13, 32]] = SPACE_CLASS
CLASS[10] = LINE_CLASS
CLASS[33:127] = np.arange(33, 127)                # ASCII symbols are classes of their own
CLASS[48:58], CLASS[65:91], CLASS[97:123] = DIGIT_CLASS, UPPER_CLASS, LOWER_CLASS
CLASS[128:] = LOWER_CLASS                         # bytes of other letters
SYMBOL_FROM = 33
REPEATED = 128                                    # added to the class of a symbol's run


class Features:
    """Feature rows of texts."""

    def __init__(self):
        self.hasher = WordHasher()

    def row(self, text: str) -> np.ndarray:
        out = np.zeros(WIDTH, dtype=np.float32)
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        if not len(raw):
            return out
        triples, classes = np.zeros(TRIPLES), np.zeros(256, dtype=np.int64)
        tail = np.zeros(0, dtype=np.int64)       # the last two runs of the block before
        for at in range(0, len(raw), BLOCK):
            own = CLASS[raw[at:at + BLOCK]]
            classes += np.bincount(own, minlength=256)
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            runs = own[starts]
            long = np.diff(np.append(starts, len(own))) > 1
            runs = np.concatenate([tail, runs + np.where(long & (runs >= SYMBOL_FROM), REPEATED, 0)])
            if len(runs) > 2:
                mixed = (runs[:-2] * 0x9E3779B1 + runs[1:-1] * 0x85EBCA77 + runs[2:] * 0xC2B2AE3D) & 0xFFFFFFFF
                triples += np.bincount((mixed ^ (mixed >> 15)) * 0x2C1B3C6D >> 12 & (TRIPLES - 1), minlength=TRIPLES)
            tail = runs[-2:]
        out[:TRIPLES] = np.sqrt(triples / max(1.0, triples.sum()))
        out[TRIPLES:] = self._stats(raw, classes).ravel()
        return out

    def _stats(self, raw: np.ndarray, classes: np.ndarray) -> np.ndarray:
        found = list(self.hasher.words(lower_ascii(raw)))
        words = np.concatenate([h for _, _, h in found]) if found else np.zeros(0, np.uint64)
        n = max(1, len(words))
        distinct, times = np.unique(words, return_counts=True)
        letters = max(1, classes[LOWER_CLASS] + classes[UPPER_CLASS])
        values = np.array([
            classes[UPPER_CLASS] / letters,
            np.sqrt(classes[SYMBOL_FROM:].sum() / len(raw)),
            np.sqrt(classes[DIGIT_CLASS] / len(raw)),
            (classes[SPACE_CLASS] + classes[LINE_CLASS]) / len(raw),
            np.log1p(len(distinct)) / np.log1p(n) if len(words) else 0.0,
            (words[1:] == words[:-1]).sum() / n,
            np.sqrt(times.max(initial=0) / n),
            min(1.0, np.log2(1 + len(raw) / n) / 8)])
        width = KNOTS[1] - KNOTS[0]
        return np.maximum(0, 1 - np.abs(values[:, None] - KNOTS[None]) / width)  # a value lies between two knots


class LinearScorer:
    def __init__(self, weights: np.ndarray, intercept: float, prior: float):
        self.weights, self.intercept, self.prior = weights, intercept, prior

    def scores(self, rows: np.ndarray) -> np.ndarray:
        if self.prior <= 0:
            return np.zeros(len(rows))
        return _sigmoid(rows @ self.weights + self.intercept)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the risk (the second before the maximum) from scores ``g``."""
    return (prior * np.logaddexp(0, -positive).mean(),
            np.logaddexp(0, unlabelled).mean() - prior * np.logaddexp(0, positive).mean())


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE,
        l2: float = L2) -> LinearScorer:
    """Minimise the non-negative risk by Adam steps over the whole sample."""
    x = np.concatenate([positive, unlabelled]).astype(np.float32)
    n_pos, n_unl = len(positive), len(unlabelled)
    w = np.zeros(x.shape[1] + 1)
    mean, square, average, kept = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w), 0
    for step in range(1, steps + 1):
        g = x @ w[:-1].astype(np.float32) + w[-1]
        p = _sigmoid(g.astype(float))
        pos, unl = p[:n_pos], p[n_pos:]
        _, negative = risk(g[:n_pos], g[n_pos:], prior)
        # Slopes by g of the second term: positives' share of it has a minus.
        of_second = np.concatenate([-prior * pos / n_pos, unl / n_unl])
        if negative >= 0:
            slope = of_second + np.concatenate([prior * (pos - 1) / n_pos, np.zeros(n_unl)])
        else:
            slope = -of_second
        grad = np.append(slope.astype(np.float32) @ x, slope.sum()) + l2 * np.append(w[:-1], 0.0)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        w = w - rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        if step > steps // 2:  # the mean of the later steps: turns at zero do not decide where it ends
            average, kept = average + w, kept + 1
    w = average / max(1, kept)
    return LinearScorer(w[:-1], float(w[-1]), prior)


def discriminate(positive: np.ndarray, unlabelled: np.ndarray, **how) -> LinearScorer:
    """Positives against unlabelled text, as if the latter were negative."""
    x = np.concatenate([positive, unlabelled]).astype(np.float32)
    y = np.concatenate([np.ones(len(positive)), np.zeros(len(unlabelled))])
    weight = np.concatenate([np.full(len(positive), 0.5 / len(positive)), np.full(len(unlabelled), 0.5 / len(unlabelled))])
    w, mean, square = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for step in range(1, STEPS // 2 + 1):
        slope = weight * (_sigmoid((x @ w[:-1].astype(np.float32) + w[-1]).astype(float)) - y)
        grad = np.append(slope.astype(np.float32) @ x, slope.sum()) + L2 * np.append(w[:-1], 0.0)
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        w = w - RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
    return LinearScorer(w[:-1], float(w[-1]), 1.0)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """The share of positives in unlabelled text, from counts of scores (bins, rising) of both."""
    n_pos, n_unl = positive.sum(), unlabelled.sum()
    if n_pos == 0:
        return 0.0
    if n_unl == 0:
        return 1.0
    above_pos, above_unl = positive[::-1].cumsum() / n_pos, unlabelled[::-1].cumsum() / n_unl
    margin = np.sqrt(np.log(4 / confidence) / 2) * (1 / np.sqrt(n_pos) + 1 / np.sqrt(n_unl))
    seen = above_pos > 0
    ratio = above_unl[seen] / above_pos[seen]
    best = int(np.argmin(ratio + 2 * margin / above_pos[seen]))
    return float(np.clip(ratio[best], 0.01, 1.0))


def _feature_rows(batches):
    features = Features()
    for part in slices(batches):
        rows = [features.row(t).tobytes() for t in part.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column("kind"), pa.array(rows, pa.binary())], names=["kind", "row"])


def _score_bins(model: LinearScorer):
    def task(batches):
        features = Features()
        for part in slices(batches):
            rows = np.array([features.row(t) for t in part.column("text").to_pylist()]).reshape(-1, WIDTH)
            place = np.minimum((model.scores(rows) * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(place, pa.int32())],
                                             names=["doc_id", "bin"])
    return task


def learn(docs: DataFrame, labels: DataFrame, quality: str = "quality", modulus: int = 3, remainder: int = 1,
          sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id") -> LinearScorer:
    """Fit on documents whose CRC-32 of the id, modulo ``modulus``, is not ``remainder``.

    ``quality`` is an SQL expression over ``labels`` whose value 1 marks a trusted positive.
    """
    texts = id_and_text(docs, id_col, text_col).where(~held_out(F.col("doc_id"), modulus, remainder))
    positives = (labels.select(F.col(label_id).alias("label_id"), F.expr(quality).cast("int").alias("quality"))
                 .where("quality is not null and label_id is not null")
                 .where(~held_out(F.col("label_id"), modulus, remainder))
                 .groupBy("label_id").agg(F.min("quality").alias("quality")).where("quality = 1")
                 .select("label_id", (F.pmod(F.xxhash64("label_id"), F.lit(PRIOR_PART)) == 0).alias("kept_out")))
    fitted = (positives.where(~F.col("kept_out")).orderBy(F.xxhash64("label_id"), "label_id").limit(sample)
              .select("label_id"))
    chosen = texts.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(sample)

    def rows_of(ids, key, kind):
        ids = ids.select(F.col(key).alias("chosen_id")).distinct()  # at most ``sample`` ids are broadcast
        found = (texts.join(F.broadcast(ids), F.col("doc_id") == F.col("chosen_id"))
                 .groupBy("doc_id").agg(F.min("text").alias("text")).select(F.lit(kind).alias("kind"), "text"))
        table = found.mapInArrow(_feature_rows, "kind int, row binary").select("row").toArrow()  # ``sample`` rows at most
        data = b"".join(table.column("row").to_pylist())
        return np.frombuffer(data, dtype=np.float32).reshape(-1, WIDTH)

    pos, unl = rows_of(fitted, "label_id", 1), rows_of(chosen, "doc_id", 0)
    if not len(pos) or not len(unl):
        return LinearScorer(np.zeros(WIDTH), 0.0, 0.0)
    first = discriminate(pos, unl)
    # Texts are scored where they are read; only ids and bins meet the labels.
    binned = texts.mapInArrow(_score_bins(first), schema_like(docs, id_col, "bin int"))
    marked = binned.join(positives.where("kept_out"), F.col("doc_id") == F.col("label_id"), "left")
    counts = np.zeros((2, BINS), dtype=np.int64)
    for r in marked.groupBy("bin").agg(F.count("*").alias("n"), F.count("label_id").alias("kept_out")).collect():
        counts[0, r["bin"]], counts[1, r["bin"]] = r["n"], r["kept_out"]  # at most BINS rows
    prior = class_prior(counts[1], counts[0])
    return fit(pos, unl, prior) if prior > 0 else LinearScorer(np.zeros(WIDTH), 0.0, 0.0)


def predict_quality(docs: DataFrame, model: LinearScorer, modulus: int = 3, remainder: int = 1,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    def task(batches):
        features = Features()
        for part in slices(batches):
            rows = np.array([features.row(t) for t in part.column("text").to_pylist()]).reshape(-1, WIDTH)
            score = model.scores(rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()),
                 pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = id_and_text(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder))
    return rows.mapInArrow(task, schema_like(docs, id_col, "held_out boolean, score double, predicted int"))
