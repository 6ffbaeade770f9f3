"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

Features of a text: which words it has, and which word beginnings of 4 and 5 bytes (so inflected
forms share a feature), hashed to ``2**HASH_BITS`` columns; presence, not counts, so a long text
is not judged by its length. Model: ``P(grade <= k) = sigmoid(threshold_k - w.x)``, with one
weight vector for all ordered thresholds; fitted by accelerated proximal gradient steps with
an L1 penalty, which leaves weight on few features. Output: the expected severity, which is
the sum over k of ``P(grade > k)``.

A document is toxic if its ``P(grade >= 1)`` is above a cut that :func:`learn` chooses on labelled
documents held out of a fit (see :func:`choose_cut`): the highest that finds ``RECALL`` of the toxic
ones, as far as ``PRECISION`` of those above it are toxic, and never above ``REJECT_ABOVE``. The
weights themselves are then fitted on the whole sample.

Fitting uses a bounded sample: the ``sample`` labelled documents with the least hash of their
id, fewer if they have more than ``features`` features together (documented parameters; all
labelled documents if there are fewer). So however long the texts are, the driver gets no more
than that. Prediction reads every row and whole text; the weights have a fixed size.

Cases: a null or wordless text has no features and gets the thresholds' prior; documents
without a label or with a null grade are not learned from; with no labels at all, or one
grade only, everything is predicted as that grade (0 without labels); with fewer than
``LEAST_TOXIC`` toxic documents held out the cut is ``REJECT_ABOVE``; repeated rows are
predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorekit.llm.common import id_and_text, schema_like, slices
from scorekit.session import delete_tables, materialize

HASH_BITS = 18
SAMPLE = 12_000
FEATURES = 1 << 24   # of the sample's documents together: 64 MB come to the driver at most
MIN_DOCS = 3         # a feature of fewer documents of the sample is not learned
L1 = 3e-5
STEPS = 200
SUMMED_AT_ONCE = 1 << 17  # entries: what the fit adds up at a time stays in the processor's memory
GAIN = 1e-6          # fitting ends when ten steps lower the loss by less
REJECT_ABOVE = 0.5   # P(grade >= 1) above this is toxic at any rate; learn() may choose a lower cut
RECALL, PRECISION = 0.95, 0.9  # wanted of the cut on held-out documents; precision goes first
FOLDS = 4            # of the sample, by content: equal texts are held out together
HELD_TOXIC = 100     # folds are held out one by one until they have so many toxic documents
LEAST_TOXIC = 20     # with fewer of them no cut is chosen
BEGINNINGS = (4, 5)
BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 20      # bytes turned to features at a time: bounds memory for very long texts

LETTER = np.zeros(256, dtype=bool)  # bytes of words: ASCII letters and digits, all of UTF-8's others
LETTER[48:58] = LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) & np.uint64((1 << HASH_BITS) - 1)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


class Hasher:
    """Feature columns of a text, by prefix sums over its bytes."""

    def __init__(self):
        self.power = np.cumprod(np.full(BLOCK + 1, BASE, dtype=np.uint64))
        self.back = np.cumprod(np.full(BLOCK + 1, np.uint64(_inverse(int(BASE))), dtype=np.uint64))

    def _block(self, raw: np.ndarray) -> np.ndarray:
        lower = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint64)
        inside = np.concatenate([[False], LETTER[raw], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[0::2], edge[1::2]
        if len(starts) == 0:
            return np.zeros(0, dtype=np.int64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((lower + np.uint64(1)) * self.power[:len(raw)])])
        back = self.back[starts]
        found = [_mix((total[ends] - total[starts]) * back)]
        for k in BEGINNINGS:
            long = ends - starts >= k
            s = starts[long]
            found.append(_mix((total[s + k] - total[s]) * back[long] + np.uint64(k)))
        return np.concatenate(found).astype(np.int64)

    def columns(self, text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        at, parts = 0, []
        while at < len(raw):
            end = min(at + BLOCK, len(raw))
            if end < len(raw):  # cut between words; a word as long as a block is cut
                spaces = np.flatnonzero(~LETTER[raw[at:end]])
                end = at + int(spaces[-1]) + 1 if len(spaces) else end
            parts.append(self._block(raw[at:end]))
            at = end
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.int64)


class OrdinalModel:
    """Shared weights and increasing thresholds; grades ``0 .. len(thresholds)``."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, lowest: int = 0):
        self.weights, self.thresholds, self.lowest = weights, thresholds, lowest
        self.reject_above = REJECT_ABOVE

    def above(self, score: np.ndarray) -> np.ndarray:
        """``P(grade > k)`` for each score (rows) and threshold (columns)."""
        return _sigmoid(score[:, None] - self.thresholds[None, :])


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(columns: list[np.ndarray], grades: np.ndarray, l1: float = L1, steps: int = STEPS) -> OrdinalModel:
    """Maximum penalised likelihood by FISTA. The thresholds are ``t_1`` and log gaps."""
    if len(grades) == 0:
        return OrdinalModel(np.zeros(1 << HASH_BITS), np.zeros(0))
    levels, y = np.unique(np.asarray(grades, dtype=np.int64), return_inverse=True)
    if len(levels) == 1:
        return OrdinalModel(np.zeros(1 << HASH_BITS), np.zeros(0), int(levels[0]))
    flat = np.concatenate(columns)
    times = np.bincount(flat, minlength=1 << HASH_BITS)
    used = np.flatnonzero(times >= MIN_DOCS)
    # The documents of each used feature, feature after feature.
    doc = np.repeat(np.arange(len(columns), dtype=np.int32), [len(c) for c in columns])
    common = np.flatnonzero(times[flat] >= MIN_DOCS)
    doc = doc[common[np.argsort(flat[common], kind="stable")]]
    del flat, common
    held = times[used]
    starts = np.cumsum(held) - held
    norm = np.sqrt(held)  # rare features step no faster
    n, k = len(y), len(levels) - 1
    share = np.clip(np.cumsum(np.bincount(y, minlength=k + 1))[:-1] / n, 1e-6, 1 - 1e-6)
    cut = np.log(share / (1 - share))
    w = np.zeros(len(used))
    t = np.concatenate([[cut[0]], np.log(np.maximum(np.diff(cut), 1e-3))])

    def thresholds(t):
        return np.cumsum(np.concatenate([[t[0]], np.exp(t[1:])]))

    def scores(w):
        """Of all documents; read where weights are not zero, which L1 leaves few of."""
        nonzero = np.flatnonzero(w)
        lengths = held[nonzero]
        ends = np.cumsum(lengths)
        at = np.repeat(starts[nonzero] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(doc[at], weights=np.repeat(w[nonzero], lengths), minlength=n)

    def by_feature(values):
        """Sums of the documents' values for each feature, some features at a time."""
        out = np.zeros(len(used))
        first = 0
        while first < len(used):
            last = max(first + 1, int(np.searchsorted(starts, starts[first] + SUMMED_AT_ONCE)))
            end = starts[last] if last < len(used) else len(doc)
            out[first:last] = np.add.reduceat(values[doc[starts[first]:end]], starts[first:last] - starts[first])
            first = last
        return out

    def chances(score, t):
        """Of each document's grade: its probability, and those of the thresholds on both sides."""
        th = thresholds(t)
        p_hi = np.where(y < k, _sigmoid(th[np.minimum(y, k - 1)] - score), 1.0)
        p_lo = np.where(y > 0, _sigmoid(th[np.maximum(y - 1, 0)] - score), 0.0)
        return np.maximum(p_hi - p_lo, 1e-12), p_hi, p_lo

    def loss(score, t):
        return -np.log(chances(score, t)[0]).mean()

    def loss_gradient(score, t):
        p, p_hi, p_lo = chances(score, t)
        d_hi, d_lo = p_hi * (1 - p_hi) / p, p_lo * (1 - p_lo) / p
        by_th = (np.bincount(y[y > 0] - 1, weights=d_lo[y > 0], minlength=k)
                 - np.bincount(y[y < k], weights=d_hi[y < k], minlength=k)) / n
        tail = np.cumsum(by_th[::-1])[::-1]
        by_t = np.concatenate([[tail[0]], tail[1:] * np.exp(t[1:])])
        return -np.log(p).mean(), by_feature((d_hi - d_lo) / n), by_t

    # Steps in scaled weights v = w * norm / sqrt(n); backtracking finds the step size.
    scale = norm / np.sqrt(n)
    v, v_old, t_old, size, momentum = w.copy(), w.copy(), t.copy(), 1.0, 1.0
    before, score, score_old = np.inf, np.zeros(n), np.zeros(n)
    for n_step in range(steps):
        nxt = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        f = (momentum - 1) / nxt
        momentum = nxt
        vy, ty = v + f * (v - v_old), t + f * (t - t_old)
        here, gw, gt = loss_gradient(score + f * (score - score_old), ty)  # scores are linear in v
        gv = gw / scale
        while True:
            step = vy - size * gv
            v_new = np.sign(step) * np.maximum(np.abs(step) - size * l1 / scale, 0)
            t_new = ty - size * gt
            dv, dt = v_new - vy, t_new - ty
            score_new = scores(v_new / scale)
            reached = loss(score_new, t_new)
            if reached <= here + gv @ dv + gt @ dt + (dv @ dv + dt @ dt) / (2 * size) + 1e-12 or size < 1e-8:
                break
            size /= 2
        v_old, t_old, v, t = v, t, v_new, t_new
        score_old, score = score, score_new
        size *= 1.1
        if n_step % 10 == 9:
            penalised = reached + l1 * np.abs(v / scale).sum()
            if before - penalised < GAIN:
                break
            before = penalised
    weights = np.zeros(1 << HASH_BITS)
    weights[used] = v / scale
    return OrdinalModel(weights, thresholds(t), int(levels[0]))


def choose_cut(p: np.ndarray, toxic: np.ndarray, recall: float = RECALL, precision: float = PRECISION) -> float:
    """The highest cut of ``REJECT_ABOVE`` or less that has ``recall`` of the ``toxic`` documents
    above it. Lower cuts than ``REJECT_ABOVE`` count only where ``precision`` of the documents
    above them are toxic; if none of those reaches ``recall``, the one with the greatest is taken."""
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.concatenate([[0], np.cumsum(toxic[order])])
    cuts = (p + np.append(p[1:], 0.0)) / 2  # between each document and the next less likely one
    cuts = np.concatenate([[REJECT_ABOVE], cuts[(cuts < REJECT_ABOVE) & (cuts < p)]])
    above = np.searchsorted(-p, -cuts, side="left")
    allowed = hits[above] >= precision * above
    allowed[0] = True
    wanted = min(recall * hits[-1], hits[above[allowed]].max())
    return float(cuts[np.flatnonzero(allowed & (hits[above] >= wanted))[0]])


def _held_out_cut(columns: list[np.ndarray], grades: np.ndarray) -> float:
    """The cut chosen on documents that the fits they are judged by have not seen."""
    fold = np.array([zlib.crc32(c.tobytes()) % FOLDS for c in columns], dtype=np.int64)
    toxic = grades > (grades.min() if len(grades) else 0)
    if toxic.sum() < LEAST_TOXIC:
        return REJECT_ABOVE
    p, truth = [], []
    for k in range(FOLDS):
        held, seen = np.flatnonzero(fold == k), np.flatnonzero(fold != k)
        model = fit([columns[i] for i in seen], grades[seen])
        if len(held) and len(model.thresholds):
            p.append(model.above(np.array([model.weights[columns[i]].sum() for i in held]))[:, 0])
            truth.append(toxic[held])
        if sum(t.sum() for t in truth) >= HELD_TOXIC:
            break
    if sum(t.sum() for t in truth) < LEAST_TOXIC:
        return REJECT_ABOVE
    return choose_cut(np.concatenate(p), np.concatenate(truth))


def _last_rank(written: DataFrame, features: int) -> int | None:
    """The greatest rank up to which documents have ``features`` features together, or the least rank."""
    last, total = None, 0
    by_rank = written.groupBy("rank").agg(F.sum(F.size("cols")).alias("n"))
    for r in sorted(by_rank.collect(), key=lambda r: r["rank"]):  # a row for each sampled document
        total += r["n"]
        if last is not None and total > features:
            break
        last = r["rank"]
    return last


def learn(docs: DataFrame, labels: DataFrame, grade: str, sample: int = SAMPLE, features: int = FEATURES,
          id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fit on the ``sample`` labelled documents with the least hash of their id, or on the first of
    them, in the hash's order, that have ``features`` features together.

    ``grade`` is an SQL expression over ``labels`` (integers; null: not learned from). Only
    the hashed features of the sample come to the driver. A document with several labels
    counts with the greatest; of several rows with one id the least text is learned from.
    """
    graded = (labels.select(F.col("doc_id").alias("_x_id"), F.expr(grade).cast("int").alias("grade"))
              .where("grade is not null and _x_id is not null")
              .groupBy("_x_id").agg(F.max("grade").alias("grade")))
    chosen = graded.select("_x_id", "grade", F.xxhash64("_x_id").alias("rank")).orderBy("rank", "_x_id").limit(sample)
    texts = id_and_text(docs, id_col, text_col).where("doc_id is not null")
    # One text for each chosen id (the least), so no repeated id makes the sample larger than its bound.
    joined = (texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_x_id"))
              .groupBy("doc_id").agg(F.max("grade").alias("grade"), F.max("rank").alias("rank"), F.min("text").alias("text"))
              .select("grade", "rank", "text"))

    def with_columns(batches):
        hasher = Hasher()
        for part in slices(batches):
            cols = [hasher.columns(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(cols, pa.list_(pa.int32()))], names=["grade", "rank", "cols"])

    written = materialize(joined.mapInArrow(with_columns, "grade int, rank bigint, cols array<int>"), "toxicity-sample")
    rows = written.where(F.col("rank") <= F.lit(_last_rank(written, features)).cast("bigint")).toArrow()
    delete_tables(docs.sparkSession, written)
    lists = rows.column("cols").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    offsets = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    order = np.argsort(rows.column("rank").to_numpy(), kind="stable")  # the fit does not depend on how rows are dealt
    columns = [flat[offsets[i]:offsets[i + 1]] for i in order]
    grades = rows.column("grade").to_numpy().astype(np.int64)[order]
    del rows
    cut = _held_out_cut(columns, grades)
    model = fit(columns, grades)
    model.reject_above = cut
    return model


def _scorer(model: OrdinalModel):
    weights, hasher = model.weights.astype(np.float64), Hasher()

    def scores(texts) -> np.ndarray:
        return np.array([weights[hasher.columns(t)].sum() for t in texts], dtype=np.float64)
    return scores


def predict_severity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id",
                     text_col: str = "text", reject_above: float | None = None) -> DataFrame:
    """``doc_id, severity, p_toxic, toxic`` for every row: expected severity, the probability
    of any grade above the lowest, and whether that exceeds ``reject_above`` (the model's cut)."""
    cut = model.reject_above if reject_above is None else reject_above

    def task(batches):
        scores = _scorer(model)
        for part in slices(batches):
            above = model.above(scores(part.column(1).to_pylist()))
            severity = above.sum(axis=1) + model.lowest
            p = above[:, 0] if above.shape[1] else np.full(len(above), float(model.lowest > 0))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(severity), pa.array(p), pa.array(p > cut)],
                names=["doc_id", "severity", "p_toxic", "toxic"])

    schema = schema_like(docs, id_col, "severity double, p_toxic double, toxic boolean")
    return id_and_text(docs, id_col, text_col).mapInArrow(task, schema)


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text",
               reject_above: float | None = None) -> DataFrame:
    """The rows of ``docs`` that :func:`predict_severity` does not call toxic, all columns
    as they were; judged row by row where they are read, without a shuffle."""
    place = docs.columns.index(text_col)
    cut = model.reject_above if reject_above is None else reject_above

    def task(batches):
        scores = _scorer(model)
        for part in slices(batches):
            above = model.above(scores(["" if t is None else str(t) for t in part.column(place).to_pylist()]))
            p = above[:, 0] if above.shape[1] else np.full(len(above), float(model.lowest > 0))
            yield part.filter(pa.array(p <= cut))

    return docs.mapInArrow(task, docs.schema)
