"""Exact de-duplication by content-defined chunk recipes.

A text is cut where a gear hash of its last 32 bytes has its low bits zero (so equal content
is cut alike wherever it stands), with a least and a greatest chunk length. Each chunk is
described by a 64-bit hash, its length and its SHA-256; the distinct descriptions get
identifiers ``(hash, n)``, where ``n`` numbers different contents that share a hash, so an
identifier stands for one content, verified by length and SHA-256. A document becomes the
ordered list of its chunks' identifiers (its recipe), and documents are equal when their
recipes are equal. The texts themselves never cross a shuffle here: only descriptions do
(about 50 bytes a chunk of 2 KB).

Cases: a null text counts as empty; the empty text has the empty recipe, and all empty texts
are one group. Repeated rows (same id, same text) form one group of which one row stays. A
null id is below every other. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorekit.llm.common import PLACE, place, placed, slices, without_places
from scorekit.session import materialize

CUT_BITS = 11             # a cut every 2 KB on average
MIN_CHUNK = 512
MAX_CHUNK = 16_384
WINDOW_DOUBLINGS = 5      # 2**5 = 32 bytes decide a cut
BLOCK = 1 << 20           # bytes hashed at a time: bounds memory for very long texts

CHUNKS = T.ArrayType(T.StructType([T.StructField("h", T.LongType()),
                                   T.StructField("n_bytes", T.IntegerType()),
                                   T.StructField("sha", T.BinaryType())]))
ARROW_CHUNK = pa.struct([("h", pa.int64()), ("n_bytes", pa.int32()), ("sha", pa.binary())])


def _gear() -> np.ndarray:
    """256 fixed pseudo-random words, from a rule: the hash of each byte value."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), seed=7) & 0xFFFFFFFF for b in range(256)],
                    dtype=np.uint32)


def cut_points(data: bytes, gear: np.ndarray) -> list[int]:
    """Ends of the chunks of ``data``, the last one included (none for empty data)."""
    n = len(data)
    if n == 0:
        return []
    marks: list[int] = []
    if n > MIN_CHUNK:
        mask = np.uint32((1 << CUT_BITS) - 1)
        raw = np.frombuffer(data, dtype=np.uint8)
        reach = 1 << WINDOW_DOUBLINGS
        for at in range(0, n, BLOCK):
            lo = max(0, at - reach)
            h = gear[raw[lo:at + BLOCK]]
            for k in range(WINDOW_DOUBLINGS):
                s = 1 << k
                longer = h.copy()
                longer[s:] += h[:-s] << np.uint32(s)
                h = longer
            found = np.flatnonzero((h[at - lo:] & mask) == 0)
            marks.extend((found + at + 1).tolist())
    ends, last = [], 0
    for m in [*marks, n]:
        while m - last > MAX_CHUNK:
            last += MAX_CHUNK
            ends.append(last)
        if m == n or m - last >= MIN_CHUNK:
            if m > last:
                ends.append(m)
            last = m
    return ends


def _describe(batches):
    gear = _gear()
    for part in slices(batches):
        offsets, h, size, sha = [0], [], [], []
        for text in part.column(2).to_pylist():
            data = text.encode("utf-8", "surrogatepass")
            start = 0
            for end in cut_points(data, gear):
                chunk = data[start:end]
                h.append(xxhash.xxh64_intdigest(chunk) - (1 << 63))
                size.append(end - start)
                sha.append(hashlib.sha256(chunk).digest())
                start = end
            offsets.append(len(h))
        values = pa.StructArray.from_arrays(
            [pa.array(h, pa.int64()), pa.array(size, pa.int32()), pa.array(sha, pa.binary())],
            fields=list(ARROW_CHUNK))
        chunks = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), chunks, part.column(3)],
                                         names=["doc_id", "text_sha256", "chunks", "place"])


def chunk_recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", where: Column | None = None) -> DataFrame:
    """One row per document row: ``row`` (a number of its own), ``doc_id``, ``text_sha256``,
    ``recipe`` (identifiers of its chunks in order) and ``place`` (the expression ``where``)."""
    where = F.lit(None).cast(PLACE) if where is None else where
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       where.alias("place")).select("doc_id", F.sha2("text", 256).alias("text_sha256"), "text", "place")
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType),
                           T.StructField("text_sha256", T.StringType()),
                           T.StructField("chunks", CHUNKS), T.StructField("place", PLACE)])
    described = materialize(
        rows.mapInArrow(_describe, schema).withColumn("row", F.monotonically_increasing_id()),
        "chunks")
    each = described.select("row", F.posexplode("chunks").alias("pos", "c")).select(
        "row", "pos", "c.h", "c.n_bytes", "c.sha")
    contents = each.select("h", "n_bytes", "sha").distinct()
    shared = (contents.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("n_bytes", "sha"))).alias("all")))
    identifiers = shared.select("h", F.posexplode("all").alias("n", "c")).select(
        "h", "n", "c.n_bytes", "c.sha")
    recipes = (each.join(identifiers, ["h", "n_bytes", "sha"])
                   .groupBy("row")
                   .agg(F.sort_array(F.collect_list(F.struct("pos", "h", "n"))).alias("parts"))
                   .select("row", F.transform("parts", lambda p: F.struct(p["h"].alias("h"), p["n"].alias("n")))
                           .alias("recipe")))
    empty = F.array().cast("array<struct<h:bigint,n:int>>")
    return (described.select("row", "doc_id", "text_sha256", "place").join(recipes, "row", "left")
            .withColumn("recipe", F.coalesce("recipe", empty)))


def _decided(docs: DataFrame, id_col: str, text_col: str, where: Column | None = None) -> DataFrame:
    recipes = materialize(chunk_recipes(docs, id_col, text_col, where), "recipes")
    # Written first, so that the join has plain inputs and a recipe that a third of the rows
    # share can be split over tasks.
    groups = materialize(recipes.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("keep"),
                                                       F.count(F.lit(1)).alias("group_size")), "recipe-groups")
    return recipes.join(groups, "recipe").select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256", "place")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Of rows with equal text the one with the largest id stays (of several rows with that id, the
    last one as the table is read). ``keep_id`` is its id, ``group_size`` the number of rows with
    that text.
    """
    return _decided(docs, id_col, text_col).drop("place")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, with all their columns.

    Rows are known by their place in the table's files; the places of dropped rows are taken out,
    so texts are not moved to find them.
    """
    docs = placed(docs)
    dropped = _decided(docs, id_col, text_col, place()).where(~F.col("kept")).select("place")
    return without_places(docs, materialize(dropped, "dropped-copies"))
