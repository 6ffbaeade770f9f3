"""SimHash near-duplicates by deletion-variant signatures.

Fingerprint: words (ASCII lower-cased, split at ASCII white space) are joined to shingles; a bit
of the 64-bit fingerprint is 1 when it is set in over half of the shingles' XXH64 hashes.

Search for fingerprints at ``max_bits`` bits or fewer: the 64 bits are cut into
``max_bits // 2 + 1`` segments, so of two linked fingerprints some segment differs in one bit at
most. Each distinct fingerprint is indexed under its segments as they are, and under each
segment with one bit deleted. An equality join then finds partners: whole segments meet equal
whole segments, and a variant whose deleted bit was 0 meets the same variant whose bit was 1
(so each pair meets once for each segment). The bit distance of every candidate is verified.

Where more than ``crowded`` fingerprints share a signature, their pairs are not formed. All
fingerprints of crowded signatures are indexed a second time under every value one flipped
bit away from them (and themselves): two fingerprints at two bits share such a value, all
fingerprints that share one are within two bits of each other, and there are at most 65 of
them, so each is linked to the least of them. Nothing is left out and no group is expanded.
For an odd ``max_bits`` one bit is deleted from that value besides.

Linked fingerprints are joined to components by rounds of star operations on tables. Documents
with equal fingerprints enter the search once.

Cases: a null or wordless text has fingerprint zero and is linked like any other; a text of
fewer words than a shingle is one shingle; repeated rows are grouped by fingerprint; a null id
is never the least unless all ids of its component are null; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorekit.llm.common import PLACE, place, placed, schema_like, slices, without_places
from scorekit.llm.components import connected_components
from scorekit.session import materialize

BITS = 64
SEED = 42
SHINGLES_AT_ONCE = 32_768  # unpacked to bits at a time: bounds memory for very long texts
CROWDED = 48               # fingerprints that share a signature before their pairs are not formed


def fingerprint(text: str, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text."""
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    total = len(words) - shingle + 1
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, total, SHINGLES_AT_ONCE):
        here = words[at:at + SHINGLES_AT_ONCE + shingle - 1]
        hashes = np.fromiter((digest(b" ".join(s), SEED) for s in zip(*(here[k:] for k in range(shingle)))),
                             dtype="<u8", count=len(here) - shingle + 1)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * ones > total, bitorder="little")
    return int(value.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id",
                 text_col: str = "text", where: Column | None = None) -> DataFrame:
    """``doc_id, fp, place``: the fingerprint of each row's whole text, as a signed bigint, and
    the expression ``where`` of the row."""
    where = F.lit(None).cast(PLACE) if where is None else where

    def task(batches):
        for part in slices(batches):
            fps = np.array([fingerprint(t, shingle) for t in part.column(2).to_pylist()],
                           dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps, pa.int64()), part.column(1)],
                                             names=["doc_id", "fp", "place"])

    rows = docs.select(F.col(id_col).alias("doc_id"), where.alias("place"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(task, schema_like(docs, id_col, f"fp bigint, place {PLACE.simpleString()}"))


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def _long(value: int):
    return F.lit(_signed(value)).cast("bigint")


def _index(fps: DataFrame, max_bits: int) -> DataFrame:
    """``sig, side, fp``: side 2 for a whole segment, else the value of the deleted bit."""
    parts = max_bits // 2 + 1
    size = -(-BITS // parts)
    variants = []
    for s, at in enumerate(range(0, BITS, size)):
        bits = range(at, min(at + size, BITS))
        whole = sum(1 << b for b in bits)
        variants.append(F.struct(F.lit(s * 100).alias("n"), _long(whole).alias("keep"), _long(0).alias("bit")))
        if max_bits:
            variants += [F.struct(F.lit(s * 100 + 1 + k).alias("n"), _long(whole ^ (1 << b)).alias("keep"),
                                  _long(1 << b).alias("bit")) for k, b in enumerate(bits)]
    v = fps.select("fp", F.explode(F.array(*variants)).alias("v"))
    return v.select(
        F.xxhash64("v.n", F.col("fp").bitwiseAND(F.col("v.keep"))).alias("sig"),
        F.when(F.col("v.bit") == 0, 2).when(F.col("fp").bitwiseAND(F.col("v.bit")) != 0, 1)
        .otherwise(0).cast("tinyint").alias("side"), "fp")


def _pairs(index: DataFrame, max_bits: int) -> DataFrame:
    """Verified pairs ``a, b`` among rows that share a signature."""
    left = index.where(F.col("side") != 1).select("sig", "side", F.col("fp").alias("a"))
    right = index.where(F.col("side") != 0).select(
        "sig", F.when(F.col("side") == 1, 0).otherwise(2).cast("tinyint").alias("side"), F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    once = (F.col("side") == 0) | (F.col("a") < F.col("b"))
    return left.join(right, ["sig", "side"]).where(near & once).select("a", "b").distinct()


def _star_links(fps: DataFrame, max_bits: int) -> DataFrame:
    """Links ``a, b`` that connect all of ``fps`` that are ``max_bits`` bits apart or fewer."""
    flips = [0, *(1 << b for b in range(BITS))] if max_bits >= 2 else [0]
    gaps = [1 << b for b in range(BITS)] if max_bits % 2 else [0]
    near = fps.select("fp", F.explode(F.array(*map(_long, flips))).alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("v"))
    near = near.select("fp", "v", F.explode(F.array(*map(_long, gaps))).alias("gap")).select(
        "fp", "gap", F.col("v").bitwiseAND(F.bitwise_not("gap")).alias("v"))
    least = near.groupBy("gap", "v").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return near.join(least, ["gap", "v"]).where(F.col("fp") != F.col("b")).select(
        F.col("fp").alias("a"), "b").distinct()


def linked_fingerprints(fps: DataFrame, max_bits: int = 2, crowded: int = CROWDED) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (column ``fp``): each is at ``max_bits`` or
    fewer, and fingerprints that far apart are always connected by them."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3")
    # Dealt by signature once: the counts and the join read the same exchange, so both use all of its
    # columns. Shared signatures grow with the documents: they are joined where they lie, not broadcast.
    index = _index(materialize(fps.select("fp").distinct(), "simhash-distinct"), max_bits).repartition("sig")
    n = [F.count(F.when(F.col("side") == side, F.col("fp"))).alias(f"n{side}") for side in (0, 1, 2)]
    shared = index.groupBy("sig").agg(*n).where("n2 > 1 or (n0 > 0 and n1 > 0)").select(
        "sig", F.greatest("n2", F.least("n0", "n1")).alias("width"))
    met = materialize(index.join(shared.hint("shuffle_hash"), "sig"), "simhash-index")
    pairs = _pairs(met.where(F.col("width") <= crowded), max_bits)
    crowd = met.where(F.col("width") > crowded).select("fp").distinct()
    return materialize(pairs.unionByName(_star_links(crowd, max_bits)), "simhash-links")


def _grouped(docs: DataFrame, shingle: int, max_bits: int, id_col: str, text_col: str, where: Column | None = None) -> DataFrame:
    """``doc_id, fp, place, component_id, root``; ``root`` names the component."""
    fps = materialize(fingerprints(docs, shingle, id_col, text_col, where), "fingerprints")
    roots = connected_components(linked_fingerprints(fps, max_bits)).select(
        F.col("node").alias("fp"), F.col("root"))
    least = materialize(
        fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp", "left")
        .select("fp", F.coalesce("root", "fp").alias("root"), "least"), "simhash-least")
    component = least.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(least.join(component, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row: 16 hex digits, and the smallest id
    that is reachable over links of ``max_bits`` differing bits or fewer."""
    return _grouped(docs, shingle, max_bits, id_col, text_col).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each_group(docs: DataFrame, shingle: int = 3, max_bits: int = 2,
                           id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is their component's smallest, with all their columns.

    Should several rows of a component have that id, the first of them stays, as the table's files
    are named and read. Rows are known by their place there; texts are not moved to find them.
    """
    docs = placed(docs)
    rows = materialize(_grouped(docs, shingle, max_bits, id_col, text_col, place()), "simhash-groups")
    stays = materialize(rows.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
                        .groupBy("root").agg(F.min("place").alias("stays")), "simhash-stays")
    dropped = rows.join(stays, "root").where(F.col("place") != F.col("stays")).select("place")
    return without_places(docs, materialize(dropped, "dropped-near-copies"))
