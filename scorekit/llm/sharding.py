"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Rows with equal text form a group that is never split. Groups enter shards largest first, each
into the shard whose remaining capacity is the tightest that still holds it (found in a
balanced tree keyed by remaining capacity), else into a new shard.

At scale the list of groups does not fit one task, so packing works on bounded items:

* a group of at least ``capacity / granularity`` bytes is an item of its own;
* smaller groups are first put together by hash into bundles of about that size.

So there are at most ``2 * granularity + 1`` items for each shard's worth of bytes. A *cell*
is a set of items packed by one task; :func:`pack_shards` deals the items to cells of about
``SHARDS_PER_CELL`` shards each, so any number of shards is packed with bounded tasks (a cell
may leave one shard part empty). A group larger than the capacity gets a shard for itself.

Cases: a null text has no bytes and is grouped with the empty text; repeated rows count each;
an empty table gives an empty result; null ids are placed like others.
"""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorekit.session import materialize

ROW_OVERHEAD = 8
GRANULARITY = 1000
SHARDS_PER_CELL = 32
SLOT_ROWS = 50_000  # rows numbered by one window task


class CapacityTree:
    """A treap of ``(remaining capacity, shard)`` keys: expected logarithmic depth."""

    def __init__(self):
        self.root = None
        self._dice = random.Random(0)

    def add(self, key):
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self._dice.random(), None, None]), high)

    def take_tightest(self, size):
        """Remove and return the least key whose capacity is at least ``size``; else None."""
        low, high = self._split(self.root, (size, -1))
        if high is None:
            return None
        node = high
        while node[2] is not None:
            node = node[2]
        key = node[0]
        _, rest = self._split(high, (key[0], key[1] + 1))
        self.root = self._merge(low, rest)
        return key

    def _split(self, node, key):
        """Keys below ``key``, and the rest."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            return [node[0], node[1], node[2], low], high
        low, high = self._split(node[2], key)
        return low, [node[0], node[1], high, node[3]]

    def _merge(self, a, b):
        if a is None or b is None:
            return a if b is None else b
        if a[1] > b[1]:
            return [a[0], a[1], a[2], self._merge(a[3], b)]
        return [b[0], b[1], self._merge(a, b[2]), b[3]]


def best_fit_decreasing(sizes, capacity: int) -> tuple[list[int], int]:
    """Shard of each size, in the order given, and the number of shards.

    ``sizes`` must be in decreasing order. A size above ``capacity`` gets a shard of its own.
    """
    tree, shards, n = CapacityTree(), [], 0
    for size in sizes:
        found = tree.take_tightest(size)
        if found is None:
            found = (capacity, n)
            n += 1
        shards.append(found[1])
        if found[0] > size:
            tree.add((found[0] - size, found[1]))
    return shards, n


def pack_into(sizes, n_shards: int) -> list[int]:
    """Shards ``0 .. n_shards-1`` for decreasing ``sizes``, at the least capacity that
    best-fit-decreasing needs for that many shards (found by bisection).

    Sizes at or above the mean of what is left get shards of their own, so one giant group
    does not raise the capacity of the others.
    """
    sizes, own = list(sizes), 0
    left = sum(sizes)
    while own < min(len(sizes), n_shards - 1) and sizes[own] * (n_shards - own) >= left:
        left -= sizes[own]
        own += 1
    rest, bins = sizes[own:], n_shards - own
    if not rest:
        return list(range(own))
    low = max(rest[0], math.ceil(left / bins))
    high = low
    while True:
        best, used = best_fit_decreasing(rest, high)
        if used <= bins:
            break
        low, high = high + 1, high + max(1, high // 50)
    while low < high:
        mid = (low + high) // 2
        placed, used = best_fit_decreasing(rest, mid)
        if used <= bins:
            best, high = placed, mid
        else:
            low = mid + 1
        if high - low <= high // 10_000:
            break
    return [*range(own), *(own + b for b in best)]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    whole = F.coalesce(text, F.lit(""))
    return materialize(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_OVERHEAD).cast("bigint").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        F.unhex(F.sha2(whole, 256)).alias("g"),
        F.monotonically_increasing_id().alias("row")), "shard-rows")


def _items(rows: DataFrame, unit: int, cells: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their item key, and the items ``cell, item, size``."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    bundles = max(1, math.ceil(total / unit))
    large = rows.groupBy("g").agg(F.sum("size").alias("w")).where(F.col("w") >= unit).select("g")
    marked = rows.join(large.withColumn("own", F.lit(True)), "g", "left").withColumn(
        "item", F.when(F.col("own"), F.hex("g")).otherwise(
            F.concat(F.lit("bundle-"), F.pmod(F.xxhash64("g"), F.lit(bundles))))).drop("own")
    items = (marked.groupBy("item").agg(F.sum("size").alias("size"))
                   .withColumn("cell", F.pmod(F.xxhash64("item"), F.lit(cells)).cast("int")))
    return marked, items


def _slots(placed: DataFrame) -> DataFrame:
    """Gapless ``slot`` in each shard without one task per shard: rows are dealt to parts of
    about ``SLOT_ROWS`` rows, numbered there, and moved up by the sizes of earlier parts."""
    parts = max(1, math.ceil(placed.count() / SLOT_ROWS))
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = (dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")))
    inside = Window.partitionBy("shard", "part").orderBy("doc_id", "row")
    return (dealt.withColumn("slot", F.row_number().over(inside) - 1)
            .join(before, ["shard", "part"])
            .withColumn("slot", (F.col("slot") + F.col("before")).cast("bigint")))


RESULT = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _result(marked: DataFrame, where: DataFrame) -> DataFrame:
    placed = materialize(marked.join(where, "item").select(
        "doc_id", "size", "text_crc32", "row", "shard"), "shard-placed")
    return (_slots(placed).withColumn("law", F.lit("bytes"))
            .withColumn("grown_shard", F.lit(None).cast("int")).select(*RESULT))


def shard_equally(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                  granularity: int = GRANULARITY) -> DataFrame:
    """All rows in shards ``0 .. n_shards-1`` of nearly equal bytes (law ``bytes``).

    ``n_shards`` is one cell here: at most ``2 * granularity * n_shards + 1`` items are packed
    by one task, whatever the input's size.
    """
    rows = _rows(docs, id_col, text_col)
    total = rows.agg(F.sum("size")).first()[0] or 0
    marked, items = _items(rows, max(1, total // (n_shards * granularity)), 1)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True])
        return pd.DataFrame({"item": pdf["item"], "shard": pack_into(pdf["size"].tolist(), n_shards)})

    where = items.groupBy("cell").applyInPandas(pack, "item string, shard int")
    return _result(marked, where)


def pack_shards(docs: DataFrame, capacity: int, id_col: str = "doc_id", text_col: str = "text",
                granularity: int = GRANULARITY) -> DataFrame:
    """All rows in as few shards of ``capacity`` bytes as best-fit-decreasing needs per cell.

    Shard numbers are gapless from 0. Only a group that is larger than ``capacity`` makes a
    shard exceed it.
    """
    rows = _rows(docs, id_col, text_col)
    total = rows.agg(F.sum("size")).first()[0] or 0
    cells = max(1, math.ceil(total / (capacity * SHARDS_PER_CELL)))
    marked, items = _items(rows, max(1, capacity // granularity), cells)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True])
        placed, _ = best_fit_decreasing(pdf["size"].tolist(), capacity)
        return pd.DataFrame({"item": pdf["item"], "cell": pdf["cell"], "local": placed})

    local = materialize(items.groupBy("cell").applyInPandas(pack, "item string, cell int, local int"),
                        "shard-cells")
    earlier = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a row per cell
    first = local.groupBy("cell").agg((F.max("local") + 1).alias("n")).select(
        "cell", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    where = local.join(first, "cell").select("item", (F.col("first") + F.col("local")).cast("int").alias("shard"))
    return _result(marked, where)
