"""Centroid clustering (Lloyd's rounds in whole numbers) with a LAESA pivot table.

A few fixed pivots are chosen among the first centroids (each the one farthest from those chosen
before). The distance of every vector to every pivot is computed once and written with the
vectors' whole-number entries. In each round the centroids' own distances to the pivots give, by
the triangle inequality, a lower bound ``max_p |d(v, p) - d(c, p)|`` of every vector's distance to
every centroid. The centroid of the least bound is measured first; only centroids whose bound does
not exceed that distance survive and are measured exactly, in integers. Bounds are floating point
and get a margin for rounding, so no nearest centroid and no tie is lost.

Spread: the rounds read the written table; a task keeps a batch, the centroids and the pivots (at
most ``k`` and ``PIVOTS`` vectors, sizes that do not grow with the rows). Sums of a round are taken
in the tasks first: one row per task and cluster is shuffled, however many vectors a cluster has.
Only the ``k`` new centroids come to the driver.

Cases: rows whose vector is null, has another length, or holds a null, NaN or infinite entry are
not kept; fewer kept rows than ``k`` give that many centroids; rows of one id each count and are
each returned (as first centroids they are ordered by their vectors); a null id hashes as empty
text; equal distances go to the smaller number; an empty cluster keeps its centroid; an entry of
2**27 or more after scaling is an error, since its squared distances do not fit a long; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorekit.llm.vectors import list_column, matrix, summed_entries, whole_vectors
from scorekit.session import delete_tables, materialize

PIVOTS = 12
LARGEST = 1 << 27          # of an entry: 64 squared differences of such entries fit a long
MARGIN = 1e-9              # of the bounds' rounding, relative to the distances they come from
PAIRS = 1 << 16            # vector and centroid pairs measured at a time


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of ``a`` and ``b``, pair by pair."""
    out = np.empty(len(a), dtype=np.int64)
    for at in range(0, len(a), PAIRS):
        diff = a[at:at + PAIRS] - b[at:at + PAIRS]
        out[at:at + PAIRS] = np.einsum("ij,ij->i", diff, diff)
    return out


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every row of ``x`` to every pivot."""
    columns = [np.sqrt(squared(x, np.broadcast_to(p, x.shape)).astype(float)) for p in pivots]
    return np.stack(columns, axis=1) if columns else np.zeros((len(x), 0))


def choose_pivots(candidates: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows (fewer if some are equal), each the farthest from the rows chosen before it."""
    chosen, near = [], None
    while len(chosen) < min(count, len(candidates)):
        at = 0 if near is None else int(near.argmax())
        if near is not None and near[at] == 0:
            break
        chosen.append(at)
        far = squared(candidates, np.broadcast_to(candidates[at], candidates.shape))
        near = far if near is None else np.minimum(near, far)
    return candidates[chosen]


def nearest(x: np.ndarray, pivot_distance: np.ndarray, centroids: np.ndarray, pivots: np.ndarray):
    """``cluster, squared distance, measured pairs`` of each row of ``x``."""
    of_centroids = to_pivots(centroids, pivots)
    bound = np.zeros((len(x), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(bound, np.abs(pivot_distance[:, p, None] - of_centroids[None, :, p]), out=bound)
    first = bound.argmin(axis=1)
    reach = np.sqrt(squared(x, centroids[first]).astype(float))
    slack = MARGIN * (reach + pivot_distance.max(axis=1, initial=0) + of_centroids.max(initial=0) + 1)
    row, candidate = np.nonzero(bound <= (reach + slack)[:, None])  # ordered by row, then centroid
    distance = np.concatenate([squared(x[row[a:a + PAIRS]], centroids[candidate[a:a + PAIRS]])
                               for a in range(0, len(row), PAIRS)] or [np.zeros(0, np.int64)])
    starts = np.searchsorted(row, np.arange(len(x)))
    least = np.minimum.reduceat(distance, starts)
    hits = np.flatnonzero(distance == least[row])
    _, at = np.unique(row[hits], return_index=True)  # the smallest number among equal distances
    return candidate[hits[at]].astype(np.int32), least, len(row)


def _cluster_sums(centroids, pivots):
    def task(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            x = matrix(batch.column("x")).astype(np.int64)
            if len(x):
                cluster, _, _ = nearest(x, matrix(batch.column("to_pivots")), centroids, pivots)
                order = np.argsort(cluster, kind="stable")
                numbers, starts = np.unique(cluster[order], return_index=True)
                total[numbers] += np.add.reduceat(x[order], starts, axis=0)
                count += np.bincount(cluster, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(  # the count goes last in the list
            [pa.array(used.astype(np.int32)),
             list_column(np.concatenate([total[used], count[used, None]], axis=1), pa.int64())],
            names=["cluster", "total"])
    return task


def _assigned(centroids, pivots, keep_id):
    def task(batches):
        for batch in batches:
            x = matrix(batch.column("x")).astype(np.int64)
            if len(x):
                cluster, distance, _ = nearest(x, matrix(batch.column("to_pivots")), centroids, pivots)
                yield pa.RecordBatch.from_arrays([batch.column(keep_id), pa.array(cluster), pa.array(distance)],
                                                 names=["vec_id", "cluster", "distance"])
    return task


def _long(value: int):
    return value if value < 1 << 63 else None


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256,
                    salt: str = "2:", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept row.

    The first centroids are the ``k`` kept rows of the smallest SHA-256 of ``salt`` and the id. An
    inertia that does not fit a long is null.
    """
    spark = vectors.sparkSession
    kept = whole_vectors(vectors.where(F.size(vector_col) == dimensions), scale, LARGEST, id_col, vector_col)
    hashed = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = kept.orderBy(hashed, "x").limit(k).select("x").collect()  # at most k rows
    centroids = np.array([r["x"] for r in start], dtype=np.int64).reshape(-1, dimensions)
    id_type = vectors.schema[id_col].dataType
    result = T.StructType([T.StructField("vec_id", id_type), T.StructField("cluster", T.IntegerType()),
                           T.StructField("distance", T.LongType())])
    if not len(centroids):
        return spark.createDataFrame([], result).select(
            "*", *(F.lit(None).cast("bigint").alias(c) for c in ("cluster_inertia", "inertia")),
            F.lit(None).cast("string").alias("centroid_sha256"))
    pivots = choose_pivots(centroids, PIVOTS)

    def measure(batches):
        for batch in batches:
            x = matrix(batch.column("x")).astype(np.int64)
            if len(x):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), list_column(x.astype(np.int32), pa.int32()),
                     list_column(to_pivots(x, pivots), pa.float64())], names=["vec_id", "x", "to_pivots"])

    stored = T.StructType([result["vec_id"], T.StructField("x", T.ArrayType(T.IntegerType())),
                           T.StructField("to_pivots", T.ArrayType(T.DoubleType()))])
    table = materialize(kept.mapInArrow(measure, stored), "pivot-table")
    for _ in range(rounds):
        parts = table.select("x", "to_pivots").mapInArrow(_cluster_sums(centroids, pivots),
                                                          "cluster int, total array<bigint>")
        sums: dict[int, dict[int, int]] = {}
        for r in summed_entries(parts, ["cluster"], "total", "decimal(38,0)").collect():  # k * (dimensions + 1) rows
            sums.setdefault(r["cluster"], {})[r["place"]] = int(r["total"])
        centroids = centroids.copy()
        for number, entries in sums.items():
            centroids[number] = [entries[i] // entries[dimensions] for i in range(dimensions)]
    assigned = materialize(table.mapInArrow(_assigned(centroids, pivots, "vec_id"), result), "clusters")
    delete_tables(spark, table)

    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    rows = [(c, _long(s), _long(sum(inertia.values())),
             hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest())
            for c, s in inertia.items()]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select(  # at most k rows are broadcast
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, salt: str = "2:") -> str:
    """The same by DuckDB SQL: every distance of every round, without pivots."""
    squares = f"list_sum([(v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) for i in range(1, {dimensions + 1})])"
    steps = [f"""v as materialized (
  select row_number() over () as r, vec_id, [floor({scale} * e::double)::bigint for e in embedding] as x
  from embeddings where len(embedding) = {dimensions}
   and len([e for e in embedding if e is not null and isfinite(e::double)]) = {dimensions}),
c0 as materialized (
  select row_number() over (order by sha256('{salt}' || coalesce(vec_id::varchar, '')), x) - 1 as k, x
  from v qualify k < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} as materialized (
  select r, vec_id, k, d from (select v.r, v.vec_id, c.k, {squares}::hugeint as d from v, c{n} c)
  qualify row_number() over (partition by r order by d, k) = 1)""")
        if n < rounds:
            steps.append(f"""c{n + 1} as materialized (
  select c.k, coalesce(m.x, c.x) as x from c{n} c left join (
    select k, list((s - ((s % n) + n) % n) // n order by i) as x from (
      select a.k, i, sum(v.x[i]) as s, count(*)::hugeint as n
      from a{n} a join v using (r), range(1, {dimensions + 1}) t(i) group by 1, 2) group by 1) m using (k))""")
    last = f"a{rounds}"
    return f"""with {', '.join(steps)}
select vec_id, k::int as cluster, d::bigint as distance, (sum(d) over (partition by k))::bigint as cluster_inertia,
       (sum(d) over ())::bigint as inertia,
       sha256(array_to_string([e::bigint for e in c.x], ',')) as centroid_sha256
from {last} join c{rounds} c using (k)"""
