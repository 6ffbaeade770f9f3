import math

from pyspark.sql import functions as F

from scorekit.operators.numbering import assign_ids, dense_rank_scores
from scorekit.operators.reports import analyzed_count
from scorekit.operators.results import merge_results, reconcile_ids, sort_final, unscored

from conftest import SF01, rows


def test_dense_rank_fixture(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", math.inf), ("c", 3.0), ("d", 3.0), ("e", math.nan)],
                               "unique_id string, score double")
    assert rows(dense_rank_scores(df), "unique_id", "rank") == [("a", 2), ("b", 1), ("c", 3), ("d", 3)]


def test_ids_contiguous_after_shuffle(spark):
    # input whose partition contents come from a shuffle: ids must still be exactly 1..n
    lines = spark.read.parquet(f"{SF01}/lineitem.parquet").repartition(13, "l_partkey")
    keyed = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    out = assign_ids(keyed, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"],
                     partitions=11)
    s = out.agg(F.min("unique_id"), F.max("unique_id"), F.count_distinct("unique_id"),
                F.count("*")).first()
    n = lines.count()
    assert tuple(s) == (1, n, n, n)


def test_ids_follow_order(spark):
    df = spark.range(0, 500).select((F.col("id") * 7 % 500).alias("k"))
    out = assign_ids(df, "k", partitions=4)
    assert all(r.unique_id == r.k + 1 for r in out.collect())


def test_ids_overwrite_existing_column(spark):
    df = spark.createDataFrame([(5, "x"), (6, "y")], "unique_id long, k string")
    out = assign_ids(df, "k")
    assert out.columns == ["unique_id", "k"]
    assert rows(out) == [(1, "x"), (2, "y")]


def test_merge_fixture_fanout_defaults(spark):
    base = spark.createDataFrame([(1, "p"), (2, "q")], "unique_id long, name string")
    res = spark.createDataFrame([("1", 10.0, "a"), ("1", 20.0, "b"), ("9", 30.0, "c")],
                                "unique_id string, score double, remarks string")
    out = merge_results(base, res)
    assert dict(out.dtypes)["unique_id"] == "bigint"
    got = rows(out, "unique_id", "score", "rank", "remarks")
    # id 9 is ranked (rank 1) but absent from the base; 3 merged rows -> default rank 4
    assert got == [(1, 10.0, 3, "a"), (1, 20.0, 2, "b"), (2, 0.0, 4, "Not analyzed by AI")]


def test_merge_null_remarks_and_text_ids(spark):
    base = spark.createDataFrame([(1,), (7,)], "unique_id long")
    res = spark.createDataFrame([("07", 5.0, "x"), ("1", 6.0, None)],
                                "unique_id string, score double, remarks string")
    got = rows(merge_results(base, res), "unique_id", "score", "remarks")
    assert got == [(1, 6.0, "Not analyzed by AI"), (7, 0.0, "Not analyzed by AI")]


def test_merge_replaces_previous_results_and_fallbacks(spark):
    base = spark.createDataFrame([(1, 99.0, "old", 1)], "unique_id long, score double, remarks string, rank long")
    res = spark.createDataFrame([("1", 5.0, "new")], "unique_id string, score double, remarks string")
    assert rows(merge_results(base, res), "score", "remarks", "rank") == [(5.0, "new", 1)]
    assert merge_results(base, None) is base
    bad = spark.createDataFrame([("1", 5.0)], "unique_id string, score double")
    u = merge_results(base, bad).first()
    assert (u.score, u.remarks, u.rank) == (None, "Error in analysis or merge", None)
    assert unscored(base).columns[-3:] == ["score", "remarks", "rank"]


def test_reconcile_and_analyzed(spark):
    base = spark.createDataFrame([(1,), (2,), (3,)], "unique_id long")
    res = spark.createDataFrame([("1", 1.0, "r"), ("3", 2.0, "r"), ("x", 3.0, "r")],
                                "unique_id string, score double, remarks string")
    r = reconcile_ids(base, res).first()
    assert (r.matched, r.base_only, r.scores_only) == (2, 1, 1)
    final = merge_results(base, res)
    assert analyzed_count(final, res).first()[0] == 2
    assert [x.unique_id for x in sort_final(final).collect()] == [3, 1, 2]


def test_ids_with_coalesced_range_partitions(spark):
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    spark.conf.set(key, "200")        # many tiny range partitions: AQE coalesces them
    try:
        df = spark.range(0, 3000).select(((F.col("id") * 7919) % 3000).alias("k"))
        out = assign_ids(df, "k")
        assert all(r.unique_id == r.k + 1 for r in out.collect())
    finally:
        spark.conf.set(key, before)


def test_ids_come_from_footers_and_the_table_is_scanned_once(spark):
    from pyspark.sql import functions as F
    df = spark.range(0, 3000).select((F.col("id") * 7 % 3000).alias("k"))
    before = spark.conf.get("spark.sql.files.maxRecordsPerFile")
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "70")   # several files to a partition
    try:
        out = assign_ids(df, "k", partitions=5)
    finally:
        spark.conf.set("spark.sql.files.maxRecordsPerFile", before)
    assert all(r.unique_id == r.k + 1 for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and "Window" not in plan


def test_merge_is_written_once_and_warns_when_no_id_matches(spark):
    import warnings
    base = spark.createDataFrame([(1, None), (2, None)], "unique_id long, nothing void")
    scores = spark.createDataFrame([("8", 1.0, "r"), ("9", 2.0, None)], "unique_id string, score double, remarks string")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        out = merge_results(base, scores)
    assert any("nothing is scored" in str(w.message) for w in caught)
    assert rows(out, "unique_id", "score", "rank") == [(1, 0.0, 3), (2, 0.0, 3)] and out.columns[:2] == ["unique_id", "nothing"]
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 1 and "Join" not in plan and "Subquery" not in plan
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        merge_results(base, scores.withColumn("unique_id", scores.score.cast("int").cast("string")))
    assert not any("nothing is scored" in str(w.message) for w in caught)


def test_reconcile_needs_one_exchange_by_id(spark):
    base = spark.createDataFrame([(1,), (1,), (2,), (None,)], "unique_id long")
    scores = spark.createDataFrame([("2",), ("2",), ("3",), ("4",), (None,)], "unique_id string")
    out = reconcile_ids(base, scores)
    assert tuple(out.first()) == (1, 1, 2)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("hashpartitioning") == 1 and "Join" not in plan


def _repeated(spark, n=4000):
    """Half of the scores are one answer for one id; the rest spread over ids, also unknown ones."""
    base = spark.range(1, 41).select(F.col("id").alias("unique_id"), F.concat(F.lit("n"), "id").alias("name"))
    i = F.col("id")
    scores = spark.range(0, n, 1, 4).select(
        F.when(i % 2 == 0, 1).when(i % 7 == 0, F.lit(None)).otherwise(i % 60 + 2).cast("string").alias("unique_id"),
        F.when(i % 2 == 0, 7.0).otherwise(i % 311).cast("double").alias("score"),
        F.when(i % 3 > 0, "r").alias("remarks"))
    return base, scores


def _ids_of_tasks(df):
    return df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()


def test_rows_of_one_id_and_rank_are_sorted_by_several_tasks(spark):
    base, scores = _repeated(spark, 40000)
    keys = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        out = merge_results(base, scores)
        held = [r["count"] for r in _ids_of_tasks(out.where("unique_id = 1"))]
        assert sum(held) == 20000 and max(held) < 10000      # one task held all of them
        got = [(r["rank"], r.unique_id) for r in out.collect()]
        assert got == sorted(got) and out.columns == ["unique_id", "name", "score", "remarks", "rank"]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_frequent_ids_and_scores_are_not_gathered_and_the_merge_is_the_same(spark, monkeypatch):
    from scorekit.operators import _joins, numbering, results

    base, scores = _repeated(spark)
    base = base.unionByName(base.where("unique_id in (1, 3)"))    # repeated ids in the base as well
    whole = rows(merge_results(base, scores))
    monkeypatch.setattr(results, "SPREAD_ROWS", 50)
    monkeypatch.setattr(numbering, "SPREAD_ROWS", 10)
    monkeypatch.setattr(numbering, "BROADCAST_LEVELS", 20)
    used, join = [], _joins.join_frequent

    def noted(many, one, many_key, one_key, frequent):
        used.append(frequent.count())
        return join(many, one, many_key, one_key, frequent)

    monkeypatch.setattr(results, "join_frequent", noted)
    monkeypatch.setattr(numbering, "join_frequent", noted)
    assert rows(merge_results(base, scores)) == whole
    assert len(used) == 2 and min(used) > 0
    monkeypatch.setattr(numbering, "SPREAD_ROWS", 10**6)          # many levels, none frequent
    assert rows(merge_results(base, scores)) == whole


def test_scores_are_not_shuffled_or_broadcast_for_few_ranks(spark):
    out = dense_rank_scores(_repeated(spark)[1])
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "SortMergeJoin" not in plan
