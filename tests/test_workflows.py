import tempfile

from pyspark.sql import functions as F

from local_scorer import field_scorer
from scorekit.plans.workflows import analyze, consolidate, retry, select_and_report
from scorekit.sources.readers import read_sources

from conftest import rows


def test_end_to_end_from_files(spark):
    d = tempfile.mkdtemp(prefix="scorekit-flow-")
    spark.createDataFrame(
        [(10, "Ann", "sql"), (11, "Bob", None), (12, "Cy", "go"), (10, "Ann B", "java")],
        "`Emp Key` long, Name string, Skills string").coalesce(1).write.parquet(f"{d}/a.parquet")
    with open(f"{d}/b.csv", "w") as f:
        f.write("Emp Key,Skills,City!\n11,rust,Oslo\n13,,Rome\n")
    spark.createDataFrame([(12, "rejected")], "`Emp Key` long, status string") \
        .write.parquet(f"{d}/status.parquet")
    sources = read_sources(spark, [f"{d}/a.parquet", f"{d}/b.csv"])
    status = read_sources(spark, [f"{d}/status.parquet"], with_order=False)[0]
    c = consolidate(sources, dedupe="key", key="Emp Key", status=status, status_key="Emp Key",
                    columns=["Skills", "City"])
    base = c.base
    assert rows(base, "Emp Key", "Name", "Skills", "City", "unique_id") == [
        ("10", "Ann", "sql", None, 1), ("11", "Bob", "rust", "Oslo", 2), ("13", None, None, "Rome", 3)]
    r = c.report.first()
    assert (r.rows_in, r.merged, r.removed, r.rows_out) == (6, 2, 1, 3)
    assert c.scoring_view.columns == ["Skills", "City", "unique_id"]

    scorer = field_scorer("unique_id", factor=10, modulus=1000, fail_every=2)
    a = analyze(base, c.scoring_view, scorer, "Engineer", batch_size=1)
    got = rows(a.final, "unique_id", "score", "rank")
    assert got == [(1, 10.0, 2), (2, 0.0, 4), (3, 30.0, 1)]
    assert rows(a.failed.select("batch_id")) == [(2,)]

    b = retry(a, base, field_scorer("unique_id", factor=10, modulus=1000), "Engineer")
    assert rows(b.final, "unique_id", "score", "rank") == [(1, 10.0, 3), (2, 20.0, 2), (3, 30.0, 1)]
    assert b.failed.count() == 0

    chosen, summary = select_and_report(b.final, lo=15)
    assert chosen.columns[:4] == ["rank", "score", "unique_id", "remarks"]
    s = summary.first()
    assert (s.n, s.min_score, s.max_score) == (2, 20.0, 30.0)


def test_rows_dedupe_and_no_status(spark):
    df = spark.createDataFrame([("x", 2), ("y", 1), ("x", 3), ("y", 1)], "a string, o long")
    c = consolidate([df], dedupe="rows", order_by="o")
    # the order column is part of the row: (x, 2) and (x, 3) differ
    assert rows(c.base.select("a", "o", "unique_id")) == [("x", 2, 2), ("x", 3, 3), ("y", 1, 1)]
    assert c.report.select("merged").first()[0] == 1


def test_wrong_dedupe_and_unknown_key(spark):
    import warnings

    import pytest
    df = spark.createDataFrame([("x", 1), ("x", 1)], "a string, o long")
    with pytest.raises(ValueError):
        consolidate([df], dedupe="row", order_by="o")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        c = consolidate([df], dedupe="key", key="zzz", order_by="o")
    assert any("zzz" in str(w.message) for w in caught)
    assert c.base.count() == 2


def test_every_scoring_view_is_guarded(spark):
    import pytest

    from scorekit.errors import SensitiveColumnError
    df = spark.createDataFrame([("x", "1", 1)], "a string, `Phone Number` string, o long")
    with pytest.raises(SensitiveColumnError):
        consolidate([df], dedupe=None, order_by="o")
    c = consolidate([df], dedupe=None, order_by="o", columns=["a"])
    with pytest.raises(SensitiveColumnError):
        analyze(c.base, c.base, field_scorer("o"), "r")


def test_final_table_is_in_rank_order_and_written_so(spark, tmp_path):
    from scorekit.operators.results import merge_results
    from scorekit.sources.writers import write_results
    base = spark.range(1, 400).withColumnRenamed("id", "unique_id")
    scores = spark.range(1, 300).select(F.col("id").alias("unique_id"), (F.col("id") * 37 % 50).cast("double").alias("score"),
                                        F.lit("r").alias("remarks"))
    final = merge_results(base, scores)
    got = [(r["rank"], r["unique_id"]) for r in final.collect()]
    assert got == sorted(got)
    chosen, _ = select_and_report(final, lo=10)
    ranks = [r["rank"] for r in chosen.collect()]
    assert ranks == sorted(ranks)
    path = write_results(final.repartition(5), str(tmp_path), fmt="csv", prefix="run_")
    import glob
    lines = [x.split(",") for f in sorted(glob.glob(path + "/part-*")) for x in open(f).read().splitlines()[1:]]
    ranks = [int(x[-1]) for x in lines]
    assert ranks == sorted(ranks) and len(ranks) == 399


def test_consolidate_needs_an_order(spark):
    import pytest
    df = spark.createDataFrame([("x",)], "a string")
    with pytest.raises(ValueError):
        consolidate([df], dedupe=None)


def test_consolidate_without_dedupe_keeps_duplicates(spark):
    df = spark.createDataFrame([("x", 2), ("x", 1)], "a string, o long")
    st = spark.createDataFrame([("y",)], "a string")
    c = consolidate([df], dedupe=None, status=st, status_key="a", order_by="o")
    assert rows(c.base.select("a", "o", "unique_id")) == [("x", 1, 1), ("x", 2, 2)]
    r = c.report.first()
    assert (r.rows_in, r.merged, r.removed, r.rows_out) == (2, 0, 0, 2)


def test_nothing_scored_keeps_base_and_selects_nothing(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "a string, o long")
    c = consolidate([df], dedupe=None, order_by="o")
    a = analyze(c.base, c.scoring_view, field_scorer("o", fail_every=1), "r")
    assert a.final.columns == c.base.columns            # base unchanged
    assert a.failed.count() == 1                        # one batch holds both rows
    chosen, summary = select_and_report(a.final, lo=0)
    assert chosen.count() == 0 and summary.first().n == 0
    b = retry(a, c.base, field_scorer("o"), "r")         # retry scores both
    assert rows(b.final.select("a", "score")) == [("x", 37.0), ("y", 74.0)]
    again = retry(b, c.base, field_scorer("o"), "r")     # nothing left to retry
    assert again.failed.count() == 0 and again.final.count() == 2
