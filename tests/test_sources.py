import json
import os
import tempfile
import warnings
from datetime import datetime

import pytest

from scorekit.errors import DuplicateColumnError
from scorekit.functions.constants import ORDER_COL
from scorekit.functions.text import normalize_header
from scorekit.sources.readers import normalize_headers, read_sources, read_status
from scorekit.sources.writers import write_results


@pytest.mark.parametrize("raw,expected", [
    (" Emp-ID ", "EmpID"), ("Name !", "Name "), ("x_y", "x_y"), ("Né#", "Né"), (5, "5"),
])
def test_header_rule(raw, expected):
    assert normalize_header(raw) == expected


def test_normalize_headers_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, ab int")
    with pytest.raises(DuplicateColumnError):
        normalize_headers(df)


def test_normalize_headers_keeps_data(spark):
    df = spark.createDataFrame([(1, "x")], "` Emp-ID ` int, `Name !` string")
    out = normalize_headers(df)
    assert out.columns == ["EmpID", "Name "]
    assert out.collect()[0] == (1, "x")


def test_read_sources_mixed_formats(spark):
    d = tempfile.mkdtemp(prefix="scorekit-src-")
    spark.createDataFrame([(1, "a"), (2, "b")], "id long, `Full Name!` string") \
        .coalesce(1).write.parquet(f"{d}/one.parquet")
    with open(f"{d}/two.csv", "w") as f:
        f.write("id,Skill-Set\n3,sql\n4,java\n")
    with open(f"{d}/three.json", "w") as f:
        f.write(json.dumps({"id": 5, "City": "Oslo"}) + "\n")
    spark.createDataFrame([], "id long").write.parquet(f"{d}/empty.parquet")
    spark.createDataFrame([(6, "x")], "id long, `Note?` string").write.orc(f"{d}/four.orc")
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        frames = read_sources(spark, [f"{d}/one.parquet", f"{d}/two.csv", f"{d}/missing.parquet",
                                      f"{d}/three.json", f"{d}/empty.parquet", f"{d}/four.orc"])
    assert any("skipped source" in str(w.message) for w in caught)
    assert len(frames) == 4
    assert frames[3].columns == ["id", "Note", ORDER_COL]
    assert frames[0].columns == ["id", "Full Name", ORDER_COL]
    assert frames[1].columns == ["id", "SkillSet", ORDER_COL]
    srcs = [f.select(f"{ORDER_COL}.source").first()[0] for f in frames]
    assert srcs == [0, 1, 3, 5]
    rows = frames[0].orderBy(f"{ORDER_COL}.row").select("id").collect()
    assert [r.id for r in rows] == [1, 2]


def test_unsupported_extension_is_reported(spark):
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert read_sources(spark, ["/nowhere/file.xlsx"]) == []
    assert any("no reader for" in str(w.message) for w in caught)


def test_read_status_first_source(spark):
    d = tempfile.mkdtemp(prefix="scorekit-st-")
    spark.createDataFrame([("7",)], "id string").write.parquet(f"{d}/s.parquet")
    st = read_status(spark, [f"{d}/s.parquet"])
    assert st.columns == ["id"] and st.count() == 1


def test_write_results_timestamped(spark):
    d = tempfile.mkdtemp(prefix="scorekit-out-")
    df = spark.createDataFrame([(1, 2.0)], "unique_id long, score double")
    path = write_results(df, d, "csv", now=datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("complete_candidate_analysis_20240102_030405")
    assert os.path.isdir(path)
    back = spark.read.option("header", "true").csv(path)
    assert back.collect()[0]["unique_id"] == "1"
    with pytest.raises(Exception):
        write_results(df, d, "csv", now=datetime(2024, 1, 2, 3, 4, 5))


def test_checkpoint_root_reads_session_setting(spark):
    from scorekit.session import checkpoint_root, materialize

    root = checkpoint_root(spark)
    assert root
    df = materialize(spark.range(3), "probe")
    assert df.count() == 3 and root.replace("file:", "") in df.inputFiles()[0].replace("file:", "")


def test_file_order_does_not_depend_on_the_place(spark, tmp_path):
    from scorekit.functions.constants import ORDER_COL
    from scorekit.operators.dedupe import merge_by_key
    from scorekit.operators.numbering import assign_ids
    from scorekit.sources.readers import read_sources

    seen = set()
    for place in ("one", "two/deeper", "a b"):
        folder = tmp_path / place / "src.parquet"
        folder.mkdir(parents=True)
        for n in (10, 2, 1, 0):
            spark.createDataFrame([("k", f"v{n}")], "k string, v string").coalesce(1).write.parquet(str(tmp_path / place / "w"), mode="overwrite")
            [part] = (tmp_path / place / "w").glob("part-*.parquet")
            part.rename(folder / f"part-{n}.parquet")
        df = read_sources(spark, [str(folder)])[0]
        ids = tuple(r.v for r in assign_ids(df, ORDER_COL).orderBy("unique_id").collect())
        seen.add((ids, merge_by_key(df, "k").first().v))
    assert seen == {(("v0", "v1", "v2", "v10"), "v0")}


def test_csv_without_a_schema_is_text(spark, tmp_path):
    from scorekit.sources.readers import read_sources
    (tmp_path / "a.csv").write_text("Id,Note\n007,x\n")
    df = read_sources(spark, [str(tmp_path / "a.csv")], with_order=False)[0]
    assert df.first().Id == "007"


def test_written_tables_can_be_deleted(spark, tmp_path):
    from scorekit.session import delete_tables, materialize
    made = materialize(spark.range(5), "gone")
    other = spark.range(5)
    other.write.parquet(str(tmp_path / "kept.parquet"))
    kept = spark.read.parquet(str(tmp_path / "kept.parquet"))
    files = made.inputFiles()
    delete_tables(spark, made, kept)
    import os
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert spark.read.parquet(str(tmp_path / "kept.parquet")).count() == 5


def _part_files(folder, n):
    return sorted(folder.glob("part-*"), key=str)[:n]


@pytest.mark.parametrize("fmt", ["parquet", "orc"])
def test_one_garbage_file_of_four_goes_and_three_stay(spark, tmp_path, fmt):
    from scorekit.sources.readers import read_intake
    folder = tmp_path / f"s.{fmt}"
    spark.range(400).repartition(4).write.format(fmt).save(str(folder))
    victim = _part_files(folder, 4)[0]
    lost = spark.read.format(fmt).load(str(victim)).count()
    victim.write_bytes(b"no table at all" * 40)
    (folder / f".{victim.name}.crc").unlink()
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        got = read_intake(spark, [str(folder)])
    assert any("cannot be read" in str(w.message) for w in caught)
    assert got.sources[0].count() == 400 - lost > 0
    [bad] = got.bad_files.collect()
    assert bad.source == 0 and bad.path.endswith(victim.name) and bad.bytes == 600 and bad.reason
    assert got.bad_rows.count() == 0


def test_empty_files_are_no_bad_files_and_a_source_of_bad_files_only_is_empty(spark, tmp_path):
    from scorekit.sources.readers import read_intake
    good, bad = tmp_path / "good.parquet", tmp_path / "bad.parquet"
    spark.range(3).repartition(1).write.parquet(str(good))
    spark.range(0).write.mode("append").parquet(str(good))
    bad.mkdir()
    (bad / "x[1].parquet").write_bytes(b"PAR1 broken")
    (bad / "y.parquet").write_bytes(b"PAR1")
    (good / "a.parquet").write_bytes(b"")    # nothing in it: as good as no file
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = read_intake(spark, [str(bad), str(good)])
    assert got.numbers == [1] and got.sources[0].count() == 3
    assert sorted(r.path.split("/")[-1] for r in got.bad_files.collect()) == ["x[1].parquet", "y.parquet"]


def test_a_storage_error_fails_the_read(spark, tmp_path, monkeypatch):
    from scorekit.sources import quarantine
    folder = tmp_path / "s.parquet"
    spark.range(8).repartition(2).write.parquet(str(folder))
    victim = _part_files(folder, 2)[0]
    whole = victim.read_bytes()
    victim.write_bytes(whole[:-20])          # its checksum no longer fits: the storage layer refuses it
    with pytest.raises(Exception, match="(?i)checksum"):
        read_sources(spark, [str(folder)])
    victim.write_bytes(whole)
    assert read_sources(spark, [str(folder)])[0].count() == 8   # the error passed: nothing is left out
    monkeypatch.setattr(quarantine, "MAX_SUSPECTS", 0)
    (folder / "part-9.parquet").write_bytes(b"garbage")
    with pytest.raises(quarantine.SourceError):
        read_sources(spark, [str(folder)])


def test_rows_that_do_not_fit_are_rejects(spark, tmp_path):
    from scorekit.operators.reports import consolidation_report
    from scorekit.sources.readers import read_intake
    (tmp_path / "a.csv").write_text("id,name\n1,a\nzz,b\n3,c,d,e\n4\n5,\n")
    (tmp_path / "b.json").write_text('{"id": 1, "n": 2}\n{"id": "x", "n": 3}\nno json\n{"id": 4}\n')
    (tmp_path / "c.csv").write_text("x,y\n1,2\n3,4,5\n")
    got = read_intake(spark, [{"path": str(tmp_path / "a.csv"), "schema": "id bigint, name string"},
                              {"path": str(tmp_path / "b.json"), "schema": "id bigint, n bigint"}, str(tmp_path / "c.csv")])
    assert [r.id for r in got.sources[0].collect()] == [1, 5]
    assert [r.id for r in got.sources[1].select("id").collect()] == [1, 4]      # whatever columns are read
    assert got.sources[1].where("id = 4").select("n").first().n is None
    assert got.sources[2].count() == 1
    rejects = sorted((r.source, r.path.split("/")[-1], r.row) for r in got.bad_rows.collect())
    assert rejects == [(0, "a.csv", "3,c,d,e"), (0, "a.csv", "4"), (0, "a.csv", "zz,b"),
                       (1, "b.json", "no json"), (1, "b.json", '{"id": "x", "n": 3}'), (2, "c.csv", "3,4,5")]
    report = consolidation_report(got.sources[0], intake=got).first()
    assert (report.rows_in, report.bad_files, report.bad_rows) == (2, 0, 6)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        read_sources(spark, [{"path": str(tmp_path / "a.csv"), "schema": "id bigint, name string"}])
    assert any("do not fit" in str(w.message) for w in caught)
    only_bad = read_intake(spark, [{"path": str(tmp_path / "c.csv"), "schema": "x date, y date"}])
    assert only_bad.sources == [] and only_bad.bad_rows.count() == 2


def test_lines_keep_file_order(spark, tmp_path):
    from scorekit.operators.numbering import assign_ids
    folder = tmp_path / "lines.csv"
    folder.mkdir()
    for n in (10, 9, 1):
        (folder / f"p{n}.csv").write_text("v\n" + "".join(f"{n}-{i}\n" for i in range(30)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    try:
        df = read_sources(spark, [str(folder)])[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = [r.v for r in assign_ids(df, ORDER_COL).orderBy("unique_id").collect()]
    assert got == [f"{n}-{i}" for n in (1, 9, 10) for i in range(30)]


def test_file_order_key_sorts_naturally_and_needs_no_join(spark, tmp_path):
    from pyspark.sql import functions as F

    from scorekit.sources.readers import file_order_key
    names = ["f:/b/p1", "f:/b/p2", "f:/b/p10", "f:/b/p010x", "f:/b/q/1", "f:/b/p" + "9" * 40]
    df = spark.createDataFrame([(n,) for n in names[::-1]], "p string")
    got = [r.p for r in df.orderBy(file_order_key(F.col("p"), "/b")).collect()]
    assert got == ["f:/b/p1", "f:/b/p2", "f:/b/p10", "f:/b/p010x", "f:/b/p" + "9" * 40, "f:/b/q/1"]
    keys = df.select(file_order_key(F.col("p"), "/b").alias("k")).distinct().count()
    assert keys == len(names)
    spark.range(9).repartition(3).write.parquet(str(tmp_path / "s.parquet"))
    plan = read_sources(spark, [str(tmp_path / "s.parquet")])[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
