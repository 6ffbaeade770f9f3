import warnings

import pytest

from scorekit.errors import DuplicateColumnError
from scorekit.functions.constants import ORDER_COL
from scorekit.operators.dedupe import drop_duplicate_rows, merge_by_key
from scorekit.operators.reports import consolidation_report
from scorekit.operators.status import exclude_by_status
from scorekit.operators.union import column_universe, union_sources

from conftest import rows


def test_union_conflicting_types_become_text(spark):
    a = spark.createDataFrame([(1, "p")], "id long, x string")
    b = spark.createDataFrame([("E7", True)], "id string, y boolean")
    u = union_sources([a, b])
    assert u.columns == ["id", "x", "y"]
    assert dict(u.dtypes)["id"] == "string"
    assert rows(u) == [("1", "p", None), ("E7", None, True)]


def test_union_numeric_widening(spark):
    a = spark.createDataFrame([(1,)], "v int")
    b = spark.createDataFrame([(2.5,)], "v double")
    u = union_sources([a, b])
    assert dict(u.dtypes)["v"] == "double"


def test_union_case_only_names(spark):
    a = spark.createDataFrame([("x",)], "Name string")
    b = spark.createDataFrame([("y",)], "name string")
    assert column_universe([a, b]) == ["Name", "name"]
    u = union_sources([a, b])  # the test session is case-sensitive
    assert u.columns == ["Name", "name"]
    spark.conf.set("spark.sql.caseSensitive", "false")
    try:
        with pytest.raises(DuplicateColumnError):
            union_sources([a, b])
    finally:
        spark.conf.set("spark.sql.caseSensitive", "true")


def _merge_fixture(spark):
    return spark.createDataFrame(
        [("b", None, "x", 0), ("b", 1, None, 1), ("a", 2, "y", 2), (None, 9, "z", 3)],
        "k string, v int, s string, o int")


def test_merge_first_non_missing_per_column(spark):
    m = merge_by_key(_merge_fixture(spark), "k", order_by="o")
    assert m.columns[0] == "k"
    assert rows(m, "k", "v", "s") == [("a", 2, "y"), ("b", 1, "x")]


def test_merge_report_counts_null_key_as_merged(spark):
    x = _merge_fixture(spark)
    m = merge_by_key(x, "k", order_by="o")
    r = consolidation_report(x, m, key="k").first()
    assert (r.rows_in, r.merged, r.null_key, r.removed, r.rows_out) == (4, 2, 1, 0, 2)


def test_merge_treats_nan_as_missing(spark):
    df = spark.createDataFrame([(1, float("nan"), 0), (1, 3.0, 1)], "k int, v double, o int")
    assert merge_by_key(df, "k", "o").first().v == 3.0


def test_merge_missing_key_column_warns(spark):
    df = _merge_fixture(spark)
    with warnings.catch_warnings(record=True) as caught:
        warnings.simplefilter("always")
        assert merge_by_key(df, "nope", "o") is df
    assert caught


def test_distinct_missing_equals_missing(spark):
    df = spark.createDataFrame([(None, 1), (None, 1)], "a string, b int")
    assert drop_duplicate_rows(df).count() == 1


def test_distinct_keeps_first_order(spark):
    df = spark.createDataFrame([("x", 5), ("x", 2), ("y", 1)], "a string, o int")
    df = df.withColumnRenamed("o", ORDER_COL)
    assert rows(drop_duplicate_rows(df)) == [("x", 2), ("y", 1)]


def test_status_null_safe_text_match(spark):
    df = spark.createDataFrame([("1",), ("2",), (None,), ("nan",)], "id string")
    st = spark.createDataFrame([("2", "hired"), (None, "x")], "id string, status string")
    assert rows(exclude_by_status(df, st, "id")) == [("1",), ("nan",)]


def test_status_without_null_keeps_missing(spark):
    df = spark.createDataFrame([("1",), (None,)], "id string")
    st = spark.createDataFrame([("1",)], "id string")
    assert rows(exclude_by_status(df, st, "id")) == [(None,)]


def test_status_integral_float_matches_int_text(spark):
    df = spark.createDataFrame([(101.0,), (102.5,), (7.0,)], "id double")
    st = spark.createDataFrame([(101,), (8,)], "id long")
    out = exclude_by_status(df, st, "id")
    assert dict(out.dtypes)["id"] == "string"
    assert rows(out) == [("102.5",), ("7",)]


def test_status_missing_column_unchanged(spark):
    df = spark.createDataFrame([("1",)], "id string")
    st = spark.createDataFrame([("1",)], "other string")
    with warnings.catch_warnings(record=True):
        warnings.simplefilter("always")
        assert exclude_by_status(df, st, "id") is df
    assert exclude_by_status(df, None, "id") is df


def test_status_integer_keys_join_as_longs(spark):
    df = spark.createDataFrame([(1,), (2,), (None,), (3,)], "id int")
    st = spark.createDataFrame([(2,), (None,)], "id long")
    out = exclude_by_status(df, st, "id")
    assert dict(out.dtypes)["id"] == "string"
    assert rows(out) == [("1",), ("3",)]
    st2 = spark.createDataFrame([(2,)], "id long")
    assert rows(exclude_by_status(df, st2, "id")) == [(None,), ("1",), ("3",)]


def test_common_types_lose_nothing():
    from pyspark.sql import types as T

    from scorekit.operators.union import common_type
    ddl = lambda t: T._parse_datatype_string(t) if t != "void" else T.NullType()
    for a, b, want in [
            ("tinyint", "bigint", "bigint"), ("int", "double", "double"), ("short", "float", "float"), ("int", "float", "double"),
            ("bigint", "double", "string"), ("bigint", "float", "string"), ("float", "double", "double"),
            ("decimal(10,2)", "decimal(8,4)", "decimal(12,4)"), ("decimal(10,2)", "bigint", "decimal(21,2)"),
            ("decimal(38,0)", "decimal(38,10)", "string"), ("decimal(5,2)", "double", "string"),
            ("date", "timestamp", "timestamp"), ("date", "timestamp_ntz", "timestamp_ntz"), ("date", "bigint", "string"),
            ("void", "int", "int"), ("boolean", "int", "string"), ("array<int>", "array<bigint>", "array<bigint>"),
            ("map<string,int>", "map<string,date>", "map<string,string>"), ("map<string,int>", "map<int,int>", "string"),
            ("struct<a:int,b:date>", "struct<b:timestamp,c:string>", "struct<a:int,b:timestamp,c:string>"),
            ("struct<a:int>", "int", "string")]:
        assert common_type(ddl(a), ddl(b)) == ddl(want) and common_type(ddl(a), ddl(a)) == ddl(a), (a, b)
        both = common_type(ddl(b), ddl(a))
        assert both == ddl(want) or isinstance(both, T.StructType) and set(both.names) == set(ddl(want).names), (a, b)


def test_union_keeps_digits_and_nested_fields(spark):
    from pyspark.sql import functions as F

    from scorekit.operators.union import union_sources
    a = spark.sql("select 9007199254740993 as v, named_struct('x', 1, 'y', 'p') as s, array(1) as l, map('k', 1) as m, date'2024-02-03' as d, null as n")
    b = spark.sql("select 1.5D as v, named_struct('z', 2.5D, 'x', 3000000000) as s, array(2.5D) as l, map('j', 'w') as m, timestamp'2024-02-03 04:05:06' as d, 7 as n")
    c = b.select(F.lit(101.0).alias("v"), F.lit(None).cast("struct<x:bigint>").alias("s"))
    got = union_sources([a, b, c]).collect()
    assert [r.v for r in got] == ["9007199254740993", "1.5", "101"]
    assert got[0].s.asDict() == {"x": 1, "y": "p", "z": None} and got[1].s.asDict() == {"x": 3000000000, "y": None, "z": 2.5}
    assert got[2].s is None and got[2].l is None
    assert got[0].l == [1.0] and got[1].l == [2.5] and got[0].m == {"k": "1"} and got[1].m == {"j": "w"}
    assert str(got[0].d) == "2024-02-03 00:00:00" and [r.n for r in got] == [None, 7, None]


def test_schema_profile(spark):
    from scorekit.operators.union import schema_profile, union_sources
    a = spark.createDataFrame([(1, 2.0, "x"), (2, float("nan"), None)], "k long, v double, `Employee ID` string")
    b = spark.createDataFrame([("p", None)], "v string, other date")
    got = {r.name: r for r in schema_profile([a, b]).collect()}
    assert [(r.position, r.sources, r.types, r.present, r.common_type, r.sensitive) for r in sorted(got.values(), key=lambda r: r.position)] == [
        (0, [0], ["bigint"], 2, "bigint", False), (1, [0, 1], ["double", "string"], 2, "string", False),
        (2, [0], ["string"], 1, "string", True), (3, [1], ["date"], 0, "date", False)]
    assert {f.name: f.dataType.simpleString() for f in union_sources([a, b]).schema} == {n: r.common_type for n, r in got.items()}
    assert schema_profile([a.where("false"), b.limit(0)]).where("present = 0").count() == 4
