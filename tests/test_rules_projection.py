import pytest

from scorekit.errors import SensitiveColumnError
from scorekit.functions.rules import is_sensitive
from scorekit.operators.projection import (
    display_columns,
    drop_result_columns,
    filter_score_range,
    ranked_only,
    scoring_projection,
    select_valid,
)

from conftest import rows


@pytest.mark.parametrize("name", ["Phone", "Employee  ID", "EmployeeID", "Contacts", "c_phone",
                                  "Mobile Number"])
def test_sensitive_names(name):
    assert is_sensitive(name)


@pytest.mark.parametrize("name", ["employee_id", "Email", "emp id", "o_custkey"])
def test_not_sensitive_names(name):
    assert not is_sensitive(name)


def test_select_valid_skips_unknown_keeps_order(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, unique_id int")
    assert select_valid(df, ["b", "zz", "a"]).columns == ["b", "a"]
    assert select_valid(df, ["b"], always=["unique_id"]).columns == ["b", "unique_id"]


def test_scoring_projection_guard(spark):
    df = spark.createDataFrame([(1, "x", "555", 1)], "a int, name string, `Phone` string, unique_id int")
    assert scoring_projection(df, ["name"]).columns == ["name", "unique_id"]
    with pytest.raises(SensitiveColumnError) as e:
        scoring_projection(df, ["name", "Phone"])
    assert e.value.columns == ["Phone"]


def test_filters_and_display(spark):
    df = spark.createDataFrame(
        [(1, 0.0, None, "n/a", "s1", "x"), (2, 10.0, 1, "good", "s2", "y"), (3, 20.0, 2, "ok", "s3", "z")],
        "unique_id int, score double, rank int, remarks string, data_source string, other string")
    assert rows(filter_score_range(df, hi=10), "unique_id") == [(1,), (2,)]
    assert rows(filter_score_range(df, lo=10, hi=20), "unique_id") == [(2,), (3,)]
    r = ranked_only(df)
    assert dict(r.dtypes)["rank"] == "bigint" and r.count() == 2
    assert display_columns(df).columns == ["rank", "score", "unique_id", "remarks", "other"]
    assert drop_result_columns(df).columns == ["unique_id", "data_source", "other"]


def test_names_in_a_table_follow_the_same_rule(spark):
    from pyspark.sql import functions as F

    from scorekit.functions.rules import is_sensitive, sensitive_name
    names = ["Phone", "my MOBILE no", "Contact  Number", "EmployeeNumber", "employee id", "employee id", "Employee", "skills", "id", ""]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    got = df.withColumn("bad", sensitive_name(F.col("name"))).collect()
    assert {r.name: r.bad for r in got} == {**{n: is_sensitive(n) for n in names}, None: False}
