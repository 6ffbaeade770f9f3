import math

from pyspark.sql import functions as F

import pytest

from scorekit.operators.responses import batch_results, parse_responses

FENCED = '```json\n[{"unique_id": 1, "score": 85, "remarks": "good"}]\n```'
CASES = [
    ("fenced list", FENCED, "ok", [("1", 85.0, "good")]),
    ("plain fence", '```\n[{"unique_id": "2", "score": "70", "remarks": "x"}]```', "ok", [("2", 70.0, "x")]),
    ("plain list", '  [{"unique_id": 3, "score": 1.5, "remarks": "r"}]  ', "ok", [("3", 1.5, "r")]),
    ("bare object", '{"unique_id": 1, "score": 5, "remarks": "r"}', "not_list", []),
    ("truncated", '[{"unique_id": 1, "score": ', "invalid_json", []),
    ("prose", "Here are the scores you asked for.", "invalid_json", []),
    ("trailing text", "[] extra", "invalid_json", []),
    ("two values", "[1] [2]", "invalid_json", []),
    ("extra bracket", '[{"unique_id": 1, "score": 5, "remarks": "r"}]]', "invalid_json", []),
    ("empty list", "[]", "ok", []),
    ("number element", '[7, {"unique_id": 4, "score": 9, "remarks": "r"}]', "ok", [("4", 9.0, "r")]),
    ("missing key", '[{"unique_id": 5, "score": 9}]', "ok", []),
    ("null remarks", '[{"unique_id": 6, "score": 9, "remarks": null}]', "ok", [("6", 9.0, None)]),
    ("null score", '[{"unique_id": 7, "score": null, "remarks": "r"}]', "ok", []),
    ("repeated key", '[{"unique_id": 8, "score": 1, "score": 2, "remarks": "r"}]', "ok", [("8", 2.0, "r")]),
    ("float id", '[{"unique_id": 9.0, "score": 1, "remarks": "r"}]', "ok", [("9", 1.0, "r")]),
    ("scalar", "42", "not_list", []),
    ("empty text", "", "invalid_json", []),
]


def _run(spark, text):
    df = spark.createDataFrame([(1, "unique_id", text)],
                               "batch_id long, unique_identifier_column string, response string")
    parsed = parse_responses(df)
    outcome = parsed.select("outcome").first()[0]
    got = [(r.unique_id, r.score, r.remarks) for r in batch_results(parsed).collect()]
    return outcome, got


@pytest.mark.parametrize("label,text,outcome,expected", CASES, ids=[c[0] for c in CASES])
def test_response_fixture(spark, label, text, outcome, expected):
    assert _run(spark, text) == (outcome, expected)


@pytest.mark.parametrize("value,expected", [
    ("85", 85.0), ('" 85 "', 85.0), ("true", 1.0), ("false", 0.0), ('"inf"', math.inf),
    ('"1e3"', 1000.0), ("12.5", 12.5), ("900", 900.0), ("-5", -5.0),  # 0-500 is not enforced
])
def test_scores_accepted(spark, value, expected):
    text = f'[{{"unique_id": 1, "score": {value}, "remarks": "r"}}]'
    assert _run(spark, text)[1] == [("1", expected, "r")]


@pytest.mark.parametrize("value", ['"85%"', "null", "[85]", '"85d"', '"1_000"', '{"a": 1}', '"true"'])
def test_scores_dropped(spark, value):
    text = f'[{{"unique_id": 1, "score": {value}, "remarks": "r"}}]'
    assert _run(spark, text) == ("ok", [])


def test_nan_text_kept_until_ranking(spark):
    outcome, got = _run(spark, '[{"unique_id": 1, "score": "nan", "remarks": "r"}]')
    assert outcome == "ok" and math.isnan(got[0][1])


def test_failed_call_outcome_is_kept(spark):
    df = spark.createDataFrame([(1, "unique_id", None, "api_error")],
                               "batch_id long, unique_identifier_column string, response string, outcome string")
    assert parse_responses(df).first().outcome == "api_error"


@pytest.mark.parametrize("raw,expected", [
    ("```", ""), ("``````", ""), ("x``````", "x```"), ("```json```", ""), ("  ```json  ", ""),
    ("``` ```", ""), ("```JSON\n[1]```", "JSON\n[1]"), ("\n```json\n[1]\n```\n", "[1]"),
    ("a ``` b", "a ``` b"), ("[1]\n```", "[1]"), ("　[1]　", "[1]"),
])
def test_clean_response_like_strip_and_fences(spark, raw, expected):
    from scorekit.functions.text import clean_response
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(clean_response(F.col("t"))).first()[0] == expected
