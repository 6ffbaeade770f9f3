"""Property checks against definitions and brute force on small random fixtures: ids are
exactly 1..n in order; dense rank; merge by key = pandas first(); exclusion = set membership;
full-row distinct = pandas drop_duplicates; union = pandas concat; answers = Python json."""

import math
import os

from hypothesis import given, settings
from hypothesis import strategies as st

from scorekit.operators.numbering import assign_ids, dense_rank_scores


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-1000, 1000), min_size=1, max_size=60, unique=True),
       st.integers(1, 6))
def test_ids_are_contiguous_in_order(spark, keys, parts):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = sorted((r.unique_id, r.k) for r in assign_ids(df, "k", partitions=parts).collect())
    assert [i for i, _ in got] == list(range(1, len(keys) + 1))
    assert [k for _, k in got] == sorted(keys)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.one_of(st.floats(allow_nan=True, allow_infinity=True, width=32),
                          st.sampled_from([0.0, 1.0, 5.0])), min_size=1, max_size=60))
def test_dense_rank_matches_definition(spark, scores):
    df = spark.createDataFrame([(i, float(s)) for i, s in enumerate(scores)], "i long, score double")
    got = {r.i: r.rank for r in dense_rank_scores(df).collect()}
    levels = sorted({s for s in scores if not math.isnan(s)}, reverse=True)
    want = {i: levels.index(s) + 1 for i, s in enumerate(scores) if not math.isnan(s)}
    assert got == want


_KEYS = st.sampled_from(["a", "b", "c", None])
_VALS = st.one_of(st.none(), st.integers(-5, 5))
_TEXT = st.one_of(st.none(), st.sampled_from(["x", "y", "z"]))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(_KEYS, _VALS, _TEXT), min_size=1, max_size=40))
def test_merge_by_key_matches_pandas_first(spark, records):
    import pandas as pd

    from scorekit.operators.dedupe import merge_by_key

    rows = [(k, v, s, i) for i, (k, v, s) in enumerate(records)]
    df = spark.createDataFrame(rows, "k string, v int, s string, o int")
    got = {r.k: (r.v, r.s) for r in merge_by_key(df, "k", order_by="o").collect()}
    pdf = pd.DataFrame(rows, columns=["k", "v", "s", "o"])
    first = pdf.drop(columns="o").groupby("k").first()      # skips missing values per column
    want = {k: (None if pd.isna(r.v) else int(r.v), None if pd.isna(r.s) else r.s)
            for k, r in first.iterrows()}
    assert got == want


@settings(max_examples=8, deadline=None)
@given(st.lists(_KEYS, min_size=1, max_size=30), st.lists(_KEYS, max_size=10))
def test_exclusion_matches_set_semantics(spark, keys, status_keys):
    from scorekit.operators.status import exclude_by_status

    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
    st_df = spark.createDataFrame([(k,) for k in status_keys], "k string")
    got = sorted(r.i for r in exclude_by_status(df, st_df, "k").collect())
    removed = set(status_keys)                               # None matches None
    assert got == [i for i, k in enumerate(keys) if k not in removed]


# Each generated value carries what must become of it, so the test needs no reader of its own.
_NUMBERS = st.one_of(st.integers(-1000, 1000), st.floats(-1e6, 1e6, allow_nan=False)).map(lambda x: (x, float(x)))
_FIXED = st.sampled_from([(True, 1.0), (False, 0.0), (" 12 ", 12.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0),
                          ("+5", 5.0), ("-inf", float("-inf")), ("12%", None), ("12d", None), ("abc", None),
                          ("", None), (None, None), ([1], None), ({"a": 1}, None)])
_ID = st.sampled_from([(7, "7"), ("7", "7"), ("x", "x"), (99, "99")])
_REMARK = st.sampled_from([None, "ok", "né"])


def _record(id_pair, score_pair, remarks, extra):
    given = {"unique_id": id_pair[0], "score": score_pair[0], "remarks": remarks, **extra}
    return given, None if score_pair[1] is None else (id_pair[1], score_pair[1], remarks)


_WHOLE = st.builds(_record, _ID, st.one_of(_NUMBERS, _FIXED), _REMARK,
                   st.sampled_from([{}, {"extra": 3}]))
_NO_ROW = st.sampled_from([(3, None), ("text", None), ({}, None), ({"unique_id": 1, "score": 2}, None),
                           ({"score": 2, "remarks": "r"}, None)])
_LIST = st.lists(st.one_of(_WHOLE, _NO_ROW), max_size=4).map(
    lambda pairs: ([g for g, _ in pairs], "ok", [row for _, row in pairs if row]))
_NOT_LIST = st.sampled_from([({"unique_id": 1, "score": 2, "remarks": "r"}, "not_list", []), (5, "not_list", []),
                             ("text", "not_list", [])])
_WRAP = st.sampled_from([("", "", True), ("```json\n", "\n```", True), ("```", "```", True), ("  \n", " ", True),
                         ("", " extra", False), ("", "]", False), ("```json", "\n``` trailing", False)])


@settings(max_examples=int(os.environ.get("ANSWER_EXAMPLES", "10")), deadline=None)
@given(st.lists(st.tuples(st.one_of(_LIST, _NOT_LIST), _WRAP), min_size=1, max_size=10))
def test_answers_become_what_they_were_made_for(spark, answers):
    import json

    from scorekit.operators.responses import batch_results, parse_responses

    made = []
    for (value, outcome, rows), (before, after, whole) in answers:
        text = before + json.dumps(value, ensure_ascii=False) + after
        made.append((text, outcome if whole else "invalid_json", rows if whole else []))
    df = spark.createDataFrame([(i, "unique_id", m[0]) for i, m in enumerate(made)],
                               "batch_id long, unique_identifier_column string, response string")
    parsed = parse_responses(df)
    outcomes = {r.batch_id: r.outcome for r in parsed.select("batch_id", "outcome").collect()}
    got = {}
    for r in batch_results(parsed).collect():
        got.setdefault(r.batch_id, []).append((r.unique_id, r.score, r.remarks))
    key = lambda t: (t[0], t[1], t[2] or "")
    for i, (text, outcome, rows) in enumerate(made):
        assert outcomes[i] == outcome, text
        assert sorted(got.get(i, []), key=key) == sorted(rows, key=key), text


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(_KEYS, _VALS), min_size=1, max_size=40))
def test_distinct_matches_pandas(spark, records):
    import pandas as pd

    from scorekit.operators.dedupe import drop_duplicate_rows

    from scorekit.functions.constants import ORDER_COL

    rows = [(k, v, i) for i, (k, v) in enumerate(records)]
    df = spark.createDataFrame(rows, f"k string, v int, {ORDER_COL} int")
    got = sorted((r[ORDER_COL], r.k, r.v) for r in drop_duplicate_rows(df).collect())
    pdf = pd.DataFrame(rows, columns=["k", "v", "o"]).astype({"v": "object"})
    kept = pdf.loc[~pdf[["k", "v"]].duplicated(keep="first")]
    want = sorted((int(r.o), r.k, None if pd.isna(r.v) else int(r.v)) for r in kept.itertuples())
    assert got == want


@settings(max_examples=6, deadline=None)
@given(st.lists(st.sets(st.sampled_from(["a", "b", "c", "d"]), min_size=1), min_size=1, max_size=4))
def test_union_matches_pandas_concat(spark, column_sets):
    import pandas as pd

    from scorekit.operators.union import union_sources

    frames, pframes = [], []
    for n, cols in enumerate(column_sets):
        cols = sorted(cols, reverse=n % 2 == 1)              # vary column order per source
        data = [tuple(f"{c}{n}{r}" for c in cols) for r in range(2)]
        frames.append(spark.createDataFrame(data, ", ".join(f"{c} string" for c in cols)))
        pframes.append(pd.DataFrame(data, columns=cols))
    u = union_sources(frames)
    expected = pd.concat(pframes, ignore_index=True)
    assert u.columns == list(expected.columns)
    def key(t):
        return tuple((v is not None, v or "") for v in t)

    got = sorted((tuple(r) for r in u.collect()), key=key)
    want = sorted((tuple(None if pd.isna(v) else v for v in row)
                   for row in expected.itertuples(index=False)), key=key)
    assert got == want
