import json

from pyspark.sql import functions as F

from scorekit.errors import ScorerUnavailableError
from scorekit.operators.batches import pack_batches, render_prompts, stringify_records
from scorekit.operators.numbering import assign_ids
from scorekit.operators.reports import (
    column_widths,
    outcome_report,
    preview,
    selection_summary,
)
from scorekit.operators.responses import batch_results
from scorekit.operators.scoring import failed_batches, final_outcomes, retry_failed, score_batches
from local_scorer import field_scorer

from conftest import SF001, rows


def _numbered(spark, n=120):
    df = spark.range(0, n).select(F.col("id").alias("k"), (F.col("id") % 3).cast("string").alias("grp"))
    return assign_ids(df, "k")


def test_stringify_fills_missing(spark):
    df = spark.createDataFrame([(None, float("nan"), 1)], "a string, b double, c int")
    assert stringify_records(df).first() == ("Not specified", "Not specified", "1")


def test_pack_invariants(spark):
    b = pack_batches(_numbered(spark, 120), batch_size=50)
    got = rows(b.select("batch_id", "batch_size"))
    assert got == [(1, 50), (2, 50), (3, 20)]
    first = b.where("batch_id = 2").first()
    assert [c.unique_id for c in first.candidates] == [str(i) for i in range(51, 101)]
    assert first.unique_identifier_column == "unique_id"
    assert first.candidates[0].asDict() == {"k": "50", "grp": "2", "unique_id": "51"}


def test_prompt_has_slots_filled(spark):
    b = pack_batches(_numbered(spark, 60), batch_size=50)
    p = render_prompts(b, "Data engineer").where("batch_id = 2").first()
    assert "role: Data engineer" in p.prompt and "batch: 2 of 2" in p.prompt
    payload = json.loads(p.payload)
    assert payload["batch_size"] == 10 and len(payload["candidates"]) == 10
    assert '"unique_id"' in p.prompt and p.payload in p.prompt


def test_scorer_called_once_per_batch_and_retry_only_failed(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    inner = field_scorer("k", fail_every=3)

    def counting(batch_id, payload, prompt):
        calls.add(1)
        return inner(batch_id, payload, prompt)

    b = pack_batches(_numbered(spark, 500), batch_size=50)   # 10 batches
    scored = score_batches(b, counting, "r", parallelism=3)
    res = batch_results(scored)
    assert res.count() == 350                 # batches 3, 6, 9 failed
    dead = failed_batches(scored)
    assert rows(dead.select("batch_id")) == [(3,), (6,), (9,)]
    assert set(r.outcome for r in dead.collect()) == {"api_error"}
    assert rows(outcome_report(scored)) == [("api_error", 3), ("ok", 7)]
    assert calls.value == 10                  # both branches read one written table

    folder = str(tmp_path)

    def echo(batch_id, payload, prompt):
        calls.add(1)
        with open(f"{folder}/{batch_id}", "w") as f:
            f.write(prompt)
        return inner(batch_id, payload, prompt)

    retried = retry_failed(dead, echo, "r")
    prompts = {p.name: p.read_text() for p in tmp_path.iterdir()}
    assert sorted(prompts) == ["3", "6", "9"]
    assert all(f"batch: {k} of 3" in p for k, p in prompts.items())
    assert calls.value == 13                  # only the dead-letter batches are re-scored
    assert rows(failed_batches(retried).select("batch_id")) == [(3,), (6,), (9,)]
    outcomes = final_outcomes([scored, retried])
    assert outcomes.where("outcome = 'ok'").count() == 7


def test_scorer_exceptions_are_isolated(spark):
    def bad(batch_id, payload, prompt):
        if batch_id == 1:
            raise ValueError("boom")
        if batch_id == 2:
            return None
        return "not json"

    b = pack_batches(_numbered(spark, 150), batch_size=50)
    out = rows(score_batches(b, bad, "r").select("batch_id", "outcome"))
    assert out == [(1, "error"), (2, "error"), (3, "invalid_json")]


def test_column_widths(spark):
    df = spark.createDataFrame([("abc", None, "x" * 80)], "name string, e string, long_text string")
    got = dict((r.column_name, r.width) for r in column_widths(df).collect())
    assert got == {"name": 6, "e": 3, "long_text": 50}
    empty = spark.createDataFrame([], "name string")
    assert column_widths(empty).first().width == 2


def test_summary_and_preview(spark):
    df = spark.read.parquet(f"{SF001}/documents.parquet")
    s = selection_summary(df, "n_chars").first()
    agg = df.agg(F.count("*"), F.min("n_chars"), F.max("n_chars")).first()
    assert tuple(s)[:3] == tuple(agg)
    p = preview(df.select("doc_id"), 3, "doc_id").collect()
    assert [r.doc_id for r in p] == sorted(r.doc_id for r in df.select("doc_id").collect())[:3]


def test_unavailable_error_is_api_error():
    assert issubclass(ScorerUnavailableError, RuntimeError)


def test_payload_is_utf8_json_in_record_order(spark):
    df = spark.createDataFrame([("Né", 1), ("Zoë", 2)], "name string, unique_id long")
    p = render_prompts(pack_batches(df), "r").first()
    assert "Né" in p.payload and "\\u" not in p.payload
    assert [c["name"] for c in json.loads(p.payload)["candidates"]] == ["Né", "Zoë"]


def test_queue_bounds_calls_in_flight_and_tasks_follow_batches(spark, tmp_path):
    import os
    import time

    folder = str(tmp_path)

    def slow(batch_id, payload, prompt):
        mark = os.path.join(folder, f"call-{batch_id}-{time.time()}")
        open(mark, "w").close()
        running = os.path.join(folder, f"run-{batch_id}")
        open(running, "w").close()
        now = sum(f.startswith("run-") for f in os.listdir(folder))
        open(os.path.join(folder, f"seen-{now}-{batch_id}"), "w").close()
        time.sleep(0.05)
        os.remove(running)
        task = TaskContext.get()
        open(os.path.join(folder, f"task-{task.stageId()}-{task.partitionId()}"), "w").close()
        return "[]"

    from pyspark import TaskContext
    b = pack_batches(_numbered(spark, 600), batch_size=10)   # 60 batches
    scored = score_batches(b, slow, "r", parallelism=3, batches_per_task=4)
    assert scored.where("outcome = 'ok'").count() == 60
    names = os.listdir(folder)
    assert sum(n.startswith("call-") for n in names) == 60          # once per batch
    assert max(int(n.split("-")[1]) for n in names if n.startswith("seen-")) <= 3
    assert sum(n.startswith("task-") for n in names) > 3            # more tasks than calls in flight


def test_payload_is_kept_for_failed_batches_only(spark):
    def some(batch_id, payload, prompt):
        return {1: "[]", 2: "{}"}.get(batch_id, "no json")

    out = {r.batch_id: r for r in score_batches(pack_batches(_numbered(spark, 150)), some, "r").collect()}
    assert out[1].payload is None and out[1].outcome == "ok"
    assert out[2].payload and out[3].payload


def test_missing_scores_and_range_text(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.25, "a"), (nan, "b"), (None, "c"), (400.0, "d")], "score double, k string")
    from scorekit.operators.projection import filter_score_range
    s = selection_summary(df).first()
    assert (s.n, s.min_score, s.max_score, s.range_text) == (4, 1.25, 400.0, "1.3 - 400.0")
    assert filter_score_range(df, lo=100).count() == 1 and filter_score_range(df, hi=100).count() == 1
    assert selection_summary(df.where("k = 'c'")).first().range_text is None


def test_a_slow_batch_stops_no_other(spark, tmp_path):
    import os
    import time

    folder = str(tmp_path)

    def slow_first(batch_id, payload, prompt):
        if batch_id == 1:
            until = time.time() + 60
            while time.time() < until and len(os.listdir(folder)) < 10:  # all batches but its own job's
                time.sleep(0.02)
            return "[]" if time.time() < until else None
        open(os.path.join(folder, str(batch_id)), "w").close()
        return "[]"

    b = pack_batches(_numbered(spark, 120), batch_size=10)   # 12 batches, 6 jobs
    scored = score_batches(b, slow_first, "r", parallelism=2, batches_per_task=2)
    assert scored.where("outcome = 'ok'").count() == 12      # the other thread went through all other jobs


def test_an_interrupted_run_is_taken_up(spark, tmp_path):
    import os
    import uuid

    import pytest

    folder, run = str(tmp_path), uuid.uuid4().hex
    inner = field_scorer("k", fail_every=7)

    def noted(batch_id, payload, prompt):
        open(os.path.join(folder, f"{batch_id}-{uuid.uuid4().hex}"), "w").close()
        if batch_id == 9 and not os.path.exists(os.path.join(folder, "again")):
            os._exit(7)                                      # the job dies, and the run with it
        return inner(batch_id, payload, prompt)

    b = pack_batches(_numbered(spark, 200), batch_size=10)   # 20 batches
    with pytest.raises(Exception):
        score_batches(b, noted, "r", parallelism=1, batches_per_task=4, run=run)
    first = {n.split("-")[0] for n in os.listdir(folder)}
    assert {"1", "8"} <= first and "20" not in first         # two jobs were committed, the third was not
    open(os.path.join(folder, "again"), "w").close()
    scored = score_batches(b, noted, "r", parallelism=3, batches_per_task=4, run=run)
    calls = [n.split("-")[0] for n in os.listdir(folder) if n != "again"]
    assert all(calls.count(str(i)) == 1 for i in (1, 2, 3, 4, 5, 6, 8))  # committed and ok
    assert calls.count("7") == 2                             # committed, but failed
    whole = score_batches(b, inner, "r", batches_per_task=4)
    assert rows(scored.drop("_parsed")) == rows(whole.drop("_parsed"))
    # Once more: nothing but the failed batches is asked again; another payload is another batch.
    for n in os.listdir(folder):
        if n != "again":
            os.rename(os.path.join(folder, n), os.path.join(folder, "again"))
    other = b.withColumn("candidates", F.when(F.col("batch_id") == 3, F.slice("candidates", 1, 2)).otherwise(F.col("candidates")))
    third = score_batches(other, noted, "r", batches_per_task=4, run=run)
    assert sorted(n.split("-")[0] for n in os.listdir(folder) if n != "again") == ["14", "3", "7"]
    assert rows(third.select("batch_id")) == [(i,) for i in range(1, 21)]
    assert batch_results(third).where("batch_id = 3").count() == 2


def test_no_batch_at_all(spark):
    b = pack_batches(_numbered(spark, 20)).where("false")
    assert score_batches(b, field_scorer("k"), "r").collect() == []


def test_a_resumed_run_reads_its_ledger_once_however_many_jobs_it_has(spark, monkeypatch):
    import uuid

    from pyspark.sql.classic.dataframe import DataFrame

    joins, join = [], DataFrame.join

    def noted(self, *args, **kwargs):
        joins.append(self)
        return join(self, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "join", noted)
    b = pack_batches(_numbered(spark, 240), batch_size=10).localCheckpoint()   # 24 batches
    seen = {}
    for per_task in (12, 2):                                 # 2 jobs, then 12 jobs
        run = uuid.uuid4().hex
        score_batches(b, field_scorer("k", fail_every=2), "r", batches_per_task=per_task, run=run)
        joins.clear()
        out = score_batches(b, field_scorer("k", fail_every=8), "r", batches_per_task=per_task, run=run)
        seen[per_task] = len(joins)
        assert rows(out.select("batch_id", "outcome")) == [(i, "ok" if i % 8 else "api_error") for i in range(1, 25)]
    assert seen[2] == seen[12]                               # what is joined does not grow with the jobs


def test_a_batch_given_twice_and_answered_is_still_one_batch_more(spark):
    import uuid

    run = uuid.uuid4().hex
    b = pack_batches(_numbered(spark, 30), batch_size=10)
    twice = b.unionByName(b.where("batch_id = 1")).localCheckpoint()
    for fail_every in (2, None):                             # the ledger holds two answers to batch 1
        out = score_batches(twice, field_scorer("k", fail_every=fail_every), "r", run=run)
    assert rows(out.select("batch_id", "outcome")) == [(1, "ok"), (1, "ok"), (2, "ok"), (3, "ok")]
    assert rows(batch_results(out).groupBy("unique_id").count().where("count = 2").select("count")) == [(2,)] * 10
