"""Score batches with a caller-supplied function, keep failures for retry.

The scorer is any picklable callable ``scorer(batch_id, payload, prompt) -> str`` (the
response text). It runs inside Python workers via ``mapInPandas``. A failing call marks only its
own batch.

Calls in flight. The batches are written once, in groups of about ``batches_per_task``. A queue of
these groups feeds ``parallelism`` driver threads; each submits a job of one task for its group and
takes the next when that is done. So at most ``parallelism`` calls are in flight, and a slow call
holds up the rest of its own group only.

Ledger. Every job commits its own answers under ``answers/attempt=../group=..`` of the run's folder;
with a ``run`` name that folder outlives the driver. Calling again with the name scores only batches
that have no committed ``ok`` answer to the same payload, keyed by batch id and the payload's
SHA-256; the answers of all attempts together are the result. The ledger is compared with the batches
once, while these are written: each row carries whether it is still to be asked for, and no job reads
the ledger again. A lost task or driver repeats the calls of the groups it had not committed: delivery
is at least once.
"""

from __future__ import annotations

import os
import queue
import sys
import uuid
from functools import reduce

import pandas as pd
from pyspark import InheritableThread, cloudpickle
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from scorekit.errors import ScorerUnavailableError
from scorekit.functions.constants import (
    DEFAULT_PARALLELISM,
    OUTCOME_API_ERROR,
    OUTCOME_ERROR,
    OUTCOME_OK,
)
from scorekit.operators.batches import BATCH_COLUMNS, batch_payload, render_prompts
from scorekit.operators.responses import parse_responses
from scorekit.session import checkpoint_root, folder_exists

BATCHES_PER_TASK = 64
BATCH_SCHEMA = "batch_id bigint, batch_size bigint, unique_identifier_column string, payload string, payload_sha256 string"
_GROUP = "_group"
_PENDING = "_pending"
SCORED_SCHEMA = ("batch_id bigint, batch_size bigint, unique_identifier_column string, "
                 "payload string, response string, outcome string, error string")
_KEY = ("batch_id", "payload_sha256")
LEDGER_SCHEMA = f"{SCORED_SCHEMA}, payload_sha256 string, attempt int"
DEAD_LETTER_COLUMNS = (*BATCH_COLUMNS, "payload", "outcome", "error")

# The scoring closure (and scorers defined in this package) travel to Python workers by
# value, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules["scorekit"])


def _caller(scorer):
    def call(frames):
        for pdf in frames:
            responses, outcomes, errors = [], [], []
            for bid, payload, prompt in zip(pdf["batch_id"], pdf["payload"], pdf["prompt"]):
                try:
                    text = scorer(int(bid), payload, prompt)
                    if text is None:
                        raise ValueError("scorer returned no text")
                    responses.append(str(text))
                    outcomes.append(OUTCOME_OK)
                    errors.append(None)
                except ScorerUnavailableError as e:
                    responses.append(None)
                    outcomes.append(OUTCOME_API_ERROR)
                    errors.append(f"{type(e).__name__}: {e}")
                except Exception as e:  # noqa: BLE001 - one bad batch must not stop the rest
                    responses.append(None)
                    outcomes.append(OUTCOME_ERROR)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({
                "batch_id": pdf["batch_id"], "batch_size": pdf["batch_size"],
                "unique_identifier_column": pdf["unique_identifier_column"],
                "payload": pdf["payload"], "response": responses,
                "outcome": outcomes, "error": errors, "payload_sha256": pdf["payload_sha256"],
            })
    return call


def _in_flight(jobs: list, parallelism: int, work) -> None:
    """Run ``work(job)`` for all jobs, ``parallelism`` at a time, each thread taking the next job
    as soon as it is free. After a failure no new job starts; the first error is raised."""
    waiting, errors = queue.SimpleQueue(), []
    for job in jobs:
        waiting.put(job)

    def take():
        while not errors:
            try:
                job = waiting.get_nowait()
            except queue.Empty:
                return
            try:
                work(job)
            except Exception as e:  # noqa: BLE001 - raised below, in the caller's thread
                errors.append(e)

    threads = [InheritableThread(target=take) for _ in range(min(int(parallelism), len(jobs)))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    if errors:
        raise errors[0]


def _groups(table: DataFrame, per_task: int) -> list[list[int]]:
    """Folders of batches put together until a job has about ``per_task`` batches (a retry's batches
    are few in each folder). Counted from the files' footers; one number per folder is held."""
    jobs, size = [], per_task
    for r in table.groupBy(_GROUP).count().orderBy(_GROUP).collect():
        if size + r["count"] > per_task:
            jobs.append([])
            size = 0
        jobs[-1].append(r[_GROUP])
        size += r["count"]
    return jobs


def score_batches(batches: DataFrame, scorer, role: str = "",
                  parallelism: int = DEFAULT_PARALLELISM, template: str | None = None,
                  total=None, batches_per_task: int = BATCHES_PER_TASK, run: str | None = None) -> DataFrame:
    """Call ``scorer`` once per batch and classify each answer.

    Output columns: ``batch_id, batch_size, unique_identifier_column, payload, response,
    outcome, error, _parsed``; outcome is ``ok``, ``not_list``, ``invalid_json``,
    ``api_error`` or ``error``; ``payload`` is null for ``ok`` batches, which nobody sends again.

    At most ``parallelism`` calls are in flight, in jobs of about ``batches_per_task`` batches each
    (see the module's text). ``run`` names a ledger under the checkpoint folder: an interrupted
    run is taken up by calling again with the same name and batches, and ``ok`` batches are not
    scored twice. ``total`` is the number in the prompts (default: the batches of this call).
    """
    spark = batches.sparkSession
    root = os.path.join(checkpoint_root(spark), f"scored-{run or uuid.uuid4().hex}")
    answers = os.path.join(root, "answers")
    work = batch_payload(batches).select(*BATCH_COLUMNS, "payload").withColumn(
        "payload_sha256", F.sha2("payload", 256))
    attempt, before = 0, None
    if run and folder_exists(spark, answers):
        before = spark.read.schema(LEDGER_SCHEMA).parquet(answers)
        attempt = 1 + (before.agg(F.max("attempt")).first()[0] or 0)

    # Written once, in folders of neighbouring batch ids; counted while it is written.
    if before is not None:
        done = before.where(F.col("outcome") == OUTCOME_OK).select(*_KEY).distinct()
        work = work.join(done.withColumn(_PENDING, F.lit(False)), list(_KEY), "left")
    else:
        work = work.withColumn(_PENDING, F.lit(True))
    parts, counted = os.path.join(root, f"batches-{attempt}"), Observation()
    (work.withColumn(_PENDING, F.coalesce(_PENDING, F.lit(True)))
     .withColumn(_GROUP, F.floor((F.col("batch_id") - 1) / int(batches_per_task)))
     .repartition(_GROUP).observe(counted, F.count(F.lit(1)).alias("n"))
     .write.mode("overwrite").partitionBy(_GROUP).parquet(parts))
    total = F.lit(counted.get["n"]) if total is None else total
    table = spark.read.schema(f"{BATCH_SCHEMA}, {_PENDING} boolean, {_GROUP} bigint").parquet(parts)

    def score(job):
        number, group = job
        folders = [os.path.join(parts, f"{_GROUP}={g}") for g in group]
        mine = spark.read.schema(f"{BATCH_SCHEMA}, {_PENDING} boolean").parquet(*folders).where(_PENDING)
        prompts = render_prompts(mine.coalesce(1), role, template, total)
        raw = prompts.select(*BATCH_COLUMNS, "payload", "payload_sha256", "prompt").mapInPandas(
            _caller(scorer), f"{SCORED_SCHEMA}, payload_sha256 string")
        judged = parse_responses(raw)
        (judged.withColumn("payload", F.when(F.col("outcome") != F.lit(OUTCOME_OK), F.col("payload")))
         .select(*raw.columns).write.mode("overwrite").parquet(
             os.path.join(answers, f"attempt={attempt}", f"group={number}")))

    _in_flight(list(enumerate(_groups(table, int(batches_per_task)))), parallelism, score)
    if not folder_exists(spark, answers):  # there was no batch
        return parse_responses(spark.createDataFrame([], SCORED_SCHEMA))
    every = spark.read.schema(LEDGER_SCHEMA).parquet(answers)
    if attempt:
        # ``ok`` answers are never asked for again; of the others the last attempt's count. Answers
        # to payloads that are no batch of this call are left in the ledger.
        every = every.where((F.col("outcome") == OUTCOME_OK) | (F.col("attempt") == attempt)).join(
            table.select(*_KEY), list(_KEY), "left_semi")
    return parse_responses(every.drop("payload_sha256", "attempt"))


def failed_batches(scored: DataFrame) -> DataFrame:
    """Dead-letter set: whole batches (payload included) whose outcome is not ``ok``."""
    return scored.where(F.col("outcome") != F.lit(OUTCOME_OK)).select(*DEAD_LETTER_COLUMNS)


def retry_failed(failed: DataFrame, scorer, role: str = "",
                 parallelism: int = DEFAULT_PARALLELISM, template: str | None = None,
                 run: str | None = None) -> DataFrame:
    """Score the dead-letter batches again (only those). The prompt's total is the number
    of batches retried. Failures of this run form the next dead-letter set. ``run`` names the
    retry's own ledger, as in :func:`score_batches`."""
    return score_batches(failed.select(*BATCH_COLUMNS, "payload"), scorer, role,
                         parallelism, template, run=run)


def final_outcomes(runs: list[DataFrame]) -> DataFrame:
    """Per batch, the outcome of the latest run that scored it (first run, then retries)."""
    tagged = [r.select("batch_id", "outcome", F.lit(i).alias("_run")) for i, r in enumerate(runs)]
    every = reduce(lambda a, b: a.unionByName(b), tagged)
    return every.groupBy("batch_id").agg(F.max_by("outcome", "_run").alias("outcome"))
