"""

Inputs are the driver tables; where an operator needs missing values, duplicate keys or
failing calls, they are derived from data attributes (segment, status, priority, event
type), so every query processes its whole tables. The local scorer simulates an outage for
batches whose first candidate is in segment BUILDING (on retry: first and last candidate);
those batches are kept, reported as failed and retried, never dropped from the input.
"""

from __future__ import annotations

import importlib
import os
import sys
import uuid
import warnings
from collections.abc import Callable

# The package lives next to this file; make it importable however this file is loaded.
_HERE = os.path.dirname(os.path.abspath(__file__))
if _HERE not in sys.path:
    sys.path.insert(0, _HERE)

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from local_scorer import field_scorer, first_candidate_is
from scorekit.functions.constants import ORDER_COL
from scorekit.functions.rules import sensitive_name
from scorekit.operators.batches import PROMPT_TEMPLATE, pack_batches, render_prompts, stringify_records
from scorekit.operators.dedupe import drop_duplicate_rows, merge_by_key
from scorekit.operators.numbering import assign_ids, dense_rank_scores
from scorekit.operators.projection import (
    display_columns,
    filter_score_range,
    ranked_only,
    scoring_projection,
)
from scorekit.operators.reports import (
    analyzed_count,
    column_widths,
    consolidation_report,
    outcome_report,
    preview,
    selection_summary,
)
from scorekit.operators.responses import batch_results, parse_responses
from scorekit.operators.results import merge_results, reconcile_ids, sort_final, sort_results
from scorekit.operators.scoring import failed_batches, final_outcomes, retry_failed, score_batches
from scorekit.operators.status import exclude_by_status
from scorekit.operators.union import schema_profile, union_sources
from scorekit.plans.workflows import analyze, consolidate, retry, select_and_report
from scorekit.session import checkpoint_root
from scorekit.sources.readers import normalize_headers, read_intake, read_sources, read_status
from scorekit.sources.writers import write_results

SMOKE_DIR = "/root/testdata/sf0.001"
ROLE = "Account manager"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _scorer(retry=False):
    return field_scorer("c_custkey",
                        fail_when=first_candidate_is("c_mktsegment", "BUILDING", also_last=retry))


# ---------------------------------------------------------------- inputs shared by queries
def _merge_input(spark, d):
    o = _t(spark, d, "orders")
    return o.select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("k"),
        "o_orderkey",
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("pr"),
        F.when(~F.col("o_orderpriority").startswith("1"), F.col("o_totalprice")).alias("tp"))


def _customers_numbered(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return assign_ids(c, "c_custkey")


def _status_orders(spark, d):
    return (_t(spark, d, "orders")
            .where((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT"))
            .select(F.col("o_custkey").alias("c_custkey")))


def _candidates(spark, d):
    """Customers minus the status table, numbered in source order."""
    src = read_sources(spark, [f"{d}/customer.parquet"])[0].select(
        "c_custkey", "c_name", "c_mktsegment", ORDER_COL)
    kept = exclude_by_status(src, _status_orders(spark, d), "c_custkey")
    return assign_ids(kept, ORDER_COL).drop(ORDER_COL)


def _event_responses(spark, d, truncate):
    e = _t(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    eid = F.col("event_id").cast("string")
    obj = F.concat(F.lit('{"unique_id": '), eid, F.lit(', "score": '), k, F.lit(', "remarks": "r"}'))
    as_text = F.concat(F.lit('[{"unique_id": "'), eid, F.lit('", "score": " '), k,
                       F.lit(' ", "remarks": "r"}]'))
    extra = F.concat(F.lit("[{\"unique_id\": "), eid, F.lit(", \"score\": "), k,
                     F.lit(", \"remarks\": null}, {\"unique_id\": "), eid,
                     F.lit(", \"score\": 1}]"))
    plain = F.concat(F.lit("["), obj, F.lit(", 42]"))
    text = (F.when(F.col("event_type") == "view", obj)
             .when(F.col("event_type") == "purchase",
                   F.concat(F.lit("```json\n"), as_text, F.lit("\n```")))
             .when(F.col("event_type") == "click", F.concat(F.lit("```\n"), extra, F.lit("\n```")))
             .otherwise(plain))
    if truncate:
        text = F.when(F.col("event_type") == "error",
                      F.concat(F.lit('[{"unique_id": '), eid, F.lit(', "score": '))).otherwise(text)
    return e.select(F.col("event_id").alias("batch_id"),
                    F.lit("unique_id").alias("unique_identifier_column"),
                    text.alias("response"))


def _label_scores(spark, d):
    return _t(spark, d, "labels").select(
        F.col("doc_id").alias("unique_id"),
        (F.col("quality") * 100 + F.col("toxic")).cast("double").alias("score"),
        F.lit("scored").alias("remarks"))


# ---------------------------------------------------------------- queries
def q_union_by_name(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
                                        F.col("c_acctbal").alias("acctbal"),
                                        F.col("c_mktsegment").alias("segment"))
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"),
                                        F.col("s_acctbal").alias("acctbal"),
                                        F.col("s_nationkey").alias("nationkey"))
    return union_sources([c, s])


def q_union_mixed_types(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    s = _t(spark, d, "supplier").select(F.col("s_name").alias("id"), F.col("s_name").alias("name"))
    return union_sources([c, s])


def q_drop_duplicate_rows(spark, d):
    docs = read_sources(spark, [f"{d}/documents.parquet"])[0]
    rows = docs.select("text", "lang", "source", "n_chars", ORDER_COL)
    return drop_duplicate_rows(rows).drop(ORDER_COL)


def q_merge_by_key(spark, d):
    return merge_by_key(_merge_input(spark, d), "k", order_by="o_orderkey")


def q_consolidation_report(spark, d):
    x = _merge_input(spark, d)
    merged = merge_by_key(x, "k", order_by="o_orderkey")
    kept = exclude_by_status(merged, _status_orders(spark, d), "k", "c_custkey")
    return consolidation_report(x, merged, kept, key="k")


def q_exclude_by_status(spark, d):
    c = _t(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey").cast("string")).alias("k"))
    st = _t(spark, d, "orders").where(F.col("o_orderstatus") == "P").select(
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey").cast("string")).alias("k"))
    return exclude_by_status(c, st, "k")


def q_assign_ids(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang")
    return assign_ids(docs, ["lang", "doc_id"]).select("doc_id", "unique_id")


def q_stringify_records(spark, d):
    c = _t(spark, d, "customer").select(
        "c_custkey", "c_name", "c_nationkey",
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment")).alias("c_mktsegment"))
    return stringify_records(c)


def q_pack_batches(spark, d):
    b = pack_batches(_customers_numbered(spark, d), "unique_id", 50)
    return b.select("batch_id", "batch_size",
                    F.col("candidates")[0]["unique_id"].cast("bigint").alias("first_id"),
                    F.element_at("candidates", -1)["unique_id"].cast("bigint").alias("last_id"))


def _scored(spark, d):
    view = _customers_numbered(spark, d).select("unique_id", "c_custkey", "c_mktsegment")
    return score_batches(pack_batches(view), _scorer(), ROLE)


def q_score_batches(spark, d):
    return batch_results(_scored(spark, d)).select(
        F.col("unique_id").cast("bigint").alias("unique_id"), "score")


def q_failed_batches(spark, d):
    return failed_batches(_scored(spark, d)).select("batch_id")


def q_retry_failed(spark, d):
    first = _scored(spark, d)
    second = retry_failed(failed_batches(first), _scorer(retry=True), ROLE)
    out = final_outcomes([first, second])
    return out.select("batch_id", F.when(F.col("outcome") == "ok", "ok").otherwise("failed")
                      .alias("outcome"))


def q_render_prompts(spark, d):
    b = pack_batches(_customers_numbered(spark, d))
    return render_prompts(b, ROLE).select("batch_id", "batch_size", "prompt")


def q_parse_responses(spark, d):
    parsed = parse_responses(_event_responses(spark, d, truncate=False))
    return batch_results(parsed).select(F.col("unique_id").cast("bigint").alias("event_id"), "score")


def q_outcome_report(spark, d):
    return outcome_report(parse_responses(_event_responses(spark, d, truncate=True)))


def q_dense_rank_scores(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "n_chars")
    return dense_rank_scores(docs, "n_chars").select("doc_id", "rank")


def q_merge_results(spark, d):
    docs = _t(spark, d, "documents").select("doc_id")
    return merge_results(docs, _label_scores(spark, d), id_col="doc_id").select(
        "doc_id", "score", "rank", "remarks")


def q_reconcile_ids(spark, d):
    docs = _t(spark, d, "documents").select("doc_id")
    shifted = _t(spark, d, "labels").select((F.col("doc_id") + 300).alias("doc_id"))
    return reconcile_ids(docs, shifted, id_col="doc_id", score_id="doc_id")


def q_filter_score_range(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "n_chars")
    return filter_score_range(docs, 200, 500, score="n_chars")


def q_selection_summary(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "n_chars")
    return selection_summary(filter_score_range(docs, 200, 500, score="n_chars"), score="n_chars")


def q_column_widths(spark, d):
    return column_widths(_t(spark, d, "customer").select("c_name", "c_mktsegment"))


def q_preview(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return preview(docs, 10, "doc_id")


def q_scoring_projection(spark, d):
    base = _customers_numbered(spark, d)
    return scoring_projection(base, ["c_name", "c_mktsegment", "c_comment"])


def q_select_report(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("unique_id"), "lang")
    final = merge_results(docs, _label_scores(spark, d))
    return display_columns(filter_score_range(ranked_only(final), lo=1))


def q_analyzed_count(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("unique_id"))
    scores = _label_scores(spark, d)
    return analyzed_count(merge_results(docs, scores), scores)


def q_consolidated_base(spark, d):
    people = read_sources(spark, [f"{d}/customer.parquet", f"{d}/orders.parquet"])
    cust = people[0].select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"),
                            F.col("c_mktsegment").alias("segment"), ORDER_COL)
    orders = people[1].select(F.col("o_custkey").alias("person_id"),
                              F.col("o_orderpriority").alias("priority"),
                              F.col("o_totalprice").alias("last_total"), ORDER_COL)
    status = _t(spark, d, "orders").where(
        (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "1-URGENT")).select(
        F.col("o_custkey").alias("person_id"))
    return consolidate([cust, orders], dedupe="key", key="person_id", status=status,
                       status_key="person_id").base


def _ranked_final(spark, d):
    base = _candidates(spark, d)
    view = base.select("unique_id", "c_custkey", "c_mktsegment")
    return analyze(base, view, _scorer(), ROLE).final


def q_ranked_candidates(spark, d):
    final = _ranked_final(spark, d)
    return final.select("unique_id", "c_custkey", "c_name", "score", "rank", "remarks")


def q_sorted_results(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("unique_id"), "n_chars")
    ranked = dense_rank_scores(docs.withColumnRenamed("n_chars", "score"))
    return sort_results(ranked).select("rank", "score", "unique_id")


def q_interview_selection(spark, d):
    chosen, _ = select_and_report(_ranked_final(spark, d), lo=100, hi=400)
    return chosen


def q_interview_summary(spark, d):
    _, summary = select_and_report(_ranked_final(spark, d), lo=100, hi=400)
    return summary


def q_export_widths(spark, d):
    return column_widths(_ranked_final(spark, d))


def q_normalized_headers(spark, d):
    messy = _t(spark, d, "customer").select(
        F.col("c_custkey").alias(" Cust-Key "), F.col("c_name").alias("Customer Name!"),
        F.col("c_mktsegment").alias("segment (market)"), F.col("c_acctbal").alias("acct.bal"))
    return normalize_headers(messy)


def q_status_preview(spark, d):
    status = read_status(spark, [f"{d}/orders.parquet"])
    return preview(status.select("o_orderkey", "o_custkey", "o_orderstatus"), 3, "o_orderkey")


def _label_final(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("unique_id"), "lang")
    return merge_results(docs, _label_scores(spark, d))


def q_top_ranked(spark, d):
    return sort_final(_label_final(spark, d)).limit(10)


def q_export_roundtrip(spark, d):
    import os
    import uuid

    folder = os.path.join(checkpoint_root(spark), f"exports-{uuid.uuid4().hex}")
    path = write_results(_label_final(spark, d), folder)
    return spark.read.parquet(path)


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def q_lineitem_consolidated(spark, d):
    """Merge at scale: lines merged per order (first non-missing value in line order),
    orders with status F removed, ids in order-key order."""
    li = _t(spark, d, "lineitem").select(
        "l_orderkey", *_LINE_ORDER,
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("returnflag"),
        F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("discount"),
        "l_quantity")
    finished = _t(spark, d, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("l_orderkey"))
    return consolidate([li], dedupe="key", key="l_orderkey", status=finished,
                       status_key="l_orderkey", order_by=_LINE_ORDER).base


def q_retried_ranking(spark, d):
    base = _candidates(spark, d)
    view = base.select("unique_id", "c_custkey", "c_mktsegment")
    first = analyze(base, view, _scorer(), ROLE)
    final = retry(first, base, _scorer(retry=True), ROLE).final
    return final.select("unique_id", "c_custkey", "score", "rank", "remarks")


# ------------------------------------------------- missing values, repeated ids, other inputs
def _order_scores(spark, d):
    """Order totals by customer with gaps: NaN for one priority, null for another."""
    return _t(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(float("nan")))
        .when(F.col("o_orderpriority") != "2-HIGH", F.col("o_totalprice")).alias("score"))


def q_merge_repeated_ids(spark, d):
    """Many identical answers for one id, and answers for ids the base does not have."""
    base = _t(spark, d, "supplier").select("s_suppkey")
    scores = _t(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "N", 1).when(F.col("l_returnflag") == "A", F.col("l_suppkey"))
        .otherwise(-F.col("l_suppkey")).alias("s_suppkey"),
        F.when(F.col("l_returnflag") == "N", 7).otherwise(F.col("l_linenumber")).cast("double").alias("score"),
        F.lit("scored").alias("remarks"))
    return merge_results(base, scores, "s_suppkey", "s_suppkey")


def q_consolidated_rows(spark, d):
    docs = _t(spark, d, "documents").select("text", "lang", "source", "n_chars")
    return consolidate([docs], dedupe="rows", order_by=["n_chars", "text", "lang", "source"]).base


def q_consolidated_all(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return consolidate([orders], dedupe=None, order_by="o_orderkey", status=_status_orders(spark, d),
                       status_key="o_custkey", status_column="c_custkey").base


def q_consolidation_flow_report(spark, d):
    return consolidate([_merge_input(spark, d)], dedupe="key", key="k", order_by="o_orderkey",
                       status=_status_orders(spark, d), status_key="k", status_column="c_custkey").report


def q_scoring_view(spark, d):
    orders = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return consolidate([orders], dedupe=None, order_by="o_orderkey",
                       columns=["o_orderstatus", "o_totalprice", "no_such_column"]).scoring_view


def q_exclude_nan_keys(spark, d):
    c = _t(spark, d, "customer").select(
        "c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.lit(float("nan")))
        .otherwise(F.col("c_custkey").cast("double")).alias("k"))
    st = _t(spark, d, "orders").where("o_orderstatus = 'P'").select(
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_custkey").cast("decimal(12,2)")).alias("k"))
    return exclude_by_status(c, st, "k").select("c_custkey", "k")


def q_distinct_missing(spark, d):
    rows = _order_scores(spark, d).select(
        "score", F.when(F.col("o_orderkey") % 2 == 0, F.lit("even")).alias("parity"))
    return drop_duplicate_rows(rows)


def q_score_range_missing(spark, d):
    return selection_summary(filter_score_range(_order_scores(spark, d), lo=1000))


def q_widths_missing(spark, d):
    rows = _order_scores(spark, d).select(
        F.when(F.col("score") > 0, 1.5).otherwise(F.col("score")).alias("s"))
    return column_widths(rows)


def q_rank_text_scores(spark, d):
    e = _t(spark, d, "events")
    k = F.get_json_object("props", "$.k")
    text = (F.when(F.col("event_type") == "view", k).when(F.col("event_type") == "click", F.concat(F.lit(" "), k, F.lit(" ")))
            .when(F.col("event_type") == "purchase", F.concat(k, F.lit("d"))))
    return dense_rank_scores(e.select("event_id", text.alias("score"))).select("event_id", "score", "rank")


def q_merge_over_old_results(spark, d):
    """A base that still has the columns of an earlier run."""
    docs = _t(spark, d, "documents").select(
        "doc_id", F.lit(1.0).alias("score"), F.lit("old").alias("remarks"), F.lit(5).alias("rank"))
    return merge_results(docs, _label_scores(spark, d), id_col="doc_id")


def q_merge_no_results(spark, d):
    return merge_results(_t(spark, d, "documents").select("doc_id", "lang"),
                         _label_scores(spark, d).where("score < 0"), id_col="doc_id")


def q_merge_all_scores_missing(spark, d):
    scores = _label_scores(spark, d).withColumn("score", F.lit(float("nan")))
    return merge_results(_t(spark, d, "documents").select("doc_id", "lang"), scores, id_col="doc_id")


def q_csv_source(spark, d):
    path = os.path.join(checkpoint_root(spark), f"csv-{uuid.uuid4().hex}")
    (_t(spark, d, "supplier").select(F.col("s_suppkey").alias("Supp-Key"), F.col("s_name").alias(" Name "),
                                     F.col("s_acctbal").alias("Balance!"))
     .write.option("header", "true").csv(f"{path}.csv"))
    source = {"path": f"{path}.csv", "schema": "`Supp-Key` bigint, ` Name ` string, `Balance!` double"}
    return read_sources(spark, [source], with_order=False)[0]


def q_source_order(spark, d):
    """A table rewritten in many files is numbered in the files' order."""
    path = os.path.join(checkpoint_root(spark), f"parts-{uuid.uuid4().hex}")
    c = _t(spark, d, "customer").select("c_custkey", "c_name")
    c.repartitionByRange(12, "c_custkey").sortWithinPartitions("c_custkey").write.parquet(f"{path}.parquet")
    return assign_ids(read_sources(spark, [f"{path}.parquet"])[0], ORDER_COL).drop(ORDER_COL)


def _orders_csv(spark, d):
    """Orders as lines of a CSV file; some have a word for the total, some a field too many."""
    path = os.path.join(checkpoint_root(spark), f"orders-{uuid.uuid4().hex}.csv")
    total = F.when(F.col("o_orderpriority") == "5-LOW", F.lit("unknown")).otherwise(F.col("o_totalprice").cast("string"))
    line = F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), total,
                       F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("urgent")))
    _t(spark, d, "orders").select(line).write.text(path)
    return {"path": path, "schema": "o_orderkey bigint, o_orderstatus string, o_totalprice double",
            "options": {"header": "false"}}


def q_fitting_rows(spark, d):
    return read_intake(spark, [_orders_csv(spark, d)], with_order=False).sources[0]


def q_rejected_rows(spark, d):
    return read_intake(spark, [_orders_csv(spark, d)]).bad_rows.select("source", "row")


def _broken_folder(spark, d):
    """The parts table beside files that are no Parquet files: one for each nation, with its name."""
    path = os.path.join(checkpoint_root(spark), f"broken-{uuid.uuid4().hex}.parquet")
    _t(spark, d, "nation").select("n_name", F.concat("n_name", F.lit("\n")).alias("value")).write.partitionBy("n_name").text(path)
    _t(spark, d, "part").select("p_partkey", "p_name", F.lit("good").alias("n_name")).repartition(3).write.mode(
        "append").partitionBy("n_name").parquet(path)
    return path


def q_quarantined_files(spark, d):
    got = read_intake(spark, [_broken_folder(spark, d)])
    name = F.regexp_extract("path", "n_name=([^/]*)/", 1)
    return got.bad_files.select("source", name.alias("name"), "bytes")


def q_readable_files(spark, d):
    got = read_intake(spark, [_broken_folder(spark, d)], with_order=False)
    return got.sources[0].select("p_partkey", "p_name")


def q_intake_report(spark, d):
    got = read_intake(spark, [_orders_csv(spark, d), _broken_folder(spark, d)])
    orders = [s for s, n in zip(got.sources, got.numbers) if n == 0]
    got.sources, got.numbers = orders, [0]
    return consolidate(got, dedupe="key", key="o_orderkey").report


def _mixed_sources(spark, d):
    """Orders and lines with columns of the same name and other types."""
    o = _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("k"), (F.col("o_custkey") + F.lit(9007199254740993)).alias("v"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("w"), F.col("o_orderdate").cast("date").alias("at"),
        F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("int").alias("n")).alias("info"))
    x = _t(spark, d, "lineitem").select(
        F.col("l_orderkey").cast("int").alias("k"), (F.col("l_extendedprice") / 2).alias("v"), F.col("l_partkey").alias("w"),
        F.col("l_shipdate").alias("at"), F.struct(F.col("l_quantity").alias("n"), F.col("l_returnflag").alias("flag")).alias("info"))
    return [o, x]


def q_union_lossless(spark, d):
    return union_sources(_mixed_sources(spark, d)).select(
        "k", "v", "w", "at", F.col("info.status").alias("status"), F.col("info.n").alias("n"), F.col("info.flag").alias("flag"))


def q_schema_profile(spark, d):
    o, x = _mixed_sources(spark, d)
    phones = _t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("Phone Number"),
                                             F.when(F.col("c_nationkey") > 5, F.col("c_acctbal")).alias("w"))
    joined = lambda c: F.array_join(F.transform(c, lambda e: e.cast("string")), ",")
    return schema_profile([o.drop("info"), x.drop("info"), phones]).select(
        "name", "position", joined("sources").alias("sources"), joined("types").alias("types"), "present", "common_type", "sensitive")


def q_sensitive_names(spark, d):
    """Names as headers have them: a segment, and what the column holds."""
    kinds = ["Phone Number", "EMPLOYEE  id", "mobile", "contact-no", "EmployeeNumber", "skills", "employee name"]
    held = F.element_at(F.array(*map(F.lit, kinds)), (F.col("c_nationkey") % len(kinds) + 1).cast("int"))
    names = _t(spark, d, "customer").select(F.concat_ws(" ", F.initcap("c_mktsegment"), held).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("n")).select("name", "n", sensitive_name(F.col("name")).alias("sensitive"))


def q_resumed_scoring(spark, d):
    """A run whose driver stops after an outage, and the same run taken up: the ledger keeps what
    was answered, only failed batches are asked again."""
    run = uuid.uuid4().hex
    batches = pack_batches(_customers_numbered(spark, d).select("unique_id", "c_custkey", "c_mktsegment"))
    score_batches(batches, _scorer(), ROLE, run=run)
    again = score_batches(batches, _scorer(retry=True), ROLE, run=run)
    return again.select("batch_id", F.when(F.col("outcome") == "ok", "ok").otherwise("failed").alias("outcome"))


def _spark_double(x: str, key: bool = False) -> str:
    """DuckDB text of a double as Spark prints it (below 10 million: plain; above: with an exponent);
    as a key, whole numbers have no fraction."""
    exponent = f"cast(floor(log10({x})) as bigint)"
    plain = f"cast({x} as varchar)"
    digits = f"rtrim(replace({plain}, '.', ''), '0')"
    large = (f"case when {x} < 1e7 then {plain} else {digits}[1] || '.' || "
             f"case when len({digits}) > 1 then {digits}[2:] else '0' end || 'E' || {exponent} end")
    return f"case when {x} = floor({x}) then cast(cast({x} as bigint) as varchar) else {large} end" if key else large


_QUERIES = {
    "fitting_rows": q_fitting_rows,
    "rejected_rows": q_rejected_rows,
    "quarantined_files": q_quarantined_files,
    "readable_files": q_readable_files,
    "intake_report": q_intake_report,
    "union_lossless": q_union_lossless,
    "schema_profile": q_schema_profile,
    "sensitive_names": q_sensitive_names,
    "resumed_scoring": q_resumed_scoring,
    "merge_repeated_ids": q_merge_repeated_ids,
    "consolidated_rows": q_consolidated_rows,
    "consolidated_all": q_consolidated_all,
    "consolidation_flow_report": q_consolidation_flow_report,
    "scoring_view": q_scoring_view,
    "exclude_nan_keys": q_exclude_nan_keys,
    "distinct_missing": q_distinct_missing,
    "score_range_missing": q_score_range_missing,
    "widths_missing": q_widths_missing,
    "rank_text_scores": q_rank_text_scores,
    "merge_over_old_results": q_merge_over_old_results,
    "merge_no_results": q_merge_no_results,
    "merge_all_scores_missing": q_merge_all_scores_missing,
    "csv_source": q_csv_source,
    "source_order": q_source_order,
    "union_by_name": q_union_by_name,
    "union_mixed_types": q_union_mixed_types,
    "drop_duplicate_rows": q_drop_duplicate_rows,
    "merge_by_key": q_merge_by_key,
    "consolidation_report": q_consolidation_report,
    "exclude_by_status": q_exclude_by_status,
    "assign_ids": q_assign_ids,
    "stringify_records": q_stringify_records,
    "pack_batches": q_pack_batches,
    "render_prompts": q_render_prompts,
    "score_batches": q_score_batches,
    "failed_batches": q_failed_batches,
    "retry_failed": q_retry_failed,
    "parse_responses": q_parse_responses,
    "outcome_report": q_outcome_report,
    "dense_rank_scores": q_dense_rank_scores,
    "merge_results": q_merge_results,
    "reconcile_ids": q_reconcile_ids,
    "filter_score_range": q_filter_score_range,
    "selection_summary": q_selection_summary,
    "column_widths": q_column_widths,
    "preview": q_preview,
    "scoring_projection": q_scoring_projection,
    "select_report": q_select_report,
    "analyzed_count": q_analyzed_count,
    "consolidated_base": q_consolidated_base,
    "ranked_candidates": q_ranked_candidates,
    "retried_ranking": q_retried_ranking,
    "sorted_results": q_sorted_results,
    "interview_selection": q_interview_selection,
    "interview_summary": q_interview_summary,
    "export_widths": q_export_widths,
    "normalized_headers": q_normalized_headers,
    "status_preview": q_status_preview,
    "top_ranked": q_top_ranked,
    "export_roundtrip": q_export_roundtrip,
    "lineitem_consolidated": q_lineitem_consolidated,
}

# Customers left after the status table, numbered in source (= key) order.
_CANDIDATES_SQL = """
c as (select c_custkey, c_name, c_mktsegment from customer
      where not exists (select 1 from orders where o_custkey = c_custkey
                        and o_orderstatus = 'P' and o_orderpriority = '1-URGENT')),
n as (select *, row_number() over (order by c_custkey) as u,
             (row_number() over (order by c_custkey) - 1) // 50 + 1 as batch_id from c)"""

# Batches the local scorer rejects: first candidate in BUILDING (retry: first and last).
_OUTAGE_SQL = """b as (select batch_id, arg_min(c_mktsegment, u) = 'BUILDING' as down,
             arg_min(c_mktsegment, u) = 'BUILDING' and arg_max(c_mktsegment, u) = 'BUILDING' as down_again
      from n group by batch_id)"""

_RANKED_FINAL_SQL = f"""with {_CANDIDATES_SQL}, {_OUTAGE_SQL},
s as (select u, cast(c_custkey * 37 % 501 as double) as score from n join b using (batch_id) where not b.down),
r as (select u, score, dense_rank() over (order by score desc) as rank from s),
f as (select n.u as unique_id, cast(n.c_custkey as varchar) as c_custkey, n.c_name, n.c_mktsegment,
             coalesce(r.score, 0) as score, coalesce(r.rank, (select count(*) from n) + 1) as rank,
             case when r.u is null then 'Not analyzed by AI' else 'scored' end as remarks
      from n left join r on n.u = r.u)"""

_NUMBERED_SQL = """n as (select c_custkey, c_mktsegment, row_number() over (order by c_custkey) as u,
             (row_number() over (order by c_custkey) - 1) // 50 + 1 as batch_id from customer)"""

_MERGE_INPUT_SQL = """x as (select case when o_orderstatus <> 'P' then o_custkey end as k, o_orderkey,
  case when o_orderstatus <> 'F' then o_orderpriority end as pr,
  case when o_orderpriority not like '1%' then o_totalprice end as tp from orders)"""

_EVENT_SCORE = "cast(json_extract_string(props, '$.k') as double)"

_LABEL_RANKS = """r as (select doc_id, cast(quality * 100 + toxic as double) as score,
  dense_rank() over (order by quality * 100 + toxic desc) as rank from labels)"""

_ORACLES = {
    "union_by_name": """
select c_custkey as id, c_name as name, c_acctbal as acctbal, c_mktsegment as segment from customer
union all by name
select s_suppkey as id, s_name as name, s_acctbal as acctbal, s_nationkey as nationkey from supplier""",
    "union_mixed_types": """
select cast(c_custkey as varchar) as id, c_name as name from customer
union all by name select s_name as id, s_name as name from supplier""",
    "drop_duplicate_rows": "select distinct text, lang, source, n_chars from documents",
    "merge_by_key": f"""with {_MERGE_INPUT_SQL}
select k, arg_min(o_orderkey, o_orderkey) as o_orderkey,
       arg_min(pr, o_orderkey) filter (where pr is not null) as pr,
       arg_min(tp, o_orderkey) filter (where tp is not null) as tp
from x where k is not null group by k""",
    "consolidation_report": f"""with {_MERGE_INPUT_SQL}
select count(*) as rows_in, count(*) - count(distinct k) as merged, count(*) - count(k) as null_key,
       count(distinct case when k in (select o_custkey from orders where o_orderstatus = 'P'
                                      and o_orderpriority = '1-URGENT') then k end) as removed,
       count(distinct k) - removed as rows_out from x""",
    "exclude_by_status": """
with c as (select c_custkey, case when c_mktsegment <> 'BUILDING' then cast(c_custkey as varchar) end as k
           from customer),
     st as (select case when o_orderpriority <> '5-LOW' then cast(o_custkey as varchar) end as k
            from orders where o_orderstatus = 'P')
select c.c_custkey, c.k from c where not exists (select 1 from st where st.k is not distinct from c.k)""",
    "assign_ids": "select doc_id, row_number() over (order by lang, doc_id) as unique_id from documents",
    "stringify_records": """
select cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey,
       coalesce(case when c_mktsegment <> 'MACHINERY' then c_mktsegment end, 'Not specified') as c_mktsegment
from customer""",
    "pack_batches": f"""with {_NUMBERED_SQL}
select (u - 1) // 50 + 1 as batch_id, count(*) as batch_size, min(u) as first_id, max(u) as last_id
from n group by 1""",
    "score_batches": f"""with {_NUMBERED_SQL}, {_OUTAGE_SQL}
select u as unique_id, cast(c_custkey * 37 % 501 as double) as score from n join b using (batch_id)
where not b.down""",
    "failed_batches": f"""with {_NUMBERED_SQL}, {_OUTAGE_SQL}
select batch_id from b where down""",
    "retry_failed": f"""with {_NUMBERED_SQL}, {_OUTAGE_SQL}
select batch_id, case when down_again then 'failed' else 'ok' end as outcome from b""",
    "parse_responses": f"""
select event_id, {_EVENT_SCORE} as score from events where event_type <> 'view'""",
    "outcome_report": """
select case when event_type = 'view' then 'not_list' when event_type = 'error' then 'invalid_json'
            else 'ok' end as outcome, count(*) as n
from events group by 1""",
    "dense_rank_scores": "select doc_id, dense_rank() over (order by n_chars desc) as rank from documents",
    "merge_results": f"""with {_LABEL_RANKS},
m as (select d.doc_id, r.score, r.rank from documents d left join r using (doc_id))
select doc_id, coalesce(score, 0) as score, coalesce(rank, (select count(*) from m) + 1) as rank,
       case when score is null then 'Not analyzed by AI' else 'scored' end as remarks from m""",
    "reconcile_ids": """
select count(*) filter (where a.id is not null and b.id is not null) as matched,
       count(*) filter (where b.id is null) as base_only,
       count(*) filter (where a.id is null) as scores_only
from (select doc_id as id from documents) a full join (select doc_id + 300 as id from labels) b on a.id = b.id""",
    "filter_score_range": "select doc_id, n_chars from documents where n_chars >= 200 and n_chars <= 500",
    "selection_summary": """
select count(*) as n, min(n_chars) as min_score, max(n_chars) as max_score,
       printf('%.1f - %.1f', min(n_chars)::double, max(n_chars)::double) as range_text
from documents where n_chars between 200 and 500""",
    "column_widths": """
select 'c_name' as column_name, least(greatest(max(length(c_name)), 6) + 2, 50) as width from customer
union all
select 'c_mktsegment', least(greatest(max(length(c_mktsegment)), 12) + 2, 50) from customer""",
    "preview": "select doc_id, lang, n_chars from documents order by doc_id limit 10",
    "scoring_projection": """
select c_name, c_mktsegment, row_number() over (order by c_custkey) as unique_id from customer""",
    "select_report": f"""with {_LABEL_RANKS}
select r.rank, r.score, d.doc_id as unique_id, 'scored' as remarks, d.lang
from documents d join r using (doc_id) where r.score >= 1""",
    "analyzed_count": f"""with {_LABEL_RANKS}
select count(*) as analyzed from documents d join r using (doc_id)
where r.rank <= (select count(*) from labels)""",
    "consolidated_base": """
with src as (
  select c_custkey as person_id, c_name as name, c_mktsegment as segment,
         null::varchar as priority, null::double as last_total, 0 as s, c_custkey as o from customer
  union all
  select o_custkey, null, null, o_orderpriority, o_totalprice, 1, o_orderkey from orders),
m as (select person_id,
        arg_min(name, (s, o)) filter (where name is not null) as name,
        arg_min(segment, (s, o)) filter (where segment is not null) as segment,
        arg_min(priority, (s, o)) filter (where priority is not null) as priority,
        arg_min(last_total, (s, o)) filter (where last_total is not null) as last_total
      from src group by person_id),
k as (select * from m where person_id not in (select o_custkey from orders
      where o_orderstatus = 'P' and o_orderpriority = '1-URGENT'))
select cast(person_id as varchar) as person_id, name, segment, priority, last_total,
       row_number() over (order by person_id) as unique_id from k""",
    "ranked_candidates": f"""with {_CANDIDATES_SQL}, {_OUTAGE_SQL},
s as (select u, cast(c_custkey * 37 % 501 as double) as score from n join b using (batch_id) where not b.down),
r as (select u, score, dense_rank() over (order by score desc) as rank from s)
select n.u as unique_id, cast(n.c_custkey as varchar) as c_custkey, n.c_name,
       coalesce(r.score, 0) as score, coalesce(r.rank, (select count(*) from n) + 1) as rank,
       case when r.u is null then 'Not analyzed by AI' else 'scored' end as remarks
from n left join r on n.u = r.u""",
    "retried_ranking": f"""with {_CANDIDATES_SQL}, {_OUTAGE_SQL},
s as (select u, cast(c_custkey * 37 % 501 as double) as score from n join b using (batch_id)
      where not b.down_again),
r as (select u, score, dense_rank() over (order by score desc) as rank from s)
select n.u as unique_id, cast(n.c_custkey as varchar) as c_custkey,
       coalesce(r.score, 0) as score, coalesce(r.rank, (select count(*) from n) + 1) as rank,
       case when r.u is null then 'Not analyzed by AI' else 'scored' end as remarks
from n left join r on n.u = r.u""",
    "sorted_results": """
select dense_rank() over (order by n_chars desc) as rank, n_chars as score, doc_id as unique_id
from documents""",
    "interview_selection": f"""{_RANKED_FINAL_SQL}
select rank, score, unique_id, remarks, c_custkey, c_name, c_mktsegment from f
where score >= 100 and score <= 400""",
    "interview_summary": f"""{_RANKED_FINAL_SQL}
select count(*) as n, min(score) as min_score, max(score) as max_score,
       printf('%.1f - %.1f', min(score), max(score)) as range_text from f
where score >= 100 and score <= 400""",
    "export_widths": f"""{_RANKED_FINAL_SQL}
select column_name, least(greatest(w, length(column_name)) + 2, 50) as width from (
  select 'unique_id' as column_name, max(length(cast(unique_id as varchar))) as w from f
  union all select 'c_custkey', max(length(c_custkey)) from f
  union all select 'c_name', max(length(c_name)) from f
  union all select 'c_mktsegment', max(length(c_mktsegment)) from f
  union all select 'score', max(length(cast(score as varchar))) from f
  union all select 'remarks', max(length(remarks)) from f
  union all select 'rank', max(length(cast(rank as varchar))) from f)""",
}


def _prompt_sql() -> str:
    """The prompt built in SQL: template pieces as literals around the batch values."""
    import re

    slots = {"role": f"'{ROLE}'", "batch_id": "cast(batch_id as varchar)",
             "total": "cast(total as varchar)", "payload": "payload", "id_col": "'unique_id'"}
    parts, pos = [], 0
    for m in re.finditer(r"\{(role|batch_id|total|payload|id_col)\}", PROMPT_TEMPLATE):
        parts.append("'" + PROMPT_TEMPLATE[pos:m.start()].replace("'", "''") + "'")
        parts.append(slots[m.group(1)])
        pos = m.end()
    parts.append("'" + PROMPT_TEMPLATE[pos:].replace("'", "''") + "'")
    return f"""with n as (select c_custkey, c_name, c_mktsegment,
                         row_number() over (order by c_custkey) as u from customer),
b as (select (u - 1) // 50 + 1 as batch_id, count(*) as batch_size,
             list({{'c_custkey': cast(c_custkey as varchar), 'c_name': c_name,
                    'c_mktsegment': c_mktsegment, 'unique_id': cast(u as varchar)}} order by u) as candidates
      from n group by 1),
p as (select batch_id, batch_size, (select count(*) from b) as total,
             cast(to_json({{'batch_id': batch_id, 'batch_size': batch_size,
                           'unique_identifier_column': 'unique_id', 'candidates': candidates}}) as varchar) as payload
      from b)
select batch_id, batch_size, {" || ".join(parts)} as prompt from p"""


_LABEL_FINAL_SQL = f"""with {_LABEL_RANKS},
m as (select d.doc_id as unique_id, d.lang, r.score, r.rank, r.doc_id as hit
      from documents d left join r using (doc_id)),
f as (select unique_id, lang, coalesce(score, 0) as score,
             case when hit is null then 'Not analyzed by AI' else 'scored' end as remarks,
             coalesce(rank, (select count(*) from m) + 1) as rank from m)"""

_ORACLES["render_prompts"] = _prompt_sql()
_ORACLES["normalized_headers"] = """
select c_custkey as CustKey, c_name as "Customer Name", c_mktsegment as "segment market",
       c_acctbal as acctbal from customer"""
_ORACLES["status_preview"] = """
select o_orderkey, o_custkey, o_orderstatus from orders order by o_orderkey limit 3"""
_ORACLES["top_ranked"] = f"{_LABEL_FINAL_SQL} select * from f order by rank, unique_id limit 10"
_ORACLES["export_roundtrip"] = f"{_LABEL_FINAL_SQL} select * from f"
_ORACLES["lineitem_consolidated"] = """
with x as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                  case when l_returnflag <> 'N' then l_returnflag end as returnflag,
                  case when l_discount > 0.05 then l_discount end as discount, l_quantity,
                  (l_linenumber, l_partkey, l_suppkey, l_extendedprice) as o
           from lineitem),
m as (select l_orderkey,
             arg_min(l_linenumber, o) as l_linenumber, arg_min(l_partkey, o) as l_partkey,
             arg_min(l_suppkey, o) as l_suppkey, arg_min(l_extendedprice, o) as l_extendedprice,
             arg_min(returnflag, o) filter (where returnflag is not null) as returnflag,
             arg_min(discount, o) filter (where discount is not null) as discount,
             arg_min(l_quantity, o) as l_quantity
      from x group by l_orderkey),
k as (select * from m where l_orderkey not in (select o_orderkey from orders where o_orderstatus = 'F'))
select cast(l_orderkey as varchar) as l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
       returnflag, discount, l_quantity, row_number() over (order by l_orderkey) as unique_id from k"""


_STATUS_ORDERS_SQL = "select o_custkey from orders where o_orderstatus = 'P' and o_orderpriority = '1-URGENT'"
_ORDER_SCORES_SQL = """o as (select o_orderkey, case when o_orderpriority not in ('1-URGENT', '2-HIGH')
                                                    then o_totalprice end as score from orders)"""
_ORACLES["merge_repeated_ids"] = """
with b as (select s_suppkey from supplier),
s as (select case when l_returnflag = 'N' then 1 when l_returnflag = 'A' then l_suppkey else -l_suppkey end as k,
             case when l_returnflag = 'N' then 7 else l_linenumber end as score from lineitem),
r as (select *, dense_rank() over (order by score desc) as rank from s),
m as (select s_suppkey, score, rank from b left join r on s_suppkey = k)
select s_suppkey, coalesce(score, 0) as score, coalesce(rank, (select count(*) from m) + 1) as rank,
       case when rank is null then 'Not analyzed by AI' else 'scored' end as remarks from m"""
_ORACLES["consolidated_rows"] = """
select *, row_number() over (order by n_chars, text, lang, source) as unique_id
from (select distinct text, lang, source, n_chars from documents)"""
_ORACLES["consolidated_all"] = f"""
select o_orderkey, cast(o_custkey as varchar) as o_custkey, o_totalprice,
       row_number() over (order by o_orderkey) as unique_id
from orders where o_custkey not in ({_STATUS_ORDERS_SQL})"""
_ORACLES["consolidation_flow_report"] = _ORACLES["consolidation_report"]
_ORACLES["scoring_view"] = """
select o_orderstatus, o_totalprice, row_number() over (order by o_orderkey) as unique_id from orders"""
_ORACLES["exclude_nan_keys"] = """
with c as (select c_custkey, case when c_mktsegment <> 'BUILDING' then cast(c_custkey as varchar) end as k
           from customer),
     st as (select case when o_orderpriority <> '5-LOW' then cast(o_custkey as varchar) end as k
            from orders where o_orderstatus = 'P')
select c.c_custkey, c.k from c where not exists (select 1 from st where st.k is not distinct from c.k)"""
_ORACLES["distinct_missing"] = f"""with {_ORDER_SCORES_SQL}
select distinct score, case when o_orderkey % 2 = 0 then 'even' end as parity from o"""
_ORACLES["score_range_missing"] = f"""with {_ORDER_SCORES_SQL}
select count(*) as n, min(score) as min_score, max(score) as max_score,
       printf('%.1f - %.1f', min(score), max(score)) as range_text from o where score >= 1000"""
_ORACLES["widths_missing"] = """
select 's' as column_name, least(greatest(coalesce(max(length(cast(case when s > 0 then 1.5 else s end as varchar))), 0), 1) + 2, 50) as width
from (select case when o_orderpriority in ('1-URGENT', '2-HIGH') then null else o_totalprice end as s from orders)"""
_ORACLES["rank_text_scores"] = f"""
select event_id, {_EVENT_SCORE} as score, dense_rank() over (order by {_EVENT_SCORE} desc) as rank
from events where event_type in ('view', 'click') and {_EVENT_SCORE} is not null"""
_ORACLES["merge_over_old_results"] = f"""with {_LABEL_RANKS}
select d.doc_id, coalesce(score, 0) as score, coalesce(rank, (select count(*) from documents) + 1) as rank,
       case when r.doc_id is null then 'Not analyzed by AI' else 'scored' end as remarks
from documents d left join r on d.doc_id = r.doc_id"""
_ORACLES["merge_no_results"] = "select doc_id, lang from documents"
_ORACLES["merge_all_scores_missing"] = """
select doc_id, lang, cast(null as double) as score, 'Error in analysis or merge' as remarks,
       cast(null as bigint) as rank from documents"""
_ORACLES["csv_source"] = 'select s_suppkey as "SuppKey", s_name as "Name", s_acctbal as "Balance" from supplier'
_ORACLES["source_order"] = "select c_custkey, c_name, row_number() over (order by c_custkey) as unique_id from customer"

_FITS = "o_orderpriority not in ('5-LOW', '1-URGENT')"
_ORACLES["fitting_rows"] = f"select o_orderkey, o_orderstatus, o_totalprice from orders where {_FITS}"
_ORACLES["rejected_rows"] = f"""
select 0 as source, concat_ws(',', o_orderkey, o_orderstatus,
         case when o_orderpriority = '5-LOW' then 'unknown' else {_spark_double("o_totalprice")} end,
         case when o_orderpriority = '1-URGENT' then 'urgent' end) as row
from orders where not ({_FITS})"""
_ORACLES["quarantined_files"] = "select 0 as source, n_name as name, length(n_name) + 2 as bytes from nation"
_ORACLES["readable_files"] = "select p_partkey, p_name from part"
_ORACLES["intake_report"] = f"""
select count(*) as rows_in, 0 as merged, 0 as null_key, 0 as removed, count(*) as rows_out,
       (select count(*) from nation) as bad_files, (select count(*) from orders where not ({_FITS})) as bad_rows
from orders where {_FITS}"""
_ORACLES["union_lossless"] = f"""
select o_orderkey as k, cast(o_custkey + 9007199254740993 as varchar) as v, cast(o_totalprice as decimal(21,2)) as w,
       cast(cast(o_orderdate as date) as timestamp) as at, o_orderstatus as status, cast(cast(o_custkey as integer) as double) as n, null as flag
from orders union all
select l_orderkey, {_spark_double("(l_extendedprice / 2)", key=True)}, cast(l_partkey as decimal(21,2)), l_shipdate, null, l_quantity, l_returnflag
from lineitem"""
_ORACLES["schema_profile"] = """
select * from (values ('k', 0, '0,1,2', 'bigint,int,bigint', 'bigint', false, (select count(*) from orders) + (select count(*) from lineitem) + (select count(*) from customer)),
  ('v', 1, '0,1', 'bigint,double', 'string', false, (select count(o_custkey) from orders) + (select count(l_extendedprice) from lineitem)),
  ('w', 2, '0,1,2', 'decimal(12,2),bigint,double', 'string', false, (select count(o_totalprice) from orders)
     + (select count(l_partkey) from lineitem) + (select count(c_acctbal) from customer where c_nationkey > 5)),
  ('at', 3, '0,1', 'date,timestamp_ntz', 'timestamp_ntz', false, (select count(o_orderdate) from orders) + (select count(l_shipdate) from lineitem)),
  ('Phone Number', 4, '2', 'string', 'string', true, (select count(c_name) from customer)))
  as t(name, position, sources, types, common_type, sensitive, present)"""
_ORACLES["sensitive_names"] = r"""
select name, count(*) as n, regexp_matches(name, '(phone|mobile|contact)\s*number', 'i') or regexp_matches(name, 'phone|mobile|contact', 'i')
       or regexp_matches(name, '(employee)\s*(id|number)', 'i') or regexp_matches(name, '(employeeid|employeenumber)', 'i') as sensitive
from (select upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' ||
             ['Phone Number', 'EMPLOYEE  id', 'mobile', 'contact-no', 'EmployeeNumber', 'skills', 'employee name'][c_nationkey % 7 + 1] as name
      from customer) group by name""".replace("\\\\", "\\")
_ORACLES["resumed_scoring"] = _ORACLES["retry_failed"]


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: consolidate customers, score them in batches, rank, merge (sf0.001)."""
    return q_ranked_candidates(spark, SMOKE_DIR)


def _add_optional() -> None:
    """Add the queries of the corpus operators and of the corpus pipeline, if they are there and
    the packages they need are installed."""
    for module in ("scorekit.llm.queries", "corpus_pipeline"):
        try:
            found = importlib.import_module(module)
        except ModuleNotFoundError as e:
            if e.name not in ("scorekit.llm", "scorekit.llm.queries", "corpus_pipeline"):
                if (e.name or "").split(".")[0] == "scorekit":
                    raise
                warnings.warn(f"no queries from {module}: {e}", stacklevel=2)
            continue
        _QUERIES.update(found.QUERIES)
        _ORACLES.update(found.ORACLES)


_add_optional()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v.strip() for k, v in _ORACLES.items()}
