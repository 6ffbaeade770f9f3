"""Corpus pipeline: five stages over ``documents``, each calling one corpus operator.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes each stage's
rows as Parquet under the shared folder and reads them again as the next one's ``docs``, so a
lost executor costs at most one stage and no plan spans stages. All stages but the last return
the columns of ``documents``. Stages share nothing but those rows: each judges all that its
predecessor kept.
"""

from __future__ import annotations

from scorekit.llm import decontamination, exact_dedup, simhash, sp_codec, toxicity
from scorekit.llm.common import table
from scorekit.llm.queries import GRADE, MAX_BITS, SHINGLE, SP_MODEL
from scorekit.session import delete_tables, materialize


def reject_toxic(spark, docs, sf_dir):
    """Documents that the severity model calls toxic go. The model learns from ``labels``."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), GRADE)
    return toxicity.drop_toxic(docs, model)


def drop_copies(spark, docs, sf_dir):
    """Of documents with equal text the one with the largest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark, docs, sf_dir):
    """Of documents whose fingerprints are linked the one with the smallest id stays."""
    return simhash.keep_one_of_each_group(docs, SHINGLE, MAX_BITS)


def drop_benchmark_text(spark, docs, sf_dir):
    """Documents that hold an item of ``benchmark``, with few edits or none, go."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark, docs, sf_dir):
    """``doc_id, ids, decoded`` of what is left."""
    return sp_codec.encode_documents(docs, SP_MODEL)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("decontamination", drop_benchmark_text),
    ("sentencepiece", encode),
]


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        delete_tables(spark, before)  # a stage's rows are not read again once the next one's are written
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fingerprints, learned weights and ids are beyond SQL; tests check each stage by brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLES = {}
