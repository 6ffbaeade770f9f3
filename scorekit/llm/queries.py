"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import functions as F

from scorekit.llm import (
    chat_windows,
    decontamination,
    exact_dedup,
    langid,
    lm_scoring,
    pivot_clustering,
    pu_quality,
    sharding,
    simhash,
    sp_codec,
    token_counts,
    toxicity,
    whitening,
)
from scorekit.llm.common import held_out, table
from scorekit.session import checkpoint_root

SHINGLE, MAX_BITS = 3, 2
SHARDS = 24
ADDED_TEXT = r"\### Assistant: </turn> ok"  # of conversation -7
SP_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")

#: Severity grades of ``labels``: 0 not toxic, 1 toxic. The labels hold no severity beyond that
#: (``quality`` does not follow toxicity), so this is a cumulative-link fit of two grades.
GRADE = "toxic"


def op1_lm_scoring(spark, sf_dir):
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op2_chat_windows(spark, sf_dir):
    added = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(ADDED_TEXT).alias("text"))
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_windows.conversation_digests(chat_windows.format_windows(conversations.unionByName(added)))


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), SHINGLE, MAX_BITS)


def op4_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark, sf_dir):
    return langid.identify_held_out(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict_severity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels"), GRADE))


def op7_sentencepiece(spark, sf_dir):
    return sp_codec.encoding_digests(table(spark, sf_dir, "documents"), SP_MODEL)


def op8_sharding(spark, sf_dir):
    return sharding.shard_equally(table(spark, sf_dir, "documents"), SHARDS)


def op9_token_counts(spark, sf_dir):
    """The table comes in two deliveries (by the checksum of the id), each of which fills one cache: texts
    of the second that the first held too are hits, the rest are appended. Counts of all rows are then
    read from the cache."""
    docs = table(spark, sf_dir, "documents")
    cache = os.path.join(checkpoint_root(spark), f"token-cache-{uuid.uuid4().hex}")
    first = held_out(F.col("doc_id"), 2, 0)
    token_counts.fill_cache(docs.where(first), BPE_FILE, cache)
    version = token_counts.fill_cache(docs.where(~first), BPE_FILE, cache)
    return token_counts.stored_counts(docs, version, cache)


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark, sf_dir):
    return pivot_clustering.cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pu_quality.predict_quality(docs, pu_quality.learn(docs, table(spark, sf_dir, "labels")))


def op13_embedding_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_chat_windows, op3_simhash, op4_decontamination, op5_language_id, op6_toxicity, op7_sentencepiece, op8_sharding,
    op9_token_counts, op10_exact_dedup, op11_centroid_clustering, op12_quality_classifier, op13_embedding_whitening)}

ORACLES = {
    "op2_chat_windows": rf"""
with added(conv_id, turn, role, text) as (values
  (-7, 0, 'user', '{ADDED_TEXT}'), (-7, 1, 'assistant', '{ADDED_TEXT}')),
rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
         from (select conv_id, turn, role, text from conversations union all select * from added)),
t as (select *, row_number() over w as pos,
             (strlen(text) + 3) // 4 + {chat_windows.TURN_TOKENS} as own,
             4 + length(role) + 2 + 8
             + length(replace(replace(replace(text, '\', '\\'), '</', '<\/'), '#', '\#')) as chars
      from rows window w as (partition by conv_id order by turn, role, text)),
s as (select *, pos = 1 and role = 'system' as is_system from t),
o as (select *, max(case when is_system then own else 0 end) over (partition by conv_id) as off_,
             sum(case when is_system then 0 else own end) over (partition by conv_id order by pos) as until_
      from s),
b as (select *, case when is_system then 0 else until_ - own end as begin_,
             greatest(1, {chat_windows.BUDGET - chat_windows.HISTORY} - off_) as span from o),
m as (select *, 2 * (begin_ // span)
                + case when not is_system and (until_ - 1) // span > begin_ // span then 1 else 0 end as win from b),
w as (select conv_id, win, min(begin_) as start_, min(pos) as first_, sum(chars) as own_chars from m group by 1, 2),
h as (select w.conv_id, w.win, sum(m.chars) as chars
      from w join m on m.conv_id = w.conv_id and w.first_ > 1
           and (m.is_system or (m.until_ <= w.start_ and m.begin_ >= w.start_ - {chat_windows.HISTORY}))
      group by 1, 2),
f as (select w.conv_id, sum(own_chars + coalesce(h.chars, 0)) as formatted_chars
      from w left join h on h.conv_id = w.conv_id and h.win = w.win group by 1),
d as (select conv_id, count(*) as n_turns,
             sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
             sum(case when role = 'assistant' then length(text) else 0 end) as loss_chars,
             sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by pos)) as loss_sha256
      from t group by 1)
select conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars
from d join f using (conv_id)""",
    "op10_exact_dedup": """
select d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id as kept,
       sha256(coalesce(d.text, '')) as text_sha256
from documents d join (select coalesce(text, '') as t, max(doc_id) as keep_id, count(*) as group_size
                       from documents group by 1) g on coalesce(d.text, '') = g.t""",
    "op11_centroid_clustering": pivot_clustering.cluster_sql(),
}
