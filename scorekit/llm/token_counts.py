"""Token counts through a digest cache.

The cache is a Parquet table ``tokenizer, digest, n_tokens``: the SHA-256 of the tokenizer file
(its version), the SHA-256 of the text, and the count. :func:`count_tokens` joins the texts'
digests to the stored counts, encodes each distinct missing text once, appends those counts
to the cache, and answers from the cache. Text is not normalised before its digest is taken:
any change of the text may change its count. Each filling writes a folder of its own in the cache's,
so several writers can fill one cache at a time; what two of them both add is read once.

Only missing texts move: one row per digest and map task enters the shuffle (map-side
reduction), so a text that fills a third of the table moves once per map task. Digests are
joined as narrow rows.

A text is encoded in pieces: it is cut before each space that follows a non-space character.
No token of a byte-level BPE crosses such a place (its splitting pattern never joins a
non-space to a following space, and looks ahead only from inside a run of white space), so
the counts of the pieces add up; pieces seen before by the worker are not encoded again. A
tokenizer that is set up otherwise (another pre-tokenizer, a normaliser, special strings with
spaces) gets whole texts.

Cases: a null text counts as empty (0 tokens); repeated rows each get their count; an empty
table gives an empty result and leaves the cache as it was.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorekit.llm.common import id_and_text, slices, worker_state

MEMO_PIECES = 300_000  # pieces a worker remembers before it starts afresh: bounds its memory
CACHE_SCHEMA = "tokenizer string, digest string, n_tokens bigint"
RUN_OF_SPACE = re.compile(r"\s |  |^ | $")
PIECE_START = re.compile(r"(?<=[A-Za-z0-9.,;:!?)\]}'\"|_-])(?= )")


def splits_at_spaces(config: dict) -> bool:
    """Whether a tokenizer file is plain byte-level BPE, so that pieces may be counted alone."""
    pre = config.get("pre_tokenizer") or {}
    return (config.get("model", {}).get("type") == "BPE" and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and config.get("normalizer") is None
            and not config["model"].get("dropout") and config.get("truncation") is None
            and all(not t.get("lstrip") and not t.get("rstrip") and not re.search(r"\s", t["content"])
                    for t in config.get("added_tokens", [])))


def pieces_of(text: str) -> list[str]:
    """``text`` cut at places that no token crosses."""
    if RUN_OF_SPACE.search(text):
        return PIECE_START.split(text)  # cut only after a character that is surely no space
    first, *rest = text.split(" ")
    return [first, *(" " + r for r in rest)] if first else [" " + r for r in rest]


class PieceCounter:
    """Counts tokens with the tokenizers library, remembering short pieces."""

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_buffer(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.by_piece = splits_at_spaces(json.loads(file))
        self.memo: dict[str, int] = {}

    def _encode(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return self._encode(texts)
        cut = [pieces_of(t) for t in texts]
        missing = set().union(*cut).difference(self.memo)
        if len(self.memo) + len(missing) > MEMO_PIECES:
            self.memo.clear()
            missing = set().union(*cut)
        missing = list(missing)
        self.memo.update(zip(missing, self._encode(missing)))
        found = self.memo.__getitem__
        return [sum(map(found, c)) for c in cut]


def _counter(file: bytes, version: str) -> PieceCounter:
    state = worker_state()
    if state.get("counter_version") != version:
        state["counter"], state["counter_version"] = PieceCounter(file), version
    return state["counter"]


def _count_task(file: bytes, version: str):
    def count(batches):
        for part in slices(batches, 256):
            texts = part.column(1).to_pylist()
            n = _counter(file, version).counts(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())],
                                             names=["digest", "n_tokens"])
    return count


def _stored(spark, cache_path: str, version: str) -> DataFrame:
    """The cache's rows for this tokenizer; a path that does not exist yet is an empty cache."""
    try:
        rows = spark.read.schema(CACHE_SCHEMA).option("recursiveFileLookup", "true").parquet(cache_path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.where(F.col("tokenizer") == version).select("digest", "n_tokens").dropDuplicates(["digest"])


def fill_cache(docs: DataFrame, tokenizer_path: str, cache_path: str, text_col: str = "text") -> str:
    """Append the counts of the distinct texts that the cache lacks; returns the version digest."""
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        file = f.read()
    version = hashlib.sha256(file).hexdigest()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.sha2(text, 256).alias("digest"), text.alias("text"))
    misses = texts.dropDuplicates(["digest"]).join(_stored(spark, cache_path, version), "digest", "left_anti")
    (misses.mapInArrow(_count_task(file, version), "digest string, n_tokens bigint")
     .select(F.lit(version).alias("tokenizer"), "digest", "n_tokens")
     .write.parquet(f"{cache_path}/run={uuid.uuid4().hex}"))
    return version


def stored_counts(docs: DataFrame, version: str, cache_path: str, limit: int = 512,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row whose text the cache holds a count of,
    by the tokenizer of this version digest."""
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("digest"))
    return rows.join(_stored(docs.sparkSession, cache_path, version), "digest").select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 512,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row, counts taken from the cache
    after :func:`fill_cache` has added what it lacked."""
    version = fill_cache(docs, tokenizer_path, cache_path, text_col)
    return stored_counts(docs, version, cache_path, limit, id_col, text_col)
