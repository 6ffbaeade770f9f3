"""Chat formatting in budgeted windows, with DataFrame functions only.

A conversation's turns are laid out over windows of at most ``budget`` tokens. Prefix sums of
the turns' tokens choose the spans: with ``S = budget - history - tokens of the system turn``,
the turns that lie wholly between two multiples of ``S`` form a span, and a turn that lies
across a multiple is a span by itself. So spans hold whole turns, and no more than ``S`` tokens
unless a single turn is longer. A window is the system turn (retained in every window), the
turns of the last ``history`` tokens before the span (repeated as context), and the span. The
loss mask covers the texts of assistant turns of the span only, so each is a target once and
repeated ones are masked.

Template: ``### role: text</turn>`` and a line feed for each turn. Inside texts ``\\`` becomes
``\\\\``, ``</`` becomes ``<\\/`` and ``#`` becomes ``\\#``, so no text can hold a turn mark, and taking
away the backslashes restores it; roles are URL-encoded. :func:`read_turns` and
:func:`read_targets` read windows back from the formatted text and mask alone.

Tokens of a turn are estimated as a quarter of its UTF-8 bytes, rounded up, and
``TURN_TOKENS`` for the template; ``tokens`` takes any other SQL expression over ``text``.

A conversation may be long: prefix sums are taken in blocks of ``BLOCK_TURNS`` turn numbers and
the blocks' sums are added, and history is found by an equality join on cells of
``history`` tokens, so no task holds more than a block, a window or a turn. Only the digests of
:func:`conversation_digests` bring a conversation's text together, as they must.

Cases: a null text or role counts as empty; turns are ordered by turn number, then role and
text (nulls first), and repeated rows are turns of their own; a null conversation id is a
conversation; an empty table gives an empty result. A first turn of role ``system`` is the
system turn; system turns elsewhere are ordinary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorekit.session import materialize

BUDGET = 1024
HISTORY = 256
TURN_TOKENS = 4
TOKENS = f"ceil(octet_length(text) / 4) + {TURN_TOKENS}"
BLOCK_TURNS = 1024

# The template's marks (fixed values of this format).
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"


def escape(text):
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit("</"), F.lit("<\\/"))
    return F.replace(text, F.lit("#"), F.lit("\\#"))


def unescape(text):
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _turns(conversations: DataFrame, tokens: str) -> DataFrame:
    """``conv_id, pos, role, text, system, begin, until``: turns with the prefix sums of their
    tokens before and after them (a system turn counts as none)."""
    rows = conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumns({
            "own": F.expr(tokens).cast("bigint"),
            "conv": F.coalesce(F.xxhash64("conv_id"), F.lit(0)),
            "block": F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62)))})
    # Rows are dealt by (conv, block) once: the windows and the join with the blocks' sums keep to that.
    dealt = ["conv", "block"]
    inside = Window.partitionBy(*dealt, "conv_id").orderBy("turn", "role", "text")
    rows = rows.repartition(*dealt).withColumn("nr", F.row_number().over(inside))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("nr") == 1
    blocks = (rows.groupBy(*dealt, "conv_id")
              .agg(F.sum("own").alias("all"), F.count(F.lit(1)).alias("n"),
                   F.max(F.when(first & (F.col("role") == "system"), F.col("own"))).alias("system_tokens"))
              .withColumns({
                  "pos0": F.coalesce(F.sum("n").over(earlier), F.lit(0)),
                  "sum0": F.coalesce(F.sum("all").over(earlier), F.lit(0)),
                  # the system turn's tokens, known to all blocks of the conversation
                  "system_tokens": F.first("system_tokens").over(
                      Window.partitionBy("conv_id").orderBy("block")
                      .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
              .withColumnsRenamed({"conv_id": "b_conv_id", "conv": "b_conv", "block": "b_block"}))
    rows = rows.join(blocks, (F.col("conv") == F.col("b_conv")) & (F.col("block") == F.col("b_block"))
                     & F.col("conv_id").eqNullSafe(F.col("b_conv_id")))
    running = F.sum("own").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    off = F.coalesce("system_tokens", F.lit(0))
    return rows.withColumns({"pos": F.col("pos0") + F.col("nr"), "until": F.col("sum0") + running - off}).select(
        "conv_id", "pos", "role", "text", off.alias("off"),
        ((F.col("pos") == 1) & (F.col("role") == "system")).alias("system"),
        F.greatest(F.col("until") - F.col("own"), F.lit(0)).alias("begin"), "until")


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY,
                   tokens: str = TOKENS) -> DataFrame:
    """``conv_id, window, formatted, n_repeated, targets``: one row per window.

    ``window`` orders the windows of a conversation; the first ``n_repeated`` turns of a window
    are repeated ones; ``targets`` is the loss mask: ``start`` (from 0) and ``length`` of stretches of
    ``formatted``, in code points.
    """
    turns = _turns(conversations, tokens)
    span = F.greatest(F.lit(1), F.lit(budget - history) - F.col("off"))
    low = F.floor(F.col("begin") / span)
    across = F.floor((F.col("until") - 1) / span) > low
    turns = turns.withColumn("window", (2 * low + F.when(F.col("system"), 0).otherwise(across.cast("int"))).cast("bigint"))
    # Written once: spans and history are chosen on narrow columns of this table, and its texts are
    # read for the windows' own turns and for the repeated ones.
    turns = materialize(turns, "turns")

    own = turns.select("conv_id", "window", F.lit(2).alias("kind"), "pos", "role", "text")
    starts = turns.groupBy("conv_id", "window").agg(F.min("begin").alias("start"), F.min("pos").alias("first"))
    later = starts.where("first > 1").select(
        F.col("conv_id").alias("w_conv"), F.col("window").alias("w"), "start", "first",
        F.floor(F.col("start") / max(1, history)).alias("cell"))
    same = F.col("conv_id").eqNullSafe(F.col("w_conv"))
    system = (turns.where("system").select("conv_id", "pos").join(later, same)
              .select("w_conv", "w", F.lit(0).alias("kind"), F.col("pos").alias("p")))
    here = F.floor(F.col("until") / max(1, history))
    cells = turns.where(~F.col("system")).select("conv_id", "pos", "begin", "until", F.explode(F.array(here, here + 1)).alias("t_cell"))
    before = (cells.join(later, same & (F.col("t_cell") == F.col("cell")))
              .where((F.col("until") <= F.col("start")) & (F.col("begin") >= F.col("start") - history))
              .select("w_conv", "w", F.lit(1).alias("kind"), F.col("pos").alias("p")))
    repeated = (turns.select("conv_id", "pos", "role", "text")
                .join(system.unionByName(before), same & (F.col("pos") == F.col("p")))
                .select("conv_id", F.col("w").alias("window"), "kind", "pos", "role", "text"))

    parts = own.unionByName(repeated).groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("kind", "pos", "role", "text"))).alias("parts"))
    parts = parts.withColumn("parts", F.transform("parts", lambda p: F.struct(
        (p["kind"] < 2).alias("repeated"), (p["role"] == "assistant").alias("answer"),
        F.url_encode(p["role"]).alias("role"), escape(p["text"]).alias("text"))))
    parts = parts.withColumn("lines", F.transform("parts", lambda p: F.concat(
        F.lit(OPEN), p["role"], F.lit(COLON), p["text"], F.lit(CLOSE))))
    sizes = F.transform("lines", F.char_length)
    where = parts.withColumn("sizes", sizes).withColumn("spots", F.transform("parts", lambda p, i: F.struct(
        (F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0).cast("int"), lambda a, x: a + x) + len(OPEN) + len(COLON)
         + F.char_length(p["role"])).alias("start"),
        F.char_length(p["text"]).alias("length"), (p["answer"] & ~p["repeated"]).alias("on"))))
    return where.select(
        "conv_id", "window", F.array_join("lines", "").alias("formatted"),
        F.size(F.filter("parts", lambda p: p["repeated"])).alias("n_repeated"),
        F.transform(F.filter("spots", lambda s: s["on"]),
                    lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))).alias("targets"))


def read_turns(windows: DataFrame) -> DataFrame:
    """Windows with ``turns``: the turns (role, text) that they do not repeat, read from the
    formatted text."""
    lines = F.split("formatted", CLOSE)
    lines = F.slice(lines, F.col("n_repeated") + 1, F.size(lines) - 1 - F.col("n_repeated"))

    def turn(line):
        colon = F.locate(COLON, line)
        return F.struct(F.url_decode(F.substr(line, F.lit(len(OPEN) + 1), colon - len(OPEN) - 1)).alias("role"),
                        unescape(F.substr(line, colon + len(COLON))).alias("text"))
    return windows.withColumn("turns", F.transform(lines, turn))


def read_targets(windows: DataFrame) -> DataFrame:
    """Windows with ``target_texts``: the texts under the loss mask, unescaped."""
    return windows.withColumn("target_texts", F.transform(
        "targets", lambda t: unescape(F.substr("formatted", t["start"] + 1, t["length"]))))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all read back
    from windows."""
    read = read_targets(read_turns(windows)).select(
        "conv_id", "window", F.size("turns").alias("n"), F.char_length("formatted").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
        .alias("turns"), F.array_join("target_texts", "").alias("loss"))
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
        F.sum(F.char_length("loss")).alias("loss_chars"),
        F.sort_array(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"))
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("w.turns", ""), 256).alias("turns_sha256"), "loss_chars",
        F.sha2(F.array_join("w.loss", ""), 256).alias("loss_sha256"), "formatted_chars")
