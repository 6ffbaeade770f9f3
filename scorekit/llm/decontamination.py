"""Benchmark decontamination by CGK embedding and bit-sampling LSH, with exact verification.

A document is contaminated by an item when some run of its words is within
``floor(max_share * words of the item)`` word edits of the item (lower-cased; punctuation and
white space do not count).

1. Windows. Every document is viewed through windows of the items' sizes (lengths in words,
   rounded down to a geometric grid from 20 words on, so there are few sizes). A window starts
   at every word; those that cannot match are passed over by the q-gram lemma: each edit
   destroys at most two word pairs, so a window that begins a match holds at least
   ``size - 1 - 2 * edits`` word pairs of items. The pairs are looked up in a bit table, whose false
   positives only let more windows through; it has ``PLACES_EACH`` places or more for each pair of the
   items, up to ``2**MOST_BITS`` (8 MB sent to a task; with more pairs than 2**22 it fills up and spares
   less work, but loses nothing). A pair counts at most as often as the items repeat any pair, so
   runs of one repeated word do not pass.
   Two walks fall out of step in long windows. So items of ``2 * PIECE`` words and more are cut into
   equal pieces, and the windows have a piece's size: of the pieces of a match, one at least has no
   greater share of edits than the whole, and every piece is one more chance to meet.
2. Embedding. The rest are embedded by the random walk of Chakraborty, Goldenberg and Koucky:
   at step ``j`` the symbol under the pointer is written, and the pointer moves on if a random
   bit of (j, symbol) says so. Few edits between two word sequences become few differing
   places of their embeddings, as the walks fall into step again.
3. Search. ``tables`` signatures are drawn from ``walks`` embeddings, each of ``sampled``
   places, and joined by equality with the items' signatures. With these numbers matches at
   the greatest distance are found with a probability of about 0.95 or more, which does not fall with
   length (tests: 15 to 59, 66 to 1000 words); most are met by several windows.
4. Verification. Every candidate is checked by the exact edit distance between the whole item
   and any run of words around the window.

Only candidate windows leave the map tasks; texts do not move.

Cases: null or wordless texts and items match nothing; an item with fewer than five words must
occur exactly; equal items each give their own rows; repeated rows give one row per id and
item; an empty table on either side gives an empty result; null ids are carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorekit.llm.common import fresh, slices
from scorekit.llm.hashing import WordHasher, mix
from scorekit.session import materialize

MAX_SHARE = 0.2
WALKS, TABLES, SAMPLED = 8, 32, 3
LEAST_BITS, MOST_BITS = 22, 26  # the bit tables have 2**22 to 2**26 places, by the number of the items' pairs
PLACES_EACH = 16
BITMAP_BITS = 15         # Spark's bitmaps have 2**15 places
EXACT_SIZES, GRID = 20, 1.1
PIECE = 30               # words, at least, of the pieces of long items
WINDOWS_AT_ONCE = 1 << 16
WORDS_AT_ONCE = 1 << 18
PAD = np.uint64(0)

#: Bytes that part words here: all ASCII that is no letter or digit (texts are lower-cased).
PARTS = np.ones(256, dtype=bool)
PARTS[48:58] = PARTS[65:91] = PARTS[97:123] = PARTS[128:] = False


def window_size(words: int) -> int:
    """The grid size for an item of ``words`` words."""
    size = words if words <= EXACT_SIZES else EXACT_SIZES
    while size * GRID <= words and words > EXACT_SIZES:
        size = int(size * GRID)
    return size


def pieces(size: int) -> int:
    """How many pieces the items of a grid size are cut into; windows have ``size // pieces`` words."""
    return max(1, size // PIECE)


def edits_allowed(words: int, max_share: float) -> int:
    return int(words * max_share + 1e-9)


class Walks:
    """Signatures of the windows of one grid size; the same for items and documents by fixed seeds."""

    def __init__(self, size: int, walks: int, tables: int, sampled: int):
        dice = np.random.Generator(np.random.PCG64([size, walks, tables, sampled]))
        self.pieces = pieces(size)
        self.size, self.sampled = size // self.pieces, sampled
        steps = max(1, 2 * self.size)  # the pointer moves at every other step: one pass over the window
        self.keys = dice.integers(0, 1 << 63, (walks, steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        per_walk = -(-tables // walks)
        self.places = [[dice.choice(steps, size=min(sampled, steps), replace=False) for _ in range(per_walk)]
                       for _ in range(walks)]
        self.names = dice.integers(0, 1 << 63, (walks, per_walk), dtype=np.uint64)

    def signatures(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of signatures for each window of ``words`` that starts at ``starts``."""
        found = []
        for keys, tables, names in zip(self.keys, self.places, self.names):
            out = [np.full(len(starts), n) for n in names]
            wanted = {}
            for t, places in enumerate(tables):
                for p in places:
                    wanted.setdefault(int(p), []).append(t)
            pointer = np.zeros(len(starts), dtype=np.int64)
            for step in range(max(wanted) + 1):
                inside = pointer < self.size
                symbol = np.where(inside, words[starts + np.minimum(pointer, self.size - 1)], PAD)
                for t in wanted.get(step, ()):
                    out[t] = mix(out[t] + symbol * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step))
                pointer += ((symbol * keys[step]) >> np.uint64(63)).astype(np.int64) & inside
            found += out
        return np.stack(found, axis=1) if found else np.zeros((len(starts), 0), np.uint64)


def _words(hasher: WordHasher, text: bytes) -> np.ndarray:
    raw = np.frombuffer(text, dtype=np.uint8)
    found = [np.maximum(h, np.uint64(1)) for _, _, h in hasher.words(raw, PARTS)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _pairs(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * np.uint64(3) + words[1:])


def _earlier(pairs: np.ndarray, at: np.ndarray, times: int) -> np.ndarray:
    """For each of the places ``at`` of ``pairs``: the place where the same pair stood ``times``
    occurrences (among ``at``) before, or -1."""
    order = np.argsort(pairs[at], kind="stable")
    sorted_pairs, place = pairs[at][order], at[order]
    found = np.full(len(at), -1, dtype=np.int64)
    same = sorted_pairs[times:] == sorted_pairs[:-times]
    found[order[times:][same]] = place[:-times][same]
    return found


def _passing(at: np.ndarray, earlier: np.ndarray, begins: np.ndarray, size: int, least: int) -> np.ndarray:
    """Starts of the windows of ``size`` words (two or more) that hold ``least`` or more of the item pairs at the
    places ``at``. A pair counts in a window only if its ``earlier`` occurrence lies before the
    window; no window starts before the text's beginning (``begins``, for each of the pairs)."""
    if len(at) < least:
        return np.zeros(0, dtype=np.int64)
    # In a window that passes, any ``least`` neighbours of its pairs lie close together.
    close = np.flatnonzero(at[least - 1:] - at[:len(at) - least + 1] <= size - 2)
    runs = np.bincount(close, minlength=len(at) + 1) - np.bincount(close + least, minlength=len(at) + 1)
    near = np.flatnonzero(np.cumsum(runs[:-1]))
    first = np.maximum(np.maximum(earlier[near] + 1, at[near] - size + 2), begins[near])
    # A pair is held by the windows from ``first`` up to its own place.
    places = np.concatenate([first, at[near] + 1])
    order = np.argsort(places, kind="stable")
    held = np.cumsum(np.where(order < len(near), 1, -1))[:-1]
    enough = np.flatnonzero(held >= least)
    lo, lengths = places[order][enough], np.diff(places[order])[enough]
    return np.repeat(lo - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())


def _word_groups(hasher: WordHasher, texts):
    """The words of each text, in lists of neighbouring texts with some ``WORDS_AT_ONCE`` words together."""
    group, held = [], 0
    for text in texts:
        group.append(_words(hasher, text))
        held += len(group[-1])
        if held >= WORDS_AT_ONCE:
            yield group
            group, held = [], 0
    if group:
        yield group


def table_bits(numbers: int) -> int:
    """The bit table for so many numbers has two to this power places."""
    return min(max(LEAST_BITS, (numbers * PLACES_EACH - 1).bit_length()), MOST_BITS)


def _bit_table(hashes: DataFrame, numbers: int) -> bytes:
    """Bits, of which those at the leading bits of each row's ``hash`` are set. Pieces of the table are
    put together in the tasks; the driver gets each piece once, so no more than the table."""
    bits = table_bits(numbers)
    place = F.shiftrightunsigned("hash", 64 - bits)
    pieces_of_table = hashes.groupBy(F.shiftright(place, BITMAP_BITS).alias("piece")).agg(
        F.bitmap_construct_agg(place.bitwiseAND((1 << BITMAP_BITS) - 1)).alias("bitmap"))
    size = 1 << BITMAP_BITS - 3
    table = np.zeros(1 << bits - 3, dtype=np.uint8)
    for r in pieces_of_table.toLocalIterator():
        table[r["piece"] * size:(r["piece"] + 1) * size] = np.frombuffer(r["bitmap"], dtype=np.uint8)
    return table.tobytes()


class BitTable:
    """A :func:`_bit_table`, opened: which hashes may be among its rows'."""

    def __init__(self, table: bytes):
        self.unused = np.uint64(65 - (len(table) * 8).bit_length())
        self.bits = np.unpackbits(np.frombuffer(table, dtype=np.uint8), bitorder="little").view(bool)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        return self.bits[(hashes >> self.unused).astype(np.int64)]


def _long_lists(values) -> pa.Array:
    return pa.array([v.view(np.int64) for v in values], pa.list_(pa.int64()))


def _item_rows(benchmark: DataFrame, item_col: str, text_col: str, shape) -> DataFrame:
    """``item`` (a number of its own), ``item_id, size, n_words, words, pairs, sigs`` of each
    distinct item; ``most``: how often it has its most frequent word pair."""
    def task(batches):
        hasher, walkers = WordHasher(), {}
        for part in slices(batches):
            kept, sizes, n, most, words, hashes, sigs = [], [], [], [], [], [], []
            for i, text in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                w = _words(hasher, text)
                if len(w) == 0:
                    continue
                size = window_size(len(w))
                if size not in walkers:
                    walkers[size] = Walks(size, *shape)
                kept.append(i)
                sizes.append(size)
                n.append(len(w))
                words.append(w)
                pairs = _pairs(w) if len(w) > 1 else mix(w)
                most.append(int(np.unique(pairs, return_counts=True)[1].max()))
                hashes.append(pairs)
                starts = np.arange(walkers[size].pieces) * len(w) // walkers[size].pieces
                sigs.append(np.unique(walkers[size].signatures(w, starts)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int32()),
                 pa.array(n, pa.int32()), pa.array(most, pa.int32()), _long_lists(words), _long_lists(hashes),
                 _long_lists(sigs)], names=["item_id", "size", "n_words", "most", "words", "pairs", "sigs"])

    rows = benchmark.select(F.col(item_col).alias("item_id"),
                            F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text")).distinct()
    schema = T.StructType([T.StructField("item_id", benchmark.schema[item_col].dataType),
                           *T._parse_datatype_string("size int, n_words int, most int, words array<bigint>, "
                                                     "pairs array<bigint>, sigs array<bigint>").fields])
    return materialize(rows.mapInArrow(task, schema).withColumn("item", F.monotonically_increasing_id()),
                       "decon-items")


def _candidates(docs: DataFrame, id_col: str, text_col: str, need: dict[int, tuple[int, int]],
                most: int, pair_bits: bytes, sig_bits: bytes, shape) -> DataFrame:
    """``cand, doc_id, sha, first, words, sigs``: stretches of documents with the signatures
    that their windows share with the bit table of the items' signatures.

    ``need``: window size -> (least number of item pairs, greatest item length and edits).
    A stretch covers the windows that start in one run of ``size`` words, and as far as a match
    can reach from there to either side.
    """
    def windows(texts, hasher, pairs):
        """All words of the texts, each text followed by padding; where each text starts; and
        for each size the starts of the windows that pass, with their texts' numbers."""
        gap = np.full(max(need, default=0), PAD)
        kept, begins, passed, at = [], [], {size: ([], []) for size in need}, 0
        for group in _word_groups(hasher, texts):
            lengths = np.array([len(w) for w in group])
            origins = np.cumsum(lengths) - lengths
            words = np.concatenate(group)
            own = _pairs(words)
            hit = pairs.holds(own)
            hit[origins[(origins > 0) & (origins < len(words))] - 1] = False  # a pair does not cross two texts
            hits = np.flatnonzero(hit)
            # Occurrences in an earlier text lie before the text's beginning, which bounds windows anyway.
            earlier = _earlier(own, hits, most)
            origin = origins[np.searchsorted(origins, hits, side="right") - 1]
            starts, found = {}, np.zeros(len(group), dtype=bool)
            for size, (least, _) in need.items():
                # Windows may hang over the end: a match can be shorter than its item.
                first = (np.flatnonzero(pairs.holds(mix(words))) if size == 1 else
                         _passing(hits, earlier, origin, size // pieces(size), least))
                text = np.searchsorted(origins, first, side="right") - 1
                starts[size] = first, text
                found[text] = True
            space = np.where(found, lengths + len(gap), 0)
            begin = at + np.cumsum(space) - space
            for size, (first, text) in starts.items():
                passed[size][0].append(first - origins[text] + begin[text])
                passed[size][1].append(text + len(begins))
            for i in np.flatnonzero(found):
                kept += [group[i], gap]
            begins += begin.tolist()
            at += int(space.sum())
        begins.append(at)
        return np.concatenate(kept) if kept else gap, np.array(begins), passed

    def task(batches):
        hasher, pairs, known = WordHasher(), BitTable(pair_bits), BitTable(sig_bits)
        walkers = {size: Walks(size, *shape) for size in need}
        for part in slices(batches):
            rows, first, words, sigs = [], [], [], []
            every, begins, passed = windows(part.column(2).cast(pa.binary()).to_pylist(), hasher, pairs)
            ends = begins[1:] - max(need, default=0)
            for size, (starts, texts) in passed.items():
                starts, texts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, texts))
                reach = need[size][1]
                for at in range(0, len(starts), WINDOWS_AT_ONCE):
                    here, text = starts[at:at + WINDOWS_AT_ONCE], texts[at:at + WINDOWS_AT_ONCE]
                    found = walkers[size].signatures(every, here)
                    match = known.holds(mix(found))
                    some = match.any(axis=1)
                    run = (here - begins[text]) // size
                    stretch = np.stack([text[some], run[some]], axis=1)
                    distinct, member = np.unique(stretch, axis=0, return_inverse=True)
                    order = np.argsort(member.ravel(), kind="stable")
                    groups = np.split(np.flatnonzero(some)[order],
                                      np.flatnonzero(np.diff(member.ravel()[order])) + 1) if len(distinct) else []
                    for (i, r), mine in zip(distinct.tolist(), groups):
                        lo = max(0, r * size - reach)
                        rows.append(i)
                        first.append(lo)
                        words.append(every[begins[i] + lo:min(begins[i] + (r + 1) * size + reach, ends[i])])
                        sigs.append(np.unique(found[mine][match[mine]]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(rows, pa.int64())), part.column(1).take(pa.array(rows, pa.int64())),
                 pa.array(first, pa.int64()), _long_lists(words), _long_lists(sigs)],
                names=["doc_id", "sha", "first", "words", "sigs"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("sha"), F.lower(text).alias("text"))
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *T._parse_datatype_string(
        "sha bigint, first bigint, words array<bigint>, sigs array<bigint>").fields])
    return materialize(rows.mapInArrow(task, schema).withColumn("cand", F.monotonically_increasing_id()),
                       "decon-candidates")


def best_run(item: np.ndarray, words: np.ndarray) -> tuple[int, int]:
    """Least edit distance between ``item`` and any run of ``words``, and the run's end."""
    place = np.arange(len(words) + 1)
    row = np.zeros(len(words) + 1, dtype=np.int64)
    for i, symbol in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        np.minimum(row[:-1] + (words != symbol), row[1:] + 1, out=new[1:])
        row = np.minimum.accumulate(new - place) + place
    end = int(np.argmin(row))
    return int(row[end]), end


def _verified(pairs: DataFrame, max_share: float, id_types) -> DataFrame:
    def task(batches):
        for part in slices(batches):
            distance, end = [], []
            for item, words in zip(part.column("item_words").to_pylist(), part.column("words").to_pylist()):
                d, e = best_run(np.array(item, np.int64), np.array(words, np.int64))
                distance.append(d)
                end.append(e)
            n = part.column("n_words").to_numpy(zero_copy_only=False)
            allowed = np.array([edits_allowed(int(k), max_share) for k in n], dtype=np.int64)
            distance, end = np.array(distance, np.int64), np.array(end, np.int64)
            keep = pa.array(distance <= allowed)
            last = part.column("first").to_numpy(zero_copy_only=False) + end - 1
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("sha"), part.column("item_id"), pa.array(distance),
                 part.column("n_words"), pa.array(last.astype(np.int64))],
                names=["doc_id", "sha", "item_id", "edits", "item_words", "last_word"]).filter(keep)

    schema = T.StructType([T.StructField("doc_id", id_types[0]), T.StructField("sha", T.LongType()),
                           T.StructField("item_id", id_types[1]),
                           *T._parse_datatype_string("edits bigint, item_words int, last_word bigint").fields])
    return pairs.mapInArrow(task, schema)


def find_matches(docs: DataFrame, benchmark: DataFrame, max_share: float = MAX_SHARE, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                 walks: int = WALKS, tables: int = TABLES, sampled: int = SAMPLED) -> DataFrame:
    """``doc_id, sha, item_id, edits, item_words, last_word``: the best match of each document
    (id and text digest) and item; ``last_word`` is the match's last word's place in the text."""
    shape = (walks, tables, sampled)
    items = _item_rows(benchmark, item_col, item_text_col, shape)
    lengths = items.groupBy("size").agg(
        F.max("n_words").alias("hi"), F.max("most").alias("most"),
        F.sum(F.size("pairs")).alias("pairs"), F.sum(F.size("sigs")).alias("sigs")).collect()
    most = max((r["most"] for r in lengths), default=1)
    need = {}  # one entry per size of the grid: about log(longest item) many
    for r in lengths:
        edits = edits_allowed(r["hi"], max_share)
        n = pieces(r["size"])
        need[r["size"]] = (max(1, r["size"] // n - 1 - 2 * edits_allowed(-(-r["hi"] // n), max_share)), r["hi"] + edits)
    pair_bits = _bit_table(items.select(F.explode("pairs").alias("hash")), sum(r["pairs"] for r in lengths))

    def mixed(batches):
        for part in batches:
            sig = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(mix(sig).view(np.int64))], names=["hash"])

    sig_bits = _bit_table(items.select(F.explode("sigs")).mapInArrow(mixed, "hash bigint"),
                          sum(r["sigs"] for r in lengths))
    cands = _candidates(docs, id_col, text_col, need, most, pair_bits, sig_bits, shape)
    met = (cands.select("cand", F.explode("sigs").alias("sig"))
           .join(items.select("item", F.explode("sigs").alias("sig")), "sig")
           .select("cand", "item").distinct())
    pairs = met.join(cands.select("cand", "doc_id", "sha", "first", "words"), "cand").join(
        items.select("item", "item_id", "n_words", F.col("words").alias("item_words")), "item")
    verified = _verified(pairs.select("doc_id", "sha", "item_id", "first", "words", "n_words", "item_words"), max_share,
                         (docs.schema[id_col].dataType, benchmark.schema[item_col].dataType))
    return verified.groupBy("doc_id", "sha", "item_id").agg(
        F.min(F.struct("edits", "last_word", "item_words")).alias("best")).select(
        "doc_id", "sha", "item_id", "best.edits", "best.item_words", "best.last_word")


def contaminated(docs: DataFrame, benchmark: DataFrame, max_share: float = MAX_SHARE, **names) -> DataFrame:
    """``doc_id, item_id, edits, item_words, similarity, last_word``: one row for each pair of
    document and item that match, the closest match of the pair."""
    found = find_matches(docs, benchmark, max_share, **names)
    return found.groupBy("doc_id", "item_id").agg(
        F.min(F.struct("edits", "last_word", "item_words")).alias("best")).select(
        "doc_id", "item_id", "best.edits", "best.item_words",
        (1 - F.col("best.edits") / F.col("best.item_words")).alias("similarity"), "best.last_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_share: float = MAX_SHARE,
                      id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns.

    Contaminated rows are known by id and text digest; their table is written first, so the
    planner knows its size when it chooses the join.
    """
    id_name, sha_name = fresh(docs.columns, "found_id"), fresh(docs.columns, "found_sha")
    found = materialize(find_matches(docs, benchmark, max_share, id_col, text_col, **names)
                        .select(F.col("doc_id").alias(id_name), F.col("sha").alias(sha_name)).distinct(),
                        "decon-found")
    digest = F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit("")))
    match = docs[id_col].eqNullSafe(found[id_name]) & (digest == found[sha_name])
    return docs.join(found, match, "left_anti")
