"""SentencePiece encoding and decoding of merge-type (BPE) models by a prefix table.

Encoding of a run of characters: for every prefix, the table holds the one token that ends the
prefix's encoding. An automaton over all pieces tells which pieces end at each position; the
piece that starts at ``i`` is the last token of its prefix when it is compatible with the last
token of prefix ``i``: that is, when merging the two tokens' characters by the model's rule
yields exactly these two tokens. Since merges only look at neighbours, exactly one piece
passes at each position. The ids are recovered backwards from the last position, so even very
long runs take linear time.

The new words of many texts are encoded together, one letter of all words at a time: the automaton
steps, the pieces that end there are tried from the longest on, and their compatibility with the
token before is looked up in a hash table of pairs; a pair not met before is tested once. The ids
are recovered in the same way, of all words at a time.

Text is escaped as the model says (a leading mark, spaces as marks) and cut before each mark
that follows another character: no piece has a mark after another character, so no merge
crosses such a place. Words that a worker met of late are not encoded again. Characters that
are no piece become byte ids.

Decoding joins the pieces, turns marks into spaces, takes off the leading one, and reads runs
of byte ids as UTF-8 with U+FFFD for each byte that fits no character.

The model file is read on the driver and shipped; no library call encodes or decodes here.
Cases: a null text counts as empty; the empty text has no ids besides the end id; repeated rows
are encoded like others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scorekit.llm.common import id_and_text, schema_like, slices, worker_state

MARK = "▁"
# What a worker remembers before it starts afresh; these bound its memory, not the work.
MEMO_WORDS = 120_000   # in each of two generations: words used of late outlive the older ones
MEMO_PAIRS = 1_000_000
START = -1
LONGEST_MEMO = 64      # longer words are not remembered, and walk by themselves
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # piece types of the model format
BPE_MODEL = 2
BATCH_WORDS = 1 << 14  # new words encoded together
FACTOR = 0x9E3779B97F4A7C15
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


# ------------------------------------------------------------------ reading a model file
def _fields(data: bytes):
    """``number, value`` of each field of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at:at + size]
        at += size


def read_model(file: bytes) -> tuple[list[tuple[str, float, int]], dict]:
    """Pieces ``(text, score, type)`` in id order, and the settings that matter here."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in _fields(file):
        if number == 1:
            piece = dict(_fields(value))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            pieces.append((piece.get(1, b"").decode("utf-8"), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    settings = {"model_type": trainer.get(3, 1), "suffix_mark": trainer.get(24, 0),
                "byte_fallback": trainer.get(35, 0), "charsmap": normalizer.get(2, b""),
                "dummy_prefix": normalizer.get(3, 1), "trim": normalizer.get(4, 1),
                "escape": normalizer.get(5, 1)}
    return pieces, settings


class PrefixTableCodec:
    """Encoder and decoder of one model."""

    def __init__(self, file: bytes):
        pieces, s = read_model(file)
        kinds = {k for _, _, k in pieces}
        if (s["model_type"] != BPE_MODEL or not s["byte_fallback"] or s["charsmap"] or s["trim"]
                or s["suffix_mark"] or not s["escape"] or kinds & {USER_DEFINED, UNUSED}):
            raise ValueError("only BPE models with byte fallback and without text normalisation are supported")
        self.pieces = [p for p, _, _ in pieces]
        self.kinds = [k for _, _, k in pieces]
        self.end_id = self.pieces.index("</s>")
        self.dummy_prefix = bool(s["dummy_prefix"])
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.rank = {p: -score for p, score, k in pieces if k == NORMAL}
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a word mark after another character")
        letters = sorted(p for p in self.ids if len(p) == 1)
        self.letter_of = np.full(0x110000, -1, dtype=np.int32)  # number of a character's letter; -1: no piece
        self.letter_of[[ord(c) for c in letters]] = np.arange(len(letters))
        self.letters = letters
        # A piece that merging its characters never makes ends no prefix.
        self.ends = {p: i for p, i in self.ids.items() if self.merged(p) == [p]}
        begins = {p[:k] for p in self.ends for k in range(len(p) + 1)}
        self.states = sorted(begins, key=lambda t: (len(t), t))  # the empty text is state 0
        self.state_of = {t: i for i, t in enumerate(self.states)}
        self._list_ends()
        self.id_text = [str(i) for i in range(len(pieces))]
        self.surface = ["" if k == CONTROL else " ⁇ " if k == UNKNOWN else p.replace(MARK, " ")
                        for p, _, k in pieces]
        self.pairs, self.steps = Numbers(), Numbers()
        self.bytes_of: dict[int, list[int]] = {}
        self.young: dict[object, str] = {}  # words and their ids as text
        self.old: dict[object, str] = {}
        self.odd: dict[object, str] = {}    # decoded texts that are not the word itself
        self.long: list = []                # words that are not remembered

    def _list_ends(self):
        """The pieces that end each state, longest first, and how long they are: those of a state are
        itself, if it is a piece, and those of its longest suffix that is a state."""
        ends: list[list[int]] = [[]]
        for text in self.states[1:]:
            shorter = text[1:]
            while shorter not in self.state_of:
                shorter = shorter[1:]
            own = self.ends.get(text)
            rest = ends[self.state_of[shorter]]
            ends.append(rest if own is None else [own, *rest])
        self.ending = np.full((len(ends), max(map(len, ends))), START, dtype=np.int32)
        for i, own in enumerate(ends):
            self.ending[i, :len(own)] = own
        self.size = np.array([len(p) for p in self.pieces], dtype=np.int32)

    def merged(self, text: str) -> list[str]:
        """The model's rule itself, on a short string: join the neighbours whose piece ranks
        best, leftmost first, until no join is a piece."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, where = r, i
            if best is None:
                break
            parts[where:where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.pieces[left], self.pieces[right]
        return self.merged(a + b) == [a, b]

    def _all_compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * len(self.pieces) + right
        known = self.pairs.get(keys)
        new = known < 0
        if new.any():
            for key in np.unique(keys[new]).tolist():
                self.pairs.put(key, int(self.compatible(*divmod(key, len(self.pieces)))))
            known[new] = self.pairs.get(keys[new])
        return known > 0

    def _next_state(self, state: int, letter: int) -> int:
        text = self.states[state] + self.letters[letter]
        while text not in self.state_of:
            text = text[1:]
        self.steps.put(state * len(self.letters) + letter, self.state_of[text])
        return self.state_of[text]

    def _stepped(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        keys = states.astype(np.int64) * len(self.letters) + letters
        after = self.steps.get(keys)
        new = after < 0
        if new.any():
            for key in np.unique(keys[new]).tolist():
                self._next_state(*divmod(key, len(self.letters)))
            after[new] = self.steps.get(keys[new])
        return after

    def _runs_ids(self, letters: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, run after run, and how many each run has. The runs, ``sizes`` letters from
        ``starts``, step through the table together."""
        for memo in ("pairs", "steps"):
            if getattr(self, memo).size > MEMO_PAIRS:
                setattr(self, memo, Numbers())
        order = np.argsort(-sizes, kind="stable")  # runs still under way stand first
        starts, sizes = starts[order], sizes[order]
        table = np.zeros((int(sizes.max(initial=0)), len(sizes)), dtype=np.int32)
        states = np.zeros(len(sizes), dtype=np.int32)
        under_way = len(sizes) - np.searchsorted(sizes[::-1], np.arange(len(table)), side="right")
        for k, n in enumerate(under_way.tolist()):
            states[:n] = self._stepped(states[:n], letters[starts[:n] + k])
            open_ = np.arange(n)  # runs whose last token of this prefix is not found yet
            for j in range(self.ending.shape[1]):
                token = self.ending[states[open_], j]
                begin = k - self.size[token]
                before = np.where(begin >= 0, table[begin, open_], START)
                fits = before == START
                inner = np.flatnonzero(~fits)
                fits[inner] = self._all_compatible(before[inner], token[inner])
                table[k, open_[fits]] = token[fits]
                open_ = open_[~fits]
                if not open_.size:
                    break
        at, found = sizes.copy(), []
        while (left := np.flatnonzero(at > 0)).size:  # recover the ids backwards
            last = table[at[left] - 1, left]
            ids = np.full(len(sizes), -1, dtype=np.int32)
            ids[order[left]] = last
            at[left] -= self.size[last]
            found.append(ids)
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
        forward = np.stack(found[::-1], axis=1)
        taken = forward >= 0
        return forward[taken], taken.sum(axis=1)

    def _long_run_ids(self, run: np.ndarray) -> list[int]:
        """Ids of one long run, letter by letter."""
        state, table, wide, pieces = 0, [], len(self.letters), len(self.pieces)
        for k, letter in enumerate(run.tolist()):
            after = self.steps.one(state * wide + letter)
            state = after if after >= 0 else self._next_state(state, letter)
            for token in self.ending[state].tolist():
                begin = k - len(self.pieces[token])
                if begin < 0:
                    break
                key = table[begin] * pieces + token
                known = self.pairs.one(key)
                if known < 0:
                    known = int(self.compatible(table[begin], token))
                    self.pairs.put(key, known)
                if known:
                    break
            table.append(token)
        ids, at = [], len(table)
        while at:
            ids.append(table[at - 1])
            at -= len(self.pieces[table[at - 1]])
        return ids[::-1]

    def words_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids, word after word; where each word's end; which words have byte ids. Runs of
        letters are encoded, all words' together; every other character is its byte ids."""
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letters = self.letter_of[flat]
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
        first = np.zeros(len(flat) + 1, dtype=bool)
        first[0] = first[ends] = True
        others = np.flatnonzero(letters < 0)
        first[others] = first[others + 1] = True  # where a run, or another character, begins
        items = np.flatnonzero(first[:-1])
        sizes = np.diff(np.append(items, len(flat)))
        is_run = letters[items] >= 0
        short, long = is_run & (sizes <= LONGEST_MEMO), np.flatnonzero(is_run & (sizes > LONGEST_MEMO))
        counts = np.zeros(len(items), dtype=np.int64)
        ids, counts[short] = self._runs_ids(letters, items[short], sizes[short])
        one_by_one = {int(i): self._long_run_ids(letters[items[i]:items[i] + sizes[i]]) for i in long}
        for i, c in zip(np.flatnonzero(~is_run).tolist(), flat[others].tolist()):
            one_by_one[i] = self._byte_ids(c)
        if one_by_one:
            numbers = np.array(list(one_by_one))
            counts[numbers] = [len(v) for v in one_by_one.values()]
            begin = np.cumsum(counts) - counts
            out = np.zeros(int(counts.sum()), dtype=np.int32)
            out[np.repeat(short, counts)] = ids
            own = counts[numbers]
            out[np.repeat(begin[numbers] - np.cumsum(own) + own, own) + np.arange(own.sum())] = [
                x for v in one_by_one.values() for x in v]
            ids = out
        through = np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(items, ends)]
        with_bytes = np.zeros(len(words), dtype=bool)
        with_bytes[np.searchsorted(ends, others, side="right")] = True
        return ids, through, with_bytes

    def _byte_ids(self, c: int) -> list[int]:
        known = self.bytes_of.get(c)
        if known is None:
            known = self.bytes_of[c] = [self.byte_id[x] for x in chr(c).encode("utf-8", "replace")]
        return known

    def escaped_words(self, text: str) -> list[str]:
        if not text:
            return []
        escaped = text.replace(" ", MARK)
        if self.dummy_prefix:
            escaped = MARK + escaped
        return WORD.findall(escaped)

    def encode(self, text: str) -> list[int]:
        return self.words_ids(self.escaped_words(text))[0].tolist()

    def _pieces_text(self, ids) -> str:
        if self.byte_of.keys().isdisjoint(ids):
            return "".join([self.surface[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(bytes_text(bytes(run)))
                run.clear()
            out.append(self.surface[i])
        if run:
            out.append(bytes_text(bytes(run)))
        return "".join(out)

    def decode(self, ids) -> str:
        ids = [i for i in ids if self.kinds[i] != CONTROL]
        text = self._pieces_text(ids)
        if self.dummy_prefix and ids and self.pieces[ids[0]].startswith(MARK):
            text = text[1:]
        return text

    def _keys(self, text: str) -> list:
        """The words of a text; the usual word, one mark and then letters, goes without its mark."""
        # Without runs of spaces, every space starts a word.
        if self.dummy_prefix and text and MARK not in text and "  " not in text and text[0] != " " != text[-1]:
            return text.split(" ")
        return [w[1:] if w[0] == MARK and w[1:2] not in ("", MARK) else w if w[0] == MARK else (w,)
                for w in self.escaped_words(text)]

    @staticmethod
    def _word(key) -> str:
        return key[0] if isinstance(key, tuple) else key if key[0] == MARK else MARK + key

    def _learn(self, keys: set) -> None:
        """Have the ids of all ``keys`` in ``young``."""
        if len(self.young) > MEMO_WORDS:
            self.old, self.young = self.young, {}
            self.odd = {k: v for k, v in self.odd.items() if k in self.old}
        new = []
        for key in keys.difference(self.young):
            known = self.old.get(key)
            if known is None:
                new.append(key)
            else:
                self.young[key] = known
        for at in range(0, len(new), BATCH_WORDS):
            own = new[at:at + BATCH_WORDS]
            ids, ends, with_bytes = (x.tolist() for x in self.words_ids([self._word(k) for k in own]))
            numbers, pieces = [self.id_text[i] for i in ids], [self.surface[i] for i in ids]
            begin = 0
            for key, end, bytes_too in zip(own, ends, with_bytes):
                self.young[key] = " ".join(numbers[begin:end])
                back = self._pieces_text(ids[begin:end]) if bytes_too else "".join(pieces[begin:end])
                if back[1:] != key or back[:1] != " ":
                    self.odd[key] = back
                if len(key) > LONGEST_MEMO:
                    self.long.append(key)
                begin = end

    def documents(self, texts: list[str]) -> list[tuple[str, str]]:
        """Of each text: decimal ids joined by one space (no end id), and the decoded text."""
        split = [self._keys(t) for t in texts]
        self._learn(set().union(*split))
        ids_of, odd, out = self.young, self.odd, []
        for keys in split:
            ids = " ".join(map(ids_of.__getitem__, keys))
            if odd.keys().isdisjoint(keys):
                back = " " + " ".join(keys) if keys else ""  # every word decodes to itself after a space
            else:
                back = "".join([odd[k] if k in odd else " " + k for k in keys])
            out.append((ids, back[1:] if self.dummy_prefix else back))
        for key in self.long:
            self.young.pop(key, None)
            self.odd.pop(key, None)
        self.long.clear()
        return out


class Numbers:
    """A hash table from whole numbers to small ones, asked many at a time (open addressing)."""

    def __init__(self, bits: int = 16):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(FACTOR)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _slot(self, key: int) -> int:
        return (key * FACTOR & (1 << 64) - 1) >> (64 - self.bits)

    def put(self, key: int, value: int) -> None:
        if 4 * self.size > len(self.keys):
            used = self.keys >= 0
            keys, values = self.keys[used].tolist(), self.values[used].tolist()
            self.__init__(self.bits + 2)
            for k, v in zip(keys, values):
                self.put(k, v)
        at = self._slot(key)
        while self.keys[at] >= 0 and self.keys[at] != key:
            at = (at + 1) & (len(self.keys) - 1)
        self.size += self.keys[at] < 0
        self.keys[at], self.values[at] = key, value

    def one(self, key: int) -> int:
        at = self._slot(key)
        while (found := self.keys[at]) != key:
            if found < 0:
                return -1
            at = (at + 1) & (len(self.keys) - 1)
        return int(self.values[at])

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 where there is none."""
        at = self._slots(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while open_.size:
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


def bytes_text(run: bytes) -> str:
    """UTF-8 text of a run of byte ids; each byte that fits no character gives U+FFFD."""
    try:
        return run.decode("utf-8")
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at:at + size].decode("utf-8"))
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


def _codec(file: bytes) -> PrefixTableCodec:
    state, version = worker_state(), hashlib.sha256(file).digest()
    if state.get("codec_version") != version:
        state["codec"], state["codec_version"] = PrefixTableCodec(file), version
    return state["codec"]


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``doc_id, ids, decoded``: all ids of the whole text with the end id last, and the text
    that they decode to."""
    file = read_file(model_path)

    def task(batches):
        codec = _codec(file)
        for part in slices(batches, 128):
            ids, back = [], []
            for joined, decoded in codec.documents(part.column(1).to_pylist()):
                ids.append([*map(int, joined.split()), codec.end_id])
                back.append(decoded)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(back, pa.string())],
                names=["doc_id", "ids", "decoded"])

    schema = schema_like(docs, id_col, "ids array<int>, decoded string")
    return id_and_text(docs, id_col, text_col).mapInArrow(task, schema)


def encoding_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: digests of the same ids (end id
    included) and decoded text, taken where they are made so that they need not leave the task."""
    file = read_file(model_path)

    def task(batches):
        codec = _codec(file)
        end = str(codec.end_id)
        for part in slices(batches, 256):
            n, ids_sha, back_sha = [], [], []
            for joined, decoded in codec.documents(part.column(1).to_pylist()):
                joined = f"{joined} {end}" if joined else end
                n.append(joined.count(" ") + 1)
                ids_sha.append(_sha(joined))
                back_sha.append(_sha(decoded))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(back_sha)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = schema_like(docs, id_col, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return id_and_text(docs, id_col, text_col).mapInArrow(task, schema)


def decode_documents(encoded: DataFrame, model_path: str, id_col: str = "doc_id",
                     ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from id lists (null: empty)."""
    file = read_file(model_path)

    def task(batches):
        codec = _codec(file)
        for part in slices(batches, 64):
            texts = [codec.decode(ids or []) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    rows = encoded.select(encoded[id_col].alias("doc_id"),
                          encoded[ids_col].cast(T.ArrayType(T.IntegerType())).alias("ids"))
    return rows.mapInArrow(task, schema_like(encoded, id_col, "text string"))
