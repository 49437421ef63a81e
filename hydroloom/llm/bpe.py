"""BPE encoding and decoding of whole texts, equal to the tokenizer's own result.

Texts up to LEAF characters are encoded where they are.  Longer ones are cut in halves, and
these again, until none is longer than LEAF; the leaves of all texts are dealt over the
cluster, encoded in parallel, and joined again pairwise up each text's tree.  At a join a
window around the cut is encoded anew, twice as wide each time, until it agrees exactly with
both sides: on each side a whole token, same place and same number, away from the edges of
its char.  What lies left of the left agreement stays, what lies right of the right one stays,
and between them the window's tokens stand.  If they never agree the window grows to both
whole sides, which is the plain encoding.

Why this is exact: a token sequence is the encoding of its text if and only if every adjacent
pair of tokens is the encoding of the pair's text (merges look at adjacent symbols only, and
a pair that is stable alone is stable in any context).  After one common token each adjacent
pair of the joined sequence stands in one of the three encodings.  An edge inside a word
gives its last token the end-of-word form, which no other encoding has there, so such tokens
never agree.  Cuts and the edges of windows stand before an ASCII char, which no normalisation joins to the
char before it, and outside the strings of special tokens.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, written

LEAF = 1 << 15
#: First window on each side of a cut, in code points.
WINDOW = 64
#: Code points at each edge of a leaf whose tokens keep their places; windows seldom reach further.
EDGE = 1024
#: Words of one generation of a worker's table, and the longest word kept, in bytes.
WORDS, LONGEST = 300_000, 64
#: Characters encoded before results leave the worker, and of long texts meant for one task.
BATCH_CHARS, TASK_CHARS = 400_000, 2_000_000

#: Lower-case letters that no normalisation changes, and punctuation that no special token holds.
_LETTERS = re.compile("[a-zß-öø-ž]+")
_MARKS = ".,!?;:%$#*&()\""
_SPACE = re.compile("[\x20\x09-\x0d]")

_TOKENIZERS: dict[str, "WordTable"] = {}


def _byte_letters() -> dict[int, str]:
    """The printable char that byte-level tokenizers write for each byte: itself, or one from U+0100 on."""
    plain = {b for b in range(256) if chr(b).isprintable() and b not in (32, 0xA0, 0xAD)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordTable:
    """A tokenizer with the tokens of words seen before.

    White space separates words before anything else and is dropped, so the encoding of a text
    is that of its words in order.  Words of letters with marks around them are put together
    from the letters' tokens, which the tokenizer's model gives without the passes before it.

    The table has two generations: a word found in the old one moves to the new one, and when
    that is full it becomes the old one.  So words in use stay, and memory is bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.names = [self.tokenizer.id_to_token(i) for i in range(size)]
        self.bytes = _byte_letters()
        # ids as 32-bit numbers in bytes: small, and nothing for the garbage collector to walk
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _made(self, word: bytes) -> bytes:
        """The tokens of a word that is in neither generation."""
        text = word.decode()
        tail = text.lstrip(_MARKS)
        bare = tail.rstrip(_MARKS)
        low = bare.lower()
        if not _LETTERS.fullmatch(low):
            return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if low != text:
            around = (text[: len(text) - len(tail)], low, tail[len(bare) :])
            return b"".join([self.of(x.encode()) for x in around if x])
        shown = low if low.isascii() else "".join([self.bytes[b] for b in word])
        return array("i", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def of(self, word: bytes) -> bytes:
        """A word's ids."""
        found = self.new.get(word)
        if found is None:
            found = self.old.get(word)
            if found is None:
                found = self._made(word)
            if len(word) <= LONGEST:
                if len(self.new) >= WORDS:
                    self.old, self.new = self.new, {}
                self.new[word] = found
        return found

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """All ids, the number of ids of each text, and the decoded texts."""
        parts, decoded = [], []
        for text in texts:
            words = text.encode().split()
            found = list(map(self.new.get, words))
            if not all(found):
                found = [f or self.of(w) for f, w in zip(found, words, strict=True)]
            parts.append(b"".join(found))
            decoded.append(self.decoded(np.frombuffer(parts[-1], np.int32)))
        sizes = np.fromiter((len(x) // 4 for x in parts), np.int64, len(parts))
        return np.frombuffer(b"".join(parts), np.int32), sizes, decoded

    def decoded(self, ids: np.ndarray) -> str:
        return " ".join(map(self.names.__getitem__, ids.tolist()))


def word_table(path: str) -> WordTable:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTable(path)
    return _TOKENIZERS[path]


def specials(tokenizer) -> tuple[str, ...]:
    return tuple(t.content for t in tokenizer.get_added_tokens_decoder().values())


#: Chars that never join the char before them in normalisation: ASCII, letters with marks, Cyrillic, kana, ideographs, Hangul syllables.
STARTERS = re.compile("[\x00-\x7f\xc0-\u024f\u0400-\u0481\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3]")


def safe(text: str, at: int, specials: tuple[str, ...]) -> bool:
    """Whether a text may be cut here: before a char that joins none before it, and not inside a special token's string."""
    return STARTERS.match(text[at]) is not None and not any(text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) >= 0 for s in specials)


def cuts(text: str, leaf: int = LEAF, special: tuple[str, ...] = ()) -> list[int]:
    """Ends of the leaves of the halving tree; a part without a safe place for a cut stays whole."""

    def place(a: int, b: int) -> int | None:
        """The safe place nearest to the middle, at least a quarter of the part away from its ends if there is one."""
        middle = (a + b) // 2
        for off in range(max(middle - a, b - middle)):
            for at in (middle + off, middle - off):
                if a < at < b and safe(text, at, special):
                    return at
        return None

    ends, todo = [], [(0, len(text))]
    while todo:
        a, b = todo.pop()
        at = place(a, b) if b - a > leaf else None
        if at is None:
            ends.append(b)
        else:
            todo += [(at, b), (a, at)]
    return ends


#: Places (begins, ends) of tokens.
Places = tuple[np.ndarray, np.ndarray]


class Part:
    """A stretch of a text with its tokens.

    Places are known for the first tokens, up to the char `low`, and for the last tokens, from
    the char `high` on; both are edges of words, or the part's own ends.
    """

    def __init__(self, start: int, end: int, ids: np.ndarray, first: Places, last: Places, low: int, high: int):
        self.start, self.end, self.ids, self.first, self.last, self.low, self.high = start, end, ids, first, last, low, high

    @classmethod
    def of(cls, tokenizer, text: str, start: int, end: int) -> Part:
        """The plain encoding, with the places of all tokens."""
        found = tokenizer.encode(text[start:end], add_special_tokens=False)
        places = np.array(found.offsets, np.int64).reshape(-1, 2) + start
        every = places[:, 0], places[:, 1]
        return cls(start, end, np.array(found.ids, np.int32), every, every, end, start)

    @classmethod
    def leaf(cls, table: WordTable, piece: str) -> Part:
        """The same tokens; places near the edges only, if white space lets the inner words be taken from the table."""
        n = len(piece)
        opens = _SPACE.search(piece, EDGE)
        a = opens.start() if opens else n
        b = max((piece.rfind(c, 0, max(n - EDGE, 0)) for c in "\x20\x09\x0a\x0b\x0c\x0d"), default=-1)
        if b <= a:
            return cls.of(table.tokenizer, piece, 0, n)
        first, last = cls.of(table.tokenizer, piece, 0, a), cls.of(table.tokenizer, piece, b, n)
        inner, _, _ = table.encode([piece[a:b]])
        return cls(0, n, np.concatenate((first.ids, inner, last.ids)), first.first, last.last, a, b)


def _agreed(ids: np.ndarray, places: Places, window: Part, low: int, high: int) -> list[tuple[int, int]]:
    """(number among the given tokens, number in window) of the tokens both have inside low..high, at clear char edges."""

    def clear(ids: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> dict[tuple[int, int, int], int]:
        held = {}
        for i in range(np.searchsorted(begins, low), np.searchsorted(begins, high)):
            alone = (i == 0 or ends[i - 1] <= begins[i]) and (i + 1 == len(ids) or ends[i] <= begins[i + 1])
            if alone and ends[i] <= high:
                held[int(begins[i]), int(ends[i]), int(ids[i])] = i
        return held

    mine = clear(ids, *places)
    return [(mine[k], i) for k, i in clear(window.ids, *window.first).items() if k in mine]


def join(tokenizer, text: str, left: Part, right: Part, width: int = WINDOW) -> Part:
    """The tokens of two neighbouring parts as one."""
    special = specials(tokenizer)
    while True:
        a, b = max(left.start, left.end - width), min(right.end, right.start + width)
        while a > left.start and not safe(text, a, special):
            a -= 1
        while b < right.end and not safe(text, b, special):
            b += 1
        window = Part.of(tokenizer, text, a, b)
        if (a, b) == (left.start, right.end):
            return window
        # a window beyond the known places needs them all
        if left.start < a < left.high:
            left = Part.of(tokenizer, text, left.start, left.end)
        if right.low < b < right.end:
            right = Part.of(tokenizer, text, right.start, right.end)
        known, more = len(left.last[0]), len(right.first[0])
        before = _agreed(left.ids[len(left.ids) - known :], left.last, window, a, left.end)
        after = _agreed(right.ids[:more], right.first, window, right.start, b)
        # a window that reaches an outer end needs no agreement there: nothing stands beyond it
        x = (-1, 0) if a == left.start else max(before, default=None)
        y = (-1, len(window.ids)) if b == right.end else min(after, default=None)
        if x is not None and y is not None and x[1] <= y[1]:
            return _joined(left, window, right, x, y)
        width *= 2


def _joined(left: Part, window: Part, right: Part, x: tuple[int, int], y: tuple[int, int]) -> Part:
    """left up to token x[0] of its last ones, window from x[1] to y[1], right from token y[0] of its first ones; -1: nothing of that side."""
    known, more = len(left.last[0]), len(right.first[0])
    stays = len(left.ids) - known + x[0] if x[0] >= 0 else 0
    goes = y[0] if y[0] >= 0 else len(right.ids)
    ids = np.concatenate((left.ids[:stays], window.ids[x[1] : y[1]], right.ids[goes:]))
    whole_left, whole_right = left.low == left.end, right.high == right.start
    first, low, last, high = left.first, left.low, right.last, right.high
    if whole_left or not stays:
        first = tuple(np.concatenate((f[:stays], w[x[1] : y[1]], r[goes:more])) for f, w, r in zip(left.first, window.first, right.first, strict=True))
        low = right.low if y[0] >= 0 else right.end
    if whole_right or y[0] < 0:
        last = tuple(np.concatenate((f[: max(known - len(left.ids) + stays, 0)], w[x[1] : y[1]], r[goes:])) for f, w, r in zip(left.last, window.first, right.first, strict=True))
        high = left.high if x[0] >= 0 else left.start
    return Part(left.start, right.end, ids, first, last, low, high)


def join_tree(tokenizer, text: str, parts: list[Part]) -> Part:
    """Neighbours are joined pairwise until one part is left."""
    while len(parts) > 1:
        parts = [join(tokenizer, text, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def with_tokens(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str = "decoded", leaf: int = LEAF, carry: bool = True) -> DataFrame:
    """`docs` with `ids` (array<int>) and `decoded`, its tokens' names joined as the tokenizer's decode does.

    Special tokens' strings in a text are those tokens, as the tokenizer finds them.  Null
    texts encode as empty: no ids, empty decoded text.  Rows may repeat.  `ids` and `decoded`
    replace columns of these names, in any case.  Without `carry` the text column is left out.
    Long texts are encoded once for each different text.
    """
    base = docs.drop(*[f"`{c}`" if "." in c else c for c in docs.columns if c.lower() in (ids.lower(), decoded.lower())])
    back = [c for c in base.columns if carry or c != text]
    size = F.coalesce(F.length(F.col(f"`{text}`")), F.lit(0))
    short = base.filter(size <= leaf)
    schema = T.StructType([*[f for f in short.schema.fields if f.name in back], T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    place, kept = short.columns.index(text), [i for i, c in enumerate(short.columns) if c in back]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table(path)
        for batch in batches:
            column = batch.column(place)
            texts = [t or "" for t in column.to_pylist()]
            start = 0
            while start < len(texts):
                stop, held = start, 0
                while stop < len(texts) and (stop == start or held + len(texts[stop]) <= BATCH_CHARS):
                    held += len(texts[stop])
                    stop += 1
                flat, sizes, plain = table.encode(texts[start:stop])
                offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
                columns = [*batch.slice(start, stop - start).select(kept).columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(plain, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*back, ids, decoded])
                start = stop

    # columns by place, since Spark takes dots in names apart here
    done = short.toDF(*[f"c{i}" for i in range(len(short.columns))]).mapInArrow(encode, schema)
    # long texts: leaves dealt out, joined by text
    key, of = free_name(base, "long_key"), free_name(base, "long_of")
    long = base.filter(size > leaf)
    keyed = long.withColumn(key, F.sha2(F.col(f"`{text}`"), 256))
    whole = written(keyed.groupBy(key).agg(F.first(F.col(f"`{text}`")).alias("whole")).toDF("key", "whole"), "long-texts")
    tokens = _long_tokens(whole, path, leaf).toDF(of, ids, decoded)
    joined = keyed.select(*[F.col(f"`{c}`") for c in back], F.col(key)).join(tokens, F.col(key) == F.col(of)).select(*[F.col(f"`{c}`") for c in back], ids, decoded)
    return done.unionByName(joined)


#: A leaf with its tokens, and what the joins need of their places (32-bit, from the leaf's start).
LEAF_FIELDS = "key string, start long, piece string, ids array<int>, first_begins array<int>, first_ends array<int>, last_begins array<int>, last_ends array<int>, low int, high int"


def _long_tokens(whole: DataFrame, path: str, leaf: int) -> DataFrame:
    """(key, ids, decoded) of rows (key, whole), one a different text."""

    def halve(batches):
        special = specials(word_table(path).tokenizer)
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("whole").to_pylist(), strict=True):
                ends = cuts(text, leaf, special)
                starts = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(ends)), pa.array(starts, pa.int64()), pa.array([text[a:b] for a, b in zip(starts, ends, strict=True)], pa.string())], names=["key", "start", "piece"])

    def encode(batches):
        table = word_table(path)
        names = [c.split()[0] for c in LEAF_FIELDS.split(", ")]
        numbers = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
        for batch in batches:
            for i in range(batch.num_rows):
                key, start, piece = (batch.column(j)[i].as_py() for j in range(3))
                part = Part.leaf(table, piece)
                # all places are sent once only
                last = part.last if part.low < part.end else (part.ids[:0], part.ids[:0])
                lists = [numbers(x) for x in (part.ids, *part.first, *last)]
                yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([start], pa.int64()), pa.array([piece]), *lists, pa.array([part.low], pa.int32()), pa.array([part.high], pa.int32())], names=names)

    def grow(key, rows):
        table = word_table(path)
        rows = rows.sort_values("start")
        parts = []
        for r in rows.itertuples(index=False):
            first = tuple(np.asarray(x, np.int64) + r.start for x in (r.first_begins, r.first_ends))
            last = first if r.low == len(r.piece) else tuple(np.asarray(x, np.int64) + r.start for x in (r.last_begins, r.last_ends))
            parts.append(Part(r.start, r.start + len(r.piece), np.asarray(r.ids, np.int32), first, last, r.start + r.low, r.start + r.high))
        found = join_tree(table.tokenizer, "".join(rows["piece"]), parts).ids
        return pd.DataFrame({"key": [key[0]], "ids": [found.tolist()], "decoded": [table.decoded(found)]})

    held = whole.agg(F.sum(F.length("whole"))).first()[0] or 0
    tasks = max(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-held // TASK_CHARS))
    leaves = whole.mapInArrow(halve, "key string, start long, piece string").repartition(tasks, "key", "start")
    return leaves.mapInArrow(encode, LEAF_FIELDS).groupBy("key").applyInPandas(grow, "key string, ids array<int>, decoded string")
