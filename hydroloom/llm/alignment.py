"""Alignment of two tokenizers' tokens on the bytes of the same text.

A text's tokens of both kinds end at byte offsets; where both end, the text can be cut for
both.  The cuts are found by divide and conquer: an interval of tokens is cut at the shared
end nearest to its middle token's, found by bisecting the other side's ends, and both halves
go on; an interval without a shared end inside is a leaf group.  All intervals of a level are
halved at once, over all texts of a batch.

A link is a pair of tokens that end together.  How often the corpus links an id pair is
counted over all texts: each text gives its distinct pairs with their times, Spark sums them.
The counts go back to the texts in two ways.  A pair with at least a HEAVY-th of all links
is one of at most HEAVY, so these are broadcast; they cover most links, and all pairs of which
a task could get too many rows.  The others meet their texts in a shuffle, in which no pair
has more than a HEAVY-th of the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, written
from .tokens import byte_bpe

#: Most pairs whose counts are broadcast (about 40 bytes each).
HEAVY = 200_000
#: Bytes of text that are aligned together.
BATCH_BYTES = 1 << 18
#: Words of one generation of the table (about 300 bytes each).
WORDS = 250_000
#: White space beside a space, and the char that stands for a space in pieces.
_WHITE = [chr(i) for i in range(0x3001) if chr(i).isspace()]
_ODD = ["\u2581", *dict.fromkeys(x for w in _WHITE for x in (" " + w, w + " "))]
#: Tokens on each side of the middle that are looked at one by one.
NEAR = 32


class TokenTable:
    """Ids of a text by both tokenizers, with a table of words already met.

    Where no piece of the sentencepiece model has a space behind another char, and none of the
    text's spaces stands beside white space, neither tokenizer joins anything across the place
    before a space.  A text is then encoded word by word, its space before it, and words are
    looked up.  Other texts are encoded whole.  Words in use move to a new generation of the
    table when one is full.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a, self.b = byte_bpe(path_a, True), sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.lengths_a, self.lengths_b = self.a.byte_lengths(), np.array([len(e) for e in self.bytes_b], np.int64)
        self.by_words = self.a.fast is not None and not any("\u2581" in p.lstrip("\u2581") for p in pieces) and "".join(self.b.id_to_piece(i) for i in self.b.encode("a  b ")) == "\u2581a\u2581\u2581b\u2581"
        self.now, self.before = {}, {}
        #: Decimal numbers with each separator behind them, at 3 * number + separator.
        self.shown = [f"{i}{mark}" for i in range(max(len(self.lengths_a), len(pieces))) for mark in ",|;"]

    def _words(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Ids of space + word by both, as bytes of 32-bit numbers."""
        found = list(map(self.now.get, words))
        if None in found:
            missing = list(dict.fromkeys(w for w, f in zip(words, found, strict=True) if f is None))
            if new := [w for w in missing if w not in self.before]:
                self.before.update(zip(new, self._new(new), strict=True))
            for w in missing:
                self.now[w] = self.before[w]
            for w in new:
                del self.before[w]
            found = list(map(self.now.get, words))
            if len(self.now) > WORDS:
                self.now, self.before = {}, self.now
        return found

    def _new(self, words: list[str]) -> list[tuple[bytes, bytes]]:
        """Encodes words in one go and cuts their ids where the words' bytes end."""
        joined = " ".join(words)
        until = np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(words)).cumsum()
        sides = []
        for ids, lengths in ((self.a.encode(" " + joined), self.lengths_a), (np.array(self.b.encode(joined, num_threads=1), np.uint32), self.lengths_b)):
            ends = lengths[ids].cumsum()
            last = np.searchsorted(ends, until)
            if last[-1] + 1 != len(ids) or (ends[last] != until).any():
                # a char that its piece doesn't give back: one by one
                return [(self.a.encode(" " + w).tobytes(), np.array(self.b.encode(w, num_threads=1), np.uint32).tobytes()) for w in words]
            raw, cut = ids.tobytes(), [0, *((last + 1) * 4).tolist()]
            sides.append([raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)])
        return list(zip(*sides, strict=True))

    def encode(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """(ids, number of ids of each text) of space + text by the first, of the text by the second, which adds the space."""
        plain = [bool(t) and self.by_words and t[0] != " " and t[-1] != " " and not any(x in t for x in _ODD) for t in texts]
        words = [t.split(" ") if p else [] for t, p in zip(texts, plain, strict=True)]
        of = np.array([len(w) for w in words])
        found = self._words([w for ws in words for w in ws])
        out = []
        for side in (0, 1):
            each = [f[side] for f in found]
            ends = np.concatenate(([0], np.fromiter(map(len, each), np.int64, len(each)).cumsum() // 4))
            ids = np.frombuffer(b"".join(each), np.uint32)
            place = np.concatenate(([0], of.cumsum()))
            counts = ends[place[1:]] - ends[place[:-1]]
            whole = [i for i, (t, p) in enumerate(zip(texts, plain, strict=True)) if t and not p]
            if whole:
                cut = np.split(ids, ends[place[1:-1]])
                for i in whole:
                    cut[i] = self.b.encode(texts[i], num_threads=1) if side else self.a.encode(" " + texts[i])
                    counts[i] = len(cut[i])
                ids = np.concatenate([np.asarray(c, np.uint32) for c in cut])
            out.append((ids.astype(np.int64), counts))
        return tuple(out)


@lru_cache(2)
def token_table(path_a: str, path_b: str) -> TokenTable:
    """One table a worker."""
    return TokenTable(path_a, path_b)


def shared_cuts(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the tokens of either side that end where one of the other side ends, in order.

    Ends ascend strictly and both sides' last ends are equal.  Divide and conquer: intervals
    (first, last) of tokens of `a`, both inside; each is cut at the shared end nearest to its
    middle token's end, until none has a shared end.
    """
    first, last = np.array([0]), np.array([len(ends_a) - 2])
    cuts_a, cuts_b = [np.array([len(ends_a) - 1])], [np.array([len(ends_b) - 1])]
    if not len(ends_a):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    while True:
        some = first <= last
        first, last = first[some], last[some]
        if not len(first):
            break
        middle = (first + last) // 2
        found, place = np.full(len(first), -1), np.zeros(len(first), np.int64)
        open_, step = np.arange(len(first)), 0
        while len(open_) and step < NEAR:
            for at in (middle[open_] + step, middle[open_] - step) if step else (middle[open_],):
                inside = (at >= first[open_]) & (at <= last[open_]) & (found[open_] < 0)
                which, at = open_[inside], at[inside]
                by = np.searchsorted(ends_b, ends_a[at])
                hit = ends_b[by] == ends_a[at]
                found[which[hit]], place[which[hit]] = at[hit], by[hit]
            step += 1
            open_ = open_[(found[open_] < 0) & ((middle[open_] + step <= last[open_]) | (middle[open_] - step >= first[open_]))]
        for i in open_:  # no shared end near the middle: all ends of the interval are bisected at once
            at = np.arange(first[i], last[i] + 1)
            by = np.searchsorted(ends_b, ends_a[at])
            hits = np.flatnonzero(ends_b[by] == ends_a[at])
            if len(hits):
                best = hits[np.abs(at[hits] - middle[i]).argmin()]
                found[i], place[i] = at[best], by[best]
        cut = found >= 0
        cuts_a.append(found[cut])
        cuts_b.append(place[cut])
        first, last = np.concatenate((first[cut], found[cut] + 1)), np.concatenate((found[cut] - 1, last[cut]))
    a, b = np.concatenate(cuts_a), np.concatenate(cuts_b)
    order = np.argsort(a)
    return a[order], b[order]


def align(texts: list[str], table: TokenTable) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids of a, ids of b, cuts in a, cuts in b) for each text; all empty where the bytes of either side aren't those of space + text."""
    (ids_a, n_a), (ids_b, n_b) = table.encode(texts)
    held = [(" " + t).encode() if t else b"" for t in texts]
    size = np.array([len(h) for h in held])

    def sums(lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
        until = np.concatenate(([0], lengths.cumsum()))
        ends = np.concatenate(([0], counts.cumsum()))
        return until[ends[1:]] - until[ends[:-1]]

    # byte-level ids give the text's bytes back, if they are as many
    good = (size > 0) & (sums(table.lengths_a[ids_a], n_a) == size) & (sums(table.lengths_b[ids_b], n_b) == size)
    keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
    if b"".join(map(table.bytes_b.__getitem__, ids_b[keep_b].tolist())) != b"".join(h for h, g in zip(held, good, strict=True) if g):
        parts = np.split(ids_b, n_b.cumsum()[:-1])
        good &= [b"".join(map(table.bytes_b.__getitem__, p.tolist())) == h for p, h in zip(parts, held, strict=True)]
        keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
    ids_a, ids_b, n_a, n_b = ids_a[keep_a], ids_b[keep_b], n_a * good, n_b * good
    # one run over all texts: a text's last ends are equal, so no group crosses from one to the next
    cuts_a, cuts_b = shared_cuts(table.lengths_a[ids_a].cumsum(), table.lengths_b[ids_b].cumsum())
    ends_a, ends_b = (np.concatenate(([0], n.cumsum())) for n in (n_a, n_b))
    from_ = np.searchsorted(cuts_a, ends_a)
    return [
        (ids_a[a:c], ids_b[b:d], cuts_a[e:f] - a, cuts_b[e:f] - b)
        for a, c, b, d, e, f in zip(*(x.tolist() for x in (ends_a[:-1], ends_a[1:], ends_b[:-1], ends_b[1:], from_[:-1], from_[1:])), strict=True)
    ]


def groups_text(ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, shown: list[str]) -> str:
    """`a1,a2|b1;a3|b2,b3`: decimal ids, sides and groups in order; `shown` as in `TokenTable`."""
    if not len(cuts_a):
        return ""
    size_a, size_b = np.diff(cuts_a, prepend=-1), np.diff(cuts_b, prepend=-1)
    shift_a, shift_b = np.concatenate(([0], size_b[:-1])).cumsum(), size_a.cumsum()
    words = np.empty(len(ids_a) + len(ids_b), np.int64)
    place_a, place_b = np.arange(len(ids_a)) + np.repeat(shift_a, size_a), np.arange(len(ids_b)) + np.repeat(shift_b, size_b)
    words[place_a], words[place_b] = ids_a * 3, ids_b * 3
    words[place_a[cuts_a]] += 1
    words[place_b[cuts_b]] += 2
    return "".join(map(shown.__getitem__, words.tolist()))[:-1]


TOKEN_COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, path_a: str, path_b: str, id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs, times) of each row of `docs`.

    A's tokens are those of space + text by a byte-level file, B's those of the text by a
    sentencepiece model, which adds the space; special tokens' strings are plain text.  groups:
    ids by group, or with `digest` its SHA-256 ('' without tokens).  pairs: distinct linked
    pairs as A's id << 32 | B's id, times: how often.  Null and empty texts, and texts that
    either side's bytes don't give back, have no tokens: zeros, no pairs.  Repeated rows come
    out repeated.
    """
    out = T.StructType([T.StructField("id", docs.schema[id].dataType), *T.StructType.fromDDL(TOKEN_COLUMNS).fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_table(path_a, path_b)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            start = 0
            while start < len(texts):
                stop, held = start, 0
                while stop < len(texts) and (stop == start or held + len(texts[stop]) <= BATCH_BYTES):
                    held += len(texts[stop])
                    stop += 1
                numbers, shown, pairs, times = [], [], [], []
                for ids_a, ids_b, cuts_a, cuts_b in align(texts[start:stop], table):
                    groups = groups_text(ids_a, ids_b, cuts_a, cuts_b, table.shown)
                    shown.append(hashlib.sha256(groups.encode()).hexdigest() if digest and groups else groups)
                    linked, often = np.unique(ids_a[cuts_a] << 32 | ids_b[cuts_b], return_counts=True)
                    numbers.append((len(ids_a), len(ids_b), len(cuts_a), len(cuts_a)))
                    pairs.append(linked)
                    times.append(often.astype(np.int32))
                offsets = pa.array(np.array([0, *map(len, pairs)]).cumsum().astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), *[pa.array(x, pa.int64()) for x in zip(*numbers, strict=True)], pa.array(shown, pa.string()), *lists], names=out.names)
                start = stop

    found = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(read, out)
    return found.withColumnRenamed("id", id)


def pair_counts(tokens: DataFrame) -> DataFrame:
    """(pair, n, best): links of each id pair in all texts, and whether its B id has none linked oftener; `tokens` as from `aligned`."""
    each = tokens.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("x.pairs", "x.times")
    counts = written(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "pair-counts")
    # one row for each id of B's vocabulary
    most = counts.groupBy(_b("pair").alias("b")).agg(F.max("n").alias("most"))
    return written(counts.join(F.broadcast(most), _b("pair") == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-best")


def _b(pair: str) -> Column:
    return F.col(pair).bitwiseAND(F.lit((1 << 32) - 1))


def with_counts(tokens: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """`tokens` (from `aligned`) without pairs and times, with n_best and count_sum over the links of each row.

    n_best: links whose pair is, in all rows, the commonest of its B id (ties included);
    count_sum: sum over links of how often all rows link the pair.
    """
    row, of = free_name(tokens, "row"), free_name(tokens, "of")
    rows = written(tokens.withColumn(row, F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows)
    least = F.lit((counts.agg(F.sum("n")).first()[0] or 0) / heavy)
    frequent = F.broadcast(counts.filter(F.col("n") >= least))
    rare = counts.filter(F.col("n") < least).select(F.col("pair").alias("p"), "n", "best")
    links = rows.filter("n_links > 0").select(F.col(row).alias("row"), F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").cast("long").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    common = links.join(frequent, "pair").groupBy("row").agg(*sums)
    seldom = links.join(frequent.select("pair"), "pair", "left_anti").join(rare.hint("shuffle_merge"), F.col("pair") == F.col("p")).groupBy("row").agg(*sums)
    whole = common.unionByName(seldom).groupBy(F.col("row").alias(of)).agg(*[F.sum(c).alias(c) for c in ("n_best", "count_sum")])
    kept = [F.col(f"`{c}`") for c in tokens.columns if c not in ("pairs", "times")]
    zero = F.lit(0).cast("long")
    return rows.join(whole, F.col(row) == F.col(of), "left").select(*kept, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"))
