"""Quality rules: base counts, and repetition from a suffix array's longest-common-prefix intervals.

A repeat is a word sequence found at two or more places of one text (places may overlap).
In the suffix array of the text's words, each longest-common-prefix interval is a maximal
repeated substring at all the places of the interval; the deepest interval that holds a
suffix has the larger of its two neighbouring prefix lengths.  The union of the spans of
all repeats is therefore the union, over suffixes, of that many words.

One pass over the rows, no shuffle.  A batch of texts shares one suffix array whose first
sort key is (text, word), so that suffixes of different texts never compare equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name

#: Repeats shorter than this many words are chance, and limits on the others.
MIN_REPEAT, MAX_COVERED, MAX_REPEAT = 8, 0.3, 150
BASE_WORDS, BASE_WINDOW = 50, 3
#: Words of one shared suffix array; a longer text has one of its own.
BATCH_WORDS = 200_000

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long"

_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[list(b"#*$%&|<>")] = 1
#: First bytes of code points that are not white space.
_IS_CHAR = np.ones(256, np.int64)
_IS_CHAR[0x80:0xC0] = 0
_IS_CHAR[list(SPACES.encode())] = 0


def longest_repeats(words: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each suffix the length of the longest prefix that another suffix of its text starts with.

    words: word numbers; text: ascending text numbers of the same length.
    Suffixes are sorted by prefix doubling; groups of one are final.  Where a group splits,
    the neighbours' common prefix follows from the ranks of the earlier, shorter prefixes.
    """
    n = len(words)
    best = np.zeros(n, np.int64)
    if n < 2:
        return best
    end = np.searchsorted(text, text, "right")
    key = text.astype(np.int64) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    opens = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank[order] = np.flatnonzero(opens)[np.cumsum(opens) - 1]
    ranks, width = [], 1
    at = order  # suffixes in groups of more than one, in order
    while True:
        size = np.diff(np.append(np.flatnonzero(opens), len(at)))
        at = at[np.repeat(size, size) > 1]
        if not len(at):
            return best
        # half the memory: a long repetitive text has a rank array for each doubling
        ranks.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        beyond = at + width
        inside = beyond < end[at]
        after = np.where(inside, rank[np.where(inside, beyond, 0)] + 1, 0)
        key = rank[at] * (n + 1) + after
        sort = np.argsort(key, kind="stable")
        at, key = at[sort], key[sort]
        group = ranks[-1][at]
        head = np.concatenate(([True], group[1:] != group[:-1]))
        opens = np.concatenate(([True], key[1:] != key[:-1]))
        index = np.arange(len(at))
        first = index[opens][np.cumsum(opens) - 1]
        rank[at] = group + first - index[head][np.cumsum(head) - 1]
        # where an old group splits, its neighbours share `width` words and less than twice as many
        split = np.flatnonzero(opens & ~head)
        p, q = at[split - 1], at[split]
        common = np.full(len(split), width, np.int64)
        for level in range(len(ranks) - 2, -1, -1):
            x, y = p + common, q + common
            both = (x < end[p]) & (y < end[q])
            same = both & (ranks[level][np.where(both, x, 0)] == ranks[level][np.where(both, y, 0)])
            common += same * (1 << level)
        # all members of a new group share with its neighbour what the first of them shares
        new = np.cumsum(opens) - 1
        left, right = np.zeros(new[-1] + 2, np.int64), np.zeros(new[-1] + 2, np.int64)
        left[new[split]], right[new[split] - 1] = common, common
        best[at] = np.maximum(best[at], np.maximum(left, right)[new])
        width *= 2


def covered(length: np.ndarray, text: np.ndarray, least: int, span: int | None = None) -> np.ndarray:
    """Marks the words within a span of `span` (or the repeat's own length) from suffixes whose repeat has `least` words."""
    starts = np.flatnonzero(length >= least)
    edge = np.zeros(len(length) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + (length[starts] if span is None else span), -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str | None], min_repeat: int = MIN_REPEAT) -> pd.DataFrame:
    """The measures of each text; a null text counts as one without words."""
    out = np.zeros((len(texts), 7), np.int64)
    start = 0
    while start < len(texts):
        raw, words, n = [], [], 0
        for t in texts[start:]:
            own = (t or "").encode()
            split = own.split()
            if raw and n + len(split) > BATCH_WORDS:
                break
            raw.append(own)
            words.append(split)
            n += len(split)
        rows = slice(start, start + len(raw))
        for i, t in enumerate(texts[rows], start):
            lines = [x for x in (t or "").split("\n") if x.strip(SPACES)]
            out[i, 3] = len(lines) - len(set(lines))
        counts = np.fromiter(map(len, words), np.int64, len(words))
        out[rows, 0] = counts
        joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        heads = np.concatenate(([0], np.cumsum([len(x) + 1 for x in raw])[:-1])).astype(np.int64)
        out[rows, 1] = np.add.reduceat(_IS_CHAR[joined], heads)
        out[rows, 2] = np.add.reduceat(_IS_SYMBOL[joined], heads)
        flat = np.empty(n, object)
        flat[:] = [w for ws in words for w in ws]
        numbers, _ = pd.factorize(flat)
        text = np.repeat(np.arange(len(raw)), counts)
        length = longest_repeats(numbers, text)
        for column, mark in ((4, covered(length, text, BASE_WINDOW, BASE_WINDOW)), (5, covered(length, text, min_repeat))):
            out[rows, column] = np.bincount(text[mark], minlength=len(raw))
        longest = np.zeros(len(raw), np.int64)
        np.maximum.at(longest, text, length)
        out[rows, 6] = longest
        start += len(raw)
    return pd.DataFrame(out, columns=[c.split()[0] for c in MEASURES.split(", ")])


def with_quality(docs: DataFrame, into: str = "quality_rules", text: str = "text", min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """`docs` with a struct column `into`: the measures, repeat_too_long, base_failed, and kept.

    kept: not base_failed, at most `max_covered` of the words inside repeats of `min_repeat`
    or more words, and no repeat of more than `max_repeat` words.  Null and empty texts have
    no word, so base_failed is true.  Rows are judged alone: repeated rows get equal verdicts.
    `into` is lengthened by `_` where `docs` has a column of that name in any case.
    """

    @F.pandas_udf(MEASURES)
    def measures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield measure(batch.tolist(), min_repeat)

    raw, into = free_name(docs, "measured"), free_name(docs, into)
    m = F.col(raw)
    base = (m["n_words"] < BASE_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
    long = m["longest_repeat"] > max_repeat
    good = (m["covered_words"] <= max_covered * m["n_words"]) & ~long
    names = [c.split()[0] for c in MEASURES.split(", ")]
    return docs.withColumn(raw, measures(F.col(f"`{text}`"))).withColumn(into, F.struct(*[m[c].alias(c) for c in names], long.alias("repeat_too_long"), base.alias("base_failed"), (~base & good).alias("kept"))).drop(raw)


def keep_good(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """The rows of `docs` that the rules keep, with the columns of `docs`."""
    into = free_name(docs, "quality_rules")
    return with_quality(docs, into, text, **limits).filter(F.col(into)["kept"]).drop(into)
