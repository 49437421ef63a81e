"""Ranked lexical search: items' best documents by a document FP-tree, searched depth first with bounds.

The items' terms are the only ones that count, so each document is first reduced to its
restricted vector: the numbers of these terms and how often it has them.  Corpus statistics
(documents, lengths, document frequencies) are sums over all documents.

Each task builds trees of the vectors it reads.  Terms stand in the order of falling document
frequency, so vectors with common first terms share a path of the trie; vectors sorted that
way are the trie in preorder, a node being a range of them.  A node knows the largest tf of
every term and the smallest m below it, and as a score rises with tf and falls with m, what
these two give is a bound for all documents below (for a leaf, one document, the score
itself).  An item's search goes down into the child with the best bound first and leaves out
whatever is bound to stay below its k-th best score so far; equality goes on, because smaller
ids win.

A node is kept only if it has at most half of its parent's documents, or else its children
hang on the parent; so no document stands under more than log2(documents) nodes, and a tree's
memory has a bound.

A task carries each item's best from tree to tree.  Before that, one search of a few parts
gives each item a score that its k-th best reaches at least, from which all tasks start.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

TOP = 50
#: Items searched together, by the number of their terms; more items are searched in several blocks.
BLOCK_TERMS = 200_000
#: Vector entries of one tree.
TREE_ENTRIES = 400_000
#: Nodes of a search whose children are looked at together.
WIDTH = 64
#: One part in so many is searched first for scores to start from.
FIRST_PARTS = 16

#: Bytes of terms: ASCII letters (small) and digits, and all of other chars; anything else ends a term.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in UTF-8: runs of chars that aren't ASCII punctuation, white space or control, A-Z lower-cased."""
    return text.translate(_TERM_BYTES).split()


def weight(documents: int, frequency: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency + 1)))


def length_norm(terms: np.ndarray, documents: int, total: int) -> np.ndarray:
    """m of documents by their number of terms."""
    return 50 + (50 * terms * documents) // max(total, 1)


def gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term of weight 1 adds to a score: rises with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class FpTree:
    """A trie of documents' restricted vectors with bounds at its nodes.

    places: what `Best` tells equal documents apart by, m: theirs, starts: where each one's
    vector starts in terms and tfs (one more than documents); terms within a vector ascend
    (commonest first).
    """

    def __init__(self, places: list[tuple], m: np.ndarray, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray):
        big = terms.astype(">u4")
        vectors = [big[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        order = np.array(sorted(range(len(places)), key=vectors.__getitem__), np.int64)
        n = len(order)
        size = np.diff(starts)[order]
        entry = np.repeat(starts[:-1][order] - np.concatenate(([0], size[:-1])).cumsum(), size) + np.arange(size.sum())
        self.places, terms, tfs = [places[i] for i in order.tolist()], terms[entry].astype(np.int64), tfs[entry].astype(np.int64)
        m, starts = m[order], np.concatenate(([0], size)).cumsum()
        parent = self._split(terms, starts, size, n)  # nodes n and up; documents are the leaves 0 to n - 1
        nodes = len(parent)
        self.least = np.full(nodes, np.iinfo(np.int64).max)
        self.least[:n] = m
        # maxima by (node, term), added up level by level from the leaves
        owner, term, most = np.repeat(np.arange(n), size), terms, tfs
        keys, values = [owner * (1 << 32) | term], [most]
        at, low = np.arange(n), m
        while True:
            owner, up = parent[owner], parent[at]
            some, more = owner >= 0, up >= 0
            if not more.any():
                break
            owner, term, most = owner[some], term[some], most[some]
            at, low = up[more], low[more]
            np.minimum.at(self.least, at, low)
            key = owner << 32 | term
            rank = np.argsort(key, kind="stable")
            key, most = key[rank], most[rank]
            head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
            key, most = key[head], np.maximum.reduceat(most, head) if len(key) else most
            keys.append(key)
            values.append(most)
            owner, term = key >> 32, key & ((1 << 32) - 1)
            at, first = np.unique(at, return_index=True)
            low = self.least[at]
        key, value = np.concatenate(keys), np.concatenate(values)
        rank = np.argsort(key, kind="stable")
        key, value = key[rank], value[rank]
        head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        self.key, self.value = key[head], np.maximum.reduceat(value, head) if len(key) else value
        # children of each node
        child = np.argsort(parent, kind="stable")
        self.child, self.child_start = child, np.searchsorted(parent[child], np.arange(-1, nodes + 1))
        self.n = n

    @staticmethod
    def _split(terms: np.ndarray, starts: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
        """Parent of each leaf and inner node, -1 for the root's children: ranges of sorted vectors by their next term."""
        parent = np.full(n, -1)
        made = []  # parents of inner nodes
        # groups of documents that share a path: their nodes and sizes, group by group
        docs, group, depth = np.arange(n), np.zeros(n, np.int64), 0
        node, held = np.array([-1]), np.array([n])
        while len(docs):
            going = size[docs] > depth
            docs, group = docs[going], group[going]
            if not len(docs):
                break
            term = terms[starts[docs] + depth]
            opens = np.concatenate(([True], (term[1:] != term[:-1]) | (group[1:] != group[:-1])))
            sub = opens.cumsum() - 1
            count = np.bincount(sub)
            up, parents_size = node[group[opens]], held[group[opens]]
            keep = (count > 1) & (2 * count <= parents_size)
            number = np.where(keep, n + len(made) + keep.cumsum() - 1, up)
            made += up[keep].tolist()
            parent[docs] = number[sub]
            node, held = number, np.where(keep, count, parents_size)
            many = count[sub] > 1
            docs, group = docs[many], sub[many]
            depth += 1
        return np.concatenate((parent, np.array(made, np.int64))) if made else parent

    def bounds(self, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each node the most that a document below it can score; for a leaf its score."""
        key = (nodes[:, None] << 32) | terms[None, :]
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        tf = np.where(self.key[at] == key, self.value[at], 0) if len(self.key) else np.zeros(key.shape, np.int64)
        return (weights[None, :] * gain(tf, self.least[nodes][:, None])).sum(1)

    def search(self, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
        """Offers `best` every document that can get in; the number of nodes looked at.

        Depth first, the nodes with the best bounds of the stack's top; up to WIDTH at a time,
        whose children's bounds are then taken together.
        """
        looked, stack, limits = 0, np.array([-1]), np.array([np.iinfo(np.int64).max])
        while len(stack):
            down = stack[-WIDTH:][limits[-WIDTH:] >= best.least]
            stack, limits = stack[:-WIDTH], limits[:-WIDTH]
            if not len(down):
                continue
            first, count = self.child_start[down + 1], self.child_start[down + 2] - self.child_start[down + 1]
            children = self.child[np.repeat(first - np.concatenate(([0], count[:-1])).cumsum(), count) + np.arange(count.sum())]
            looked += len(children)
            bounds = self.bounds(children, terms, weights)
            fit = bounds >= best.least
            children, bounds = children[fit], bounds[fit]
            leaf = children < self.n
            found, score = children[leaf], bounds[leaf]
            if len(found) > best.k:
                # of these leaves only the best k can get in, and those that tie with the last of them
                cut = np.partition(score, len(score) - best.k)[len(score) - best.k]
                found, score = found[score >= cut], score[score >= cut]
            best.offer(score.tolist(), [self.places[i] for i in found.tolist()])
            inner, bounds = children[~leaf], bounds[~leaf]
            rank = np.argsort(bounds, kind="stable")
            stack, limits = np.concatenate((stack, inner[rank])), np.concatenate((limits, bounds[rank]))
        return looked


class Best:
    """The k highest scores from `least` up, equal ones by the highest place (a tuple)."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.heap = k, max(least, 1), []

    def offer(self, scores: list[int], places: list[tuple]) -> None:
        for score, place in zip(scores, places, strict=True):
            if score < self.least:
                continue
            row = (score, *place)
            if len(self.heap) < self.k:
                heapq.heappush(self.heap, row)
            else:
                heapq.heappushpop(self.heap, row)
            if len(self.heap) == self.k:
                self.least = max(self.least, self.heap[0][0])


VECTOR = "n long, terms array<int>, tfs array<int>"


def vectors(docs: DataFrame, vocabulary: list[bytes], text: str = "text") -> DataFrame:
    """(row, n, terms, tfs, id) of rows (row, text, id): the number of all terms, and those of the vocabulary with their counts."""
    shared = docs.sparkSession.sparkContext.broadcast({term: i for i, term in enumerate(vocabulary)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            sizes, terms, tfs, ends = [], [], [], [0]
            for value in batch.column(1):
                words = terms_of(value.as_py() or b"")
                counts = Counter(map(known.get, words))
                counts.pop(None, None)
                sizes.append(len(words))
                terms.append(np.fromiter(counts.keys(), np.int32, len(counts)))
                tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))
                ends.append(ends[-1] + len(counts))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *x]))) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists, batch.column(2)], names=["row", "n", "terms", "tfs", "id"])

    return docs.select("row", F.col(f"`{text}`").cast("string").cast("binary").alias("text"), "id").mapInArrow(count, "row long, " + VECTOR + ", id long")


def item_terms(items: DataFrame, text: str = "text") -> DataFrame:
    """(item, term) rows, each term of an item once, from rows (item, text)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [sorted(set(terms_of(t or b""))) for t in batch.column(1).to_pylist()]
            of = np.repeat(np.arange(batch.num_rows), [len(x) for x in each])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array([t for x in each for t in x], pa.binary())], names=["item", "term"])

    return items.select("item", F.col(f"`{text}`").cast("string").cast("binary").alias("text")).mapInArrow(split, "item long, term binary")


#: A document found: its score, and what goes before among equal scores (0 or -1 for a null id, -id, -row).
FOUND = "item long, score long, known long, low long, first long"


def _found(parts: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], least: dict[int, int], order: np.ndarray, documents: int, total: int, k: int, entries: int) -> DataFrame:
    """(item, score, known, low, first) rows: each task's best documents of each item, from rows (row, n, terms, tfs, id)."""
    shared = parts.sparkSession.sparkContext.broadcast((queries, least, order))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least, order = shared.value
        best = [Best(k, least.get(item, 1)) for item, *_ in queries]

        def tree(held: list[tuple]) -> None:
            places = [p for part, *_ in held for p in part]
            n, size, terms, tfs = (np.concatenate(x) for x in list(zip(*held, strict=True))[1:])
            # each vector's terms in order of falling frequency
            of, rank = np.repeat(np.arange(len(size)), size), order[terms]
            sort = np.lexsort((rank, of))
            fp = FpTree(places, length_norm(n, documents, total), np.concatenate(([0], size)).cumsum(), rank[sort], tfs[sort])
            there = np.zeros(len(order), bool)
            there[rank] = True
            for (_, item_terms, weights), own in zip(queries, best, strict=True):
                some = there[item_terms]
                if some.any():
                    fp.search(item_terms[some], weights[some], own)

        held, many = [], 0
        for batch in batches:
            row, n, id = (batch.column(i) for i in (0, 1, 4))
            places = [(-1, 0, -r) if i is None else (0, -i, -r) for r, i in zip(row.to_pylist(), id.to_pylist(), strict=True)]
            n = n.to_numpy(zero_copy_only=False)
            ends = batch.column(2).offsets.to_numpy()
            terms, tfs = (batch.column(i).values.to_numpy(zero_copy_only=False) for i in (2, 3))
            start = 0
            while start < len(n):
                stop = min(len(n), max(start + 1, int(np.searchsorted(ends, ends[start] + entries - many, "right")) - 1))
                part = slice(ends[start], ends[stop])
                held.append((places[start:stop], n[start:stop], np.diff(ends[start : stop + 1]), terms[part], tfs[part]))
                many += int(ends[stop] - ends[start])
                if many >= entries:
                    tree(held)
                    held, many = [], 0
                start = stop
        if held:
            tree(held)
        for (item, *_), own in zip(queries, best, strict=True):
            if own.heap:
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(own.heap), pa.int64()), *[pa.array(x, pa.int64()) for x in zip(*own.heap, strict=True)]], names=["item", "score", "known", "low", "first"])

    return parts.mapInArrow(search, FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their rank."""
    order = Window.partitionBy("item").orderBy(*[F.desc(c) for c in ("score", "known", "low", "first")])
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block_terms: int = BLOCK_TERMS, tree_entries: int = TREE_ENTRIES) -> DataFrame:
    """(item_id, rank, id, score): the k best documents of each row of `items` with a score above 0.

    A score sums weight * gain over the item's terms, each once; equal scores stand by
    ascending id (a whole number; null last), then row.  Every row of `items` is an item, also
    one whose id is null or repeats; every row of `docs` is a document.  Null and empty texts
    have no terms: such items have no rows, such documents are found by none.
    """
    if docs.schema[id].dataType not in (T.LongType(), T.IntegerType(), T.ShortType(), T.ByteType()):
        raise TypeError(f"{id} must be a whole number: equal scores are told apart by it")
    spark = docs.sparkSession
    # written: the numbers have to be the same wherever they are read
    asked = written(items.select(F.monotonically_increasing_id().alias("item"), F.col(f"`{item_id}`").alias("of"), F.col(f"`{item_text}`").alias("text")), "items")
    held = written(item_terms(asked), "item-terms")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    ranked = None
    for low, high in _blocks(held, block_terms):
        # at most block_terms rows, or those of one item
        each = held.filter((F.col("item") >= low) & (F.col("item") <= high)).toPandas()
        vocabulary = sorted(set(map(bytes, each["term"])))
        number = {term: i for i, term in enumerate(vocabulary)}
        vector = written(vectors(rows, vocabulary), "vectors")
        sums = vector.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
        frequency = np.zeros(len(vocabulary), np.int64)
        for term, df in vector.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # a row a term of the block
            frequency[term] = df
        order = np.empty(len(vocabulary), np.int64)
        order[np.argsort(-frequency, kind="stable")] = np.arange(len(vocabulary))
        weights = np.array([weight(sums["documents"], int(f)) for f in frequency], np.int64)
        queries = []
        for item, own in each.groupby("item", sort=True):
            own = np.array([number[bytes(t)] for t in own["term"]], np.int64)
            own = own[(frequency[own] > 0) & (weights[own] > 0)]
            if len(own):
                queries.append((int(item), order[own], weights[own]))
        some = vector.filter(F.size("terms") > 0)
        settings = (order, sums["documents"], sums["total"], k, tree_entries)
        first = _found(some.filter(F.pmod(F.xxhash64("row"), F.lit(FIRST_PARTS)) == 0), queries, {}, *settings)
        # one row an item of the block
        least = {r["item"]: r["least"] for r in _ranked(first, k).filter(F.col("rank") == k).select("item", F.col("score").alias("least")).collect()}
        best = written(_ranked(_found(some, queries, least, *settings), k), "found")
        ranked = best if ranked is None else ranked.unionByName(best)
    named = asked.select(F.col("item").alias("i"), "of")
    if ranked is None:
        ranked = spark.createDataFrame([], FOUND + ", rank int")
    return ranked.join(named, F.col("item") == F.col("i")).select(F.col("of").alias(item_id), F.col("rank").cast("int").alias("rank"), F.when(F.col("known") == 0, -F.col("low")).alias(id), "score")


def _blocks(held: DataFrame, block_terms: int) -> list[tuple[int, int]]:
    """(first, last) item of each block of at most `block_terms` terms (or one item), from rows (item, term)."""
    # numbers of terms are added up over ranges of items; a row a block comes to the driver
    counts = held.groupBy("item").agg(F.count("*").alias("n"))
    until = counts.withColumn("block", F.floor((F.sum("n").over(Window.orderBy("item")) - 1) / block_terms))
    return [(r["low"], r["high"]) for r in until.groupBy("block").agg(F.min("item").alias("low"), F.max("item").alias("high")).orderBy("low").collect()]
