"""keep_one keeps one row of each component where ids are missing or repeated."""

from __future__ import annotations

import random

import numpy as np
import pytest

from hydroloom.llm import simhash


def text(word):
    return " ".join(f"{word}{i} {word}x{i * i}" for i in range(80))


def kept(spark, rows):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()), key=repr)


def test_texts_without_id(spark):
    rows = [(None, text("a"), "1"), (None, text("b"), "2"), (None, text("b"), "3"), (None, text("c"), "4"), (7, text("c"), "5")]
    assert kept(spark, rows) == [(7, text("c"), "5"), (None, text("a"), "1"), (None, text("b"), "2")]


@pytest.mark.parametrize("few", [0, 1_000])
def test_one_id_with_two_texts(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "BROADCAST_NUMBERS", few)
    rows = [(1, text("a"), "1"), (1, text("b"), "2"), (1, text("b"), "3"), (2, text("b"), "4"), (3, text("c"), "5"), (3, text("a"), "6")]
    assert kept(spark, rows) == [(1, text("a"), "1"), (1, text("b"), "2"), (3, text("c"), "5")]


def likeness(a, b):
    """Jaccard similarity of the sets of five-word shingles of two lists of words."""
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def edited(rng, words, to):
    """Words replaced, left out or put in until five-word similarity falls to `to`; the last text not below it."""
    own = list(words)
    while True:
        at = rng.randrange(len(own))
        kind = rng.randrange(3)
        new = own[:at] + ([f"w{rng.randrange(20_000)}"] if kind < 2 else []) + own[at + (kind != 1) :]
        if likeness(words, new) < to:
            return " ".join(own)
        own = new


def extended(rng, words, to):
    """A passage put in as long as five-word similarity stays at `to`."""
    more = [f"w{rng.randrange(20_000)}" for _ in range(int((len(words) - 8) / to) - len(words))]
    at = rng.randrange(len(words))
    assert likeness(words, words[:at] + more + words[at:]) >= to
    return " ".join(words[:at] + more + words[at:])


@pytest.mark.parametrize("crowd", [8_000, 20])
def test_recall_of_planted_copies(spark, monkeypatch, crowd):
    """Of copies at a five-word similarity of 0.8 nine in ten go, of those at 0.9 almost all; originals and unlike texts stay."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(3)
    common = [f"w{i}" for i in range(40)]
    words = lambda: [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(20_000)}" for _ in range(rng.randrange(120, 500))]
    rows = []
    for i in range(150):
        own = words()
        rows += [(i, " ".join(own), "own"), (1_000 + i, edited(rng, own, 0.8), "0.8"), (2_000 + i, edited(rng, own, 0.9), "0.9"), (4_000 + i, extended(rng, own, 0.8), "passage")]
        # half of its sentences elsewhere: about a third alike
        rows.append((3_000 + i, " ".join(own[: len(own) // 2] + words()[: len(own) // 2]), "unlike"))
    left = [source for _, _, source in kept(spark, rows)]
    assert left.count("own") == 150 and left.count("unlike") == 150
    assert left.count("0.8") <= 0.1 * 150 and left.count("passage") <= 0.1 * 150 and left.count("0.9") <= 0.02 * 150


def test_only_pairs_as_like_as_asked_are_linked(spark):
    """The same words in another order have the same fingerprints, but no shingle in common."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    mixed = [" ".join(rng.sample(words, 60)) for _ in range(20)]
    rows = [(i, t, "x") for i, t in enumerate(mixed)] + [(100, "a b c", "x"), (101, "c b a", "x"), (102, "A  b\nc", "x"), (103, "a b c d", "x")]
    assert sorted(d for d, _, _ in kept(spark, rows)) == [*range(20), 100, 101, 103]


@pytest.mark.parametrize("group", [2_000, 30])
def test_a_large_group_of_variants(spark, monkeypatch, group):
    """Variants of one text are 0.8 like it, but less like each other: all meet through it, in one task or several."""
    monkeypatch.setattr(simhash, "GROUP", group)
    rng = random.Random(6)
    own = [f"w{rng.randrange(20_000)}" for _ in range(400)]
    rows = [(500, " ".join(own), "own")] + [(i, edited(rng, own, 0.85), "copy") for i in range(100)]
    left = kept(spark, rows)
    assert len(left) <= 3 and min(d for d, _, _ in left) == 0


def test_pairs_alike():
    """Components are those of all pairs, compared one by one."""
    rng = np.random.default_rng(2)
    for n, kinds in ((2, 3), (30, 40), (80, 12)):
        sets = [np.unique(rng.integers(0, kinds, rng.integers(0, 30)).astype(np.int32)) for _ in range(n)]
        root = list(range(n))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        def jaccard(x, y):
            return len(set(sets[x]) & set(sets[y])) / max(1, len(set(sets[x]) | set(sets[y])))

        want = [(x, y) for x in range(n) for y in range(x) if jaccard(x, y) >= 0.6]
        got = simhash.alike(sets, 0.6)
        assert all(jaccard(x, y) >= 0.6 for x, y in got)
        for edges in (want, got):
            root = list(range(n))
            for x, y in edges:
                root[max(find(x), find(y))] = min(find(x), find(y))
            found = [find(x) for x in range(n)]
            if edges is want:
                expected = found
        assert found == expected and len(got) == n - len(set(found))


def test_empty_table_and_texts(spark):
    assert kept(spark, []) == []
    assert kept(spark, [(2, None, "1"), (1, "", "2"), (3, " \n", "3")]) == [(1, "", "2")]
