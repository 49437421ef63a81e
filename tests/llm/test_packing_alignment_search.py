"""Packing, alignment and ranked search against plain Python, odd input and small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hydroloom.llm import alignment, packing, queries, search, tokens

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "  a", "a  b ", "\ta\n", "a \nb", "x<|endoftext|> <|endoftext|>y <s>", "▁a", "a▁b c", "é́ ß 漢字 \U0001f388", "<0x41> a\0b", "a b 　c", "naïve café naïve", "a", "aaaa " * 700, "b" * 5000, "same text", "same text"]


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i != 3 else None, t, i, "x") for i, t in enumerate(ODD)] + [(18, "same text", 1, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, piece int, sequence_id string")


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return queries.table(spark, sf_dir, "documents")


def plain_tokenizer(special_as_text):
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = special_as_text
    return tokenizer


# -- packing


def check_packing(rows, texts, capacity):
    """Pieces are the tokenizer's ids in order, cut only where too long, gapless in sequences."""
    tokenizer, by_doc, by_sequence = plain_tokenizer(False), {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        ids = tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids + [2]
        pieces.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and len(pieces) == -(-len(ids) // capacity)
        assert all(r["length"] == capacity for r in pieces[1:])
        at = 0
        for r in pieces:
            assert r["start"] == at
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for held in by_sequence.values():
        at = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return by_sequence


def best_fit_decreasing(lengths, capacity):
    gaps = Counter()
    n = 0
    for length in sorted(lengths, reverse=True):
        gap = min((g for g, c in gaps.items() if c and g >= length), default=None)
        if gap is None:
            gap, n = capacity, n + 1
        else:
            gaps[gap] -= 1
        gaps[gap - length] += 1
    return n


def test_op11_pieces_and_sequences(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, sf_dir, "documents").select("doc_id", "text").collect()}
    rows = queries.op11_packing(spark, sf_dir).collect()
    made = check_packing(rows, texts, 1024)
    # not many more sequences than best fit in falling order needs
    assert len(made) <= 1.02 * best_fit_decreasing([r["length"] for r in rows], 1024) + 2


def test_packing_of_odd_rows(spark, odd):
    rows = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    pieces = packing.token_pieces(rows, BYTES, 2, 16).withColumn("ids_crc32", F.crc32("ids")).withColumn("sequence_id", F.lit("own")).withColumn("row", F.lit(1)).withColumn("x.y", F.lit(None).cast("map<string,int>"))
    packed = packing.pack(pieces, 16, shard=40)
    assert packed.columns == [*pieces.columns, "sequence_id_", "offset"]
    check_packing(packed.drop("sequence_id", "x.y").withColumnRenamed("sequence_id_", "sequence_id").collect(), {r["doc_id"]: r["text"] for r in rows.collect()}, 16)
    # null ids and repeated rows keep their pieces
    assert packing.token_pieces(odd, BYTES, 2, 16).groupBy("doc_id").count().filter("doc_id is null").first()["count"] == 1
    assert packing.token_pieces(odd, BYTES, 2).filter("doc_id = 18").count() == 2
    assert packing.pack(packing.token_pieces(odd.limit(0), BYTES, 2)).count() == 0
    with pytest.raises(Exception, match="capacity"):
        packing.pack(spark.createDataFrame([(0,)], "length long")).collect()


def test_sequences_give_texts_back(spark, odd):
    packed = packing.pack(packing.token_pieces(odd, BYTES, 2, 64), 64)
    made = packing.sequences(packed).collect()
    assert sum(r["length"] for r in made) == sum(len(plain_tokenizer(False).encode(t or "", add_special_tokens=False).ids) + 1 for t in [*ODD, "same text"])
    for r in made:
        assert len(r["ids"]) == 4 * r["length"] == 4 * sum(r["parts"]) <= 256


def test_placing_takes_the_smallest_sum_of_squares():
    rng = random.Random(1)
    bins, levels = packing.OpenBins(20), Counter()
    for number in range(400):
        length = rng.randint(1, 19)

        def total(level):
            after = levels.copy()
            if level:
                after[level] -= 1
            if level + length < 20:
                after[level + length] += 1
            return sum(c * c for c in after.values())

        choices = [0, *(h for h, c in levels.items() if c and h + length <= 20)]
        _, level = bins.place(length, number, False)
        assert level in choices and total(level) == min(map(total, choices))
        if level:
            levels[level] -= 1
        if level + length < 20:
            levels[level + length] += 1
        assert {h: c for h, c in levels.items() if c} == {h: int(c) for h, c in enumerate(bins.count) if c}


def test_many_shards_pack_as_well(spark):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1024, 6000)
    pieces = spark.createDataFrame([(int(x),) for x in lengths], "length long")
    packed = packing.pack(pieces, shard=2000)
    held = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.min("offset").alias("low")).collect()
    assert packed.count() == 6000 and max(r["n"] for r in held) <= 1024 and {r["low"] for r in held} == {0}
    assert len(held) <= 1.03 * best_fit_decreasing(lengths.tolist(), 1024)


@pytest.mark.parametrize("special_as_text", [False, True])
def test_byte_ids_are_the_tokenizers(special_as_text, documents):
    own, theirs = tokens.ByteBpe(BYTES, special_as_text), plain_tokenizer(special_as_text)
    assert own.fast
    texts = [t or "" for t in ODD] + [" " * 1_500_000 + "x", "\n" * 300_000] + [r["text"] for r in documents.limit(150).collect()]
    for text in texts:
        ids = own.encode(text or "").tolist()
        assert ids == theirs.encode(text or "", add_special_tokens=False).ids
        assert b"".join(own.entries[i] for i in ids) == (text or "").encode()


# -- alignment


def plain_alignment(texts):
    """The contract of op12 read word by word."""
    a_tok, b_tok = plain_tokenizer(True), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    entries = tokens.ByteBpe(BYTES, True).entries
    b_bytes = lambda i: bytes([int(b_tok.id_to_piece(i)[3:5], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    out, counts = [], Counter()
    for text in texts:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_tok.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(entries.__getitem__, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            out.append(([], [], []))
            continue
        ends = []
        for ids, size in ((a, lambda i: len(entries[i])), (b, lambda i: len(b_bytes(i)))):
            at, own = 0, {}
            for place, i in enumerate(ids):
                at += size(i)
                own[at] = place
            ends.append(own)
        groups, x, y = [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            p, q = ends[0][end] + 1, ends[1][end] + 1
            groups.append((a[x:p], b[y:q]))
            counts[a[p - 1], b[q - 1]] += 1
            x, y = p, q
        out.append((a, b, groups))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    rows = []
    for a, b, groups in out:
        links = [(x[-1], y[-1]) for x, y in groups]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        rows.append((len(a), len(b), len(groups), len(links), sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if shown else ""))
    return rows


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_op12_against_plain_python(spark, sf_dir, documents):
    docs = documents.select("doc_id", "text").collect()
    want = dict(zip([r["doc_id"] for r in docs], plain_alignment([r["text"] for r in docs]), strict=True))
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries.op12_alignment(spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("heavy", [1, 7, 100_000])
def test_alignment_of_odd_rows(odd, heavy):
    want = sorted(plain_alignment([r["text"] for r in odd.collect()]))
    made = alignment.aligned(odd, BYTES, PIECES, digest=True).withColumnRenamed("groups", "groups_sha256")
    assert sorted(tuple(r[c] for c in COLUMNS) for r in alignment.with_counts(made, heavy).collect()) == want
    assert alignment.with_counts(alignment.aligned(odd.limit(0), BYTES, PIECES)).count() == 0
    groups = alignment.aligned(odd.filter("doc_id = 14"), BYTES, PIECES).first()["groups"]
    assert re.fullmatch(r"[\d,]+\|[\d,]+", groups)


def test_shared_cuts_are_all_common_ends():
    rng = np.random.default_rng(5)
    for size in (1, 2, 5, 40, 400):
        for share in (0.0, 0.02, 0.5, 1.0):
            every = np.arange(1, 10 * size)
            a = np.unique(np.append(rng.choice(every, size), 10 * size))
            b = np.unique(np.append(np.where(rng.random(len(a)) < share, a, np.minimum(a + 1, 10 * size)), 10 * size))
            x, y = alignment.shared_cuts(a, b)
            assert (a[x] == b[y]).all() and set(a[x]) == set(a) & set(b) and (np.diff(x) > 0).all()
    # over a thousand tokens without a cut
    a, b = np.append(np.arange(2, 4000, 2), 4001), np.append(np.arange(1, 4000, 2), 4001)
    assert alignment.shared_cuts(a, b)[0].tolist() == [len(a) - 1]


def test_word_table_gives_the_ids_of_whole_texts(documents, monkeypatch):
    monkeypatch.setattr(alignment, "WORDS", 50)
    table = alignment.TokenTable(BYTES, PIECES)
    assert table.by_words
    texts = [t or "" for t in ODD] + [r["text"] for r in documents.limit(120).collect()]
    for start in range(0, len(texts), 7):
        part = texts[start : start + 7]
        (a, n_a), (b, n_b) = table.encode(part)
        assert [x.tolist() for x in np.split(a, n_a.cumsum()[:-1])] == [table.a.encode(" " + t).tolist() if t else [] for t in part]
        assert [x.tolist() for x in np.split(b, n_b.cumsum()[:-1])] == [table.b.encode(t) if t else [] for t in part]


# -- search


def plain_search(docs, items, k):
    """The contract of op13 read word by word; docs and items as (id, text)."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    terms = [split(t) for _, t in docs]
    counts = [Counter(x) for x in terms]
    n, total = sum(bool(x) for x in terms), sum(map(len, terms))
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), own, c in zip(docs, terms, counts, strict=True):
            m = 50 + (50 * len(own) * n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(split(text)) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc if doc is not None else 0))
        out += [(item, rank, None if none else doc, -score) for rank, (score, none, doc) in enumerate(sorted(scores)[:k], 1)]
    return out


def shown(rows):
    return sorted(map(repr, rows))


def test_search_against_plain_python(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)] + ["naïve", "漢字", "W1", "w2!"]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=rng.randint(0, 40)))) for i in range(400)]
    docs += [(1000 + i % 40, docs[5][1]) for i in range(90)] + [(None, docs[5][1]), (2000, None), (2001, "")]
    rng.shuffle(docs)
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(30)] + [(7, docs[5][1]), (None, "w3 w4"), (99, None), (98, "!!"), (97, "unheard")]
    want = shown(plain_search(docs, items, 12))
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, item string, row int").repartition(5)
    asked = spark.createDataFrame([(*i, 0) for i in items], "item_id int, text string, term int")
    for settings in ({}, {"tree_entries": 150}, {"block_terms": 20}):
        got = search.rank_documents(frame, asked, 12, **settings)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert shown(map(tuple, got.collect())) == want


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.rank_documents(docs, items).count() == 0
    assert search.rank_documents(items.withColumnRenamed("item_id", "doc_id"), items.limit(0)).count() == 0
    with pytest.raises(TypeError, match="whole number"):
        search.rank_documents(docs.withColumn("doc_id", F.lit("a")), items)


def test_tree_bounds_hold_and_nodes_halve():
    rng = np.random.default_rng(4)
    vectors = [np.unique(rng.geometric(0.15, rng.integers(0, 14)).clip(1, 30) - 1) for _ in range(300)] + [np.arange(9)] * 60
    size = np.array([len(v) for v in vectors])
    terms = np.concatenate(vectors)
    tfs, m = rng.integers(1, 6, len(terms)), rng.integers(50, 90, len(vectors))
    starts = np.concatenate(([0], size)).cumsum()
    tree = search.FpTree([(i,) for i in range(len(vectors))], m, starts, terms, tfs)
    weights, every = rng.integers(0, 50, 30), np.arange(30)
    bounds = tree.bounds(np.arange(len(tree.least)), every, weights)
    exact = [sum(int(weights[t]) * int(search.gain(tf, m[i])) for t, tf in zip(terms[a:b], tfs[a:b], strict=True)) for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True))]
    for leaf, (place,) in enumerate(tree.places):
        assert bounds[leaf] == exact[place]

    def below(node):
        if 0 <= node < tree.n:
            return [node]
        return [x for c in tree.child[tree.child_start[node + 1] : tree.child_start[node + 2]] for x in below(c)]

    assert sorted(below(-1)) == list(range(len(vectors)))
    for node in range(tree.n, len(tree.least)):
        leaves = below(node)
        assert bounds[node] >= max(bounds[x] for x in leaves) and len(leaves) > 1
    best = search.Best(10, 0)
    looked = tree.search(every, weights, best)
    assert sorted((s for s, _ in best.heap), reverse=True) == sorted((x for x in exact if x > 0), reverse=True)[:10] and looked <= len(tree.least)
