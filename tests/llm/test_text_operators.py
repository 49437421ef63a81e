"""The text operators against brute force, the tokenizer, SQL, and held-out labels."""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import oracle
from hydroloom.llm import bpe, chat, exact_dedup, langid, line_dedup, mixing, quality, queries, simhash, template, toxicity, url_filter

SF = "/root/testdata/sf0.001"
SF10 = "/root/testdata/sf0.01"
WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.mark.parametrize("name", ["op2_quality_rules", "op3_line_dedup", "op6_mixing", "op8_chat", "op9_exact_dedup"])
def test_query_equals_its_sql(spark, name):
    assert oracle.compare(spark, queries.QUERIES[name], queries.ORACLES[name]) > 20


# quality rules


def brute_repeats(words):
    n, best = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and words[i + k] == words[j + k]:
                k += 1
            best[i] = max(best[i], k)
    return best


def test_suffix_array_finds_the_longest_repeat_of_each_suffix():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.randint(0, rng.choice([1, 3, 20])) for _ in range(rng.randint(0, 40))] for _ in range(3)]
        words = np.array([w for t in texts for w in t], np.int64)
        text = np.repeat(np.arange(3), [len(t) for t in texts])
        assert quality.longest_repeats(words, text).tolist() == [b for t in texts for b in brute_repeats(t)]


def test_quality_measures_of_one_text():
    line = "a b c d e f g h i j"
    found = quality.measure([f"{line}\n\n{line}\nend #x", None, "", "é \x0b ü"])
    assert found.iloc[0].tolist() == [22, 25, 1, 1, 20, 20, 10]
    assert found.iloc[1].tolist() == found.iloc[2].tolist() == [0] * 7
    assert found.iloc[3].tolist()[:2] == [2, 2]


def test_batches_do_not_change_measures(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(40)]
    whole = quality.measure(texts)
    monkeypatch.setattr(quality, "BATCH_WORDS", 50)
    assert whole.equals(quality.measure(texts))


# BPE


@pytest.fixture(scope="module")
def words():
    return bpe.word_table(queries.tokenizer_path())


def edged(words, text, ends):
    """Leaves that know places near their edges only, as the tasks send them."""
    parts = [(a, bpe.Part.leaf(words, text[a:b])) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
    moved = lambda places, a: tuple(x + a for x in places)
    return [bpe.Part(a, a + p.end, p.ids, moved(p.first, a), moved(p.last, a), a + p.low, a + p.high) for a, p in parts]


@pytest.mark.parametrize("edge", [1, 4, 30])
def test_leaves_with_places_at_their_edges_only(words, monkeypatch, edge):
    monkeypatch.setattr(bpe, "EDGE", edge)
    rng = random.Random(edge)
    parts = ["a", "the", "ing", "é", "'s", "3", "#", " ", " ", "\n", "\xa0", "<|endoftext|>", "日本", "🙂", "İ", "hello", "x" * 50]
    special = bpe.specials(words.tokenizer)
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 120)))
        leaves = edged(words, text, bpe.cuts(text, rng.choice([6, 20, 60]), special))
        assert bpe.join_tree(words.tokenizer, text, leaves).ids.tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_texts_without_ascii_are_cut_near_their_middle():
    text = "x" * 10 + "日本語" * 400
    ends = bpe.cuts(text, 100)
    assert ends[-1] == len(text) and max(b - a for a, b in zip([0, *ends], ends)) <= 100


@pytest.mark.parametrize("size", [10, 10**6])
def test_word_table_equals_the_tokenizer(monkeypatch, size):
    monkeypatch.setattr(bpe, "WORDS", size)
    table, rng = bpe.WordTable(queries.tokenizer_path()), random.Random(size)
    parts = ["a", "B", "ing", "é", "É", "ß", "ŉ", "ſ", "İ", "'s", "'", "3", "#", ".", ",", "(", '"', "÷", "×", "ñ", "n\u0303", "\xa0", "\x1c", "\u200b", "<|endoftext|>", "<|", "|>", "日", "🙂", "\u0338", "=", "Σ", "Ω", "ǆ"]
    for _ in range(400):
        texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        flat, sizes, decoded = table.encode(texts)
        want = [table.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert flat.tolist() == [i for ids in want for i in ids] and sizes.tolist() == [len(ids) for ids in want]
        assert decoded == [table.tokenizer.decode(ids, skip_special_tokens=False) for ids in want]
        assert len(table.new) <= size


def test_joined_halves_equal_the_plain_encoding(words):
    rng = random.Random(1)
    parts = ["a", "b", "the", "ing", "é", "é", "ß", "'s", "3", "##", " ", "\n", "\xa0", "<|endoftext|>", "日本", "🙂", "́", "İ", "</w>", "hello"]
    special = bpe.specials(words.tokenizer)
    for k in range(400):
        text = "".join(rng.choice(parts if k % 2 else parts[:9]) for _ in range(rng.randint(0, 200)))
        want = words.tokenizer.encode(text, add_special_tokens=False).ids
        ends = bpe.cuts(text, rng.choice([3, 10, 40]), special)
        leaves = [bpe.Part.of(words.tokenizer, text, a, b) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        assert bpe.join_tree(words.tokenizer, text, leaves).ids.tolist() == want
        assert bpe.join_tree(words.tokenizer, text, edged(words, text, ends)).ids.tolist() == want
        ids, sizes, decoded = words.encode([text, "x y", text])
        assert ids[: sizes[0]].tolist() == want and decoded[2] == words.tokenizer.decode(want, skip_special_tokens=False)


def test_tokens_equal_the_tokenizer_on_whole_texts(spark, words):
    long = "abcdefgh" * 3000 + " " + "wörter und Wörter, " * 1500
    docs = spark.createDataFrame([(1, long), (1, long), (2, None), (3, ""), (4, "Hello  <|endoftext|>World's"), (5, "x" * 5000)], "doc_id long, text string")
    for row in bpe.with_tokens(docs, queries.tokenizer_path(), leaf=1000).collect():
        want = words.tokenizer.encode(row["text"] or "", add_special_tokens=False).ids
        assert row["token_ids"] == want and row["decoded"] == words.tokenizer.decode(want, skip_special_tokens=False)
    assert bpe.with_tokens(docs, queries.tokenizer_path(), leaf=1000).count() == 6


def test_bpe_query(spark, words):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_bpe(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = words.tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(words.tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# SimHash


def brute_fingerprint(text):
    words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_prints(text, prints):
    """Fingerprints of the shingles' hashes, mixed anew for each but the first."""
    words = WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes, full, out = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], (1 << 64) - 1, []
    for kind in range(prints):
        mixed = []
        for h in hashes:
            z = h
            if kind:
                z = (z + kind * 0x9E3779B97F4A7C15) & full
                z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & full
                z = ((z ^ z >> 27) * 0x94D049BB133111EB) & full
                z ^= z >> 31
            mixed.append(z)
        out.append(sum(1 << b for b in range(64) if 2 * sum(z >> b & 1 for z in mixed) > len(mixed)))
    return tuple(out)


def brute_components(fingerprints, bits=3):
    """Components of the links of fingerprints, or of tuples of which any may link."""
    fingerprints = {d: f if isinstance(f, tuple) else (f,) for d, f in fingerprints.items()}
    root = {d: d for d in fingerprints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fingerprints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if any((x ^ y).bit_count() <= bits for x, y in zip(fingerprints[a], fingerprints[b], strict=True)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_simhash_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF10}/documents.parquet").collect()}
    want = {d: brute_fingerprint(t) for d, t in texts.items()}
    groups = brute_components(want)
    rows = queries.op5_simhash(spark, SF10).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {d: f"{f:016x}" for d, f in want.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == groups


@pytest.mark.parametrize("crowd", [10**9, 6])
def test_links_keep_every_component(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(7)
    values = set()
    for _ in range(12):
        value = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(value)
            for _ in range(rng.randint(1, 4)):
                value ^= 1 << rng.randrange(64)
    values |= {0, 1, 7, 15, 2**64 - 1}
    signed = {v - (v >> 63 << 64): v for v in values}
    frame = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame)).collect()}
    got, want = {}, {}
    for s in signed:
        got.setdefault(roots.get(s, s), set()).add(s)
    for v, r in brute_components({v: v for v in values}).items():
        want.setdefault(r, set()).add(v - (v >> 63 << 64))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_long_chains_become_one_component(spark):
    chain = spark.range(200).select(F.col("id").alias("node"), (F.col("id") + 1).alias("root"))
    assert [r["root"] for r in simhash.components(chain).select("root").distinct().collect()] == [0]


# mixing


def test_targets_stop_at_twice_their_source_and_reshare(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 500)], "source string, source_size long")
    got = {r["source"]: (r["weight"], r["target"]) for r in mixing.source_targets(sizes).collect()}
    # weights 3, 1, 2, 3; budget 3765; a stops at 20, null at 1000; 2745 left for weights 1 and 2
    assert got["a"] == (3, 20.0) and got[None] == (3, 1000.0)
    assert got["b"] == (1, 915.0) and got["c"] == (2, 1830.0)


def test_mix_takes_about_its_targets(spark):
    rows = queries.op6_mixing(spark, SF10).toPandas()
    assert (rows["taken"] <= 2 * rows["size"]).all() and (rows["taken"] % rows["size"].clip(lower=1) == 0).all()
    by = rows.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert ((by["taken"] - by["target"]).abs() <= by["most"]).all()
    assert rows["taken"].sum() <= rows["size"].sum() * 1.5


def test_mixed_documents_repeat_rows_as_taken(spark):
    docs = spark.createDataFrame([(i, "a b c", "x") for i in range(6)] + [(9, "a b c", "x")] * 3 + [(20, None, None)], "doc_id long, text string, source string")
    mixed = mixing.mixed_documents(docs)
    times = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == docs.columns and 3 * sum(times.values()) == 39 + 3 * times[20] and times[9] <= 6
    assert all(n <= 2 for d, n in times.items() if d != 9)


@pytest.mark.parametrize("text", ["'a b c'", "concat('a b ', id)"])
def test_rows_of_one_id_are_spread(spark, monkeypatch, text):
    monkeypatch.setattr(mixing, "UNFOLD", 1000)
    docs = spark.range(50_000).selectExpr("1L AS doc_id", f"{text} AS text", "'s' AS source")
    timed, _, rows = mixing.queued(docs)
    assert rows == 100_000 and timed.select("mix_key").distinct().count() == 100_000
    times = timed.selectExpr("substring(mix_key, 1, 1) AS first").groupBy("first").count().collect()
    assert len(times) == 16 and max(r["count"] for r in times) < 7_000


def test_sums_of_small_blocks_change_nothing(spark, monkeypatch):
    rows = lambda: sorted(map(tuple, queries.op6_mixing(spark, SF).collect()))
    want = rows()
    monkeypatch.setattr(mixing, "BLOCK", 3)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    assert rows() == want


# exact dedup


@pytest.mark.parametrize("broadcast", [exact_dedup.BROADCAST_ROWS, -1])
def test_radix_rounds_find_equal_texts_only(spark, monkeypatch, broadcast):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", broadcast)
    rng = random.Random(2)
    base = "".join(rng.choice("ab") for _ in range(3000))
    texts = [base, base + " ", base[:-1], base[:64], base[:64] + "\n", base[:256], base[:256], base[:1024] + "x", base[:1024] + "y", None, "", " \t", "é" * 32, "é" * 31 + "e", base]
    rows = {r["doc_id"]: r for r in exact_dedup.with_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    bare = [re.sub("[\x20\x09-\x0d]", "", t or "") for t in texts]
    for i, t in enumerate(bare):
        alike = [j for j, u in enumerate(bare) if u == t]
        best = min(alike, key=lambda j: (-len(texts[j] or ""), j))
        assert (rows[i]["keep_id"], rows[i]["group_size"], rows[i]["kept"]) == (best, len(alike), i == best)
        assert rows[i]["text_sha256"] == hashlib.sha256(t.encode()).hexdigest()


# URLs


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute_cells(host, path):
    """Hashed n-grams of a URL and their values, by a plain loop."""
    counts = Counter()
    for part, text in ((1, host), (2, path)):
        raw = b"^" + text.encode() + b"$"
        for n in url_filter.GRAMS:
            for i in range(len(raw) - n + 1):
                key = part * 31 + n
                for byte in raw[i : i + n]:
                    key = key * 0x100000001B3 % 2**64 ^ byte
                key = (key ^ key >> 29) * 0x9E3779B97F4A7C15 % 2**64
                counts[(key >> 40) % url_filter.SIZE] += 1
    values = {c: np.log1p(k) for c, k in counts.items()}
    norm = np.sqrt(sum(v * v for v in values.values()))
    return {c: v / norm for c, v in values.items()}


@functools.cache
def url_model():
    return url_filter.train(url_filter.seed_labels())


def brute_score(host, path):
    model = url_model()
    return 1 / (1 + np.exp(-model.bias - sum(v * model.weights[c] for c, v in brute_cells(host, path).items())))


def test_url_features_and_slope():
    labels = url_filter.seed_labels().sample(60, random_state=1)
    hosts, paths = zip(*map(url_filter.split_url, labels["url"]), strict=True)
    cells = url_filter.features(hosts, paths)
    found = {}
    for row, column, value in zip(*cells, strict=True):
        found.setdefault(int(row), {})[int(column)] = value
    for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
        want = brute_cells(host, path)
        assert found[i].keys() == want.keys() and all(abs(found[i][c] - v) < 1e-12 for c, v in want.items())
    rng = np.random.default_rng(2)
    weights, bias, y, share = rng.normal(size=url_filter.SIZE), 0.3, labels["unwanted"].to_numpy(float), np.full(60, 1 / 60)
    _, by_weight, by_bias = url_filter.loss_and_slope(weights, bias, cells, y, share, 1e-3)
    risk = lambda w, b: url_filter.loss_and_slope(w, b, cells, y, share, 1e-3)[0]
    for c in rng.choice(cells[1], 8):
        step = np.zeros(url_filter.SIZE)
        step[c] = 1e-5
        assert abs((risk(weights + step, bias) - risk(weights - step, bias)) / 2e-5 - by_weight[c]) < 1e-7
    assert abs((risk(weights, bias + 1e-5) - risk(weights, bias - 1e-5)) / 2e-5 - by_bias) < 1e-7


def test_labels_sorted_by_class_are_sampled(monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LABELS", 400)
    model = url_filter.train(url_filter.seed_labels(), rounds=50)
    assert model.weights.max() > 0 > model.weights.min()


def test_url_query(spark):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SF10}/pages.parquet").collect()}
    rows = queries.op1_url_filters(spark, SF10).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path = url_filter.split_url(urls[r["page_id"]])
        rule, verdict = brute_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and r["verdict"] in ("allow", "block")
        if rule is None:
            assert r["verdict"] == ("block" if brute_score(host, path) >= url_filter.THRESHOLD else "allow")


def test_odd_urls(spark):
    urls = [None, "", "no-scheme.com/en/", "HTTP://EXAMPLE.COM/en/7?x", "a://b://c/d", "x://host#f/en/", "x://notcom/en/", "x://com/en/1", "x://É.COM/\nen/?q"]
    pages = spark.createDataFrame([(i, u, "kept", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, score int")
    rows = {r["page_id"]: r for r in url_filter.with_verdict(pages).collect()}
    got = {i: (r["url_filter"]["host"], r["url_filter"]["path"], r["url_filter"]["rule"]) for i, r in rows.items()}
    assert got[0] == got[1] == got[2] == ("", "", None)
    assert got[3] == ("example.com", "/en/7", "example.com/en/7") and got[4] == ("b:", "//c/d", None)
    assert got[5] == ("host", "", None) and got[6] == ("notcom", "/en/", None) and got[7] == ("com", "/en/1", "com/en/")
    assert got[8] == ("É.com", "/\nen/", None) and rows[3]["host"] == "kept"


# learned scores


def test_language_of_held_out_rows(spark):
    rows = queries.op7_language(spark, SF10).join(spark.read.parquet(f"{SF10}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows["held_out"]]
    assert len(held) > 200 and (held["lang_pred"] == held["lang"]).mean() > 0.97 and rows["score"].between(0, 1).all()


def test_language_of_texts_without_letters(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 #!", None), (4, "the cat", "en"), (5, "der Hund", "de")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["language"] for r in langid.with_language(docs, F.lit(True)).collect()}
    assert [got[i]["lang"] for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"] and got[1]["score"] == 0
    assert {r["language"]["lang"] for r in langid.with_language(docs, F.lit(False)).collect()} == {"und"}


def brute_grams(text):
    """For each n the set of hashed n-grams of a text, by plain loops."""
    codes = [c if c >= 0x3000 or chr(c).isalpha() else 32 for c in map(ord, f" {text} ".lower())]
    out = []
    for n, size, _ in langid.SPECTRA:
        grams = set()
        for i in range(len(codes) - n + 1):
            key = 0
            for c in codes[i : i + n]:
                key = key * 0x01000193 % 2**32 ^ c
            grams.add((key * 0x9E3779B1 % 2**32) >> (32 - (size.bit_length() - 1)))
        out.append(grams)
    return out


def brute_kernel(a, b):
    return sum(w * len(x & y) / np.sqrt(max(len(x), 1) * max(len(y), 1)) for (_, _, w), x, y in zip(langid.SPECTRA, a, b, strict=True))


def test_language_equals_plain_kernels_and_ridge():
    rng = random.Random(11)
    parts = {"aa": "the and ing tion of", "bb": "der und ung schaft ß", "cc": "日本 語 の です"}
    rows = [(" ".join(rng.choice(p.split()) + rng.choice("xyz,. ") for _ in range(12)), lang) for lang, p in parts.items() for _ in range(10)]
    texts, langs = map(list, zip(*rows, strict=True))
    model = langid.fit(langid.presence(texts), langs, landmarks=6, ridge=0.01)
    grams = list(map(brute_grams, texts))
    # landmarks: the first two of each language
    marks = [i for k in range(2) for i in (k, 10 + k, 20 + k)]
    of = lambda g: np.array([brute_kernel(g, grams[m]) for m in marks])
    values, vectors = np.linalg.eigh([of(grams[m]) for m in marks])
    back = vectors[:, values > 1e-6 * values.max()] / np.sqrt(values[values > 1e-6 * values.max()])
    z = np.array([of(g) @ back for g in grams])
    target = np.array([[lang == name for name in sorted(parts)] for lang in langs], float)
    solved = np.linalg.solve(z.T @ z / 10 + 0.01 * np.eye(z.shape[1]), z.T @ target / 10)
    probes = [*texts, "the Und ing", "", "x", "です of"]
    points = np.array([of(brute_grams(t)) @ back @ solved for t in probes])
    best, score = model.decide(probes)
    shares = np.exp(langid.SHARPNESS * points)
    assert best.tolist() == points.argmax(1).tolist()
    assert np.allclose(score, (shares / shares.sum(1, keepdims=True)).max(1), atol=1e-4)


def test_language_training_rows_are_bounded(spark):
    docs = spark.range(3000).selectExpr("1L AS doc_id", "concat('text number ', id) AS text", "IF(id % 2 = 0, 'en', 'de') AS lang").union(spark.range(500).selectExpr("1L", "'the same text'", "'en'"))
    draw = lambda frame: langid.sample(frame, F.lit(True), "doc_id", "text", "lang", most=40)
    present, langs = draw(docs)
    again, same = draw(docs.repartition(7))
    assert 10 < len(langs) <= 80 and langs == same and (present == again).all()


def test_toxicity_training_rows_are_bounded(spark):
    docs = spark.range(2000).selectExpr("IF(id % 3 = 0, 7L, id) AS doc_id", "concat('word', id) AS text")
    labels = spark.range(100).selectExpr("id AS key", "IF(id = 7, 1, 0) AS bad")
    seen = []
    real = toxicity.fit
    toxicity.fit = lambda p, u, prior: seen.append((p, u)) or real(p, u, prior)
    try:
        for frame in (docs, docs.repartition(5), docs.union(docs)):
            toxicity.train(frame, labels, F.lit(True), label_id="key", toxic="bad", most=(30, 50))
    finally:
        toxicity.fit = real
    for p, u in seen:
        assert len(p) == 30 and len(u) == 50
        assert all((a == b).all() for a, b in zip(p + u, seen[0][0] + seen[0][1], strict=True))


def test_toxicity_equals_plain_loops():
    rng = np.random.default_rng(5)
    places = np.unique([p for w in (b"awful", b"awfully", b"bad", "böse".encode()) for p in toxicity.places_of(w)])
    model = toxicity.ToxicModel(places, rng.normal(size=len(places)), -0.4)
    texts = ["Awful awfulness, bad BAD!", None, "", "bösen Bösewicht nice", "nothing here", "awful " * 50]
    for text, score in zip(texts, model.score(texts), strict=True):
        hit = set()
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()):
            for part in [word, *(b"^" + word[:n] for n in toxicity.STEMS if len(word) >= n)]:
                hit.add(xxhash.xxh64_intdigest(part) % toxicity.SIZE)
        z = -0.4 + sum(model.weights[list(places).index(p)] for p in hit if p in places)
        assert abs(score - 1 / (1 + np.exp(-z))) < 1e-9


def test_toxicity_slopes():
    rng = np.random.default_rng(6)
    x, y, weights, bias, prior = rng.integers(0, 2, (20, 5)), rng.integers(0, 2, (30, 5)), rng.normal(size=5), 0.2, 0.1
    _, clean, known = toxicity.risk_slopes(x, y, weights, bias, prior)
    loss = lambda v: np.logaddexp(0, -v).mean()
    risks = [lambda w, b: loss(-(y @ w + b)) - prior * loss(-(x @ w + b)), lambda w, b: prior * loss(x @ w + b)]
    for risk, slope in zip(risks, (clean, known), strict=True):
        for i in range(6):
            step = np.eye(6)[i] * 1e-6
            gap = risk(weights + step[:5], bias + step[5]) - risk(weights - step[:5], bias - step[5])
            assert abs(gap / 2e-6 - slope[i]) < 1e-7


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = rows[rows["held_out"]]
    ranks = held["score"].rank()
    toxic = held["toxic"] == 1
    auc = (ranks[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum())
    recall = held["predicted"][toxic].mean()
    assert auc > 0.96 and recall > 0.85 and held["predicted"][~toxic].mean() < 0.05 and rows["score"].between(0, 1).all()


def test_non_negative_risk_on_plain_data():
    rng = np.random.default_rng(0)
    mark = toxicity.places_of(b"awful")
    clean = [np.unique(rng.integers(0, 5000, 30)) for _ in range(900)]
    toxic = [np.unique(np.append(c, mark)) for c in clean[:100]]
    model = toxicity.fit(toxic[:60], clean[100:] + toxic[60:], prior=0.05)
    assert model.score(["awful thing"])[0] > 0.5 > model.score(["nice thing"])[0]
    assert toxicity.fit([], clean, 0.1).score([None])[0] < 0.5


# chat


def test_templates():
    show = lambda source, **names: template.compile_template(source, chat.FILTERS)(**names)
    assert show("a{# no #}{{ 'b' ~ 1 }}{% if not x %}c{% elif x == 2 %}d{% else %}e{% endif %}", x=2) == ("ab1d", [])
    assert show("{% for i in l %}{{ loop.index }}{% generation %}{{ i['k'] }}{% endgeneration %}{% endfor %}", l=[{"k": "é"}, {"k": ""}]) == ("1é2", [(1, 2)])
    assert template.fold(template.parse("{% if true and 'a' in 'abc' %}x{{ 'y' }}{% else %}z{% endif %}w"), {}) == (template.Text("xyw"),)
    for bad in ("{{ x.__class__ }}", "{{ x() }}", "{% if x %}", "{% boo %}", "{{ x | nofilter }}", "{{ }}"):
        with pytest.raises(template.TemplateError):
            show(bad, x="text")


def test_formatting_reads_back(spark):
    rng = random.Random(4)
    parts = ["\\", "#", "###", "<", "</turn>", "\n", ":", " ", "x", "### Assistant: ", "é"]
    turns = [(c, t, rng.choice(["user", "assistant", "As: s", "", "System"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) or None) for c in range(40) for t in range(5)]
    rows = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    for r in rows:
        own = [(role, text or "") for c, _, role, text in turns if c == r["conv_id"]]
        assert chat.read_back(r["formatted"]) == own
        assert [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]] == [t for role, t in own if role == "assistant" and t]


# lines


@pytest.mark.parametrize("broadcast", [line_dedup.BROADCAST_BYTES, -1])
def test_lines_over_the_ratio_go_from_their_own_host_only(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", broadcast)
    pages = [(i, "a", f"menu\nown {i}\n\n menu ") for i in range(10)] + [(100 + i, "b", f"menu\nown {i}") for i in range(3)] + [(200, None, None), (201, "a", "menu")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_boilerplate(spark.createDataFrame(pages, "doc_id long, source string, text string")).collect()}
    assert got[0] == "own 0\n" and got[100] == "menu\nown 0" and got[200] is None and got[201] == ""


def test_names_with_dots(spark):
    pages = spark.createDataFrame([(i, "a", f"menu\nown {i}", "x") for i in range(10)], "`doc.id` long, `site.host` string, `page.text` string, n_lines string")
    out = line_dedup.drop_boilerplate(pages, "site.host", "page.text", counts=True)
    assert out.columns == [*pages.columns, "n_lines_", "n_dropped"] and {r["n_dropped"] for r in out.collect()} == {1}
    assert simhash.with_components(pages, "doc.id", "page.text").count() == 10
    assert simhash.keep_one(pages, "doc.id", "page.text").columns == pages.columns
    assert mixing.mixed_documents(pages, "site.host", "doc.id", "page.text").columns == pages.columns
