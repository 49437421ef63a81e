"""The pipeline's stages, one after another, against plain Python on a small table."""

from __future__ import annotations

import re
from collections import Counter

import corpus_pipeline
from hydroloom.llm import bpe, common, queries, simhash
from test_text_operators import WORDS, brute_repeats

SF = "/root/testdata/sf0.001"


def good(text):
    words = WORDS.findall(text or "")
    longest = brute_repeats(words) if len(words) < 700 else [0] * len(words)
    marks = {n: {j for i, b in enumerate(longest) if b >= n for j in range(i, i + (3 if n == 3 else b))} for n in (3, 8)}
    return len(words) >= 50 and 100 * len(marks[3]) <= 50 * len(words) and len(marks[8]) <= 0.3 * len(words) and max(longest) <= 150


def near_groups(texts):
    """Smallest id of each text's group: components of all pairs with five-word shingles 0.8 alike, or equal words."""
    words = {d: re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split() for d, t in texts.items()}
    sets = {d: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for d, w in words.items()}
    low = {d: d for d in texts}

    def find(d):
        while low[d] != d:
            d = low[d]
        return d

    for x in texts:
        for y in texts:
            if x < y and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                low[max(find(x), find(y))] = min(find(x), find(y))
    return {d: find(d) for d in texts}


def test_stages_equal_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    rows = {r["doc_id"]: r for r in docs.collect()}
    # long texts are left to the SQL test of the rules: the plain search is quadratic
    checked = {d for d, r in rows.items() if len(WORDS.findall(r["text"] or "")) < 700}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), "stage")
        steps[name] = docs.collect()

    kept = {r["doc_id"] for r in steps["quality rules"]}
    assert kept & checked == {d for d in checked if good(rows[d]["text"])}

    pages, seen = Counter(), Counter()
    for r in steps["quality rules"]:
        pages[r["source"]] += 1
        seen.update({(r["source"], bare) for line in r["text"].split("\n") if (bare := line.strip(common.SPACES))})
    bad = {k for k, n in seen.items() if n >= 5 and n > 0.08 * pages[k[0]]}
    cut = {r["doc_id"]: "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(common.SPACES)) not in bad) for r in steps["quality rules"]}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in steps["line dedup"]} == {d: (t, len(t)) for d, t in cut.items()}

    groups = near_groups(cut)
    left = {r["doc_id"] for r in steps["simhash near-dedup"]}
    removable = {d for d, low in groups.items() if d != low}
    assert len(steps["simhash near-dedup"]) == len(left) and set(groups.values()) <= left
    assert len(left & removable) <= 0.1 * len(removable)

    sizes = {r["doc_id"]: len(WORDS.findall(r["text"])) for r in steps["simhash near-dedup"]}
    source = {r["doc_id"]: r["source"] for r in steps["simhash near-dedup"]}
    total = Counter()
    for d, n in sizes.items():
        total[source[d]] += n
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(total))}
    targets, left = {}, 1.5 * sum(total.values())
    while True:
        free = [s for s in total if s not in targets]
        level = left / sum(weights[s] for s in free)
        stops = [s for s in free if 2 * total[s] < weights[s] * level]
        if not stops:
            break
        for s in stops:
            targets[s] = 2 * total[s]
            left -= targets[s]
    targets |= {s: weights[s] * level for s in free}
    times = Counter(r["doc_id"] for r in steps["mixing"])
    assert set(times) <= set(sizes) and max(times.values()) <= 2
    taken = Counter()
    for d, n in times.items():
        taken[source[d]] += n * sizes[d]
    assert all(abs(taken[s] - targets[s]) <= max(sizes[d] for d in sizes if source[d] == s) for s in total)

    tokenizer = bpe.word_table(queries.tokenizer_path()).tokenizer
    texts = {r["doc_id"]: r["text"] for r in steps["mixing"]}
    assert Counter(r["doc_id"] for r in steps["bpe"]) == times
    for r in steps["bpe"]:
        assert r["token_ids"] == tokenizer.encode(texts[r["doc_id"]], add_special_tokens=False).ids and r["n_tokens"] == len(r["token_ids"])
