"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hydroloom.llm import bpe, chat, common, exact_dedup, langid, line_dedup, mixing, quality, queries, simhash, toxicity, url_filter

#: Names that operators use inside themselves.
CLASHES = ["id", "size", "row", "copy", "finish", "line", "lines", "host", "group", "norm", "digest", "fp", "node", "root", "of", "key", "start", "whole", "place", "bits", "measured", "quality_rules", "quality_rules_", "url_parts", "mix_key", "mix_times", "long_key", "kept", "taken", "times", "ids", "hash", "__host", "__lines", "__id", "__component", "n_lines", "N_dropped", "Language", "Toxicity", "toxic_id", "drawn", "mix_copies", "mix_turn", "Token_IDS", "row_number", "line_host", "line_bad", "alike", "n", "many", "label", "of_n", "conv_id_", "turns", "roles"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows():
    text = " ".join(f"word{i % 97} and{i}" for i in range(60))
    long = "x" * 70_000 + " " + "many words here " * 30_000
    return [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, "en", "b", 1), (3, None, None, None, None), (None, text + " more", None, "a", 5), (4, "", "de", "a", 0), (5, " \n\t ", "de", "b", 4), (6, long, "en", "a", len(long)), (7, "é 日本 🙂", "fr", None, 6)]


@pytest.fixture(params=["rows", "none", "clash"])
def docs(request, spark):
    if request.param == "none":
        return spark.createDataFrame([], SCHEMA)
    frame = spark.createDataFrame(rows(), SCHEMA)
    return frame.select("*", *[F.lit("x").alias(c) for c in CLASHES]) if request.param == "clash" else frame


OPERATORS = {
    "quality": lambda d: quality.with_quality(d),
    "lines": lambda d: line_dedup.drop_boilerplate(d),
    "bpe": lambda d: bpe.with_tokens(d, queries.tokenizer_path()),
    "simhash": lambda d: simhash.with_components(d),
    "mixing": lambda d: mixing.mix_shares(d),
    "language": lambda d: langid.with_language(d, F.lit(True)),
    "exact": lambda d: exact_dedup.with_groups(d),
    "toxicity": lambda d: toxicity.with_toxicity(d, toxicity.train(d, d.select("doc_id", (F.col("n_chars") % 2).alias("toxic")), F.lit(True))),
    "urls": lambda d: url_filter.with_verdict(d, "source"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_out_for_each_row_in(docs, name):
    out = OPERATORS[name](docs)
    got = out.collect()
    assert len(got) == docs.count()
    if name in ("quality", "lines", "bpe", "language", "toxicity", "urls"):
        replaced = {"Token_IDS"} if name == "bpe" else set()
        assert set(docs.columns) - replaced <= set(out.columns) and len({c.lower() for c in out.columns}) == len(out.columns)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_the_columns(docs, spark, name, stage):
    out = stage(spark, docs, "")
    out.collect()
    assert out.columns == docs.columns


def test_chat(docs):
    turns = docs.withColumnsRenamed({"doc_id": "conv_id", "n_chars": "turn", "source": "role"})
    out = chat.format_conversations(turns).collect()
    assert len(out) == docs.select("doc_id").distinct().count()
    assert sum(len(chat.read_back(r["formatted"])) for r in out) == docs.count()


def test_a_huge_turn_is_read_back():
    text = "### user: " + chat.escape("<#\\ text " * 300_000) + "</turn>\n"
    assert chat.read_back(text) == [("=user"[1:], "<#\\ text " * 300_000)]


def test_clusters_need_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: {})
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        common.shared_folder(Session)


def test_last_stage(docs, spark):
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == docs.count()


def test_toxicity(docs, spark):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, None), (2, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        model = toxicity.train(docs, table, F.lit(True))
        assert len(toxicity.with_toxicity(docs, model).collect()) == docs.count()


def test_defined_results(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    groups = {(r["doc_id"], r["kept"]): r for r in exact_dedup.with_groups(frame).collect()}
    assert groups[5, True]["group_size"] == 3 and groups[3, False]["keep_id"] == 5  # the most code points stay
    assert groups[1, True]["group_size"] == 3 and groups[1, False]["keep_id"] == 1
    parts = {r["doc_id"]: r for r in simhash.with_components(frame).collect()}
    assert parts[3]["fingerprint"] == "0" * 16 and parts[3]["component_id"] == parts[4]["component_id"] == parts[5]["component_id"] == 3
    assert parts[2]["component_id"] == 1
    one = simhash.keep_one(frame).collect()
    assert sorted(r["doc_id"] for r in one if r["doc_id"] in (1, 2, 3, 4, 5)) == [1, 3]


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string, formatted string"
    turns = [(1, 0, "user", None, "x"), (1, 0, "user", None, "x"), (1, None, None, "t", "x"), (None, 1, "assistant", "a" * 100_000, "x")]
    out = {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(turns, schema)).collect()}
    assert chat.read_back(out[1]["formatted"]) == [("", "t"), ("user", ""), ("user", "")] and len(out[None]["formatted"]) > 100_000
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0


def test_ids_beside_null_and_of_other_types(spark):
    turns = [(2**60 + 1, 0, "user", "a"), (None, 0, "user", "b"), (-(2**63), 1, "user", "c")]
    out = chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    assert {r["conv_id"]: chat.read_back(r["formatted"]) for r in out.repartition(1).collect()} == {i: [("user", t)] for i, _, _, t in turns}
    named = spark.createDataFrame([("x", 0, "user", "a"), ("x", 1, "assistant", "b")], "conv_id string, turn long, role string, text string")
    assert [(r["conv_id"], len(chat.read_back(r["formatted"]))) for r in chat.format_conversations(named).collect()] == [("x", 2)]


@pytest.mark.parametrize("kind, low, high", [("long", -(2**63), 5), ("string", "a", "b"), ("date", None, None)])
def test_exact_groups_of_any_ids(spark, kind, low, high):
    if kind == "date":
        low, high = (datetime.date(2024, 1, d) for d in (1, 2))
    frame = spark.createDataFrame([(high, "same  text"), (low, "same text"), (None, "sametext"), (low, "other"), (high, "sametext ")], f"doc_id {kind}, text string")
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.with_groups(frame).collect()}
    assert got == {(high, high, 4, True), (high, high, 4, False), (low, high, 4, False), (None, high, 4, False), (low, low, 1, True)}
    tie = spark.createDataFrame([(high, "ab"), (low, "ab"), (None, "ab")], f"doc_id {kind}, text string")
    assert {r["keep_id"] for r in exact_dedup.with_groups(tie).collect()} == {low}


def test_values_of_columns_with_dots_maps_and_taken_names(spark):
    text = " ".join(f"word{i}" for i in range(60))
    odd = spark.createDataFrame([(1, text, "a", {"k": 1, "m": None}, "mine", "own"), (2, None, None, None, None, None)], "`doc.id` long, `the.text` string, source string, `a.map` map<string,int>, quality_rules string, URL_filter string")
    own = [(1, text, "a", {"k": 1, "m": None}, "mine", "own"), (2, None, None, None, None, None)]
    values = lambda df: sorted(tuple(r)[:6] for r in df.collect())
    tokens = bpe.with_tokens(odd, queries.tokenizer_path(), text="the.text")
    assert values(tokens) == own and [len(r["token_ids"]) > 0 for r in tokens.orderBy("`doc.id`").collect()] == [True, False]
    judged = quality.with_quality(odd, text="the.text")
    assert values(judged) == own and [r["quality_rules_"]["n_words"] for r in judged.orderBy("`doc.id`").collect()] == [60, 0]
    urls = url_filter.with_verdict(odd.withColumn("url", F.lit("https://x.com/en/")))
    assert values(urls) == own and [r["url_filter_"]["rule"] for r in urls.collect()] == ["com/en/"] * 2
    mixed = mixing.mixed_documents(odd, id="doc.id", text="the.text").collect()
    assert mixed and all(tuple(r) in own for r in mixed)
    assert simhash.keep_one(odd, "doc.id", "the.text").columns == odd.columns


def test_many_languages(spark):
    """250 languages of their own letters: all are learned and told apart."""
    letters = "bcdfghjklmnpqrstvwxz"
    names = [f"{a}{b}{v}" for a in letters for b in letters for v in "aeiou"][:250]

    def said(name, n):
        rng = random.Random(f"{name}{n}")
        return " ".join("".join(rng.choice((name, name[::-1], name[1:] + name[0])) for _ in range(rng.randrange(1, 4))) for _ in range(30))

    rows = [(i * 20 + n, said(name, n), name if n < 14 else None) for i, name in enumerate(names) for n in range(16)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["language"]["lang"] for r in langid.with_language(docs, F.lit(True)).filter("lang is null").collect()}
    right = sum(found[i * 20 + n] == name for i, name in enumerate(names) for n in (14, 15))
    assert len(set(found.values())) >= 225 and right >= 0.9 * len(found)
