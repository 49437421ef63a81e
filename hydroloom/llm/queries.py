"""The registered queries of the text operators and of the pipeline, with SQL where SQL can say the same."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from . import alignment, bpe, chat, exact_dedup, langid, line_dedup, mixing, packing, quality, search, simhash, toxicity, url_filter
from .common import table

#: The tokenizer file of the BPE query; its folder's path is a setting.
TOKENIZER = os.environ.get("TOKENIZER_JSON", "")


def tokenizer_path() -> str:
    return TOKENIZER or vocabulary_file("word_bpe_49k.json")


def vocabulary_file(name: str) -> str:
    """A public tokenizer's file, in the folder of the setting TOKENIZER_FOLDER or the package's own."""
    if folder := os.environ.get("TOKENIZER_FOLDER", ""):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark, sf_dir):
    judged = url_filter.with_verdict(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", *[F.col("url_filter")[c].alias(c) for c in ("host", "path", "rule", "verdict", "score")])


def op2_quality_rules(spark, sf_dir):
    judged = quality.with_quality(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *[F.col("quality_rules")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words", "repeat_too_long")])


def op3_line_dedup(spark, sf_dir):
    return line_dedup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=True)


def op4_bpe(spark, sf_dir):
    tokens = bpe.with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path(), carry=False)
    decimal = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return tokens.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_simhash(spark, sf_dir):
    return simhash.with_components(table(spark, sf_dir, "documents"))


def op6_mixing(spark, sf_dir):
    return mixing.mix_shares(table(spark, sf_dir, "documents"))


def op7_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 3
    found = langid.with_language(docs, learn=remainder != 1)
    return found.select("doc_id", F.coalesce(remainder == 1, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


#: A conversation whose texts look like the format itself.
TRICKY = [(-7, turn, role, r"\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


def op8_chat(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(turns.unionByName(tricky))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                back = chat.read_back(text)
                loss = "".join(chat.unescape(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(back), sha("".join(f"{role}\n{said}\n" for role, said in back)), len(loss), sha(loss), len(text)))
            made = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)] if rows else []
            if made:
                yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.with_groups(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn)
    scored = toxicity.with_toxicity(docs, model, "score")
    return scored.select("doc_id", F.coalesce(~learn, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: The token that ends a document in a packed sequence.
END_OF_TEXT = 2


def op11_packing(spark, sf_dir):
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), END_OF_TEXT)
    short = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(short)


def op12_alignment(spark, sf_dir):
    tokens = alignment.aligned(table(spark, sf_dir, "documents"), vocabulary_file("byte_bpe_50k.json"), vocabulary_file("piece_bpe_32k.model"), digest=True)
    return alignment.with_counts(tokens.withColumnRenamed("groups", "groups_sha256"))


def op13_search(spark, sf_dir):
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {q.__name__: q for q in (op1_url_filters, op2_quality_rules, op3_line_dedup, op4_bpe, op5_simhash, op6_mixing, op7_language, op8_chat, op9_exact_dedup, op10_toxicity, op11_packing, op12_alignment, op13_search)}

#: DuckDB SQL of the queries; learned scores, XXH64 fingerprints and BPE have none.
ORACLES = {
    "op2_quality_rules": r"""
        WITH split AS (
            SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), places AS (
            SELECT doc_id, words, len(words) AS n, unnest(generate_series(1, len(words))) AS pos FROM split
        ), windows AS (
            SELECT doc_id, n, pos,
                   pos + 2 <= n AND count(*) OVER (PARTITION BY doc_id, hash(words[pos:pos + 2])) > 1 AS twice3,
                   pos + 7 <= n AND count(*) OVER (PARTITION BY doc_id, hash(words[pos:pos + 7])) > 1 AS twice8,
                   pos + 150 <= n AND count(*) OVER (PARTITION BY doc_id, hash(words[pos:pos + 150])) > 1 AS twice151
            FROM places
        ), marked AS (
            SELECT doc_id, bool_or(twice3) OVER (PARTITION BY doc_id ORDER BY pos ROWS 2 PRECEDING) AS in3,
                   bool_or(twice8) OVER (PARTITION BY doc_id ORDER BY pos ROWS 7 PRECEDING) AS in8, twice151 FROM windows
        ), sums AS (
            SELECT doc_id, count(*) FILTER (WHERE in3) AS n_repeat_words, count(*) FILTER (WHERE in8) AS covered_words, bool_or(twice151) AS long FROM marked GROUP BY doc_id
        ), lines AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
        ), base AS (
            SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(covered_words, 0) AS covered_words, coalesce(long, false) AS long
            FROM split LEFT JOIN sums USING (doc_id) LEFT JOIN lines USING (doc_id)
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered_words <= 0.3 * n_words AND NOT long AS kept,
               covered_words, long AS repeat_too_long
        FROM base""",
    "op3_line_dedup": r"""
        WITH split AS (
            SELECT doc_id, source, text, pos, string_split(text, chr(10))[pos] AS line
            FROM (SELECT doc_id, source, text, unnest(generate_series(1, len(string_split(text, chr(10))))) AS pos FROM documents)
        ), trimmed AS (
            SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM split
        ), totals AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY source),
        bad AS (
            SELECT source, bare FROM (SELECT DISTINCT doc_id, source, bare FROM trimmed WHERE bare <> '') JOIN totals USING (source)
            GROUP BY source, bare, host_pages HAVING count(*) >= 5 AND count(*) > 0.08 * host_pages
        )
        SELECT t.doc_id, t.source, coalesce(string_agg(t.line, chr(10) ORDER BY t.pos) FILTER (WHERE b.bare IS NULL), '') AS text,
               count(*) AS n_lines, count(b.bare) AS n_dropped
        FROM trimmed t LEFT JOIN bad b ON t.source = b.source AND t.bare = b.bare
        GROUP BY t.doc_id, t.source""",
    "op6_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   md5(doc_id || ':' || coalesce(source, '') || ':' || coalesce(text, '')) AS alike FROM documents
        ), sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
            FROM sized GROUP BY source
        ), levels AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (need ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                   / sum(weight) OVER (need ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM sources WINDOW need AS (ORDER BY 2 * source_size / weight::DOUBLE, source NULLS LAST)
        ), cut AS (
            SELECT arg_min(level, row(2 * source_size / weight::DOUBLE, source IS NULL, coalesce(source, ''))) AS level FROM levels WHERE 2 * source_size >= weight * level
        ), targets AS (
            SELECT l.source, source_size, CASE WHEN 2 * source_size < weight * l.level THEN (2 * source_size)::DOUBLE ELSE weight * c.level END AS target
            FROM levels l, cut c
        ), queues AS (
            SELECT doc_id, s.source, size, source_size, target, copy, md5('42:' || copy || ':0:' || alike) AS mix_key,
                   sum(size) OVER (PARTITION BY s.source ORDER BY copy, md5('42:' || copy || ':0:' || alike), doc_id ROWS UNBOUNDED PRECEDING) / target AS finish
            FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source, (VALUES (0), (1)) AS c(copy)
        ), total AS (
            SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, copy, mix_key, doc_id ROWS UNBOUNDED PRECEDING) AS until FROM queues
        )
        SELECT doc_id, size, source_size, any_value(target) AS target,
               coalesce(sum(size) FILTER (WHERE until <= (SELECT sum(target) FROM targets)), 0)::BIGINT AS taken
        FROM total GROUP BY doc_id, size, source_size""",
    "op8_chat": r"""
        WITH every AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               sum(14 + length(role) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')))::BIGINT AS formatted_chars
        FROM every GROUP BY conv_id""",
    "op9_exact_dedup": r"""
        WITH norm AS (
            SELECT doc_id, length(coalesce(text, '')) AS size, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare
            FROM documents
        ), ranked AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY bare ORDER BY size DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM norm
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked""",
    "op13_search": r"""
        WITH docs AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
        ), items AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
        ), totals AS (
            SELECT count(*) FILTER (WHERE len(terms) > 0) AS documents, coalesce(sum(len(terms)), 0)::BIGINT AS held FROM docs
        ), each AS (
            SELECT doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM docs
        ), tfs AS (
            SELECT doc_id, n, term, count(*) AS tf FROM each WHERE term IN (SELECT term FROM items) GROUP BY doc_id, n, term
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * any_value(documents) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tfs, totals GROUP BY term
        ), gains AS (
            SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * documents) // held))) AS gain FROM tfs JOIN weights USING (term), totals
        ), scores AS (
            SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM items JOIN gains USING (term) GROUP BY item_id, doc_id
        ), ranked AS (
            SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scores WHERE score > 0
        )
        SELECT * FROM ranked WHERE rank <= 50""",
}
