"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkclin.llm import bpe_codec, decontaminate, quality_cascade, quality_fm, secret_scan, shard_table, suffix_dedup, super_minhash, token_count, warc_archive
from sparkclin.llm.common import shared_dir, table

SHARDS = [f"shard-{i:03d}" for i in range(64)]


def tokenizer_file(name: str) -> str:
    """Place of a public vocabulary file: in the folder of TOKENIZER_DIR, else in the installed package."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def pre_token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it; documents without a leak have none."""
    return decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[secret_scan.count_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.written_spans(secret_scan.base_spans()), 256).alias("base_sha256"),
        secret_scan.written_spans(F.col("secrets")).alias("spans"),
    )


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), pre_token_pattern())


def op5_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    # source and document together: a hot source spreads over all shards
    placed = shard_table.place(docs, F.concat_ws("/", "source", F.col("doc_id").cast("string")), SHARDS)
    return placed.select("doc_id", "source", "slot", "shard")


def op6_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    warc_archive.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc_archive.read_pages(spark, folder, with_payload=False)


def op7_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_fm.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", quality_fm.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_cascade.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_super_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_minhash.group(table(spark, sf_dir, "documents"), size=2, percent=80)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_latent_leaks": op1_latent_leaks,
        "op2_secret_scan": op2_secret_scan,
        "op3_token_count": op3_token_count,
        "op4_bpe_round_trip": op4_bpe_round_trip,
        "op5_shard_table": op5_shard_table,
        "op6_warc_segments": op6_warc_segments,
        "op7_quality_fm": op7_quality_fm,
        "op8_quality_cascade": op8_quality_cascade,
        "op9_super_minhash": op9_super_minhash,
        "op10_suffix_dedup": op10_suffix_dedup,
    }


def _op5_sql() -> str:
    literal = ",".join(map(str, shard_table.fill_table(SHARDS)))
    return f"""
WITH t AS (SELECT string_split('{literal}', ',') AS shards),
d AS (SELECT doc_id, source, ('0x' || substr(md5(concat_ws('/', source, CAST(doc_id AS VARCHAR))), 1, 15))::BIGINT % {shard_table.TABLE_SIZE} AS slot FROM documents)
SELECT doc_id, source, slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM d, t
"""


_OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(5) AS r(k) GROUP BY doc_id),
m AS (SELECT w.doc_id, text, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(c.n, 0) AS n_repeat_words, words FROM w LEFT JOIN covered c USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT (base_failed OR 20 * n_symbols > word_chars OR (n_dup_lines > 3 AND 2 * n_dup_lines > len(string_split(text, chr(10))))
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words
            OR 2 * length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) > length(regexp_replace(text, '[^\p{L}]+', '', 'g'))
            OR 10 * len(list_filter(words, lambda x: regexp_matches(x, '(!!|\.\.\.|\?\?)$'))) > 3 * n_words) AS kept
FROM b
"""


_OP6_SQL = """
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
k AS (SELECT payload_digest, max(page_id) AS kept FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN kept <> page_id THEN kept END AS refers_to, TRUE AS complete
FROM p LEFT JOIN k USING (payload_digest)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_warc_segments": _OP6_SQL, "op5_shard_table": _op5_sql(), "op8_quality_cascade": _OP8_SQL}
