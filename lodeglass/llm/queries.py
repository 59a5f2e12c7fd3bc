"""The registered queries of this subpackage: one per operator, applied to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.llm import (
    alignment,
    credentials,
    decontaminate,
    html_region,
    language,
    line_dedup,
    order_minhash,
    prefix_bpe,
    quality,
    sharding,
    token_store,
    variants,
    warc,
)
from lodeglass.session import materialise

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SHARDS = 16
RANKS = "byte_bpe_multi_50k.tiktoken"
TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_html_region")
def op1_html_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, with weights from labelled layouts and from pages with one article element."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    weights = html_region.learn(spark, html_region.labelled_by_article(pages))
    texts = html_region.extract_pages(pages, weights)
    return texts.withColumn("n_chars", F.length("text").cast("long"))


@query("op2_prefix_bpe")
def op2_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    return prefix_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query("op3_benchmark_leaks")
def op3_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item found in it."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_token_files")
def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, written to files and read back from them."""
    manifest = token_store.write_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), token_store.new_folder(spark)
    )
    return token_store.read_tokens(spark, manifest).withColumnRenamed("key", "doc_id")


@query("op5_rank_order_language")
def op5_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from the four fifths that are not held out."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = language.held_out(F.col("doc_id"))
    profiles = language.learn(documents.where(~apart))
    found = language.predict(documents.select("doc_id", "text", apart.alias("held_out")), profiles, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")


@query("op6_order_minhash")
def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    return order_minhash.classes(table(spark, sf_dir, "documents"))


@query("op7_fuzzy_lines")
def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that occur, equal or nearly so, earlier in the corpus."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(documents)


QUALITY_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(l)::BIGINT AS n_lines, len(regexp_extract_all(t, '\p{Lu}'))::BIGINT AS n_upper
  FROM d LEFT JOIN covered USING (r)),
f AS (
  SELECT *, (n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (100 * n_symbols > 30 * n_words)::INT
         + 8 * (100 * n_dup_lines > 50 * n_lines)::INT + 16 * (100 * n_upper > 50 * word_chars)::INT
         + 32 * (word_chars < 2 * n_words)::INT + 64 * (word_chars > 25 * n_words)::INT AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed,
       failed & 31 = 0 AS kept, n_lines, n_upper, failed::BIGINT AS failed
FROM f"""


@query("op8_quality_rules", QUALITY_SQL)
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of every document with the verdicts of the base rules and of the first policy."""
    rows = quality.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"),
        quality.passes(quality.V1).alias("kept"),
        "n_lines",
        "n_upper",
        "failed",
    )


@query("op9_byte_shards")
def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sixteen contiguous shards of near equal bytes."""
    placed = sharding.byte_shards(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "before",
    )


def _listed(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in credentials.KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


@query("op10_credential_links")
def op10_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong findings of every document and the weak parts linked to them."""
    found = credentials.scan(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        k = credentials.KINDS.index(kind)
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] < len(credentials.STRONG))
    return found.select(
        "doc_id",
        *[count(k) for k in credentials.STRONG],
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
    )


@query("op11_segment_reassembly")
def op11_segment_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back: its payload, and the record that holds it."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), warc.new_folder(spark))
    rows = warc.resolve(warc.read_payloads(spark, manifest))
    return rows.select(
        F.col("key").alias("page_id"),
        "payload_bytes",
        F.col("sha1").alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
        "n_segments",
        "problem",
    )


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus with the frequent word one edit away that it stands for."""
    runs = variants.words(table(spark, sf_dir, "documents"), one_in=97)
    return variants.variants(materialise(variants.vocabulary(runs), "words"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two tokenizers line up in every document, and how usual its links are in the corpus."""
    return alignment.align(
        table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES)
    )


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules, line dedup, near-dedup, decontamination and encoding, one after the other. Its script lies beside the
    driver's entry, not in this package, and is imported when it runs."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
