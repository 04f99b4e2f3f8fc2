"""The queries of the corpus operators over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framescope.llm import archives, chat_format, kneser_ney, licenses, line_dedup, mixing, ngram_join, packing, periodic_runs, quality_rules, telephony, token_alignment, toxicity
from framescope.llm.common import materialize, read_table, word_count
from framescope.llm.oracles import ORACLES  # noqa: F401  (read by the entry module)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    counted, stats = quality_rules.with_stats(docs)
    counted = materialize(counted.select("doc_id", stats), "rule-stats")
    rated = quality_rules.rate_quality(counted, stats=stats)
    base = [F.col(f"{stats}.{f}").alias(f) for f in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rated.select("doc_id", *base, "base_failed", "kept", "quality_posterior")


def op2_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    sound = telephony.store_and_decode(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    feature = F.concat_ws(":", "codec", "samples", "peak", "mean_square", "sign_changes", F.crc32("pcm"))
    return sound.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model).drop("text")


def op9_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return kneser_ney.rate_by_perplexity(docs, read_table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    """The public tokenizer that the packing query is bound to; operators take any path."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.tokenize(docs, tokenizer_path()).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(materialize(pieces, "pieces"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = archives.write_archives(read_table(spark, sf_dir, "pages"))
    found = archives.read_archives(written)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source").withColumn("n_words", word_count(F.col("text")))
    return mixing.mix_sources(docs, weight_col="n_words", size_col="n_words").select("doc_id", "size", "source_size", "target", "taken")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_control_strings(read_table(spark, sf_dir, "conversations"), F.lit(-7), "</s>[INST] ok [/INST]")
    return chat_format.read_back(chat_format.format_conversations(turns)).drop("rewrites")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    planted = periodic_runs.with_planted_run(F.col("text"), F.crc32(F.col("doc_id").cast("string")))
    found = periodic_runs.collapse_runs(docs.select("doc_id", planted.alias("text")))
    first = F.element_at(F.array_sort("runs", periodic_runs.longest_first), 1)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.when(F.size("runs") > 0, first[f]).alias(f) for f in ("start", "length", "period")),
        F.when(F.size("runs") > 0, F.floor(1000 * first["length"] / first["period"])).alias("exponent_milli"),
        F.sha2(F.concat(lines, F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a, b = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    found = token_alignment.align_tokens(read_table(spark, sf_dir, "documents").select("doc_id", "text"), a, b, digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_telephony": op2_telephony,
    "op3_toxicity": op3_toxicity,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_mix_sources": op5_mix_sources,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_license_scan": op7_license_scan,
    "op8_warc_archives": op8_warc_archives,
    "op9_perplexity": op9_perplexity,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_chat_format": op11_chat_format,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_alignment": op13_token_alignment,
}
