"""From raw documents to packed training sequences, in five stages.

1. quality: documents that the quality rules reject go.
2. near_duplicates: of each group of near copies the document with the smallest id stays. Rows that repeat it go too.
3. substring_dedup: repeated lines and runs of sentences are cut out of the texts; ``n_chars`` follows the text.
4. mixing: documents are repeated, kept once or dropped, until sources have their target weights.
5. packing: texts are tokenised and their pieces packed; the result says where each piece goes.

Each stage's result is written as Parquet to the folder that driver and executors share, and read again by the next.
All stages but the last return the columns of ``documents``. Documents without an id are told apart by their texts; a
group that only has such documents keeps them all. An empty table passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framescope.llm import line_dedup, mixing, ngram_join, packing, quality_rules
from framescope.llm.common import materialize, read_table, word_count
from framescope.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    counted, stats = quality_rules.with_stats(docs.select(*COLUMNS))
    return quality_rules.rate_quality(counted, stats=stats).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mark, key = "text_mark", "row_mark"
    # Two 64-bit hashes tell rows apart, of the text alone and with the id: keys without nulls, so that the join and the
    # window deal texts out once.
    marked = docs.select(*COLUMNS, F.xxhash64("text").alias(mark), F.xxhash64("doc_id", "text").alias(key))
    groups = ngram_join.near_duplicates(marked, keep=(mark, key))
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(mark, key).distinct()
    stay = marked.join(first, [mark, key], "left_semi")
    same = Window.partitionBy(mark, key).orderBy("source", "lang", "n_chars")
    return stay.withColumn("repeat", F.row_number().over(same)).where("repeat = 1").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("removed_chars") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    weighed = docs.select(*COLUMNS).withColumn("n_words", word_count(F.col("text")))
    mixed = mixing.mix_sources(weighed, weight_col="n_words", size_col="n_words", keep=COLUMNS).where("copies > 0")
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(docs.select("doc_id", "text"), tokenizer_path(), cache_words=400_000).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(materialize(pieces, "pieces"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("mixing", mix),
    ("packing", pack),
]
#: Expectation-maximisation and the tokenizer are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
