"""From raw documents to packed training sequences: five stages, each an operator of ``quillstone.llm``.

Every stage reads what its predecessor wrote; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import jaccard, lines, mixing, packing, perplexity
from quillstone.llm.common import written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Share of a source's documents beyond which a line is boilerplate, and the documents a source needs to be judged.
LINE_RATIO, LINE_PAGES = 0.1, 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules with n-gram perplexity: documents that they reject go.

    Null and empty texts go; null languages are a language; repeated rows go or stay alike; null ids and sources pass through;
    no documents, no rows; further columns are dropped."""
    return perplexity.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are boilerplate of their source go; no document does. n_chars follows the text. Documents without a source
    are one source.

    Null and empty texts stay as they are; repeated rows count once in their source; a text of which all lines go is left
    with its blank lines or empty; no documents, no rows; further columns are dropped."""
    site = F.coalesce(F.concat(F.lit("/"), F.col("source")), F.lit(""))
    out = lines.drop_site_lines(docs.select(*COLUMNS), site, F.col("text"), max_ratio=LINE_RATIO, min_pages=LINE_PAGES, distinct_texts=True)
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that five-word shingle sets of similarity 0.8 or more link, directly or not, the smallest doc_id stays.

    Texts without words and rows without doc_id stay; of repeated rows one stays; rows of one doc_id with other texts are
    documents each; no documents, no rows; further columns are dropped."""
    return jaccard.keep_first(docs.select(*COLUMNS), words=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights: a document stays as often as its copies say, if at all.

    A null source is a source; texts without words stay as often as their source is due whole copies; rows that repeat doc_id
    and text share a draw; no documents, no rows; further columns are dropped."""
    out = mixing.mix_sources(docs.select(*COLUMNS))
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become pieces of full sequences, neighbours by content together.

    Null and empty texts hold their end id; null ids and repeated rows are packed like others; no documents, no rows; columns
    other than doc_id and text are dropped."""
    return packing.pack_curve(docs, tokenizer_path=public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("mixing", mix), ("packing", pack)]

#: No SQL: perplexities, hash draws and token ids are beyond it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
