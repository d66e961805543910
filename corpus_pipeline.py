"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again by the next.

Defined cases are those of the operators: null and empty texts fail the quality rules; rows that repeat an id stay apart until near-dedup, which
keeps or drops all rows of an id; extra columns pass through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bytewright.llm import line_dedup, minhash, mixing, packing, quality
from bytewright.llm.common import WORD, discard, shared_folder, table
from bytewright.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_runs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines go, and documents of which no word is left with them; ``n_chars`` follows the text."""
    out = line_dedup.dedup_lines(docs)
    removed = out.columns[-1]
    out = out.filter((F.col(removed) == 0) | F.col("text").rlike(WORD)).drop(removed)
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the mix takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_runs),
    ("MinHash near-dedup", near_copies),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", packed),
]
#: Random rounding and tokenization have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage keeps is written to the shared checkpoint folder, and removed once the next stage is written;
    the last stage reads its input when its rows are asked for, so that one stays."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            discard(spark, f"{folder}/{n - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
