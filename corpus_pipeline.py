"""Training-data pipeline over the documents: each stage is written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from showbill.llm import bpe, decontaminate, fertility, line_spread, near_dedup
from showbill.llm.common import documents, stored
from showbill.llm.queries import quality_vocabulary, ranks

#: Least similarity, in percent, of two documents of which the stage keeps one.
NEAR_SIMILARITY = 85


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the bands of their language; the others go."""
    return fertility.drop_low_quality(docs, quality_vocabulary())


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without cross-site lines; one that held nothing else goes with them."""
    return line_spread.drop_emptied(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group."""
    return near_dedup.drop_near_duplicates(docs, similarity=NEAR_SIMILARITY)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of every document, with the length and digest of the text they decode to."""
    codec = {"ranks": ranks(), "pattern": public_tokenizers.PATTERN}
    tokens = bpe.decode(bpe.encode(docs, **codec), **codec)
    return tokens.select("doc_id", "n_tokens", "ids", F.octet_length("decoded").cast("long").alias("n_bytes"), F.sha2("decoded", 256).alias("text_sha256"))


STAGES = [
    ("quality rules", quality_rules), ("line dedup", line_dedup), ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination), ("byte-level BPE", byte_level_bpe),
]

#: Learned bands, signatures and tokens have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
