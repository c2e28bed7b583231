"""Shared storage and Arrow helpers of the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where rows are joined or ordered: a null id sorts first.
NULL_ID = -(2**63)
#: Text bytes that the vectorised kernels take at a time; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's, or in a local session one of our own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="showbill-")
    sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table written once in the shared folder.

    It cuts the lineage and survives the loss of executors. The folder belongs to the
    session's shared folder and goes with it.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def placed(docs: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """The rows with columns named _0, _1, ... by place, which no other name meets, and where ``names`` are among them."""
    def place(name):
        if name in docs.columns:
            return docs.columns.index(name)
        return [c.lower() for c in docs.columns].index(name)

    return docs.toDF(*[f"_{i}" for i in range(len(docs.columns))]), [f"_{place(n)}" for n in names]


def id_or_least(name: str = "doc_id"):
    """The id as a long that is never null."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_or_null(column):
    return F.nullif(column, F.lit(NULL_ID))


def raw_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return pc.fill_null(column, "").cast(pa.binary()).to_pylist()


def text_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK_BYTES):
    """Arrow batches cut into (rows, their texts as bytes) of about ``size`` text bytes.

    Texts leave Arrow block by block, and Arrow gives back what a batch took when it is done.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
        first, held = 0, 0
        for i, length in enumerate(lengths):
            if held and held + length > size:
                yield batch.slice(first, i - first), raw_texts(texts.slice(first, i - first))
                first, held = i, 0
            held += length
        if first < len(lengths):
            yield batch.slice(first), raw_texts(texts.slice(first))
        del batch, texts
        pa.default_memory_pool().release_unused()


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
