"""A log of model calls: a prompt that has an answer is never asked again.

The log is a folder of Parquet files under ``bucket=<n>``, one row per call: call_id (a digest
of model and prompt), content, and the number of tries. A task writes each answer as soon as
it has it, under a name of its own and then moved in place, so neither a lost executor nor a
killed job loses an answer that has been paid for: a repeated task reads what its bucket
holds before it asks.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from showbill.operators.scale import written

_LOG = "call_id string, content string, tries int, bucket int"


def call_id(model: str, prompt: Column) -> Column:
    """Address of a call by its contents."""
    return F.sha2(F.concat_ws("\n", F.lit(model), prompt), 256)


def _answered(fs, folder: str) -> set:
    """Calls of one bucket that have an answer."""
    import pyarrow.parquet as pq
    from pyarrow.fs import FileSelector

    done: set = set()
    for info in fs.get_file_info(FileSelector(folder, allow_not_found=True)):
        if info.base_name.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                done.update(pq.read_table(f, columns=["call_id"]).column(0).to_pylist())
    return done


def _keep(fs, folder: str, rows: dict) -> None:
    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pa.table({"call_id": pa.array(rows["call_id"], pa.string()), "content": pa.array(rows["content"], pa.string()), "tries": pa.array(rows["tries"], pa.int32())})
    name = uuid.uuid4().hex
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(f"{folder}/.{name}") as f:
        pq.write_table(table, f)
    fs.move(f"{folder}/.{name}", f"{folder}/{name}.parquet")


def _asker(fn, log: str, batch: int, tries: int, pause: float, budget: int):
    """The work of one task: ask what its buckets lack, write every answer, give (call_id, error) of the rest."""

    def answer(prompts: list) -> tuple[list | None, str | None, int]:
        for n in range(1, tries + 1):
            try:
                return fn(pd.Series(prompts)).tolist(), None, n
            except Exception as exc:  # the caller's function may raise anything
                error = f"{type(exc).__name__}: {exc}"
                if n < tries:
                    time.sleep(pause * 2 ** (n - 1))
        return None, error, tries

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(log)
        bucket, done, failed = None, set(), 0
        for frame in frames:
            lost: dict = {"call_id": [], "error": []}
            for number, rows in frame.groupby("bucket", sort=False):
                if number != bucket:
                    bucket, done = number, _answered(fs, f"{root}/bucket={number}")
                rows = rows[~rows["call_id"].isin(done)]
                for at in range(0, len(rows), batch):
                    part = rows.iloc[at:at + batch]
                    ids = part["call_id"].tolist()
                    if failed >= budget:
                        content, error = None, "not asked: too many failures"
                    else:
                        content, error, n = answer(part["prompt"].tolist())
                        failed += content is None
                    if content is None:
                        lost["call_id"] += ids
                        lost["error"] += [error] * len(ids)
                    else:
                        _keep(fs, f"{root}/bucket={bucket}", {"call_id": ids, "content": content, "tries": [n] * len(ids)})
            yield pd.DataFrame(lost, dtype=object)

    return ask


def read_calls(spark: SparkSession, log: str) -> DataFrame:
    """(call_id, content, tries, bucket) of every logged call, each once."""
    path = spark._jvm.org.apache.hadoop.fs.Path(log)
    if not path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path):
        return spark.createDataFrame([], _LOG)
    return spark.read.schema(_LOG).parquet(log).dropDuplicates(["call_id"])


def run_logged(requests: DataFrame, fn: Callable[[pd.Series], pd.Series], log: str, model: str, key: str = "event_key",
               buckets: int = 64, batch: int = 1, tries: int = 3, pause: float = 1.0, budget: int = 100) -> DataFrame:
    """(key, content, error, asked) of every (key, prompt) row; calls in the log are not made again.

    Equal prompts are one call. What has no answer yet is dealt by its digest to ``buckets``
    tasks, which is also the number of calls that run at the same time; ``batch`` prompts go
    into one call. A call that fails is tried ``tries`` times with pauses that double. After
    ``budget`` failed calls a task asks no more and marks the rest, so an outage ends soon. Errors are not
    logged: the next run asks again. If a task dies, the call under way is the only one whose
    answer can be lost; run it without speculative execution, since two attempts of one task know
    nothing of each other. A null prompt gives null content. The calls are made here, not when
    the result is read; ``asked`` tells whether this run answered the row.
    """
    spark = requests.sparkSession
    rows = requests.select(key, F.when(F.col("prompt").isNotNull(), call_id(model, F.col("prompt"))).alias("call_id"), "prompt")
    before = read_calls(spark, log).select("call_id", F.lit(True).alias("_before"))
    distinct = rows.where("call_id is not null").groupBy("call_id").agg(F.any_value("prompt").alias("prompt"))
    missing = distinct.join(before, "call_id", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("call_id"), F.lit(buckets)).cast("int"))
    # the calls known before are written down before any new one is made
    known = written(before, "calls-before")
    dealt = missing.repartition(buckets, "bucket").sortWithinPartitions("bucket", "call_id")
    lost = written(dealt.select("bucket", "call_id", "prompt").mapInPandas(
        _asker(fn, log, batch, tries, pause, budget), "call_id string, error string"), "calls-lost")
    answers = read_calls(spark, log).select("call_id", "content")
    out = rows.select(key, "call_id").join(answers, "call_id", "left").join(lost, "call_id", "left").join(known, "call_id", "left")
    asked = F.col("call_id").isNotNull() & F.col("_before").isNull() & F.col("error").isNull()
    return out.select(key, "content", "error", asked.alias("asked"))


def compact_calls(spark: SparkSession, log: str, to: str) -> None:
    """The log with one file per bucket, written to a new folder."""
    read_calls(spark, log).repartition("bucket").write.partitionBy("bucket").parquet(to)
