"""Published sets with a commit log: every version is a folder of data and one log entry.

Spark writes the data first, into a folder no one else writes to. The version exists from
the moment its log entry does, and an entry is created only if there is none of that number.
So of two writers that reach for the same number one gets it and the other one knows, and a
reader that holds a version reads the same rows for as long as the version is kept.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


class VersionTaken(RuntimeError):
    """Another writer has committed since the version this one was made from."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _create(spark: SparkSession, name: str, text: str) -> bool:
    """Creates a file with its whole text unless there is one of that name.

    The text is written under a name of its own and then moved without overwriting, which
    the name node decides; a local file system gets a hard link, which fails in the same way.
    """
    path, fs = _path(spark, name)
    fs.mkdirs(path.getParent())
    draft, _ = _path(spark, f"{path.getParent()}/.{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), path.toUri().getPath())
            except FileExistsError:
                return False
            return True
        return not fs.exists(path) and bool(fs.rename(draft, path))
    finally:
        fs.delete(draft, False)


def _entry(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/log/{version:020d}.json"


def log(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions that are kept, oldest first."""
    path, fs = _path(spark, f"{root.rstrip('/')}/log")
    if not fs.exists(path):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(path)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _details(spark: SparkSession, root: str, version: int) -> dict:
    row = spark.read.schema("snapshot string, folder string, schema string").json(_entry(root, version)).first()
    return row.asDict()


def folder(spark: SparkSession, root: str, version: int) -> str:
    """The folder with the data of a version."""
    return f"{root.rstrip('/')}/{_details(spark, root, version)['folder']}"


def commit(df: DataFrame, root: str, snapshot: str = "", base: int | None = None, partition_by: Sequence[str] = ()) -> int:
    """Writes the rows as the next version and returns its number.

    With ``base``, the version the rows were made from, the commit holds only if that is
    still the newest one (0: there is none yet), else ``VersionTaken`` is raised. Without it
    the rows replace whatever is there, and the writer takes the next free number. Data of a
    failed commit are removed.
    """
    spark = df.sparkSession
    data = f"data/{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(f"{root.rstrip('/')}/{data}")
    entry = json.dumps({"snapshot": snapshot, "folder": data, "schema": df.schema.json()})
    version = max(log(spark, root), default=0) if base is None else base
    while True:
        version += 1
        # A kept entry of a later number means that this number has been given, too.
        newest = max(log(spark, root), default=0)
        if newest < version and _create(spark, _entry(root, version), entry):
            return version
        if base is not None:
            path, fs = _path(spark, f"{root.rstrip('/')}/{data}")
            fs.delete(path, True)
            raise VersionTaken(f"version {base} is no longer the newest of {root}")
        version = max(version, newest)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest if none is named; the schema is the log's."""
    from pyspark.sql.types import StructType

    kept = log(spark, root)
    if not kept or (version is not None and version not in kept):
        raise ValueError(f"{root} has no version {'' if version is None else version}".rstrip())
    details = _details(spark, root, kept[-1] if version is None else version)
    schema = StructType.fromJson(json.loads(details["schema"]))
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{details['folder']}")


def retain(spark: SparkSession, root: str, keep: int) -> list[int]:
    """Removes all but the newest ``keep`` versions and returns the numbers of those removed.

    The log entry goes first, so that no reader finds a version without its data.
    """
    if keep < 1:
        raise ValueError("at least one version has to be kept")
    gone = log(spark, root)[:-keep]
    for version in gone:
        data = folder(spark, root, version)
        for name in (_entry(root, version), data):
            path, fs = _path(spark, name)
            fs.delete(path, True)
    return gone
