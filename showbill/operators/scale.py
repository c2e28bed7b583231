"""Building blocks that stay parallel when one key holds a large share of the rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def position_in_group(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """1-based position of every row in its group, ordered by a text column.

    Rows are dealt out in ranges of (keys, text), which Spark finds by sampling, so a group of
    any size and any spelling is numbered by many tasks; the counts of the ranges before
    are added. The ranges are checkpointed, since a repeated task must not cut them anew.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *keys, text).withColumn("_part", F.spark_partition_id()).checkpoint()
    sizes = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    w = Window.partitionBy(*keys, "_part").orderBy(text)
    return rows.withColumn("_rn", F.row_number().over(w)).join(offsets, [*keys, "_part"]).withColumn(
        "position", F.col("_rn") + F.col("_before")).drop("_part", "_rn", "_before")


def carry_forward(df: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Every null of ``columns`` takes the latest value above it under the same key.

    A key of any size is dealt to many tasks: rows lie in ranges of (key, order), each range
    is filled on its own, and the last values of the ranges before are added for the few keys
    that go on from one range to the next (at most one a range). Rows that tie in key and
    order lie in the same range, and which of them is above the other is open.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, key, order).withColumn("_part", F.spark_partition_id()), "ranges")
    ends = rows.groupBy("_part").agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    before = Window.orderBy("_part")  # one row a range
    going_on = ends.withColumn("_above", F.lag("_last").over(before)).where("_first = _above").select(F.col("_first").alias(key)).distinct()
    latest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in columns]
    tails = rows.join(F.broadcast(going_on), key).groupBy(key, "_part").agg(*latest)
    ranges_above = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # a key that goes on has at most one row for each of the n ranges
    held = tails.select(key, "_part", *[F.last(c, ignorenulls=True).over(ranges_above).alias(f"_held_{c}") for c in columns])
    inside = Window.partitionBy(key, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(inside) for c in columns}).join(F.broadcast(held), [key, "_part"], "left")
    return filled.withColumns({c: F.coalesce(c, f"_held_{c}") for c in columns}).select(*df.columns)


def parse_rows(df: DataFrame, source: str, parts: Column, parse) -> DataFrame:
    """One row per part of a text column, with the fields ``parse`` gives for it.

    The fields come out of a generator, so each is computed once however often the
    following filters and projections read it. (The outer form keeps the optimizer from
    evaluating the parts a second time to skip empty texts; callers filter the fields.)
    """
    return df.select(
        *[c for c in df.columns if c != source], F.inline_outer(F.transform(parts, lambda p: F.struct(*parse(p)))))


#: Letters of the needles that one task holds as an automaton.
SHARD_LETTERS = 4_000_000


def occurring(texts: Iterable[str], needles: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(text, needle) of every needle in every text, each once, by an automaton with failure links.

    A text is read once, one step a letter, whatever the number of needles.
    """
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for needle in needles:
        automaton.add_word(needle, needle)
    if not len(automaton):
        return
    automaton.make_automaton()
    for text in texts:
        for needle in {needle for _, needle in automaton.iter(text)}:
            yield text, needle


def containing(texts: DataFrame, needles: DataFrame, text: str = "text", needle: str = "needle") -> DataFrame:
    """All (text, needle) pairs where the needle occurs in the text.

    A containment test is no join key, and comparing all pairs grows with the square. The
    distinct needles are dealt to shards of a measured size and the distinct texts to
    blocks; every block meets every shard in a task of its own, which reads each text once
    through the shard's automaton. Only true pairs come out. Nulls and empty needles match nothing.
    """
    spark = texts.sparkSession
    sought = written(needles.select(F.col(needle).alias("needle")).where("needle <> ''").distinct(), "needles")
    shards = 1 + (sought.agg(F.sum(F.length("needle"))).first()[0] or 0) // SHARD_LETTERS
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def dealt(df: DataFrame, column: str, own: str, n: int, other: str, m: int) -> DataFrame:
        return df.select(column, F.pmod(F.xxhash64(column), F.lit(n)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))

    def found(left, right):
        import pandas as pd

        return pd.DataFrame(occurring(left["text"], right["needle"]), columns=["text", "needle"])

    every = texts.select(F.col(text).alias("text")).where("text <> ''").distinct()
    pairs = dealt(every, "text", "block", blocks, "shard", shards).groupBy("block", "shard").cogroup(
        dealt(sought, "needle", "shard", shards, "block", blocks).groupBy("block", "shard")).applyInPandas(found, "text string, needle string")
    return pairs.toDF(text, needle)


def _roots(batches):
    """(node, least node it is linked with) of the links of one task."""
    import pyarrow as pa

    parent: dict = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    schema = None
    for batch in batches:
        schema = batch.schema
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    if schema is not None:
        rows = [(x, root(x)) for x in list(parent)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema.field(i).type) for i in (0, 1)], schema=schema)


def connected(links: DataFrame) -> DataFrame:
    """(node, group) of the nodes of undirected (a, b) links; a group's name is its least node.

    Each round first contracts the links that lie in one task, which are those of a range of
    nodes, and then points every node at the least neighbour of its neighbours. Chains
    shrink by far more than half in a round. A link of a node with itself names it as a node.
    """
    n = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(links.dtypes)["a"]
    edges, before = links.select("a", "b"), None
    while True:
        near = edges.repartitionByRange(n, "b", "a").mapInArrow(_roots, f"a {kind}, b {kind}").distinct()
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")), "group-least")
        # the least neighbour of a node is joined with all its neighbours
        edges = written(both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "group-edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.groupBy("a").agg(F.min("b").alias("group")).withColumnRenamed("a", "node")
        before = now


#: With this setting Spark removes the shuffle files of a job at its end; else they lie on disk until the driver collects garbage.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a table that is written once, in the shared checkpoint folder; the job's shuffle files go."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    held = spark.conf.get(_CLEAN_UP, None)
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if held is None:
            spark.conf.unset(_CLEAN_UP)
        else:
            spark.conf.set(_CLEAN_UP, held)
    return spark.read.schema(df.schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the cluster's if it names one, else one of our own."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    existing = spark.sparkContext.getCheckpointDir()
    if existing:
        return existing
    if not configured:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        configured = tempfile.mkdtemp(prefix="showbill-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext.getCheckpointDir() or configured
