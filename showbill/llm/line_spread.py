"""Cross-site boilerplate lines by HyperLogLog sketches, with exact counts near the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showbill.llm.common import id_or_least, placed, stored

#: Sites on which a line must stand to count as boilerplate.
MIN_SITES = 10
#: Relative error of the sketches (128 registers); estimates within six errors of the
#: threshold are counted exactly.
ERROR = 0.1


def _lines(text: str = "text"):
    return F.split(F.coalesce(F.col(text).cast("string"), F.lit("")), "\n")


def _positions(docs: DataFrame, *kept: str) -> DataFrame:
    """Every nonblank line, trimmed, with its position."""
    rows = docs.select(*kept, F.posexplode(_lines()).alias("pos", "line"))
    return rows.withColumn("line", F.trim("line")).where("line != ''")


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, error: float = ERROR) -> DataFrame:
    """Lines that stand on at least ``min_sites`` distinct sources, as rows (doc_id, text_hash, pos, line, first).

    ``first`` is the place (doc_id, text_hash, pos) at which the line stands first.
    """
    keyed = docs.select(
        id_or_least().alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text", F.col("source").cast("string").alias("source"))
    spread = _positions(keyed, "source").groupBy(F.xxhash64("line").alias("line_hash")).agg(
        F.approx_count_distinct("source", error).alias("sites"))
    # few lines are on several sites; once these are written Spark knows their size and, where
    # it allows, looks them up without a shuffle of all lines
    wide = stored(spread.where(F.col("sites") >= F.lit(min_sites * (1 - 6 * error))), "spread-wide")
    rows = stored(_positions(keyed, "doc_id", "text_hash", "source").withColumn("line_hash", F.xxhash64("line")).join(
        wide, "line_hash").drop("line_hash"), "spread-lines")
    near = F.col("sites") <= F.lit(min_sites * (1 + 6 * error))
    # the exact count is taken of near lines alone: for the others the site is left out
    sites = rows.groupBy("line", "sites", F.when(near, F.col("source")).alias("site")).agg(
        F.min(F.struct("doc_id", "text_hash", "pos")).alias("first"))
    lines = sites.groupBy("line", "sites").agg(F.count("site").alias("exact"), F.min("first").alias("first"))
    lines = lines.where(F.when(near, F.col("exact") >= min_sites).otherwise(True))
    return rows.select("doc_id", "text_hash", "pos", "line").join(lines.select("line", "first"), "line")


def drop_boilerplate(
        docs: DataFrame, min_sites: int = MIN_SITES, error: float = ERROR, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All rows and columns of ``docs`` with boilerplate lines cut from ``text``, plus n_lines and n_removed.

    Lines are the parts between line feeds; they are compared without the blanks around
    them, and blank lines always stay. A line on at least ``min_sites`` distinct sources
    (a null source is no site) stays where it stands first (smallest doc_id, position) and
    goes everywhere else. A null text has one blank line and stays null; a null doc_id
    counts as the smallest. Equal rows that repeat a doc_id stand at the same place and
    fare alike. An empty table gives no rows. ``counts`` names the two numbers, which replace
    columns of these names; columns of any other name are kept.
    """
    found = boilerplate(docs, min_sites, error)
    cuts = found.where(F.struct("doc_id", "text_hash", "pos") != F.col("first")).groupBy(
        F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash")).agg(F.array_sort(F.collect_set("pos")).alias("_cut"))
    kept = docs.drop(*counts)
    rows, (doc_id, text) = placed(kept, "doc_id", "text")
    rows = rows.withColumns({"_own": id_or_least(doc_id), "_own_hash": F.xxhash64(text)}).join(
        cuts, (F.col("_own") == F.col("_doc")) & (F.col("_own_hash") == F.col("_hash")), "left")
    lines, cut = F.col("_lines"), F.col("_cut")
    bounds = F.concat(F.array(F.lit(-1)), cut, F.array(F.size(lines)))
    # whole stretches between cuts, so that the work is linear in the lines
    stretches = F.transform(F.sequence(F.lit(0), F.size(cut)), lambda i: F.slice(
        lines, F.element_at("_bounds", i + 1) + 2, F.element_at("_bounds", i + 2) - F.element_at("_bounds", i + 1) - 1))
    rows = rows.withColumn("_lines", _lines(text)).withColumn("_bounds", bounds)
    new = F.when(F.col("_cut").isNull(), F.col(text)).otherwise(F.array_join(F.flatten(stretches), "\n"))
    return rows.select(
        *[(new if f"_{i}" == text else F.col(f"_{i}")).alias(c) for i, c in enumerate(kept.columns)],
        F.size("_lines").cast("long").alias(counts[0]), F.coalesce(F.size("_cut"), F.lit(0)).cast("long").alias(counts[1]))


def drop_emptied(docs: DataFrame, min_sites: int = MIN_SITES, error: float = ERROR) -> DataFrame:
    """The rows and columns of ``docs`` without boilerplate lines; a row that held no other line goes.

    Rows that were null, empty or blank before stay. Columns of any name are kept.
    """
    fresh = max(map(len, docs.columns)) * "_" + "_"
    out = drop_boilerplate(docs, min_sites, error, (f"{fresh}lines", f"{fresh}removed"))
    rows, (text, removed) = placed(out, "text", f"{fresh}removed")
    emptied = (F.col(removed) > 0) & (F.trim(F.regexp_replace(text, "\n", "")) == "")
    return rows.where(F.coalesce(~emptied, F.lit(True))).toDF(*out.columns).select(*[f"`{c}`" for c in docs.columns])
