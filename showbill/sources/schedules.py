"""Schedule documents, prospect lists, digest archives and page manifests."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from showbill.functions.clock import to_24h
from showbill.functions.dates import full_month_number, let, match, month_number, week_start
from showbill.functions.facts import is_caps_title, is_live_title
from showbill.functions.text import squeeze, unescape
from showbill.operators.scale import carry_forward, parse_rows
from showbill.values import MONTHS_LONG, WEEKDAYS_LONG


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text files as documents: file name and whole text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc"), F.col("value").alias("text"))


def split_lines(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    return docs.select(doc, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))


# Headings and entries are lines: blanks within them are never line ends.
_MONTH_HEAD = r"^##[ \t]+([A-Za-z]+)[ \t]+(\d{4})[ \t]*$"
_DAY_HEAD = r"^###[ \t]+(?:" + "|".join(WEEKDAYS_LONG) + r"),?[ \t]+([A-Za-z]+)[ \t]+(\d{1,2})[ \t]*$"
_ENTRY = r"^-[ \t]*\*\*(.+?)\*\*[ \t]*[—–-][ \t]*(.+?)[ \t]*$"


def _said(lines: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Headings and film entries among the lines; other lines carry nothing and need not move.

    ``set_month`` is there (with a null inside for an unknown name) where a line changes the
    month. The fields come out of a generator, so each line is read once.
    """
    line = F.col("line")

    def said(year=None, set_month=None, day=None, title=None, times=None) -> Column:
        fields = (("year", year, "string"), ("set_month", set_month, "struct<month:int>"), ("day", day, "string"), ("title", title, "string"), ("times", times, "string"))
        return F.struct(*[(F.lit(None) if c is None else c).cast(kind).alias(name) for name, c, kind in fields])

    def group(pattern: str, i: int) -> Column:  # only asked for where the pattern holds; no group of these can be empty
        return F.regexp_extract(line, pattern, i)

    def month(pattern: str) -> Column:
        return F.struct(full_month_number(group(pattern, 1)).cast("int").alias("month"))

    read = F.when(
        line.rlike(_DAY_HEAD), said(set_month=F.when(month(_DAY_HEAD)["month"].isNotNull(), month(_DAY_HEAD)), day=group(_DAY_HEAD, 2))
    ).when(
        line.rlike(_MONTH_HEAD), said(year=group(_MONTH_HEAD, 2), set_month=month(_MONTH_HEAD))
    ).when(line.rlike(_ENTRY), said(title=squeeze(group(_ENTRY, 1)), times=group(_ENTRY, 2)))
    rows = lines.where(F.startswith(line, F.lit("##")) | F.startswith(line, F.lit("-"))).select(*keep, F.inline_outer(F.array(read)))
    heading = F.col("year").isNotNull() | F.col("day").isNotNull()
    return rows.where(heading | (F.col("title").isNotNull() & is_caps_title(F.col("title"))))


_CARRIED = ("year", "set_month", "day")


def _showings(rows: DataFrame, doc: str) -> DataFrame:
    """One row per readable time of the entries, which hold the headings above them."""
    date = F.concat(
        F.lpad("year", 4, "0"), F.lit("-"), F.lpad(F.col("set_month.month").cast("string"), 2, "0"), F.lit("-"), F.lpad("day", 2, "0"))
    dated = rows.where(F.col("title").isNotNull()).select(doc, "title", date.alias("date"), "times").where(F.col("date").isNotNull())
    read = parse_rows(dated, "times", F.split("times", ","), lambda chunk: [F.trim(chunk).alias("time_12"), to_24h(chunk).alias("time_24")])
    return read.where(F.col("time_24").isNotNull())


#: Ends of lines and blanks as Java's patterns know them.
_LINE_END = re.compile("\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]")
_NO_END = re.compile("[\x1c-\x1e]")
_BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")
_TIME = re.compile(r"[ \t\n\x0b\f\r]*([0-9]{1,2}):([0-9]{2})[ \t\n\x0b\f\r]*([AaPp])[Mm][ \t\n\x0b\f\r]*")
_IN_MONTH, _IN_DAY, _FILM = (re.compile(p.replace(r"\d", "[0-9]")) for p in (_MONTH_HEAD, _DAY_HEAD, _ENTRY))
_MONTH_NO = {m.lower(): i for i, m in enumerate(MONTHS_LONG, 1)}


def _all_caps(title: str) -> bool:
    """``is_caps_title`` of a text."""
    if title.isascii():
        return title == title.upper()
    return all(unicodedata.category(c) in ("Lu",) or not unicodedata.category(c).startswith("L") for c in title)


def _doc_showings(text: str) -> Iterator[tuple[str, str, str, str]]:
    """(title, date, 12-hour time, 24-hour time) of one document, line by line with the headings that hold."""
    year = month = day = None
    # splitlines has three ends of lines more, which are rare
    for line in _LINE_END.split(text) if _NO_END.search(text) else text.splitlines():
        if line.startswith("###"):
            if found := _IN_DAY.match(line):
                month, day = _MONTH_NO.get(found[1].lower(), month), found[2].rjust(2, "0")
        elif line.startswith("##"):
            if found := _IN_MONTH.match(line):
                year, month = found[2], _MONTH_NO.get(found[1].lower())
        elif line.startswith("-") and year and month and day and (found := _FILM.match(line)):
            title = _BLANKS.sub(" ", found[1]).strip(" ")
            if not _all_caps(title):
                continue
            for chunk in found[2].split(","):
                if clock := _TIME.fullmatch(chunk):
                    hour, late = int(clock[1]), clock[3] in "Pp"
                    hour = hour + 12 if late and hour != 12 else 0 if not late and hour == 12 else hour
                    yield title, f"{year}-{month:02d}-{day}", chunk.strip(" "), f"{str(hour)[:2].rjust(2, '0')}:{clock[2]}"


def _read_docs(batches, doc: str):
    """The showings of every document of a task."""
    import pyarrow as pa

    for batch in batches:
        at, rows = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            found = list(_doc_showings(text)) if text is not None else []
            at += [i] * len(found)
            rows += found
        fields = [pa.array(column, pa.string()) for column in (zip(*rows) if rows else [()] * 4)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *fields], [doc, "title", "date", "time_12", "time_24"])


def schedule_doc(docs: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """Showings of a schedule with month and day headings; only titles in capitals are films.

    A document is read inside its row, line by line with the headings that hold, so the
    work is linear in the text and nothing moves. Each row of ``docs`` is a document of its
    own, even if ``doc`` repeats. Unreadable times are dropped. Documents too long for a row
    come as lines: see ``schedule_lines``.
    """
    kind = docs.schema[doc].dataType.simpleString()
    shape = f"`{doc}` {kind}, title string, date string, time_12 string, time_24 string"
    return docs.select(doc, text).mapInArrow(lambda batches: _read_docs(batches, doc), shape)


def schedule_lines(lines: DataFrame, doc: str = "doc") -> DataFrame:
    """``schedule_doc`` of a line table (doc, pos, line), for documents of any length.

    A document may span many tasks: see ``carry_forward``. Rows without document or
    position are left out.
    """
    rows = _said(lines.where(F.col(doc).isNotNull() & F.col("pos").isNotNull()), [doc, "pos"])
    return _showings(carry_forward(rows, doc, "pos", _CARRIED), doc)


_ROW = r"^([A-Za-z]{3,4})\s+(\d{1,2})\s*\t(.+?)\s*$"


def schedule_table(lines: DataFrame, doc: str = "doc", default_year: int = 2026,
                   time_12: str = "7:30 PM", time_24: str = "19:30") -> DataFrame:
    """Rows of a tabbed schedule; the year is in the file name, live events are marked."""
    rows = parse_rows(lines.where(F.col("line").rlike(_ROW)), "line", F.array("line"), lambda line: [
        match(line, _ROW, 1).alias("month_name"), match(line, _ROW, 2).alias("day"), F.trim(match(line, _ROW, 3)).alias("raw")])
    year = F.coalesce(match(F.col(doc), r"(\d{4})", 1).cast("int"), F.lit(default_year))
    month = month_number("month_name")
    written = F.concat(
        F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad("day", 2, "0"))
    return rows.select(
        doc, "pos", F.trim(F.regexp_replace("raw", r"(?i)\s+\(live event\)\s*$", "")).alias("title"), written.alias("date"),
        F.lit(time_12).alias("time_12"), F.lit(time_24).alias("time_24"), is_live_title(F.col("raw")).alias("live"),
    ).where(month.isNotNull())


_BULLET = r"^\s*-\s*\[[ xX]\]\s*(.+?)\s*\(([a-zA-Z_][\w/\- ]*)\)\s*(?:[—–-]+\s*(.+))?$"
_URL = r"(https?://\S+)"


def _no_refs(col: Column) -> Column:
    return squeeze(F.regexp_replace(F.coalesce(col, F.lit("")), r"\[\d+\]", ""))


def between_markers(lines: DataFrame, doc: str, begin: str, end: str) -> DataFrame:
    """Lines between the first ``begin`` and the first ``end`` line of each document."""
    spans = lines.where(F.col("line").contains(begin) | F.col("line").contains(end)).groupBy(doc).agg(
        F.min(F.when(F.col("line").contains(begin), F.col("pos"))).alias("_from"),
        F.min(F.when(F.col("line").contains(end), F.col("pos"))).alias("_to"))
    return lines.join(spans, doc).where((F.col("pos") > F.col("_from")) & (F.col("pos") < F.col("_to"))).drop("_from", "_to")


def prospect_bullets(lines: DataFrame, doc: str = "doc", markers: tuple[str, str] | None = None) -> DataFrame:
    """"- [ ] Name (category) — text — url" lines; the last link counts.

    The lines of a document may come from many rows. Documents that are rows: see ``prospect_docs``.
    """
    rows = lines
    if markers is not None:  # only bullets and marker lines meet
        rows = between_markers(lines.where(F.col("line").rlike(_BULLET) | F.col("line").contains(markers[0]) | F.col("line").contains(markers[1])), doc, *markers)
    rows = parse_rows(rows.where(F.col("line").rlike(_BULLET)), "line", F.array("line"), lambda line: [
        _no_refs(match(line, _BULLET, 1)).alias("name"),
        F.replace(F.lower(F.trim(match(line, _BULLET, 2))), F.lit(" "), F.lit("_")).alias("category"),
        let(F.coalesce(match(line, _BULLET, 3), F.lit("")), lambda rest: F.struct(
            rest.alias("text"), F.rtrim(F.element_at(F.concat(
                F.array(F.lit("")), F.regexp_extract_all(rest, F.lit(_URL), F.lit(1))), -1), F.lit(").,;")).alias("url"))).alias("rest")])
    text, url = F.col("rest.text"), F.col("rest.url")
    at = F.length(text) - F.position(F.reverse(url), F.reverse(text)) - F.length(url) + 1
    before = F.regexp_replace(F.substring(text, F.lit(1), at), r"[\s—–-]+$", "")
    return rows.where(F.col("name") != "").select(
        doc, "pos", "name", "category", _no_refs(F.when(url != "", before).otherwise(text)).alias("description"), url.alias("url"))


def prospect_docs(docs: DataFrame, doc: str = "doc", markers: tuple[str, str] | None = None, text: str = "text") -> DataFrame:
    """``prospect_bullets`` of whole documents, one a row: the markers are sought inside the row and nothing moves.

    Rows without ``doc`` are left out where there are markers; rows that repeat ``doc`` are each read on their own.
    """
    lines = F.split(text, r"\r?\n")
    if markers is None:
        return prospect_bullets(split_lines(docs, doc, text), doc)

    def first(lines: Column, marker: str) -> Column:
        return F.array_position(F.transform(lines, lambda x: x.contains(marker)), F.lit(True)).cast("int")

    def within(lines: Column) -> Column:
        def cut(span: Column) -> Column:
            numbered = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
            held = (span["a"] > 0) & (span["b"] > span["a"] + 1)
            return F.when(held, F.slice(numbered, span["a"] + 1, span["b"] - span["a"] - 1))

        return let(F.struct(first(lines, markers[0]).alias("a"), first(lines, markers[1]).alias("b")), cut)

    rows = docs.where(F.col(doc).isNotNull()).select(doc, F.inline(let(lines, within)))
    return prospect_bullets(rows, doc)


_WEEK_FILE = r"^(\d{4}-W\d{2})\.html$"
_META = r'(?i)<meta\s+name="description"\s+content="([^"]*)"'
_PICK = r'(?i)(<li[^>]*class="[^"]*\bweekly-pick\b[^"]*")'


def digest_entries(files: DataFrame, name: str = "file_name", html: str = "html") -> DataFrame:
    """Weekly digest pages with week, Monday and pick count; other files are skipped.

    The count is in the meta text, else it is the number of list items, else unknown.
    """
    label = match(F.col(name), _WEEK_FILE, 1)
    meta = unescape(F.trim(F.coalesce(match(F.col(html), _META, 1), F.lit(""))))
    items = F.size(F.regexp_extract_all(html, F.lit(_PICK), F.lit(1)))
    monday = week_start(label)
    return files.select(
        name, label.alias("label"), monday.alias("monday"), F.date_add(monday, 6).alias("sunday"),
        F.coalesce(match(meta, r"(?i)(\d+)\s+top\s+picks?", 1).cast("int"), F.nullif(items, F.lit(0))).alias("picks"),
        meta.alias("description"),
    ).where(F.col("monday").isNotNull())


def digest_archive(spark: SparkSession, path: str) -> DataFrame:
    """The digest files of a folder, newest first."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("html"))
    return digest_entries(files).orderBy(F.col("label").desc())


# Pages that belong into the manifest.
TOP_PAGES = ("index.html", "how-it-works.html", "wishlist.html")
PAGE_FOLDERS = ("weekly", "venues", "people", "features", "events")


def manifest(files: DataFrame, base_url: str, top: Sequence[str] = TOP_PAGES, folders: Sequence[str] = PAGE_FOLDERS) -> DataFrame:
    """Address and last change of every listed page; the index is the folder itself."""
    path = F.col("path")
    listed = path.isin(list(top)) | path.rlike(r"^(?:" + "|".join(folders) + r")/[^/]+\.html$")
    url = F.concat(F.lit(base_url), F.when(path == "index.html", "").otherwise(path))
    return files.where(listed).groupBy(url.alias("url")).agg(F.max(F.to_date("modified")).alias("last_change")).orderBy("url")


def page_manifest(spark: SparkSession, root: str, base_url: str) -> DataFrame:
    """Manifest of a folder tree; only names and times are read, no contents."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(root)
    relative = F.regexp_replace(F.substring_index(F.col("path"), root.rstrip("/").split("/")[-1] + "/", -1), "^/", "")
    return manifest(found.select(relative.alias("path"), F.col("modificationTime").alias("modified")), base_url)
