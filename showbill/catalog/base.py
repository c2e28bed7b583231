"""Registration helper and the table mapping shared by the comparison statements.

The driver's star-schema tables stand in for listing data. ``sources/tables.py``
builds the mapping for Spark; the common table expressions here are the same
mapping for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

REGISTRY: dict[str, tuple[Callable, str | None]] = {}

#: Reference dates used by the registered queries.
TODAY = "1998-06-15"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its comparison statement."""

    def keep(fn):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = (fn, sql)
        return fn

    return keep


TYPE_CASE = """CASE p_type WHEN 'ECONOMY' THEN 'movie' WHEN 'STANDARD' THEN 'concert'
    WHEN 'SMALL' THEN 'opera' WHEN 'MEDIUM' THEN 'dance' WHEN 'LARGE' THEN 'book_club'
    WHEN 'PROMO' THEN 'visual_arts' ELSE 'other' END"""

SCREENING = f"""
screening AS (
  SELECT l_partkey AS event_key,
    concat(lpad(CAST(l_orderkey AS VARCHAR), 13, '0'), lpad(CAST(l_linenumber AS VARCHAR), 2, '0'),
           lpad(CAST(l_partkey AS VARCHAR), 12, '0'), lpad(CAST(l_suppkey AS VARCHAR), 10, '0'),
           lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0')) AS ord,
    concat(p_name, ' ', CAST(p_partkey % 500 AS VARCHAR)) AS title,
    {TYPE_CASE} AS type,
    s_name AS venue,
    strftime(l_shipdate, '%Y-%m-%d') AS date,
    concat(lpad(CAST(10 + l_linenumber AS VARCHAR), 2, '0'), ':',
           CASE WHEN l_quantity % 2 = 0 THEN '00' ELSE '30' END) AS time,
    CASE WHEN l_returnflag = 'R' THEN NULL ELSE p_size % 11 END AS rating,
    concat('https://', lower(replace(s_name, '#', '')), '/', CAST(l_partkey AS VARCHAR)) AS url,
    CAST(l_shipdate AS DATE) AS d,
    CAST(isodow(l_shipdate) - 1 AS INTEGER) AS dow,
    l_linenumber AS n, l_orderkey AS order_key, l_suppkey AS supp_key
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
)"""

PERSON = """
screening_person AS (
  SELECT s.*, c_name AS person
  FROM screening s JOIN orders ON s.order_key = o_orderkey JOIN customer ON o_custkey = c_custkey
)"""

EVENT = """
event AS (
  SELECT event_key, title, type, venue, rating, url FROM screening
  QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY ord) = 1
)"""

EVENT_PERSON = """
event_person AS (
  SELECT event_key, title, type, venue, rating, url, person FROM screening_person
  QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY ord) = 1
)"""


def month_case(expr: str, names: list[str]) -> str:
    """A CASE over month numbers that both engines read."""
    arms = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names, 1))
    return f"CASE month({expr}) {arms} END"


MONTHS = ["January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December"]
MONTHS_SHORT = [m[:3] for m in MONTHS]
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

MONTH_NAME = month_case("d", MONTHS)
MONTH_SHORT = month_case("d", MONTHS_SHORT)
WEEKDAY_NAME = "CASE dow " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(WEEKDAYS)) + " END"
WEEKDAY_SHORT = "CASE dow " + " ".join(f"WHEN {i} THEN '{w[:3]}'" for i, w in enumerate(WEEKDAYS)) + " END"

LISTING = """
listing AS (
  SELECT * EXCLUDE (date, time, dow, title),
    event_key % 7 AS damage,
    list_transform(range(0, n % 4), lambda i:
      CASE WHEN event_key % 7 = 2
        THEN concat(month(d + CAST(7 * i AS INTEGER)), '/', day(d + CAST(7 * i AS INTEGER)), '/', year(d + CAST(7 * i AS INTEGER)))
        ELSE strftime(d + CAST(7 * i AS INTEGER), '%Y-%m-%d') END) AS dates,
    list_transform(
      range(0, CASE event_key % 7 WHEN 3 THEN 0 WHEN 4 THEN least(n % 4, 1) ELSE n % 4 END), lambda i:
      CASE WHEN event_key % 7 = 1
        THEN concat(CASE WHEN (n + 10 + i) % 12 = 0 THEN 12 ELSE (n + 10 + i) % 12 END, ':', time[4:5],
                    CASE WHEN n + 10 + i >= 12 THEN ' PM' ELSE ' AM' END)
        ELSE concat(lpad(CAST(n + 10 + i AS VARCHAR), 2, '0'), ':', time[4:5]) END) AS times,
    CASE WHEN event_key % 7 = 6 THEN strftime(d - 30, '%Y-%m-%d')
         WHEN event_key % 5 = 0 THEN strftime(d + 45, '%Y-%m-%d') END AS end_date,
    CASE WHEN event_key % 7 = 5 THEN '  ' ELSE title END AS title
  FROM screening
)"""


def with_(*parts: str) -> str:
    """A WITH clause of the given table expressions."""
    return "WITH " + ",".join(parts)
