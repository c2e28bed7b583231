"""Runs a registered query next to its comparison statement and reports differences."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

SPARK_TO_DUCK = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def compare(df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and a statement; empty when they agree."""
    problems = []
    relation = con.execute(sql)
    names = [c[0] for c in relation.description]
    kinds = {c[0]: str(c[1]) for c in relation.description}
    theirs = relation.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    for name, kind in df.dtypes:
        want = SPARK_TO_DUCK.get(kind)
        if want and kinds[name] != want:
            problems.append(f"type of {name}: {kind} vs {kinds[name]}")
    order = sorted(df.columns)
    ours = Counter(tuple(_plain(r[c]) for c in order) for r in df.collect())
    index = [names.index(c) for c in order]
    wanted = Counter(tuple(_plain(r[i]) for i in index) for r in theirs)
    if ours != wanted:
        extra, missing = ours - wanted, wanted - ours
        problems.append(f"rows {sum(ours.values())} vs {sum(wanted.values())}")
        problems += [f"  only here:  {dict(zip(order, r))}" for r in list(extra)[:3]]
        problems += [f"  only there: {dict(zip(order, r))}" for r in list(missing)[:3]]
    elif not wanted:
        problems.append("no rows on either side")
    return problems
