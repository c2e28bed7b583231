"""Model replies: the call itself, and the rows inside their JSON."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names a reply's list may have when it is not under "events".
WRAPPERS = ("events", "results", "data", "items", "candidates", "venues")

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}\[\]]', re.S)


def complete_prefix(text: str):
    """The value of a JSON text cut short: everything up to the last closed container."""
    open_, best = [], None
    for token in _TOKEN.finditer(text):
        mark = token.group()[0]
        if mark in "{[":
            open_.append("}" if mark == "{" else "]")
        elif mark in "}]":
            if not open_:
                return None
            open_.pop()
            best = text[:token.end()] + "".join(reversed(open_))
    try:
        return json.loads(best) if best else None
    except ValueError:
        return None


def first_object(text: str | None):
    """First JSON object of a reply; prose and fences around it do not matter."""
    start = (text or "").find("{")
    if start < 0:
        return None
    try:
        return json.JSONDecoder().raw_decode(text, start)[0]
    except ValueError:
        return complete_prefix(text[start:])


def entries(value) -> list[str]:
    """The list of objects in a reply: under a known name, else the first one there is."""
    if not isinstance(value, dict):
        return []
    named = [value[k] for k in WRAPPERS if isinstance(value.get(k), list) and value[k]]
    for group in (*named, *value.values()):
        if isinstance(group, list) and any(isinstance(e, dict) for e in group):
            return [json.dumps(e, ensure_ascii=False) for e in group if isinstance(e, dict)]
    return []


@F.pandas_udf(T.ArrayType(T.StringType()))
def salvage_json(texts: pd.Series) -> pd.Series:
    """JSON text of every complete entry in a reply, cut-short replies included."""
    return texts.map(lambda t: entries(first_object(t)))


def response_events(responses: DataFrame, schema: str, text: str = "text") -> DataFrame:
    """One row per entry of every reply, with the entry's fields.

    Replies that parse as they are stay inside Spark; only the others go to Python. Every
    reply is read and judged once.
    """
    fields = f"events array<struct<{schema}>>"
    direct = F.from_json("_plain", fields)["events"]
    is_plain = F.col(text).rlike(r'^\s*\{\s*"events"\s*:\s*\[\s*\{') & F.try_parse_json(F.col(text)).isNotNull()
    keep = [c for c in responses.columns if c != text]
    split = F.when(is_plain, F.struct(F.col(text).alias("_plain"), F.lit(None).cast("string").alias("_other"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("_plain"), F.col(text).alias("_other")))
    judged = responses.select(*keep, F.inline(F.array(split)))
    salvaged = F.transform(salvage_json(F.col("_other")), lambda raw: F.from_json(raw, f"struct<{schema}>"))
    read = F.when(F.col("_plain").isNotNull(), direct).otherwise(salvaged)
    return judged.select(*keep, F.posexplode(read).alias("pos", "e")).select(*keep, "pos", "e.*")


def _answered(frames: Iterator[pd.DataFrame], fn: Callable[[pd.Series], pd.Series], key: str, batch: int) -> Iterator[pd.DataFrame]:
    """The answers to each frame of prompts as one frame; handing on a frame costs more than a small call."""
    for frame in frames:
        prompts, content, error = frame["prompt"], [], []
        for at in range(0, len(frame), batch):
            part = prompts.iloc[at:at + batch]
            try:
                got, failed = fn(part).tolist(), None
            except Exception as exc:  # the caller's function may raise anything
                got, failed = [None] * len(part), f"{type(exc).__name__}: {exc}"
            if len(got) != len(part):
                raise ValueError(f"{len(got)} answers for {len(part)} prompts")
            content += got
            error += [failed] * len(part)
        yield pd.DataFrame({key: frame[key].tolist(), "content": content, "error": error})


def run_model(requests: DataFrame, fn: Callable[[pd.Series], pd.Series], key: str = "event_key",
              partitions: int | None = None, batch: int = 100) -> DataFrame:
    """(key, content, error) of the caller's function over (key, prompt) rows.

    ``partitions`` caps how many calls run at the same time (as many as the rows have, if it
    is not given), ``batch`` how many prompts one call gets. A call that fails marks its own prompts only.
    """
    kind = dict(requests.dtypes)[key]
    rows = requests.select(key, "prompt")
    return (rows.repartition(partitions) if partitions else rows).mapInPandas(lambda frames: _answered(frames, fn, key, batch), f"{key} {kind}, content string, error string")

