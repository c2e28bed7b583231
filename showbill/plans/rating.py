"""Rating events: cheap rules first, model calls only for what is left."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from showbill.functions.facts import nonblank
from showbill.functions.review import is_refusal, parse_response
from showbill.operators import joins
from showbill.operators.scale import ensure_checkpoint_dir
from showbill.sources.responses import run_model
from showbill.values import DEFAULT_SCORE

#: Score and hook of recurring meetings.
RECURRING = (7, "Weekly literary discussion group")

RATED = ("event_key", "score", "summary", "review_confidence", "origin")


def _rated(df: DataFrame, score, summary, confidence, origin: str) -> DataFrame:
    return df.select("event_key", score.cast("int").alias("score"), summary.alias("summary"),
                     confidence.alias("review_confidence"), F.lit(origin).alias("origin"))


def rate(event: DataFrame, rules: Sequence[dict], cache: DataFrame,
         attempts: Sequence[Callable[[pd.Series], pd.Series]], prompt, partitions: int | None = None) -> DataFrame:
    """Score, summary and confidence of every event, and where they come from.

    In order: an override rule, the default of recurring meetings, the text of ready-made
    "other" events, the cache, then the attempts one after the other on what is still open.
    The outcome of each attempt is checkpointed: a lost executor must not repeat paid calls.
    """
    ensure_checkpoint_dir(event.sparkSession)
    judged = joins.apply_overrides(event, rules)
    hit = F.col("override").isNotNull()
    unknown = F.lit(None).cast("string")
    recurring = F.coalesce("is_recurring", F.lit(False))
    ready = (F.col("type") == "other") & nonblank(F.col("description"))
    parts = [
        _rated(judged.where(hit), F.col("override.rating"), F.coalesce("override.summary", "description"), unknown, "override"),
        _rated(judged.where(~hit & recurring), F.lit(RECURRING[0]), F.coalesce("description", F.lit("Weekly recurring event")), unknown, "recurring"),
        _rated(judged.where(~hit & ~recurring & ready), F.lit(None), F.col("description"), unknown, "ready"),
    ]
    rest = judged.where(~hit & ~recurring & ~F.coalesce(ready, F.lit(False))).drop("override")
    cached, misses = joins.attach_rating_cache(rest, cache)
    parts.append(_rated(cached, F.col("cached_rating"), F.col("cached_summary"), unknown, "cache"))

    # One call per title: events that share a title share the answer.
    asked = misses.groupBy("cache_key").agg(F.min_by(prompt, "event_key").alias("prompt"))
    open_ = asked
    answers = None
    for no, fn in enumerate(attempts, 1):
        replies = run_model(open_, fn, "cache_key", partitions).checkpoint()
        usable = replies.where(nonblank(F.col("content")) & ~is_refusal(F.col("content"))).select(
            "cache_key", parse_response(F.col("content")).alias("p"), F.lit(f"attempt {no}").alias("origin"))
        answers = usable if answers is None else answers.unionByName(usable)
        open_ = open_.join(usable, "cache_key", "left_anti")
    rated = misses.select("event_key", "cache_key", "title").join(answers, "cache_key", "left")
    stub = F.concat(F.lit("Unable to evaluate "), F.col("title"), F.lit(" (no sources found)."))
    parts.append(rated.select(
        "event_key", F.coalesce("p.score", F.lit(DEFAULT_SCORE)).alias("score"), F.coalesce("p.summary", stub).alias("summary"),
        F.col("p.review_confidence").alias("review_confidence"), F.coalesce("origin", F.lit("stub")).alias("origin")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
