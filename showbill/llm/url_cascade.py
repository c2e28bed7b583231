"""URL filter: path rules first, then a Bloom filter cascade over the complete key universe."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from showbill.llm.common import stored

#: Rules (host, path, verdict): each fits its host and all subdomains where the path starts so.
RULES = (
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
)
#: Keys of one shard of the cascade, which one task builds.
SHARD_KEYS = 250_000
#: A cascade of up to so many bytes is broadcast; a larger one meets the keys shard by shard.
BROADCAST_BYTES = 32 << 20

_U = np.uint64


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule as host followed by path, its verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


class Level:
    """A Bloom filter for a known number of keys and a rate of false positives."""

    def __init__(self, bits: np.ndarray, size: int, probes: int, seed: int):
        self.bits, self.size, self.probes, self.seed = bits, size, probes, seed

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, rate: float, seed: int) -> Level:
        probes = max(1, round(-math.log2(rate)))
        size = max(64, math.ceil(len(a) * -math.log(rate) / math.log(2) ** 2))
        level = cls(np.zeros(-(-size // 8), np.uint8), size, probes, seed)
        for at in level._places(a, b):
            np.bitwise_or.at(level.bits, at >> _U(3), (_U(1) << (at & _U(7))).astype(np.uint8))
        return level

    def _places(self, a, b):
        salt = _U((self.seed * 0x9E3779B97F4A7C15) % 2**64)
        step = (b ^ salt) * _U(0xFF51AFD7ED558CCD) | _U(1)
        place = (a ^ salt) * _U(0xC4CEB9FE1A85EC53)
        place ^= place >> _U(29)
        for _ in range(self.probes):
            yield (place >> _U(16)) % _U(self.size)
            place = place + step

    def has(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for at in self._places(a, b):
            out &= (self.bits[at >> _U(3)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1
        return out


def build(a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> list[Level]:
    """Levels that tell listed keys from the others exactly: each encodes what the one before lets through wrongly."""
    levels, inside, outside = [], (a[listed], b[listed]), (a[~listed], b[~listed])
    while len(inside[0]):
        if len(levels) == 64:
            raise ValueError("a listed and an unlisted key have the same two hashes")
        ratio = len(inside[0]) / max(1, len(outside[0]))
        rate = min(0.5, ratio / math.sqrt(2)) if not levels else 0.5
        level = Level.of(*inside, max(rate, 2**-20), len(levels) + 1)
        levels.append(level)
        wrong = level.has(*outside)
        inside, outside = (outside[0][wrong], outside[1][wrong]), inside
    return levels


def contains(levels: list[Level], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed: the depth at which a level first says no decides."""
    out, open_ = np.zeros(len(a), bool), np.arange(len(a))
    for depth, level in enumerate(levels):
        open_ = open_[level.has(a[open_], b[open_])]
        out[open_] = depth % 2 == 0
    return out


_LEVELS = "shard long, depth int, size long, probes int, bits binary"


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit("second")).alias("b")]


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    levels = build(frame["a"].to_numpy().view(_U), frame["b"].to_numpy().view(_U), frame["listed"].to_numpy().astype(bool))
    return pd.DataFrame({
        "shard": int(frame["shard"].iloc[0]), "depth": range(len(levels)), "size": [x.size for x in levels],
        "probes": [x.probes for x in levels], "bits": [x.bits.tobytes() for x in levels]})


def _levels(rows) -> dict[int, list[Level]]:
    out: dict[int, list[Level]] = {}
    for shard, depth, size, probes, bits in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(shard, []).append(Level(np.frombuffer(bits, np.uint8), size, probes, depth + 1))
    return out


def cascade(universe: DataFrame, listed: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """(levels by shard, number of shards) of a cascade over the column ``key`` of both tables.

    ``universe`` holds all keys that are ever asked for; listed keys that are not in it are
    dropped. Keys are spread over shards by their hash, so that each is built by one task.
    """
    keys = universe.select("key").where("key is not null").withColumn("listed", F.lit(0)).unionByName(
        listed.select("key").where("key is not null").withColumn("listed", F.lit(1)))
    keys = keys.groupBy("key").agg(F.max("listed").alias("listed"), F.min("listed").alias("known")).where("known = 0")
    keys = stored(keys.select(*_hashes(F.col("key")), "listed"), "cascade-keys")
    shards = max(1, math.ceil(keys.count() / shard_keys))
    keyed = keys.withColumn("shard", F.pmod("a", F.lit(shards)))
    return stored(keyed.groupBy("shard").applyInPandas(_build, _LEVELS), "cascade"), shards


def _probe(levels: dict[int, list[Level]], shards: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    shard, out = np.mod(a, shards), np.zeros(len(a), bool)  # of signed hashes, as pmod
    for k in np.unique(shard):
        own = np.flatnonzero(shard == k)
        out[own] = contains(levels.get(int(k), []), a[own].view(_U), b[own].view(_U))
    return out


def is_listed(rows: DataFrame, levels: DataFrame, shards: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``rows`` (with a column ``key``) plus ``listed``; a null key is not listed.

    The cascade is measured: up to ``broadcast_bytes`` it goes to all tasks and the rows stay
    where they are. Beyond, the distinct keys meet it shard by shard.
    """
    total = levels.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    if total <= broadcast_bytes:
        held = rows.sparkSession.sparkContext.broadcast(_levels([tuple(r) for r in levels.collect()]))

        @F.pandas_udf("boolean")
        def listed(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series(_probe(held.value, shards, a.to_numpy(np.int64), b.to_numpy(np.int64)))

        a, b = _hashes(F.col("key"))
        return rows.withColumn("listed", F.col("key").isNotNull() & listed(a, b))

    def meet(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        held = _levels(own[["shard", "depth", "size", "probes", "bits"]].itertuples(index=False))
        return asked.assign(listed=_probe(held, shards, asked["a"].to_numpy(), asked["b"].to_numpy()))[["key", "listed"]]

    keys = rows.select("key").where("key is not null").distinct().select("key", *_hashes(F.col("key")))
    keys = keys.withColumn("shard", F.pmod("a", F.lit(shards)))
    answers = keys.groupBy("shard").cogroup(levels.groupBy("shard")).applyInPandas(meet, "key string, listed boolean")
    return rows.join(answers, "key", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))


def judged(pages: DataFrame, listed: DataFrame, rules=RULES, **options) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; ``listed`` has the keys (host and path) of blocked pages.

    The longest rule that fits decides. Where none does, a page is blocked if its key is
    listed, which a cascade over the keys of all pages answers exactly. A url that is null or
    has no :// has an empty host, path and key and is never listed. Repeated rows fare alike;
    an empty table gives no rows, and columns other than page_id and url are not read.
    """
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("key", F.when(F.col("host") != "", F.concat("host", "path")))
    levels, shards = cascade(rows.select("key"), listed, **options)
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    return is_listed(rows, levels, shards).select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def thin_pages(pages: DataFrame, least_chars: int) -> DataFrame:
    """Keys of pages whose mark-up has fewer than ``least_chars`` characters."""
    url = F.col("url").cast("string")
    host = host_of(url)
    return pages.where((F.length(F.col("html").cast("string")) < least_chars) & (host != "")).select(
        F.concat(host, path_of(url)).alias("key")).distinct()
