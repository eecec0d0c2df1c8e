"""URL filter: a Bloom filter cascade over the complete key universe of the corpus gives exact rule membership without joins.

A key is a host suffix with a path prefix, cut at the path lengths that rules have.  The universe is every distinct key of the corpus.
Level 1 holds the listed keys, level 2 the unlisted keys of the universe that level 1 takes for listed, level 3 the listed ones that
level 2 takes, and so on until a level has no false positive; a key is listed if the first level that rejects it is an even one.
A second cascade over the listed keys tells blocking from allowing rules.

Listed keys are dealt into shards so that the filters of one shard stay under a bound; pages meet one shard after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyloom.llm.common import LOWER, UPPER, cut

# Listed keys of one shard: at about 2 bytes of filter each and 8 at most, a shard ships no more than 32 MB.
SHARD_KEYS = 4_000_000
MAX_LEVELS = 64

# The host, path and verdict of each rule of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: F.Column) -> F.Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: F.Column) -> F.Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def keys_of(host: F.Column, path: F.Column, lengths: list[int]) -> F.Column:
    """Every host suffix with every path prefix of the given lengths."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    heads = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, 1, n))
    return F.flatten(F.transform(hosts, lambda h: F.transform(heads, lambda p: F.concat(h, p))))


@dataclass
class Cascade:
    """Levels of packed bits with their number of hash functions; a key is a pair of 64-bit hashes."""

    levels: list[tuple[np.ndarray, int, int]]  # bytes, bits, hash functions

    def positions(self, h1: np.ndarray, h2: np.ndarray, level: int) -> Iterator[np.ndarray]:
        return places(h1, h2, level, *self.levels[level][1:])

    def listed(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """True where the first level that rejects the key is an even one (counted from 1)."""
        depth = np.zeros(len(h1), np.int64)
        open_ = np.arange(len(h1))
        for level, (packed, _, _) in enumerate(self.levels):
            passed = np.ones(len(open_), bool)
            for at in self.positions(h1[open_], h2[open_], level):
                passed &= (packed[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            open_ = open_[passed]
            depth[open_] += 1
        return depth % 2 == 1


def places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    """Bit numbers of keys at a level; each level and function mixes both hashes anew."""
    for i in range(hashes):
        x = h1 + np.uint64((level * 31 + i) * 2 + 1) * h2
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)  # odd multiplier of a well-known 64-bit mixer
        yield (x ^ (x >> np.uint64(32))) % np.uint64(bits)


def _unsigned(s: pd.Series) -> np.ndarray:
    return s.to_numpy("i8").view("u8")


def _filled(keys: DataFrame, level: int, bits: int, hashes: int) -> np.ndarray:
    """Packed bits of a level: bit numbers are made in the tasks, combined per 64-bit word before the shuffle, and only words come back."""
    @F.pandas_udf("array<long>")
    def bits_of(h1: pd.Series, h2: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack([p.astype("i8") for p in places(_unsigned(h1), _unsigned(h2), level, bits, hashes)], 1)))

    at = keys.select(F.explode(bits_of("h1", "h2")).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask")).toPandas()
    out = np.zeros(-(-bits // 64), "<u8")
    out[words["word"].to_numpy("i8")] = words["mask"].to_numpy("i8").view("u8")
    return out.view(np.uint8)


def _passes(spark, packed: np.ndarray, bits: int, hashes: int, level: int):
    shipped = spark.sparkContext.broadcast(packed)

    @F.pandas_udf("boolean")
    def passes(h1: pd.Series, h2: pd.Series) -> pd.Series:
        held, ok = shipped.value, np.ones(len(h1), bool)
        for at in places(_unsigned(h1), _unsigned(h2), level, bits, hashes):
            ok &= (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return pd.Series(ok)

    return passes


def build(universe: DataFrame) -> Cascade:
    """Cascade of a universe (h1, h2, listed) of distinct keys.  The first level's rate follows the ratio of listed to other keys, which
    keeps the whole in proportion to the listed ones; the levels after it use one hash function at a rate of a half."""
    sides = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    listed, others = sides.get(True, 0), sides.get(False, 0)
    if not listed:
        return Cascade([])
    rate = min(0.5, listed * math.sqrt(0.5) / max(others, 1))
    cascade, inside, outside, size = Cascade([]), universe.where("listed"), universe.where("not listed"), listed
    for level in range(MAX_LEVELS):
        per_key = -math.log(rate) / math.log(2) ** 2
        bits, hashes = max(64, math.ceil(size * per_key)), max(1, round(per_key * math.log(2)))
        packed = _filled(inside, level, bits, hashes)
        cascade.levels.append((packed, bits, hashes))
        fooled = cut(outside.where(_passes(universe.sparkSession, packed, bits, hashes, level)("h1", "h2")))
        size = fooled.count()
        if not size:
            return cascade
        inside, outside, rate = fooled, inside, 0.5
    raise RuntimeError("the cascade did not end: two keys of the universe share both hashes")


def hashed(key: F.Column) -> list[F.Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


def _flags(cascade: Cascade, spark):
    shipped = spark.sparkContext.broadcast(cascade)

    @F.pandas_udf("array<boolean>")
    def flags(first: pd.Series, second: pd.Series) -> pd.Series:
        sizes = first.map(len).to_numpy()
        if not sizes.sum():
            return pd.Series([[] for _ in sizes])
        h1, h2 = (np.concatenate(s.to_list()).astype("i8").view("u8") for s in (first, second))
        return pd.Series(np.split(shipped.value.listed(h1, h2), np.cumsum(sizes)[:-1]))

    return flags


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", shard_keys: int = SHARD_KEYS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``.

    ``rules`` is (host, path, verdict); a rule fits its host and all subdomains if the path starts with the rule's.  The longest rule
    wins; a page without one gets no rule and the ``default`` verdict: no level of the cascade lists any of its keys.  Of rules with the
    same host and path, blocking wins.  A null url, or one without ``://``, has empty host and path.  Repeated rows are judged alike.
    """
    spark = pages.sparkSession
    ruled = cut(rules.where("host is not null and path is not null")
                .select(F.concat(F.translate("host", UPPER, LOWER), "path").alias("key"), F.length("path").alias("n"), (F.col("verdict") == "block").alias("block"))
                .groupBy("key", "n").agg(F.max("block").alias("block")))
    lengths = sorted(r["n"] for r in ruled.select("n").distinct().collect())
    located = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not lengths:
        return located.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    shards = max(1, -(-ruled.count() // shard_keys))
    shard = lambda key: F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(shards))
    # Every distinct key of the corpus; host and head of the path first, so that repeated pages shrink before their keys are made.
    heads = located.select("host", F.substring("path", 1, lengths[-1]).alias("path")).distinct()
    universe = cut(heads.select(F.explode(keys_of(F.col("host"), F.col("path"), lengths)).alias("key")).distinct()
                   .join(ruled.select("key", F.lit(True).alias("listed")), "key", "left")
                   .select(*hashed(F.col("key")), F.coalesce("listed", F.lit(False)).alias("listed"), shard(F.col("key")).alias("shard")))
    ways = cut(ruled.select(*hashed(F.col("key")), F.col("block").alias("listed"), shard(F.col("key")).alias("shard")))
    out = located.select("*", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("boolean").alias("blocks"))
    for n in range(shards):
        of_rule, of_block = (_flags(build(x.where(F.col("shard") == n)), spark) for x in (universe, ways))
        keyed = out.withColumn("_keys", F.filter(keys_of(F.col("host"), F.col("path"), lengths), lambda k: shard(k) == n))
        keyed = keyed.withColumn("_first", F.transform("_keys", lambda k: F.xxhash64(k))).withColumn("_second", F.transform("_keys", lambda k: F.xxhash64(F.lit("second"), k)))
        keyed = keyed.withColumn("_listed", of_rule("_first", "_second")).withColumn("_block", of_block("_first", "_second"))
        rows = F.filter(F.arrays_zip("_keys", "_listed", "_block"), lambda r: r["_listed"])
        best = F.array_max(F.transform(rows, lambda r: F.struct(F.length(r["_keys"]).alias("n"), r["_keys"].alias("key"), r["_block"].alias("block"))))
        keyed = keyed.withColumn("_best", best)
        longer = F.col("_best").isNotNull() & (F.col("rule").isNull() | (F.col("_best.n") > F.length("rule")))
        out = keyed.select("page_id", "host", "path", F.when(longer, F.col("_best.key")).otherwise(F.col("rule")).alias("rule"),
                           F.when(longer, F.col("_best.block")).otherwise(F.col("blocks")).alias("blocks"))
        out = cut(out) if shards > 1 else out
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(F.col("blocks"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
