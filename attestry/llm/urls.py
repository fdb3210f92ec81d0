"""URL filters by a Bloom filter cascade, in DataFrame functions only.

Level 1 encodes the listed keys. Among all keys that the corpus holds, those that level 1 takes wrongly are
encoded in level 2; the listed keys that level 2 takes wrongly in level 3; and so on until a level errs on none.
A key is listed exactly if the first level that refuses it is an even one. So membership is exact for every key
of the corpus, and the urls themselves are never joined or shuffled. Each verdict of the rules has a cascade of its own, so that
the cascades alone give the verdict. They are one row of bitmaps that every task gets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import drop_table, write_table

#: (host, path, verdict) of the rules that the query applies.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: The verdict on a url that the cascade finds unlisted.
UNLISTED = "allow"
#: Bitmaps together are no larger than this, which is some 50 million keys; longer lists are joined by key instead.
MAX_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where :// is missing."""
    at = F.instr(url, "://")
    after = F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every host suffix (at label borders) with every path prefix of a length that some rule has."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]) if lengths else F.array().cast("array<string>")
    prefixes = F.filter(prefixes, lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def _positions(key: Column, level: int, bits: int, hashes: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(level * 64 + i), key), F.lit(bits)) for i in range(hashes)]


def level_bits(n: int, rate: float) -> int:
    return max(64, math.ceil(-max(1, n) * math.log(rate) / math.log(2) ** 2 / 8) * 8)


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its bitmap, and how keys are looked up in it."""

    bitmap: bytes
    bits: int
    hashes: int


def build_level(keys: DataFrame, level: int, rate: float) -> Level:
    """The filter over column key; the bits are or-ed on the executors, byte by byte."""
    n = max(1, keys.count())
    bits = level_bits(n, rate)
    hashes = max(1, round(bits / n * math.log(2))) if n * 20 > bits else 4
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), level, bits, hashes))).alias("p"))
    octets = at.select(F.shiftright("p", 3).alias("i"), F.call_function("shiftleft", F.lit(1), (F.col("p") % 8).cast("int")).alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    bitmap = bytearray(bits // 8)
    for row in octets.toLocalIterator():  # bounded by MAX_BYTES
        bitmap[row.i] = row.b
    return Level(bytes(bitmap), bits, hashes)


def takes(key: Column, level: int, built: Level, bitmap: Column | None = None) -> Column:
    """Whether the filter takes the key; bitmap is the column that holds the filter's bytes, else they are a literal."""
    held = F.lit(bytearray(built.bitmap)) if bitmap is None else bitmap
    out = F.lit(True)
    for p in _positions(key, level, built.bits, built.hashes):
        octet = F.conv(F.hex(F.substring(held, (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        out = out & (F.getbit(octet, (p % 8).cast("int")) == 1)
    return out


def with_bitmaps(df: DataFrame, cascades: dict[str, list[Level]]) -> DataFrame:
    """df with the column _maps, the bitmaps of all levels; one row is broadcast, no larger than MAX_BYTES by construction."""
    maps = [level.bitmap for v in sorted(cascades) for level in cascades[v]]
    one = df.sparkSession.createDataFrame([([bytearray(m) for m in maps],)], "_maps array<binary>")
    return df.crossJoin(F.broadcast(one))


def build_cascade(listed: DataFrame, universe: DataFrame, rate: float = 0.05) -> list[Level]:
    """Levels over the listed keys and the universe's false positives. Both frames have the column key.

    Only universe keys that level 1 takes are gathered, so what is shuffled is about the listed keys and the share
    rate of the others. An empty list gives no level: nothing is then listed.
    """
    listed = listed.where("key is not null").distinct()
    if not listed.limit(1).count():
        return []
    levels = [build_level(listed, 0, rate / 2)]
    passing = with_bitmaps(universe.where("key is not null"), {"": levels}).where(takes(F.col("key"), 0, levels[0], F.col("_maps")[0]))
    flagged = passing.select("key", F.lit(0).alias("own")).unionByName(listed.select("key", F.lit(1).alias("own")))
    pool = write_table(flagged.groupBy("key").agg(F.max("own").alias("own")))
    side, rest = 0, {0: pool.where("own = 0").select("key"), 1: pool.where("own = 1").select("key")}
    while rest[side].limit(1).count():  # rest[0]: unlisted keys that all levels so far take; rest[1]: listed ones
        levels.append(build_level(rest[side], len(levels), rate if len(levels) > 1 else 0.5))
        rest[1 - side] = with_bitmaps(rest[1 - side], {"": levels[-1:]}).where(takes(F.col("key"), len(levels) - 1, levels[-1], F.col("_maps")[0])).select("key")
        side = 1 - side
    drop_table(pool)
    return levels


def is_listed(key: Column, levels: list[Level], maps: Column | None = None, first: int = 0) -> Column:
    """Exact for the keys of the universe the cascade was built over. maps holds the bitmaps, from place first on."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(~takes(key, i, levels[i], None if maps is None else maps[first + i]), F.lit(i % 2 == 1)).otherwise(out)
    return out


def _by_join(split: DataFrame, rules: DataFrame, keys: Column) -> DataFrame:
    """rule and verdict by an equi-join of the distinct hosts and paths: the exact way for lists that no bitmap should hold."""
    asked = split.select("host", "path").distinct().select("host", "path", F.explode(keys).alias("key"))
    best = asked.join(rules, "key").groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "said")).alias("x"))
    return split.join(best, ["host", "path"], "left").withColumn("rule", F.col("x.key")).withColumn("verdict", F.col("x.said")).drop("x")


def _hits(keys: Column, levels: list[Level], first: int, verdict: str) -> Column:
    """The keys that a verdict's cascade lists."""
    found = F.filter(keys, lambda k: is_listed(k, levels, F.col("_maps"), first))
    return F.transform(found, lambda k: F.struct(F.length(k).alias("n"), k.alias("k"), F.lit(verdict).alias("said")))


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES, url_col: str = "url", unlisted: str = UNLISTED, most_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds host, path, rule (null if none) and verdict. rules has (host, path, verdict); the longest rule that fits wins.

    Null urls and urls without :// have empty host and path and get the method's verdict, as do all urls that
    fit no rule. A rule given with two verdicts has the first of them by code point; rules with a null go. Columns named
    like the added ones are replaced. Repeated rows stay. Verdicts, and lengths of rule paths, are few.
    """
    spark = df.sparkSession
    frame = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "host string, path string, verdict string")
    frame = frame.select("host", "path", "verdict").dropna()
    listed = write_table(frame.groupBy(F.concat("host", "path").alias("key")).agg(F.min("verdict").alias("said"), F.min(F.length("path")).alias("n"), F.max(F.length("path")).alias("m")))
    lengths = sorted({n for r in listed.select("n", "m").distinct().collect() for n in r})
    host, path = host_and_path(F.col(url_col))
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    # The row goes along as a struct, so that no column of it can clash.
    split = df.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), host.alias("host"), path.alias("path"))
    keys = candidate_keys(F.col("host"), F.col("path"), lengths)
    numbers = {r.said: r["n"] for r in listed.groupBy("said").agg(F.count(F.lit(1)).alias("n")).collect()}
    columns = ["row.*", "host", "path", "rule"]
    told = F.coalesce(F.col("verdict"), F.lit(unlisted)).alias("verdict")
    # Later levels hold a small share of the first one's keys; four times the first is more than all of them.
    if 4 * sum(level_bits(n, 0.025) for n in numbers.values()) > 8 * most_bytes:
        return _by_join(split, listed.select("key", "said"), keys).select(*columns, told)
    universe = split.select(F.explode(keys).alias("key"))
    cascades = {v: build_cascade(listed.where(F.col("said") == v).select("key"), universe) for v in sorted(numbers)}
    drop_table(listed)
    mapped, hits, place = with_bitmaps(split, cascades), [], 0
    for verdict, levels in cascades.items():
        hits.append(_hits(keys, levels, place, verdict))
        place += len(levels)
    longest = F.array_max(F.concat(*hits)) if hits else F.lit(None).cast("struct<n:int,k:string,said:string>")
    judged = mapped.withColumn("_best", longest).withColumn("rule", F.col("_best.k")).withColumn("verdict", F.col("_best.said"))
    return judged.select(*columns, told)
