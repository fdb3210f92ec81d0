"""Exact dedup by a minimal perfect hash over historical distinct digests.

Texts are equal when their digests are: the sha256 of the text without white space. The distinct digests of the history are dealt into
buckets; each bucket is one row that holds a minimal perfect hash of its digests (levels of bitmaps, in each of which a digest is placed where
it meets no other; the slot is the rank of its bit), the full digests by slot, and for each slot the locator of its winner and the
number of rows. Digests of other rows are looked up in their bucket: the slot's digest is compared byte by byte, so a nonmember is
never taken for a member. Members join their slot, nonmembers are groups of their own.

The rows of a digest are counted before any shuffle, so that a digest with a third of all rows is as cheap as any other; the number of buckets
grows with the distinct digests, so that a bucket stays a few megabytes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import drop_table, join_told, text_of, write_table

#: White space that two equal texts may differ in.
BLANKS = " \t\n\x0b\x0c\r"
#: Digests of a bucket, on average.
BUCKET = 32_768
#: Bits of a level for each digest that is still to be placed.
ROOM = 2
DIGEST = 32
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: What a slot tells: rows, and the place of the winner in the order of winners.
_SLOT = ["n", "short", "no_id", "id", "at"]
_ORDER = _SLOT[1:]


def normal_digest(text: Column) -> Column:
    """sha256 of the text without white space, as 32 bytes; a null text counts as empty."""
    return F.unhex(F.sha2(F.encode(F.translate(text, BLANKS, ""), "UTF-8"), 256))


def _halves(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, :16]).view(np.uint64)


def _places(halves: np.ndarray, level: int, size: int) -> np.ndarray:
    x = (halves[:, 0] ^ np.uint64((level + 1) * int(_K1) % (1 << 64))) * _K2
    x = (x ^ (x >> np.uint64(32)) ^ halves[:, 1]) * _K1
    return ((x ^ (x >> np.uint64(29))) % np.uint64(size)).astype(np.int64)


def perfect_hash(digests: np.ndarray) -> list[bytes]:
    """Bitmaps of the levels for distinct digests (n, 32): bit is 1 where one digest only is placed; all others go on to the next level."""
    levels, left = [], _halves(digests)
    while len(left):
        if len(levels) > 200:
            raise ValueError("equal digests among the distinct ones")
        size = -(-len(left) * ROOM // 64) * 64
        at = _places(left, len(levels), size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little").tobytes())
        left = left[~alone[at]]
    return levels


def slots_of(levels: list[bytes], digests: np.ndarray) -> np.ndarray:
    """The slot of each digest, 0 to n - 1 without gaps over the members; -1, or any slot, for what is no member."""
    halves, out, base = _halves(digests), np.full(len(digests), -1, np.int64), 0
    left = np.arange(len(digests))
    for level, packed in enumerate(levels):
        bits = np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little")
        at = _places(halves[left], level, len(bits))
        hit = bits[at] == 1
        out[left[hit]] = base + np.cumsum(bits, dtype=np.int64)[at[hit]] - 1
        base, left = base + int(bits.sum()), left[~hit]
    return out


def _array(digests) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, digests)), np.uint8).reshape(-1, DIGEST)


def digest_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", old: Column | None = None) -> DataFrame:
    """(at, id, digest, chars, old), written: every row with a number of its own. The texts are read here only."""
    text = text_of(text_col)
    own = F.lit(True) if old is None else F.coalesce(old, F.lit(False))
    return write_table(df.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).cast("bigint").alias("id"), normal_digest(text).alias("digest"), F.length(text).alias("chars"), own.alias("old")))


def digest_groups(rows: DataFrame) -> DataFrame:
    """(digest, n, short, no_id, id, at): the rows of each digest and its winner: the most characters, then the smallest id, none last, then the first row."""
    best = F.min(F.struct((-F.col("chars")).alias("short"), F.col("id").isNull().cast("int").alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), "at"))
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), best.alias("x")).select("digest", "n", "x.*")


def _bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """One row a bucket: (bucket, levels, digests, n, short, no_id, id, at), with the digests end to end and the rest as arrays, all by slot."""

    def build(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        digests = _array(g["digest"])
        levels = perfect_hash(digests)
        order = np.argsort(slots_of(levels, digests))
        row = {"bucket": key[0], "levels": levels, "digests": digests[order].tobytes()} | {c: g[c].to_numpy(np.int64)[order] for c in _SLOT}
        return pd.DataFrame([row])

    schema = "bucket bigint, levels array<binary>, digests binary, " + ", ".join(f"{c} array<bigint>" for c in _SLOT)
    return _bucketed(groups, buckets).groupBy("bucket").applyInPandas(build, schema)


def look_up(groups: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """(digest, n, short, no_id, id, at, member): the index's slots with the rows of the groups that are members joined to them, and the nonmembers.

    member is true for digests of the index. Of two winners the better one stays; rows are added.
    """
    names = ["digest", *_SLOT, "member"]

    def meet(fresh: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        digests = _array(fresh["digest"])
        cells = {c: fresh[c].to_numpy(np.int64) for c in _SLOT}
        if not len(held):
            return pd.DataFrame({"digest": fresh["digest"], **cells, "member": False})[names]
        row = held.iloc[0]
        known = np.frombuffer(row["digests"], np.uint8).reshape(-1, DIGEST)
        slot = slots_of(list(row["levels"]), digests)
        found = slot >= 0
        found[found] = (known[slot[found]] == digests[found]).all(1)
        old = {c: np.array(row[c], np.int64) for c in _SLOT}
        at, better, open_ = slot[found], np.zeros(int(found.sum()), bool), np.ones(int(found.sum()), bool)
        for c in _ORDER:
            new, was = cells[c][found], old[c][at]
            better |= open_ & (new < was)
            open_ &= new == was
        old["n"][at] += cells["n"][found]
        for c in _ORDER:
            old[c][at[better]] = cells[c][found][better]
        first = pd.DataFrame({"digest": [x.tobytes() for x in known], **old, "member": True})
        rest = pd.DataFrame({"digest": fresh["digest"].to_numpy()[~found], **{c: v[~found] for c, v in cells.items()}, "member": False})
        return pd.concat([first, rest])[names]

    schema = "digest binary, " + ", ".join(f"{c} bigint" for c in _SLOT) + ", member boolean"
    return _bucketed(groups, buckets).groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(meet, schema)


def bucket_number(groups: DataFrame) -> int:
    """As many buckets as the digests need; on few digests, enough to keep all tasks busy."""
    return max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-groups.count() // BUCKET))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", history: Column | None = None) -> DataFrame:
    """(id, keep_id, group_size, kept, member, text_sha256) for every row: its group of equal texts and the row of it that stays.

    The row with the most code points in the original text stays, then the smallest id, rows without an id last; of rows equal in both,
    one. keep_id is null where no row of the group has an id. history is a condition on the rows of df that are the history; by default the
    half of them with an even hash of the id. It decides how much is looked up, never the result, except for member: whether the
    history holds the text. Null and empty texts, and those of white space only, are one group. Texts are read whole; other columns go; an
    empty table gives an empty one.
    """
    old = F.pmod(F.xxhash64(id_col), F.lit(2)) == 0 if history is None else history
    rows = digest_rows(df, id_col, text_col, old)
    past, fresh = write_table(digest_groups(rows.where("old"))), digest_groups(rows.where("not old"))
    buckets = bucket_number(past)
    index = write_table(build_index(past, buckets))
    groups = write_table(look_up(fresh, index, buckets))
    for table in (past, index):
        drop_table(table)
    told = groups.select("digest", F.col("n").alias("rows"), F.col("n").alias("group_size"), F.when(F.col("no_id") == 0, F.col("id")).alias("keep_id"), F.col("at").alias("keep_at"), "member")
    out = join_told(rows.select("at", "id", "digest"), told, "digest", "rows")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("at") == F.col("keep_at")).alias("kept"), "member", F.lower(F.hex("digest")).alias("text_sha256"))
