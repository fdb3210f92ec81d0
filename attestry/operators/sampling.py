"""Splits, folds, bootstrap draws and permutations as pure functions of (seed, stable id)."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions.scalars import hash32
from attestry.operators.running import renamed, same_keys, sums_before

# Fixed value: the root of all named seeds.
ROOT = 20260922


def derive(name: str, n: int) -> list[int]:
    """n seeds for a named experiment; the first ones do not depend on n."""
    return [int(x) for x in np.random.SeedSequence([ROOT, zlib.crc32(name.encode())]).generate_state(n) >> 1]


def seeds(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("seed"))


def hash_rank(df: DataFrame, by: list[str], h: Column, key: str, out: str) -> DataFrame:
    """Adds the rank of (h, key) within by, exactly, in two levels: 4,096 ranges of the 32-bit hash are counted, then ranked inside. Nulls in by are groups of their own."""
    cut = df.withColumn("_h", h).withColumn("_c", F.shiftright("_h", 20))
    ahead = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(ahead), F.lit(0)))
    inside = Window.partitionBy(*by, "_c").orderBy("_h", key)
    told = renamed(offsets.withColumnRenamed("_c", "_to"), by, "_to", "_o")
    met = cut.withColumn("_r", F.row_number().over(inside)).join(told, same_keys(by) & (F.col("_c") == F.col("_to")))
    return met.select(*df.columns, (F.col("_r") + F.col("_o")).alias(out))


def hash_split(df: DataFrame, key: str, seed: Column, by: list[str], share: float = 0.2, kind: str = "split") -> DataFrame:
    """Adds is_test for exactly ceil(share n) rows of each group of by: the first by (hash, key).

    The hashes are counted in 4,096 ranges. Rows of all ranges but the one that holds the border know their side from their hash alone;
    only that range is ranked, so no row outside it is shuffled. The borders, a row a group, are settled first: by the size of what
    was written Spark knows them to be few and sends them to the rows, or, if groups are very many, joins by key.
    """
    from attestry.sources.readers import settled

    cut = df.withColumn("_h", hash32(seed, kind, F.col(key))).withColumn("_c", F.shiftright("_h", 20))
    group = Window.partitionBy(*by)
    ahead = group.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut.groupBy(*by, "_c").agg(F.count(F.lit(1)).alias("_n"))
    ranges = ranges.withColumn("_o", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).withColumn("_k", F.ceil(F.sum("_n").over(group) * share))
    border = ranges.where("_o < _k and _k <= _o + _n").withColumn("_need", F.col("_k") - F.col("_o")).withColumnRenamed("_c", "_edge")
    sided = cut.join(settled(renamed(border, by, "_edge", "_need")), same_keys(by))
    sure = sided.where("_c <> _edge").withColumn("is_test", F.col("_c") < F.col("_edge"))
    close = sided.where("_c = _edge").withColumn("is_test", F.row_number().over(group.orderBy("_h", key)) <= F.col("_need"))
    columns = [*df.columns, "is_test"]
    return sure.select(*columns).unionByName(close.select(*columns))


def group_split(df: DataFrame, group: str, seed: int, share: float = 0.2) -> DataFrame:
    """Adds is_test for ceil(share g) of the groups, whole; the groups are ranked in ranges of their hash. Rows without a group are one group."""
    groups = df.select(group).distinct().withColumn("_all", F.lit(0))
    told = hash_split(groups, group, F.lit(seed), ["_all"], share, "group")
    return df.join(renamed(told, [group], "is_test"), same_keys([group])).select(*df.columns, "is_test")


def stratified_folds(df: DataFrame, key: str, label: str, seed: Column | int, k: int, by: list[str] | None = None) -> DataFrame:
    """Adds fold 0..k-1, balanced within each class; rows without a label are a class too."""
    ranked = hash_rank(df, [*(by or []), label], hash32(seed, "fold", F.col(key)), key, "_rank")
    return ranked.withColumn("fold", ((F.col("_rank") - 1) % k).cast("bigint")).drop("_rank")


#: Positions that one row of a draw's plan stands for, and positions of a cell of the join: a draw meets the values of its cell.
_DEAL, _CELL = 8192, 2


def bootstrap_weights(df: DataFrame, strata: list[str], values: list[str], draws: int, seed: int, seen: bool = False, times: str | None = None, few: int | None = None) -> DataFrame:
    """(b, strata, values, drawn): how often each combination of values is drawn from its stratum, as many rows as it has, with replacement.

    Rows of equal values are alike for any statistic over them, so they are counted first and stand side by side at
    positions 0 to size - 1 of their stratum, in order of the values; draw k of replicate b takes position hash(seed, b, stratum, k) mod size.
    No row is ranked or joined: what is dealt out is draws, spread over tasks by position. With seen, also size and seen, the rows and
    the different rows drawn, and combinations that a replicate does not draw. times names a column that says how many rows a row is. Strata with nulls are left out; values are numbers without nulls.
    Where there are no more than few combinations (FEW if not given) each task has them all, and no draw is a row.
    """
    from attestry.operators.replicates import FEW, few_weights
    from attestry.sources.readers import settled

    counts = df.dropna(subset=strata).groupBy(*strata, *values).agg((F.sum(times) if times else F.count(F.lit(1))).alias("_n"))
    if few is None or few:
        counts = settled(counts)
        if 0 < counts.limit((FEW if few is None else few) + 1).count() <= (FEW if few is None else few):
            return few_weights(counts.withColumn("_n", F.col("_n").cast("bigint")), strata, values, draws, seed, seen)
    placed = sums_before(counts, strata, values, ["_n"]).withColumn("_to", F.col("before__n") + F.col("_n"))
    cells = placed.withColumn("_cell", F.explode(F.sequence(F.expr(f"before__n div {_CELL}"), F.expr(f"(_to - 1) div {_CELL}"))))
    sizes = counts.groupBy(*strata).agg(F.sum("_n").alias("_size"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sizes.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_size - 1) div {_DEAL}")))).repartition(parts, *strata, "_part")
    picks = dealt.withColumn("_k", F.explode(F.sequence(F.col("_part") * _DEAL, F.least((F.col("_part") + 1) * _DEAL, F.col("_size")) - 1)))
    picks = picks.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    picks = picks.select(*strata, "b", (hash32(seed, F.col("b"), *[F.col(s) for s in strata], F.col("_k")) % F.col("_size")).alias("_at"))
    hits = picks.groupBy(*strata, "b", "_at").agg(F.count(F.lit(1)).alias("_w")) if seen else picks.withColumn("_w", F.lit(1).cast("bigint"))
    met = hits.withColumn("_cell", F.expr(f"_at div {_CELL}")).join(cells, [*strata, "_cell"]).where((F.col("before__n") <= F.col("_at")) & (F.col("_at") < F.col("_to")))
    out = met.groupBy("b", *strata, *values).agg(F.sum("_w").alias("drawn"), F.count(F.lit(1)).alias("seen"))
    if not seen:
        return out.drop("seen")
    every = counts.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    zero = F.lit(0).cast("bigint")
    return every.join(out, ["b", *strata, *values], "left").select("b", *strata, *values, F.coalesce("drawn", zero).alias("drawn"), F.coalesce("seen", zero).alias("seen"), F.col("_n").alias("size"))


#: Distinct values of a leaf of the splitting tree, and replicates that a task draws for it.
LEAF, REPLICATES = 1024, 128


def _leaf_total(total: int, sizes: np.ndarray, leaf: int, keys: tuple[int, ...]) -> int:
    """How many of total draws fall to a leaf: from the root down, each node's draws are split by a binomial that its own hash seeds."""
    low, high, left = 0, len(sizes), total
    while high - low > 1 and left:
        mid = (low + high) // 2
        here, before = int(sizes[low:high].sum()), int(sizes[low:mid].sum())
        first = int(np.random.Generator(np.random.Philox(np.random.SeedSequence([*keys, low, high]))).binomial(left, before / here)) if here else 0
        low, high, left = (low, mid, first) if leaf < mid else (mid, high, left - first)
    return left


def split_weights(df: DataFrame, strata: list[str], values: list[str], draws: int, seed: int, times: str | None = None) -> DataFrame:
    """(b, strata, values, drawn): what bootstrap_weights gives, by a tree of binomials over the cumulative counts of the distinct values.

    The rows of a stratum are drawn with replacement, as many as it has. A replicate's counts are multinomial: its draws are split
    between halves of the values, and again, down to leaves of LEAF values, whose counts come from one generator a leaf and replicate. So the cost is
    distinct values x replicates, whatever the number of rows, and every leaf is a task's own work, seeded by where it is in the tree. Strata with nulls are left out.
    """
    rows = F.sum(times) if times else F.count(F.lit(1))
    counts = df.dropna(subset=strata).groupBy(*strata, *values).agg(rows.cast("bigint").alias("_n")).where("_n > 0")
    hashed = counts.withColumn("_st", F.xxhash64(*strata) if strata else F.lit(0).cast("bigint")).withColumn("_place", F.xxhash64(*values) if values else F.lit(0).cast("bigint"))
    sizes = hashed.groupBy("_st").agg(F.count(F.lit(1)).alias("_k"))
    # Leaves are ranges of the values' hash: about LEAF values each, whatever their distribution.
    leaves = F.greatest(F.lit(1), F.ceil(F.col("_k") / LEAF)).cast("bigint")
    placed = hashed.join(F.broadcast(sizes), "_st").withColumn("_leaf", F.floor(F.pmod("_place", F.lit(1 << 40)) * leaves / F.lit(1 << 40)).cast("bigint"))  # a row a stratum
    tops = placed.groupBy("_st", "_leaf").agg(F.sum("_n").alias("_m"), F.max(leaves).alias("_c"))
    trees = tops.groupBy("_st").agg(F.max("_c").alias("_c"), F.sort_array(F.collect_list(F.struct("_leaf", "_m"))).alias("_sizes"))  # a leaf is LEAF values
    types = {f.name: f.dataType.simpleString() for f in counts.schema.fields}
    parts = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // REPLICATES)))

    def draw(held: pd.DataFrame, tree: pd.DataFrame) -> pd.DataFrame:
        if not len(held):
            return pd.DataFrame(columns=["b", *strata, *values, "drawn"])
        leaf, part, sizes_ = int(held["_leaf"].iloc[0]), int(held["_part"].iloc[0]), np.zeros(int(tree["_c"].iloc[0]), np.int64)
        for x in tree["_sizes"].iloc[0]:
            sizes_[x["_leaf"]] = x["_m"]
        held = held.sort_values(["_place", "_n"], kind="stable")
        n, total, st = held["_n"].to_numpy(np.int64), int(sizes_.sum()), int(held["_st"].iloc[0]) & ((1 << 64) - 1)
        hits, times_, which = [], [], []
        for b in range(part * REPLICATES, min(draws, (part + 1) * REPLICATES)):
            keys = (seed, b, st)
            left = _leaf_total(total, sizes_, leaf, keys)
            got = np.random.Generator(np.random.Philox(np.random.SeedSequence([*keys, leaf]))).multinomial(left, n / n.sum())
            hits.append(np.flatnonzero(got))
            times_.append(got[hits[-1]])
            which.append(np.full(len(hits[-1]), b, np.int32))
        return held[[*strata, *values]].iloc[np.concatenate(hits)].assign(b=np.concatenate(which), drawn=np.concatenate(times_))[["b", *strata, *values, "drawn"]]

    schema = ", ".join(["b int", *[f"`{c}` {types[c]}" for c in (*strata, *values)], "drawn bigint"])
    spread = trees.join(tops.select("_st", "_leaf"), "_st").select(F.col("_st").alias("_st2"), F.col("_leaf").alias("_leaf2"), "_c", "_sizes", parts.alias("_part2"))
    return placed.withColumn("_part", parts).groupBy("_st", "_leaf", "_part").cogroup(spread.groupBy("_st2", "_leaf2", "_part2")).applyInPandas(draw, schema)


def matched_draw(pool: DataFrame, target: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Rows of the pool with the target's number of rows in each class, without replacement."""
    want = target.groupBy(label).agg(F.count(F.lit(1)).alias("want"))
    return hash_rank(pool, [label], hash32(seed, "matched", F.col(key)), key, "r").join(want, label).where("r <= want").drop("r", "want")


def permute(df: DataFrame, key: str, label: str, seed: Column, by: list[str]) -> DataFrame:
    """The label column dealt anew within by: rank by one hash meets rank by another, both in ranges of the hash. Null labels are dealt like others."""
    a = hash_rank(df.drop(label), by, hash32(seed, "place", F.col(key)), key, "_rank")
    b = hash_rank(df.select(*by, key, label, seed.alias("_seed")), by, hash32(F.col("_seed"), "perm", F.col(key)), key, "_rank")
    told = renamed(b.withColumnRenamed("_rank", "_at"), by, label, "_at")
    return a.join(told, same_keys(by) & (F.col("_rank") == F.col("_at"))).select(*[c for c in df.columns if c != label], label)


def second_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows without replacement, for a second look: the first by hash, in order of the key."""
    first = df.withColumn("_h", hash32(seed, "second", F.col(key))).orderBy("_h", key).limit(n)  # a report of n rows
    return first.drop("_h").orderBy(key)


def uniform(seed, *parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    return (hash32(seed, *parts) + F.lit(0.5)) / F.lit(4294967296.0)


def normal(seed, *parts: Column) -> Column:
    """A standard normal number from two hashes of the parts (Box-Muller)."""
    return F.sqrt(-2 * F.ln(uniform(seed, F.lit("r"), *parts))) * F.cos(F.lit(6.283185307179586) * uniform(seed, F.lit("a"), *parts))


def contamination(df: DataFrame, key: str, group: str, test: DataFrame) -> DataFrame:
    """Share of test rows whose group also has a row outside the test set."""
    inside = df.join(test.select(key), key, "left_semi")
    outside = df.join(test.select(key), key, "left_anti").select(group).distinct().withColumn("hit", F.lit(1))
    return inside.join(outside, group, "left").agg(F.count(F.lit(1)).alias("n_test"), F.count("hit").alias("n_hit"), F.round(F.count("hit") / F.nullif(F.count(F.lit(1)), F.lit(0)), 9).alias("share"))


def split_edges(df: DataFrame, key: str, seeds: list[int], share: float = 0.2, kind: str = "split") -> DataFrame:
    """(i, seed, edge, edge_key, n_test): the last test row of hash_split for each seed, by (hash, key); i numbers the seeds.

    Hashes are counted in 4,096 ranges a seed; only rows of the range that holds the border are ranked.
    """
    table = df.sparkSession.createDataFrame([(i, int(s)) for i, s in enumerate(seeds)], "i int, seed bigint")
    each = df.select(F.col(key).alias("_key"), F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(int(s)).cast("bigint").alias("seed")) for i, s in enumerate(seeds)])).alias("_s")).select("_key", "_s.i", hash32(F.col("_s.seed"), kind, F.col("_key")).alias("_h"))
    each = each.withColumn("_c", F.shiftright("_h", 20))
    group = Window.partitionBy("i")
    ahead = group.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    ranges = each.groupBy("i", "_c").agg(F.count(F.lit(1)).alias("_n"))
    ranges = ranges.withColumn("_o", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).withColumn("n_test", F.ceil(F.sum("_n").over(group) * share).cast("bigint"))
    border = ranges.where("_o < n_test and n_test <= _o + _n").select("i", "_c", "_o", "n_test")
    close = each.join(F.broadcast(border), ["i", "_c"])  # a row a seed
    last = close.withColumn("_r", F.row_number().over(group.orderBy("_h", "_key")) + F.col("_o")).where("_r = n_test")
    return last.join(F.broadcast(table), "i").select("i", "seed", F.col("_h").alias("edge"), F.col("_key").alias("edge_key"), "n_test")


def contamination_by_seed(df: DataFrame, key: str, group: str, seeds: list[int], share: float = 0.2) -> DataFrame:
    """(seed, n_test, n_hit, share): for each seed's split, the test rows whose group also has a row outside the test set.

    Only rows of groups of two or more can be hit. Each of those rows gets one bit a seed, in words of 64; a group's rows outside the test set are
    or-ed into one bitmap, and a row's hits are its own bits under that. So all seeds share one shuffle of the groups. Null groups are one group.
    """
    from attestry.sources.readers import settled

    edges = settled(split_edges(df, key, seeds, share))
    some = df.select(F.col(key).alias("_key"), F.xxhash64(group).alias("_g"))
    shared = some.groupBy("_g").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_g")
    words = edges.groupBy(F.expr("i div 64").alias("word")).agg(F.collect_list(F.struct((F.col("i") % 64).alias("bit"), "seed", "edge", "edge_key")).alias("cuts"))
    rows = some.join(shared, "_g", "left_semi").withColumn("word", F.explode(F.sequence(F.lit(0), F.lit((len(seeds) - 1) // 64)))).withColumn("word", F.col("word").cast("bigint"))
    one = F.lit(1).cast("bigint")
    flag = lambda x: F.call_function("shiftleft", one, x["bit"].cast("int"))

    def test(x: Column) -> Column:
        h = hash32(x["seed"], "split", F.col("_key"))
        return (h < x["edge"]) | ((h == x["edge"]) & (F.col("_key") <= x["edge_key"]))

    bits = F.aggregate("cuts", F.lit(0).cast("bigint"), lambda a, x: F.when(test(x), a.bitwiseOR(flag(x))).otherwise(a))
    every = F.aggregate("cuts", F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(flag(x)))
    told = settled(rows.join(F.broadcast(words), "word").select("_g", "word", bits.alias("inside"), every.alias("every")))  # a row for 64 seeds
    outside = told.groupBy("_g", "word").agg(F.bit_or(F.col("every").bitwiseAND(F.bitwise_not("inside"))).alias("outside"))
    hits = told.join(outside, ["_g", "word"]).select("word", F.col("inside").bitwiseAND(F.col("outside")).alias("hit")).where("hit <> 0")
    set_bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("hit", b) == 1)
    each = hits.select("word", F.explode(set_bits).alias("bit")).groupBy((F.col("word") * 64 + F.col("bit")).alias("i")).agg(F.count(F.lit(1)).alias("n_hit"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return edges.withColumn("i", F.col("i").cast("bigint")).join(each, "i", "left").select("seed", "n_test", hit.alias("n_hit"), F.round(hit / F.col("n_test"), 9).alias("share"))
