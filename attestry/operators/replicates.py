"""Bootstrap replicates drawn where their values lie: a task holds the distinct values of a group and makes some of its replicates.

What leaves a task is a number or a few counts a replicate, so that draws are no rows. The draws are those of bootstrap_weights and split_weights;
groups of more than HELD distinct values go by those, as rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct values of a group that a task holds, and the most that come back as rows of each replicate.
HELD, FEW = 1 << 20, 4096
#: Positions that are hashed at a time, and distinct values of a leaf of the splitting tree.
_CHUNK, LEAF = 65_536, 1024


def hash_hits(seed: int, b: int, stratum: str, size: int) -> Iterator[np.ndarray]:
    """The positions that a replicate takes from a stratum of so many rows, some at a time: hash32 of seed, b, stratum and draw, mod size."""
    start = f"{seed}:{b}:{stratum}:".encode()
    for low in range(0, size, _CHUNK):
        raw = b"".join([md5(start + b"%d" % k).digest() for k in range(low, min(size, low + _CHUNK))])
        yield np.frombuffer(raw, ">u4")[::4].astype(np.int64) % size


def hash_drawn(seed: int, b: int, stratum: str, n: np.ndarray, seen: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """How often a replicate draws each value of a stratum, whose rows stand side by side in order of the values; with seen also how many different rows."""
    ends, drawn = np.cumsum(n), np.zeros(len(n), np.int64)
    hit = np.zeros(int(ends[-1]) if seen else 0, bool)
    for at in hash_hits(seed, b, stratum, int(ends[-1])):
        drawn += np.bincount(np.searchsorted(ends, at, side="right"), minlength=len(n))
        if seen:
            hit[at] = True
    return drawn, np.add.reduceat(hit, ends - n, dtype=np.int64) if seen else drawn


def _random(*keys: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence(keys)))


def leaf_numbers(place: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, int]:
    """The leaf of each value by its hash, and how many leaves there are."""
    leaves = max(1, -(-len(place) // leaf))
    return np.floor((place % (1 << 40)) * leaves / float(1 << 40)).astype(np.int64), leaves


def tree_drawn(seed: int, b: int, stratum: int, n: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How often a replicate draws each value of a stratum: its draws are split by binomials down to the leaves, which begin at starts, and dealt out there."""
    keys, out = (seed, b, stratum & ((1 << 64) - 1)), np.zeros(len(n), np.int64)
    before = np.concatenate([[0], np.cumsum(n)])[np.append(starts, len(n))]
    open_ = [(0, len(starts), int(before[-1]))]
    while open_:
        low, high, left = open_.pop()
        if not left:
            continue
        if high - low == 1:
            at = slice(starts[low], starts[low + 1] if low + 1 < len(starts) else len(n))
            out[at] = _random(*keys, low).multinomial(left, n[at] / n[at].sum())
            continue
        mid = (low + high) // 2
        here, ahead = int(before[high] - before[low]), int(before[mid] - before[low])
        first = int(_random(*keys, low, high).binomial(left, ahead / here)) if here else 0
        open_ += [(low, mid, first), (mid, high, left - first)]
    return out


def few_weights(counts: DataFrame, strata: list[str], values: list[str], draws: int, seed: int, seen: bool) -> DataFrame:
    """What bootstrap_weights gives for at most FEW combinations (strata, values, _n): each task has them all and hashes the draws of some replicates."""
    each, types = 4, dict(counts.dtypes)
    parts = -(-draws // each)

    def draw(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([*strata, *values], kind="stable")
        out = []
        for b in range(each * int(g["_part"].iloc[0]), min(draws, each * (int(g["_part"].iloc[0]) + 1))):
            for _, s in g.groupby("_stratum", sort=False):
                n = s["_n"].to_numpy(np.int64)
                drawn, rows = hash_drawn(seed, b, s["_stratum"].iloc[0], n, seen)
                out.append(s[[*strata, *values]].assign(b=np.int32(b), drawn=drawn, **({"seen": rows, "size": n} if seen else {})))
        whole = pd.concat(out)
        return whole if seen else whole[whole["drawn"] > 0]

    named = counts.withColumn("_stratum", F.concat_ws(":", *[F.col(s).cast("string") for s in strata])).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    schema = ", ".join(["b int", *[f"`{c}` {types[c]}" for c in (*strata, *values)], "drawn bigint", *(["seen bigint", "size bigint"] if seen else [])])
    order = ["b", *strata, *values, "drawn", *(["seen", "size"] if seen else [])]
    return named.repartition(parts, "_part").groupBy("_part").applyInPandas(lambda g: draw(g)[order], schema)


class Scores:
    """The distinct values of one score: where each row stands among them, and its class; draws of the rows give an AUC."""

    def __init__(self, x: np.ndarray, label: np.ndarray):
        known = ~np.isnan(x)
        distinct, place = np.unique(x[known], return_inverse=True)
        self.rows, self.place, self.number, self.pos = np.flatnonzero(known), place, len(distinct), label[known] == 1

    def auc(self, drawn: np.ndarray) -> tuple[float, float]:
        """The AUC with ties averaged, nan where a class is missing, and the number of rows drawn."""
        w = drawn[self.rows].astype(float)
        p, q = (np.bincount(self.place, w * side, self.number) for side in (self.pos, ~self.pos))
        n1, n0 = p.sum(), q.sum()
        return (float((p * (q.cumsum() - q + q / 2)).sum() / (n1 * n0)) if n1 and n0 else np.nan), float(n1 + n0)


def replicate_aucs(df: DataFrame, strata: list[str], values: list[str], draws: int, seed: int, by: list[str] | None = None, site: str | None = None, tree: bool = False, label: str = "y", held: int | None = None) -> DataFrame:
    """(by, b, auc_<value>, [site_<value>]): the AUC of each value in each bootstrap replicate, null where a class is missing; with site also the mean of site AUCs by rows.

    Rows are drawn with replacement within strata, which hold label, by and site, as bootstrap_weights deals them, or split_weights with tree. A task holds
    a group's distinct values and makes some of its replicates; groups of more than held values are drawn as rows. Rows with nulls in strata are left out.
    """
    from attestry.operators.sampling import bootstrap_weights, split_weights
    from attestry.operators.statistics import auc_by, site_weighted_auc
    from attestry.sources.readers import settled

    by, types = by or [], dict(df.dtypes)
    counts = settled(df.dropna(subset=strata).groupBy(*strata, *values).agg(F.count(F.lit(1)).alias("_n")))
    sizes = counts.groupBy(*by).count().agg(F.count(F.lit(1)).alias("groups"), F.max("count").alias("most")).first()
    names = [f"auc_{v}" for v in values] + [f"site_{v}" for v in values if site]
    schema = ", ".join([*[f"`{c}` {types[c]}" for c in by], "b int", *[f"`{c}` double" for c in names]])
    if not sizes.groups:
        return df.sparkSession.createDataFrame([], schema)
    if sizes.most > (HELD if held is None else held):
        drawn = settled(split_weights(counts, strata, values, draws, seed, "_n") if tree else bootstrap_weights(counts, strata, values, draws, seed, times="_n"))
        out = None
        for v in values:
            part = auc_by(drawn, v, label, [*by, "b"], "drawn").select(*by, "b", F.col("auc").alias(f"auc_{v}"))
            if site:
                part = part.join(site_weighted_auc(drawn, v, site, [*by, "b"], "drawn").select(*by, "b", F.col("auc").alias(f"site_{v}")), [*by, "b"])
            out = part if out is None else out.join(part, [*by, "b"])
        return out.select(*by, "b", *names)
    each = 64 if tree else 4
    parts = -(-draws // each)
    key = F.xxhash64(*strata) if tree else F.concat_ws(":", *[F.col(s).cast("string") for s in strata])
    slim = counts.select(
        *[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], key.alias("_key"), (F.xxhash64(*values) if tree else F.lit(0).cast("bigint")).alias("_place"), (F.xxhash64(site) if site else F.lit(0).cast("bigint")).alias("_site"),
        (F.col(label) == 1).cast("double").alias("_y"), "_n", *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)], F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_part"),
    )
    own, at = [f"_b{i}" for i in range(len(by))], [f"_v{i}" for i in range(len(values))]

    def run(g: pd.DataFrame) -> pd.DataFrame:
        if tree:
            # The leaves of a stratum are side by side, and its values in order of their hash.
            g = g.sort_values(["_key", "_place", "_n"], kind="stable")
        else:
            g = g.sort_values(["_key", *at], kind="stable")
        n, y, where, x = g["_n"].to_numpy(np.int64), g["_y"].to_numpy(), g["_site"].to_numpy(), g[at].to_numpy(float)
        keys, first = np.unique(g["_key"].to_numpy(), return_index=True)
        spans = [slice(a, b) for a, b in zip(first, [*first[1:], len(g)], strict=True)]
        starts = []
        if tree:
            for span in spans:
                leaf, number = leaf_numbers(g["_place"].to_numpy(np.int64)[span])
                order = np.argsort(leaf, kind="stable")
                x[span], y[span], n[span], where[span] = x[span][order], y[span][order], n[span][order], where[span][order]
                starts.append(np.searchsorted(leaf[order], np.arange(number)))
        whole = [Scores(x[:, i], y) for i in range(len(at))]
        sites = [[(np.flatnonzero(where == s), Scores(x[where == s, i], y[where == s])) for s in np.unique(where)] for i in range(len(at))] if site else []
        rows = []
        for b in range(each * int(g["_part"].iloc[0]), min(draws, each * (int(g["_part"].iloc[0]) + 1))):
            drawn = np.zeros(len(g), np.int64)
            for j, (k, span) in enumerate(zip(keys, spans, strict=True)):
                drawn[span] = tree_drawn(seed, b, int(k), n[span], starts[j]) if tree else hash_drawn(seed, b, k, n[span])[0]
            row = [s.auc(drawn)[0] for s in whole]
            for per in sites:
                got = [(a, m) for a, m in (s.auc(drawn[rows_]) for rows_, s in per) if not np.isnan(a)]
                row.append(sum(a * m for a, m in got) / sum(m for _, m in got) if got else np.nan)
            rows.append([*[g[c].iloc[0] for c in own], b, *row])
        return pd.DataFrame(rows, columns=[*by, "b", *names])

    made = slim.repartition(min(1000, sizes.groups * parts), *own, "_part").groupBy(*own, "_part").applyInPandas(run, schema)
    return made.select(*by, "b", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in names])
