"""Exact nearest neighbours of all rows by pivots.

Sampled pivots cut the rows of a run into cells: a row is in the cell of its nearest pivot. The neighbours in a query's own cell bound the
distance of its k-th neighbour; by the triangle inequality a cell whose pivot is farther away than that bound and the cell's radius holds none of
the k, and is not visited. Rows and queries of large cells are dealt into parts. Of equal vectors only the k first keys can be
neighbours, so many copies of one row cost no more than k.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.sources.readers import settled

#: Rows of a cell, about, and rows of a part of it; pivots of a run at most, which are sent to all tasks.
CELL_ROWS, PART_ROWS, PIVOTS = 512, 4096, 4096
#: Distances are rounded to so many digits of their square before they are compared.
DIGITS = 9


def _pivots(rows: DataFrame, cell_rows: int, most: int) -> dict[int, np.ndarray]:
    """{run: pivots}: training rows whose hash is small, about one for cell_rows rows, at least one and at most most."""
    sized = rows.where("train").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    wanted = F.greatest(F.lit(1), F.least(F.lit(most), F.ceil(F.col("n") / cell_rows)))
    hashed = rows.where("train").join(F.broadcast(sized.select("run", "n", wanted.alias("want"))), "run").withColumn("h", F.pmod(F.xxhash64("key", F.lit(11)), F.lit(1 << 40)))  # a row a run
    some = hashed.where(F.col("h") * F.col("n") <= F.col("want") * F.lit(float(1 << 40)) * 0.9).select("run", "h", "x")
    first = hashed.groupBy("run").agg(F.min(F.struct("h", "x")).alias("m")).select("run", "m.*")
    out: dict[int, list] = {}
    for r in sorted(some.unionByName(first).distinct().collect(), key=lambda r: (r.run, r.h)):
        out.setdefault(r.run, []).append(r.x)
    return {k: np.array(v[:most], float).reshape(len(v[:most]), -1) for k, v in out.items()}


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a[:, None, :] - b[None, :, :]) ** 2).sum(2)


def _placed(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds cell and far, the distance to its pivot."""

    def go(batches):
        for g in batches:
            out = []
            for run, part in g.groupby("run", sort=False):
                for s in range(0, len(part), 1024):
                    some = part.iloc[s : s + 1024]
                    d = _squares(np.stack(some["x"].to_numpy()).astype(float), pivots[run])
                    out.append(some.assign(cell=d.argmin(1).astype(np.int32), far=np.sqrt(d.min(1))))
            if out:
                yield pd.concat(out)

    known = rows.where(F.col("run").isin(*pivots)) if pivots else rows.limit(0)
    return known.mapInPandas(go, "run int, key bigint, y int, train boolean, test boolean, x array<double>, cell int, far double")


def _first_copies(rows: DataFrame, k: int) -> DataFrame:
    """Training rows without those that k equal vectors with smaller keys come before; in two levels, so that no vector meets in one task."""
    salted = rows.where("train").withColumn("_salt", F.pmod(F.xxhash64("key"), F.lit(64)))
    for by in (["run", "x", "_salt"], ["run", "x"]):
        salted = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("key"))).where(F.col("_r") <= k)
    return salted.drop("_salt", "_r")


def _met(queries: DataFrame, train: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(run, key, truth, near, d, y): for queries (run, key, cell, ...) the k nearest rows of the cell in each of its parts."""

    def deal(df: DataFrame, own: str, other: str, key: str) -> DataFrame:
        dealt = df.join(F.broadcast(parts), ["run", "cell"])  # a row a cell
        return dealt.select(*df.columns, F.pmod(F.xxhash64(key), F.col(f"n_{own}")).alias(own), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"n_{other}") - 1)).alias(other))

    left = deal(queries.select("run", "cell", "key", "x", F.col("y").alias("truth")), "q", "p", "key")
    right = deal(train.select("run", "cell", F.col("key").alias("near"), "x", "y"), "p", "q", "near")

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("near", kind="stable")
            x, ids, labels = np.stack(b["x"].to_numpy()).astype(float), b["near"].to_numpy(), b["y"].to_numpy()
            for s in range(0, len(a), 256):
                some = a.iloc[s : s + 256]
                d = np.round(_squares(np.stack(some["x"].to_numpy()).astype(float), x), DIGITS)
                d[some["key"].to_numpy()[:, None] == ids[None, :]] = np.inf
                at = np.argsort(d, axis=1, kind="stable")[:, :k]  # by key among equals
                got = np.take_along_axis(d, at, 1)
                row, col = np.nonzero(np.isfinite(got))
                out.append(pd.DataFrame({"run": some["run"].to_numpy()[row], "key": some["key"].to_numpy()[row], "truth": some["truth"].to_numpy()[row], "near": ids[at[row, col]], "d": got[row, col], "y": labels[at[row, col]]}))
        return pd.concat(out) if out else pd.DataFrame([], columns=["run", "key", "truth", "near", "d", "y"])

    by = ["run", "cell", "p", "q"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(nearest, "run int, key bigint, truth int, near bigint, d double, y int")


def nearest_rows(rows: DataFrame, k: int, cell_rows: int = CELL_ROWS, part_rows: int = PART_ROWS, most_pivots: int = PIVOTS, told: dict | None = None) -> DataFrame:
    """(run, key, truth, near, d, y, rank): the k nearest training rows of each test row of the run, d squared, ties by key; itself never.

    rows are (run, key, y, train, test, x): vectors of equal length within a run, without nulls, keys unique in a run. A run without training rows has no
    neighbours. told, if given, gets the pairs of queries and training rows that were compared and how many there are.
    """
    placed = settled(_placed(rows, pivots := _pivots(rows, cell_rows, most_pivots)))
    train = settled(_first_copies(placed, k + 1))
    sizes = placed.where("test").groupBy("run", "cell").agg(F.count(F.lit(1)).alias("nq"))
    cells = settled(train.groupBy("run", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).join(sizes, ["run", "cell"], "left"))
    # Bounded by the pivots: one row a cell.
    radii: dict[int, list] = {}
    for r in cells.select("run", "cell", "radius").collect():
        radii.setdefault(r.run, []).append((r.cell, r.radius))
    shape = {run: (np.array([c for c, _ in v]), np.array([r for _, r in v], float)) for run, v in radii.items()}
    queries = placed.where("test")
    own = parts_of(cells, part_rows)
    near = settled(_met(queries, train, own, k))
    bound = near.groupBy("run", "key").agg(F.count(F.lit(1)).alias("n"), F.max("d").alias("worst"), F.sort_array(F.collect_list("d")).alias("all"))
    bound = bound.select("run", "key", F.when(F.col("n") >= k, F.sqrt(F.get("all", F.lit(k - 1)))).alias("bound"))

    def others(batches):
        for g in batches:
            out = []
            for run, part in g.groupby("run", sort=False):
                at, radius = shape.get(run, (np.zeros(0, int), np.zeros(0)))
                d = np.sqrt(_squares(np.stack(part["x"].to_numpy()).astype(float), pivots[run][at]))
                reach = np.nan_to_num(part["bound"].to_numpy(float), nan=np.inf)
                row, col = np.nonzero((d - radius[None, :] <= reach[:, None] * (1 + 1e-9) + 1e-6) & (part["cell"].to_numpy()[:, None] != at[None, :]))
                out.append(pd.DataFrame({"run": np.int32(run), "key": part["key"].to_numpy()[row], "y": part["y"].to_numpy()[row], "x": part["x"].to_numpy()[row], "cell": at[col].astype(np.int32)}))
            if out:
                yield pd.concat(out)

    more = settled(queries.join(bound, ["run", "key"], "left").select("run", "key", "y", "x", "cell", "bound").mapInPandas(others, "run int, key bigint, y int, x array<double>, cell int"))
    visits = more.groupBy("run", "cell").agg(F.count(F.lit(1)).alias("nq"))
    beyond = _met(more, train, parts_of(cells.drop("nq").join(visits, ["run", "cell"]), part_rows), k)
    if told is not None:
        pairs = cells.select((F.col("n") * F.coalesce("nq", F.lit(0))).alias("m")).unionByName(cells.drop("nq").join(visits, ["run", "cell"]).select((F.col("n") * F.col("nq")).alias("m")))
        told["compared"] = pairs.agg(F.sum("m")).first()[0] or 0
        told["pairs"] = rows.groupBy("run").agg((F.count_if("train") * F.count_if("test")).alias("m")).agg(F.sum("m")).first()[0] or 0
    ranked = near.unionByName(beyond).withColumn("rank", F.row_number().over(Window.partitionBy("run", "key").orderBy("d", "near")))
    return ranked.where(F.col("rank") <= k)


def parts_of(cells: DataFrame, part_rows: int) -> DataFrame:
    """(run, cell, n_p, n_q): into how many parts a cell's rows and queries are dealt."""
    parts = lambda c: F.greatest(F.lit(1), F.ceil(F.coalesce(c, F.lit(0)) / part_rows)).cast("bigint").alias
    return cells.select("run", "cell", parts(F.col("n"))("n_p"), parts(F.col("nq"))("n_q"))


def vote(near: DataFrame, ks: list[int], weights: tuple[str, ...] = ("uniform",)) -> DataFrame:
    """(run, key, y, k, weights, score): the share of positives among the k nearest; by inverse distance, a neighbour at distance 0 outweighs all others."""
    each = near.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k").withColumn("weights", F.explode(F.array(*[F.lit(w) for w in weights])))
    worth = F.when(F.col("weights") == "uniform", 1.0).otherwise(F.coalesce(F.try_divide(F.lit(1.0), F.sqrt("d")), F.lit(1e30)))
    return each.groupBy("run", "key", F.col("truth").alias("y_"), "k", "weights").agg((F.sum(worth * F.col("y")) / F.sum(worth)).alias("score")).withColumnRenamed("y_", "y")
