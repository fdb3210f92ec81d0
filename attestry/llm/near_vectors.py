"""Embedding near-dedup by an epsilon grid order join.

Unit vectors are projected on their leading principal directions and sorted by the cells of a grid over them, finer
than the join distance. The sorted sequence is cut into runs of vectors; a tree of intervals over the runs is joined with itself
from the root down, and a pair of intervals whose boxes are farther apart than the join distance is skipped with all
below it. Inside a surviving pair of runs the recursion goes on: pairs of short pieces of the sequence whose boxes are
too far apart are skipped, all others are compared exactly, in double precision. An orthonormal projection never
lengthens a distance, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import NO_ID, connected_components, drop_table, hash_sample, join_told, write_table

COSINE = 0.95
#: Principal directions come from about so many vectors, by hash: they steer the order, never the result.
SAMPLE_ROWS = 4000
DIRECTIONS = 8
#: Grid cells in a join distance: a finer grid makes boxes narrow in more directions.
FINE = 4
#: Vectors of a run, which is the unit that is shipped, and of a piece, which is the unit that is compared.
RUN, PIECE = 8192, 64
FANOUT = 8


def _unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _stack(values, width: int) -> np.ndarray:
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        out[i, : len(v)] = v
    return out


def principal_directions(vectors: DataFrame, width: int, rows: int, sample_rows: int = SAMPLE_ROWS, directions: int = DIRECTIONS) -> np.ndarray:
    """width x directions orthonormal columns from a sample of a set size."""
    some = hash_sample(vectors.select("vector"), ["vector"], sample_rows, rows).toPandas()
    x = _unit(_stack(some["vector"], width)) if len(some) else np.zeros((1, width))
    return np.linalg.eigh(x.T @ x / len(x))[1][:, ::-1][:, :directions]


def _packed(x: np.ndarray) -> bytes:
    """Doubles, or floats where those hold the same values."""
    small = x.astype(np.float32)
    return b"f" + small.tobytes() if (small == x).all() else b"d" + x.tobytes()


def _loaded(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.float32 if raw[:1] == b"f" else np.float64, offset=1).reshape(-1, width).astype(float)


def _runs(vectors: DataFrame, basis: np.ndarray, width: int, side: float, run: int, piece: int) -> DataFrame:
    """Runs of the grid order, written: box, boxes of the pieces, members (rep, copies, length) and their vectors, as bytes."""
    q = basis.shape[1]

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        return pd.Series(list(_unit(_stack(vectors, width)) @ basis)) if len(vectors) else pd.Series([], dtype=object)

    cells = [F.floor(F.col("point")[i] / side).alias(f"cell{i}") for i in range(q)]
    placed = vectors.withColumn("point", project("vector")).select("rep", "copies", "vector", "point", *cells)
    order = [f"cell{i}" for i in range(q)]
    shuffles = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = placed.repartitionByRange(shuffles, *order, "rep").sortWithinPartitions(*order, "rep")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held, k, part = [], 0, TaskContext.get().partitionId()

        def emit(rows: pd.DataFrame) -> pd.DataFrame:
            points, starts = np.stack(rows["point"].to_numpy()), np.arange(0, len(rows), piece)
            low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
            return pd.DataFrame(
                [{
                    "part": part, "k": k, "lo": points.min(0), "hi": points.max(0), "boxes": np.stack([low, high]).tobytes(), "reps": rows["rep"].to_numpy(np.int64).tobytes(),
                    "copies": rows["copies"].to_numpy(np.int64).tobytes(), "lengths": rows["vector"].map(len).to_numpy(np.int64).tobytes(), "vectors": _packed(_stack(rows["vector"], width)),
                }]
            )

        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= run:
                rows = pd.concat(held, ignore_index=True)
                yield emit(rows[:run])
                held, k = [rows[run:]], k + 1
        if held and sum(map(len, held)):
            yield emit(pd.concat(held, ignore_index=True))

    shape = "part int, k int, lo array<double>, hi array<double>, boxes binary, reps binary, copies binary, lengths binary, vectors binary"
    return write_table(ranged.select("rep", "copies", "vector", "point").mapInPandas(cut, shape))


def _ranked(runs: DataFrame) -> DataFrame:
    """The runs with their place in the whole sequence; what is ordered in one task is one row a partition."""
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", F.coalesce(F.sum("_n").over(ahead), F.lit(0))).drop("_n")
    return runs.join(F.broadcast(offsets), "part").withColumn("rank", (F.col("_o") + F.col("k")).cast("bigint")).drop("part", "k", "_o")


def _box_gap(a: str, b: str):
    """Squared distance of two boxes."""
    gaps = F.transform(
        F.arrays_zip(F.col(f"{a}.lo").alias("al"), F.col(f"{a}.hi").alias("ah"), F.col(f"{b}.lo").alias("bl"), F.col(f"{b}.hi").alias("bh")),
        lambda z: F.greatest(F.lit(0.0), z["al"] - z["bh"], z["bl"] - z["ah"]),
    )
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def interval_pairs(boxes: DataFrame, reach: float) -> DataFrame:
    """(a, b) with a <= b: pairs of runs within reach, by a self-join of the interval tree from the root down."""
    n = boxes.count()
    depth, span = 0, 1
    while span < n:
        depth, span = depth + 1, span * FANOUT
    width = len(boxes.select("lo").first()[0]) if n else 0
    pairs = boxes.sparkSession.createDataFrame([(0, 0)] if n else [], "a bigint, b bigint")
    for level in range(depth - 1, -1, -1):
        step = FANOUT**level
        ends = [f(F.col(c)[i]).alias(f"{c}{i}") for f, c in ((F.min, "lo"), (F.max, "hi")) for i in range(width)]
        nodes = boxes.groupBy(F.expr(f"rank div {step}").alias("node")).agg(*ends).select("node", F.array(*[f"lo{i}" for i in range(width)]).alias("lo"), F.array(*[f"hi{i}" for i in range(width)]).alias("hi"))
        kids = lambda c: F.explode(F.sequence(F.col(c) * FANOUT, F.col(c) * FANOUT + FANOUT - 1))
        wide = pairs.withColumn("a", kids("a")).withColumn("b", kids("b")).where("a <= b")
        near = wide.join(nodes.select(F.col("node").alias("a"), F.struct("lo", "hi").alias("x")), "a").join(nodes.select(F.col("node").alias("b"), F.struct("lo", "hi").alias("y")), "b")
        upper, pairs = pairs, write_table(near.where(_box_gap("x", "y") <= reach * reach).select("a", "b"))
        drop_table(upper)
    return pairs


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of the edges u-v that are not their component's root, the smallest node."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, root = at[: len(u)], at[len(u) :], np.arange(len(ids))
    while True:
        low = np.minimum(root[u], root[v])
        fresh = root.copy()
        np.minimum.at(fresh, u, low)
        np.minimum.at(fresh, v, low)
        fresh = fresh[fresh]
        if (fresh == root).all():
            break
        root = fresh
    inner = root != np.arange(len(ids))
    return ids[inner], ids[root[inner]]


def _compare(a: dict, b: dict | None, width: int, cosine: float, reach: float, piece: int) -> tuple[np.ndarray, ...]:
    """(rep, links) by vector and (rep, root) of a spanning forest of one pair of runs (b None: of a with itself)."""
    ints = lambda raw: np.frombuffer(raw, np.int64)

    def load(run: dict) -> tuple:
        v = _loaded(run["vectors"], width)
        v /= np.abs(v).max(1, keepdims=True)
        low, high = np.frombuffer(run["boxes"]).reshape(2, -(-len(v) // piece), -1)
        return ints(run["reps"]), ints(run["copies"]), ints(run["lengths"]), v, np.sqrt((v * v).sum(1)), low, high

    ra, ca, la, x, nx, alow, ahigh = load(a)
    rb, cb, lb, y, ny, blow, bhigh = (ra, ca, la, x, nx, alow, ahigh) if b is None else load(b)
    links_a, links_b, edges = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64), []
    for i in range(len(alow)):
        gap = np.maximum(0, np.maximum(alow[i] - bhigh, blow - ahigh[i]))
        near = np.repeat((gap * gap).sum(1) <= reach * reach, piece)[: len(y)]
        s = slice(i * piece, (i + 1) * piece)
        at = np.flatnonzero(near)
        if not len(at):
            continue
        some = y if len(at) == len(y) else y[at]
        cos = (x[s] @ some.T) / (nx[s][:, None] * ny[at][None, :])
        hit = (cos >= cosine) & (la[s][:, None] == lb[at][None, :])
        if b is None:
            hit &= np.arange(s.start, s.start + len(hit))[:, None] != at[None, :]
        if not hit.any():
            continue
        links_a[s] += hit @ cb[at]
        links_b[at] += ca[s] @ hit
        p, r = np.nonzero(hit)
        edges.append(_forest(ra[s][p], rb[at][r]))  # at most one edge a vector, however many links
    if not edges:
        return (np.zeros(0, np.int64),) * 4
    rep, links = (ra, links_a) if b is None else (np.concatenate([ra, rb]), np.concatenate([links_a, links_b]))
    node, root = _forest(*(np.concatenate(v) for v in zip(*edges, strict=True)))
    return rep[links > 0], links[links > 0], node, root


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, run: int = RUN, piece: int = PIECE) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of df.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing: n_links 0, a
    component of their own. Vectors of different lengths never link. Equal vectors are compared once, with their
    number; repeated rows count as vectors. kept is true for the smallest id of each component. A component whose vectors
    have no id has none itself. Ids are below 2^62. Other columns of df go.
    """
    column = F.col("vector")
    fine = column.isNotNull() & F.forall(column, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(column, lambda v: v != 0)
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("key", F.when(F.col("fine"), F.sha2(F.array_join(F.transform("vector", lambda v: v.cast("string")), ","), 256)))
    distinct = write_table(rows.where("fine").groupBy("key").agg(F.coalesce(F.min("id"), F.pmod(F.xxhash64("key"), F.lit(NO_ID)) + NO_ID).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector")))
    width, number = distinct.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    width = width or 1
    basis = principal_directions(distinct, width, number)
    reach = float(np.sqrt(2 - 2 * cosine)) + 1e-6
    runs = _runs(distinct.select("rep", "copies", "vector"), basis, width, reach / FINE, run, piece)
    ranked = _ranked(runs)
    boxes = write_table(ranked.select("rank", "lo", "hi"))
    pairs = interval_pairs(boxes, reach)
    sides = pairs.select(F.col("a").alias("rank"), "a", "b", F.lit(0).alias("side")).unionByName(pairs.where("a <> b").select(F.col("b").alias("rank"), "a", "b", F.lit(1).alias("side")))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = sides.join(ranked.drop("lo", "hi"), "rank").repartition(parts, "a", "b").sortWithinPartitions("a", "b", "side").drop("rank")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = None
        for batch in batches:
            for one in batch.to_dict("records"):
                if one["side"] == 0:
                    first = one
                    if one["a"] != one["b"]:
                        continue
                rep, links, node, root = _compare(first, None if one["side"] == 0 else one, width, cosine, reach, piece)
                if len(rep):
                    told = pd.DataFrame({"rep": rep, "links": links, "to": pd.array([None] * len(rep), "Int64")})
                    yield pd.concat([told, pd.DataFrame({"rep": node, "links": 0, "to": pd.array(root, "Int64")})], ignore_index=True)

    found = write_table(work.mapInPandas(compare, "rep bigint, links bigint, to bigint"))
    parts = connected_components(found.where("to is not null").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    links = found.where("to is null").groupBy("rep").agg(F.sum("links").alias("links"))
    told = distinct.select("key", "rep", "copies").join(links, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    told = write_table(told.select("key", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("bigint").alias("links"), F.coalesce("component", "rep").alias("component")))
    for table in (runs, boxes, pairs, found, distinct):
        drop_table(table)
    linked = join_told(rows.where("fine").select("id", "key"), told, "key", "copies").select("id", "links", "component")
    alone = rows.where("not fine").select("id", F.lit(0).cast("bigint").alias("links"), F.col("id").alias("component"))
    out = linked.withColumn("component", F.when(F.col("component") < NO_ID, F.col("component"))).unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("links").alias("n_links"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))
