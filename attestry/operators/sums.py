"""Many models at once from sums over row blocks.

The rows lie packed in blocks on the executors. A fit is a generator: it yields a function of a block that returns an array of
sums, is sent the total over all blocks, and goes on from there; what it returns scores rows of a block. So seeds, folds, grid points, label
shuffles and trees share their passes, and what reaches the driver are sums and parameters of models, never rows.

Frames of more than one block are driven from the driver, a Spark job a pass. Where all rows are one block, its sums are the
totals: the generators then run to their end in tasks, the models dealt among them. Both ways run the same code and give the same models.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.sources.readers import settled

BLOCK_ROWS, FINER = 65_536, 4
#: Numbers of a total that one row carries.
PIECE = 65_536
#: Candidate cuts of a column; columns of fewer values are cut at each.
BINS = 64
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class Block:
    """Rows of a block: key, label y, measurements x (nan where missing), and named integer codes. held lasts as long as the block stays in a task."""

    def __init__(self, row, numeric: list[str], codes: list[str]):
        self.key = np.frombuffer(row["key"], np.int64)
        self.y = np.frombuffer(row["y"], np.float64)
        self.x = np.frombuffer(row["x"], np.float64).reshape(len(self.key), len(numeric))
        coded = np.frombuffer(row["e"], np.int64).reshape(len(self.key), len(codes))
        self.code = {c: coded[:, i] for i, c in enumerate(codes)}
        self.held: dict = {}

    def keep(self, name: tuple, make: Callable):
        if name not in self.held:
            self.held[name] = make()
        return self.held[name]


@dataclass
class Blocks:
    """The packed rows of a frame, how many blocks they are, and the names of their columns."""

    frame: DataFrame
    number: int
    numeric: list[str]
    codes: list[str]


def pack_rows(df: DataFrame, numeric: list[str], codes: list[str] | None = None, key: str = "rid", label: str = "y", block_rows: int = BLOCK_ROWS) -> Blocks:
    """The rows in blocks of about block_rows, dealt by a hash of the key. Rows without key or label are left out; null codes are -1."""
    codes = codes or []
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    number = -(-rows.count() // block_rows)
    # Rows of more than one block are cut finer, so that passes over them have tasks enough.
    number = number if number < 2 else number * FINER
    coded = F.array(*[F.coalesce(F.col(c).cast("bigint"), F.lit(-1).cast("bigint")) for c in codes]) if codes else F.array().cast("array<bigint>")
    slim = rows.select(F.pmod(F.xxhash64(key), F.lit(max(1, number))).alias("block"), F.col(key).cast("bigint").alias("key"), F.col(label).cast("double").alias("y"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in numeric]).alias("x"), coded.alias("e"))

    def pack(block: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("key", kind="stable")
        flat = lambda c, kind: b"".join(np.asarray(v, kind).tobytes() for v in g[c])
        return pd.DataFrame([{"block": block[0], "key": g["key"].to_numpy(np.int64).tobytes(), "y": g["y"].to_numpy(np.float64).tobytes(), "x": flat("x", np.float64), "e": flat("e", np.int64)}])

    packed = slim.groupBy("block").applyInPandas(pack, "block bigint, key binary, y binary, x binary, e binary")
    return Blocks(settled(packed.repartition(max(1, number))), number, numeric, codes)


def totals(blocks: Blocks, of: dict[int, Callable[[Block], np.ndarray]]) -> dict[int, np.ndarray]:
    """The sums of several arrays over all blocks, in one Spark job: each task adds its own blocks, and pieces of the arrays are added apart."""
    numeric, codes = blocks.numeric, blocks.codes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mine: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, row in batch.iterrows():
                block = Block(row, numeric, codes)
                for fit, one in of.items():
                    got = np.asarray(one(block), float)
                    mine[fit] = mine[fit] + got if fit in mine else got
                    block.held.clear()
        for fit, whole in mine.items():
            flat = whole.ravel()
            yield pd.DataFrame([{"fit": fit, "piece": i // PIECE, "shape": json.dumps(whole.shape), "data": flat[i : i + PIECE].tobytes()} for i in range(0, max(1, len(flat)), PIECE)])

    def add(g: pd.DataFrame) -> pd.DataFrame:
        return g.head(1).assign(data=[sum(np.frombuffer(d, float) for d in g["data"]).tobytes()])

    schema = "fit int, piece int, shape string, data binary"
    parts: dict[int, list] = {}
    for r in blocks.frame.mapInPandas(run, schema).groupBy("fit", "piece").applyInPandas(add, schema).collect():
        parts.setdefault(r["fit"], []).append(r)
    return {fit: np.concatenate([np.frombuffer(r["data"], float) for r in sorted(rows, key=lambda r: r["piece"])]).reshape(json.loads(rows[0]["shape"])) for fit, rows in parts.items()}


def driven_together(blocks: Blocks, fits: list[Iterator]) -> list:
    """What fits return after all their passes, each a Spark job that they share; fits that are done drop out."""
    out, going = [None] * len(fits), dict.fromkeys(range(len(fits)))
    while going:
        for i, got in list(going.items()):
            try:
                going[i] = next(fits[i]) if got is None else fits[i].send(got)
            except StopIteration as done:
                out[i] = done.value
                del going[i]
        if going:
            going = totals(blocks, going)
    return out


def driven(blocks: Blocks, fit: Iterator) -> object:
    """What a fit returns after all its passes, each a Spark job."""
    return driven_together(blocks, [fit])[0]


def _driven(fit, summed: Callable) -> object:
    try:
        of = next(fit)
        while True:
            of = fit.send(summed(of))
    except StopIteration as done:
        return done.value


SCORES = "run int, part int, key bigint, y int, score double"
#: Runs that share their passes at most.
SHARED = 1024


def scored(blocks: Blocks, runs: list[dict], fit: Callable[[list[dict], list[str]], Iterator], parts: tuple[int, ...] = (1,), per_task: int = 16) -> DataFrame:
    """(run, part, key, y, score): the rows of each run by its fitted model; part 1 are test rows, 0 training rows.

    fit(runs, numeric) is a generator that returns score(block, i) -> (training rows, test rows, labels, scores). run is the place in runs; more runs
    than per_task are fitted in turn, so that what a pass sums stays bounded.
    """
    numeric, codes = blocks.numeric, blocks.codes
    spark = blocks.frame.sparkSession
    chunks = [list(range(i, min(len(runs), i + per_task))) for i in range(0, len(runs), per_task)]
    if not blocks.number or not runs:
        return spark.createDataFrame([], SCORES)

    def rows_of(block: Block, score: Callable, at: list[int]) -> Iterator[pd.DataFrame]:
        for i, run in enumerate(at):
            train, test, y, p = score(block, i)
            for part in parts:
                m = test if part else train
                yield pd.DataFrame({"run": np.int32(run), "part": np.int32(part), "key": block.key[m], "y": y[m].astype(np.int32), "score": p[m]})

    cells = CELL_LEARNERS.get(fit)
    if blocks.number == 1:
        work = blocks.frame.withColumn("work", F.explode(F.array(*[F.lit(json.dumps(c)) for c in chunks]))).repartition(len(chunks), "work")

        def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, row in batch.iterrows():
                    at, block = json.loads(row["work"]), Block(row, numeric, codes)
                    own, here = [runs[i] for i in at], lambda of, block=block: np.asarray(of(block), float)
                    score = cells and fitted_here(block, own, numeric, cells)
                    yield from rows_of(block, score or _driven(fit(own, numeric), here), at)

        return work.mapInPandas(go, SCORES)
    if cells and (whole := scored_by_cells(blocks, runs, cells, chunks, rows_of)) is not None:
        return whole
    out = []
    # What trees sum is large, so their chunks are fitted in turn; other fits share their passes.
    waves = [[c] for c in chunks] if cells else [chunks[i : i + max(1, SHARED // per_task)] for i in range(0, len(chunks), max(1, SHARED // per_task))]
    for wave in waves:
        scores = driven_together(blocks, [fit([runs[i] for i in at], numeric) for at in wave])

        def apply(batches: Iterator[pd.DataFrame], scores=scores, wave=wave) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, row in batch.iterrows():
                    block = Block(row, numeric, codes)
                    for score, at in zip(scores, wave, strict=True):
                        yield from rows_of(block, score, at)
                        block.held.clear()

        out.append(settled(blocks.frame.mapInPandas(apply, SCORES)))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def design_rows(blocks: Blocks, runs: list[dict]) -> DataFrame:
    """(run, key, y, train, test, x): every row that a run trains or tests on, with the run's features."""
    view, numeric, codes = View(runs, blocks.numeric), blocks.numeric, blocks.codes
    schema = "run int, key bigint, y int, train boolean, test boolean, x array<double>"
    if not blocks.number or not runs:
        return blocks.frame.sparkSession.createDataFrame([], schema)
    driven(blocks, view.design())

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                block = Block(row, numeric, codes)
                for i in range(len(runs)):
                    train, test = view.sides(block, i)
                    m = train | test
                    yield pd.DataFrame({"run": np.int32(i), "key": block.key[m], "y": view.label(block, i)[m].astype(np.int32), "train": train[m], "test": test[m], "x": list(view.features(block, i)[m])})

    return blocks.frame.mapInPandas(go, schema)


# Hashes and exact order statistics


def mixed(seed: int, *keys) -> np.ndarray:
    """A 64-bit hash of a seed and integers."""
    x = np.uint64(seed * int(_K1) % (1 << 64))
    for k in keys:
        x = (x ^ np.asarray(k, np.int64).view(np.uint64)) * _K2
        x = (x ^ (x >> np.uint64(29))) * _K1
        x = x ^ (x >> np.uint64(32))
    return x


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers in the same order."""
    z = np.ascontiguousarray(x + 0.0).view(np.uint64)
    top = np.uint64(1) << np.uint64(63)
    return np.where(z & top, ~z, z | top)


def back(u: np.ndarray) -> np.ndarray:
    top = np.uint64(1) << np.uint64(63)
    return np.where(u & top, u ^ top, ~u).astype(np.uint64).view(np.float64)


def select(number: int, values: Callable, ranks: Callable):
    """Exact order statistics of many sets at once, a byte a pass: values(block, i) are the unsigned integers of set i, ranks(sizes) the wanted ranks from 0.

    Returns the values and the sizes; of an empty set the value means nothing.
    """
    prefix, left, sizes = np.zeros(number, np.uint64), None, None
    for shift in range(56, -1, -8):
        base, at = np.uint64(shift), np.uint64(min(63, shift + 8))

        def count(block: Block, prefix=prefix, base=base, at=at, first=shift == 56) -> np.ndarray:
            out = np.zeros((number, 256))
            for i in range(number):
                u = values(block, i)
                u = u if first else u[(u >> at) == prefix[i]]
                out[i] = np.bincount(((u >> base) & np.uint64(255)).astype(np.int64), minlength=256)
            return out

        counts = yield count
        up = counts.cumsum(1)
        if left is None:
            sizes = up[:, -1]
            left = np.asarray(ranks(sizes), float)
        digit = np.minimum((up <= left[:, None]).sum(1), 255)
        left = left - np.where(digit > 0, np.take_along_axis(up, np.maximum(digit - 1, 0)[:, None], 1)[:, 0], 0)
        prefix = prefix << np.uint64(8) | digit.astype(np.uint64)
    return prefix, sizes


# What a run trains and tests on, and its design


#: What of a run says its rows and features.
DESIGN = ("columns", "flags", "arm", "split", "group", "train_not", "test_is", "test_not", "scale", "impute")


class View:
    """Rows, labels and features of each run.

    A run is a dict: columns (used measurements), flags (measurements whose absence is a feature), and either split (a seed: a fifth of the rows, or
    of the groups in the code column group, is tested), or train_not, test_is and test_not: pairs of a code column and a value. Training rows have none
    of the first, test rows all of the second and none of the third. A run may name arm (a code column that is 1 for the rows it works on) and label (a code
    column in place of y), and the scopes scale and impute: train or full.
    """

    def __init__(self, runs: list[dict], numeric: list[str]):
        self.runs, self.numeric = runs, numeric
        self.columns = [[numeric.index(c) for c in r["columns"]] for r in runs]
        self.flags = [[numeric.index(c) for c in r.get("flags", ())] for r in runs]
        # Runs that differ in their learner only have one design: each is like the first such run.
        named = [json.dumps({k: r[k] for k in DESIGN if k in r}, sort_keys=True) for r in runs]
        self.like = np.array([named.index(n) for n in named], int)
        self.border = np.zeros(len(runs), np.uint64)
        self.middle = self.mean = self.sd = None

    def live(self, block: Block, i: int) -> np.ndarray:
        arm = self.runs[i].get("arm")
        return np.ones(len(block.key), bool) if arm is None else block.code[arm] == 1

    def _place(self, block: Block, i: int) -> np.ndarray:
        group = self.runs[i].get("group")
        return mixed(self.runs[i]["split"], block.key if group is None else block.code[group])

    def sides(self, block: Block, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The training and the test rows."""

        def make():
            live, run = self.live(block, i), self.runs[i]
            if "split" in run:
                test = self._place(block, i) <= self.border[i]
                return live & ~test, live & test
            train, test = live.copy(), live.copy()
            for c, v in run["train_not"]:
                train &= block.code[c] != v
            for c, v in run["test_is"]:
                test &= block.code[c] == v
            for c, v in run.get("test_not", ()):
                test &= block.code[c] != v
            return train, test

        return block.keep(("sides", int(self.like[i])), make)

    def label(self, block: Block, i: int) -> np.ndarray:
        name = self.runs[i].get("label")
        return block.y if name is None else block.code[name].astype(float)

    def borders(self):
        """The hash below which a split's ceil(share n) rows, or groups, lie. A group counts once: at the row whose code head is 1."""
        if not any("split" in r for r in self.runs):
            return

        def values(block: Block, i: int) -> np.ndarray:
            if "split" not in self.runs[i] or self.like[i] != i:
                return np.zeros(0, np.uint64)
            rows = self.live(block, i)
            return self._place(block, i)[rows if self.runs[i].get("group") is None else rows & (block.code["head"] == 1)]

        border, _ = yield from select(len(self.runs), values, lambda n: np.maximum(np.ceil(n * 0.2) - 1, 0))
        self.border = border[self.like]

    def _stat(self, block: Block, i: int, scope: str) -> np.ndarray:
        return self.live(block, i) if self.runs[i].get(scope, "train") == "full" else self.sides(block, i)[0]

    def medians(self):
        """The exact median of each measurement over the run's rows of the scope impute; 0 where there is none."""
        m, d = len(self.runs), len(self.numeric)

        def values(block: Block, i: int) -> np.ndarray:
            j, c = divmod(i // 2, d)
            if c not in self.columns[j] or self.like[j] != j:
                return np.zeros(0, np.uint64)

            def make():
                v = block.x[self._stat(block, j, "impute"), c]
                return ordered(v[~np.isnan(v)])

            return block.keep(("ranked", j, c), make)

        ranks = lambda n: np.where(np.arange(len(n)) % 2 == 0, np.maximum((n - 1) // 2, 0), n // 2)
        found, sizes = yield from select(2 * m * d, values, ranks)
        pair = back(found).reshape(m, d, 2)
        self.middle = np.where(sizes.reshape(m, d, 2)[:, :, 0] > 0, np.nan_to_num(pair.mean(2)), 0.0)[self.like]

    def moments(self):
        """Mean and population deviation over the rows of the scope scale, after imputation; the deviation of a constant is 1."""
        m, d, own = len(self.runs), len(self.numeric), np.unique(self.like)

        def first(block: Block) -> np.ndarray:
            out = np.zeros((m, d + 1))
            block.held = {k: v for k, v in block.held.items() if k[0] != "ranked"}
            for i in own:
                rows = self._stat(block, i, "scale")
                out[i, :d], out[i, d] = self.filled(block, i)[rows].sum(0), rows.sum()
            return out

        got = (yield first)[self.like]
        n = np.maximum(got[:, d:], 1)
        self.mean = got[:, :d] / n

        def second(block: Block) -> np.ndarray:
            out = np.zeros((m, d))
            for i in own:
                out[i] = ((self.filled(block, i)[self._stat(block, i, "scale")] - self.mean[i]) ** 2).sum(0)
            return out

        sd = np.sqrt((yield second)[self.like] / n)
        self.sd = np.where(sd == 0, 1.0, sd)

    def filled(self, block: Block, i: int) -> np.ndarray:
        return np.where(np.isnan(block.x), self.middle[i], block.x)

    def features(self, block: Block, i: int) -> np.ndarray:
        def make():
            c = self.columns[i]
            scaled = (self.filled(block, i)[:, c] - self.mean[i][c]) / self.sd[i][c]
            return np.column_stack([scaled, np.isnan(block.x[:, self.flags[i]]).astype(float)])

        return block.keep(("features", int(self.like[i])), make)

    def width(self, i: int) -> int:
        return len(self.columns[i]) + len(self.flags[i])

    def design(self):
        yield from self.borders()
        yield from self.medians()
        yield from self.moments()

    def scorer(self, of: Callable) -> Callable:
        return lambda block, i: (*self.sides(block, i), self.label(block, i), of(block, i))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


# Learners


def logistic(runs: list[dict], numeric: list[str], steps: int = 25):
    """Logistic regressions with an l2 penalty of 1 / c, a Newton step of all runs a pass; settled runs drop out."""
    view = View(runs, numeric)
    yield from view.design()
    d = max(view.width(i) for i in range(len(runs))) + 1
    w, open_ = np.zeros((len(runs), d)), np.ones(len(runs), bool)

    def design(block: Block, i: int) -> np.ndarray:
        x = view.features(block, i)
        return np.column_stack([x, np.ones(len(x))])

    def trained(block: Block, i: int) -> np.ndarray:
        return block.keep(("trained", int(view.like[i])), lambda: design(block, i)[view.sides(block, i)[0]])

    for _ in range(steps):

        def sums(block: Block) -> np.ndarray:
            out = np.zeros((len(runs), d + d * d))
            for i in np.flatnonzero(open_):
                rows, k = view.sides(block, i)[0], view.width(i) + 1
                a, y = trained(block, i), view.label(block, i)[rows]
                p = sigmoid(a @ w[i, :k])
                out[i, :k] = a.T @ (y - p)
                out[i, d : d + k * k] = ((a.T * (p * (1 - p))) @ a).ravel()
            return out

        got = yield sums
        for i in np.flatnonzero(open_):
            k = view.width(i) + 1
            ridge = np.diag([1 / runs[i].get("c", 1.0)] * (k - 1) + [1e-9])
            step = np.clip(np.linalg.solve(got[i, d : d + k * k].reshape(k, k) + ridge, got[i, :k] - ridge @ w[i, :k]), -5, 5)
            w[i, :k] += step
            open_[i] = np.abs(step).max() >= 1e-10
        if not open_.any():
            break
    return view.scorer(lambda block, i: sigmoid(design(block, i) @ w[i, : view.width(i) + 1]))


def bin_cuts(number: int, bins: int = BINS):
    """For each measurement the values at its bins - 1 inner quantiles, over all rows: where trees may cut."""
    each = bins - 1

    def values(block: Block, i: int) -> np.ndarray:
        return block.keep(("ordered", i // each), lambda: ordered(block.x[:, i // each][~np.isnan(block.x[:, i // each])]))

    ranks = lambda n: np.floor(n * ((np.arange(len(n)) % each) + 1) / bins)
    found, sizes = yield from select(number * each, values, lambda n: np.minimum(ranks(n), np.maximum(n - 1, 0)))
    points = back(found).reshape(number, each)
    return [np.unique(p) if n else np.zeros(0) for p, n in zip(points, sizes.reshape(number, each)[:, 0], strict=True)]


class Trees:
    """T binary trees a run, grown together level by level. A code of at most cut goes left, a missing value (code 0) the way that gains more."""

    def __init__(self, runs: int, trees: int):
        self.feature, self.cut, self.lost, self.left, self.value = ([np.full((trees, 1), v, kind) for _ in range(runs)] for v, kind in ((-1, np.int16), (0, np.int16), (False, bool), (0, np.int32), (0.0, float)))

    def widen(self, i: int, more: int) -> None:
        for held, v in ((self.feature, -1), (self.cut, 0), (self.lost, False), (self.left, 0), (self.value, 0.0)):
            held[i] = np.concatenate([held[i], np.full((len(held[i]), more), v, held[i].dtype)], 1)

    def step(self, codes: np.ndarray, i: int, row: np.ndarray, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The leaf that each row comes to in its tree from its node on."""
        node, going = node.copy(), np.arange(len(node))
        while True:
            going = going[self.feature[i][tree[going], node[going]] >= 0]
            if not len(going):
                return node
            t, v = tree[going], node[going]
            code = codes[row[going], self.feature[i][t, v]]
            node[going] = self.left[i][t, v] + ~np.where(code == 0, self.lost[i][t, v], code <= self.cut[i][t, v])

    def leaves(self, codes: np.ndarray, i: int, rows: np.ndarray) -> np.ndarray:
        """Values of the chosen rows, (rows, trees)."""
        t = len(self.feature[i])
        row, tree = np.repeat(np.flatnonzero(rows), t), np.tile(np.arange(t), int(rows.sum()))
        return self.value[i][tree, self.step(codes, i, row, tree, np.zeros(len(row), np.int64))].reshape(-1, t)


def _entries(w: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, tree, root, weight, target) of rows with a weight."""
    row, tree = np.nonzero(w)
    return row, tree, np.zeros(len(row), np.int64), w[row, tree], g[row, tree]


def best_cuts(w: np.ndarray, g: np.ndarray, ridge: float, least: float) -> tuple[np.ndarray, ...]:
    """For histograms (nodes, features, bins) of weights and targets: the gain of each feature's best cut, the cut, whether missing goes left, and the left sums."""
    all_w, all_g = w.sum(2, keepdims=True), g.sum(2, keepdims=True)

    def up(h: np.ndarray) -> np.ndarray:
        out = h.cumsum(2)
        out -= h[:, :, :1]
        return out

    ways = []
    # Where nothing is missing both ways are the same; the first of equal ones is missing to the left.
    for lost in (True, False) if w[:, :, 0].any() else (True,):
        lw, lg = up(w), up(g)
        if lost:
            lw, lg = lw + w[:, :, :1], lg + g[:, :, :1]
        rw, rg = all_w - lw, all_g - lg
        allowed = (lw >= least) & (rw >= least)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            gain = lg * lg / (lw + ridge) + rg * rg / (rw + ridge) - all_g * all_g / (all_w + ridge)
        # Sums of floats differ in their last digits by the order of blocks: gains that far apart are ties, the first of which is taken.
        gain = np.where(allowed, np.round(gain, 9), -np.inf)
        at = gain.argmax(2)[..., None]
        ways.append([np.take_along_axis(a, at, 2)[..., 0] for a in (gain, lw, lg)] + [at[..., 0]])
    gain, lw, lg, cut = ways[0]
    lost = np.ones(gain.shape, bool)
    if len(ways) > 1:
        # Ties go to the lower cut, then to the left.
        better = (ways[1][0] > gain) | ((ways[1][0] == gain) & (ways[1][3] < cut))
        gain, lw, lg, cut = (np.where(better, y, x) for x, y in zip(ways[0], ways[1], strict=True))
        lost = ~better
    return gain, cut, lost, lw, lg


def grow(trees: Trees, runs: int, codes: Callable, weights: Callable, depth: list[int], ridge: float, least: float, order: Callable | None, bins: int, features: list[int]):
    """Grows all trees of all runs, a pass a level: weights and targets of every open node by feature and bin are all that is summed.

    weights(block, i) gives (rows, trees) weights and targets; order(i, tree, node) the features in the order they are tried: the
    first that can be cut is; without it the best of all is.
    """
    front = [(np.arange(len(trees.feature[i])), np.zeros(len(trees.feature[i]), np.int64)) for i in range(runs)]
    for level in range(max(depth) + 1):
        offsets = np.cumsum([0] + [len(front[i][0]) * features[i] * bins for i in range(runs)])
        if not offsets[-1]:
            break

        def sums(block: Block, front=front, offsets=offsets, level=level) -> np.ndarray:
            out = np.zeros((2, offsets[-1]))
            if not level:
                block.held = {k: v for k, v in block.held.items() if k[0] != "open"}
            for i in range(runs):
                if not len(front[i][0]):
                    continue
                c, size = codes(block, i), offsets[i + 1] - offsets[i]
                slot = np.full(trees.feature[i].shape, -1)
                slot[front[i]] = np.arange(len(front[i][0]))
                # Rows in open nodes, one entry a tree; they go on from where the last pass left them, if this block was here then.
                row, tree, node, w, g = block.held.pop(("open", trees, i), None) or _entries(*weights(block, i))
                node = trees.step(c, i, row, tree, node)
                at = slot[tree, node]
                row, tree, node, w, g = (v[at >= 0] for v in (row, tree, node, w, g))
                block.held["open", trees, i] = row, tree, node, w, g
                at = at[at >= 0]
                for f in range(features[i]):
                    place = (at * features[i] + f) * bins + c[row, f]
                    out[0, offsets[i] : offsets[i + 1]] += np.bincount(place, w, size)
                    out[1, offsets[i] : offsets[i + 1]] += np.bincount(place, g, size)
            return out

        got, following = (yield sums), []
        for i in range(runs):
            tree, node = front[i]
            if not len(tree):
                following.append(front[i])
                continue
            w, g = got[:, offsets[i] : offsets[i + 1]].reshape(2, len(tree), features[i], bins)
            all_w, all_g = w[:, 0].sum(1), g[:, 0].sum(1)
            if level == 0:
                trees.value[i][tree, node] = np.where(all_w + ridge > 0, all_g / np.maximum(all_w + ridge, 1e-300), 0.0)
            rows, some = np.arange(len(tree)), np.full(len(tree), level < depth[i])
            if order is None:
                gain, cut, lost, lw, lg = best_cuts(w, g, ridge, least)
                f = gain.argmax(1)
                gain, cut, lost, lw, lg = (a[rows, f] for a in (gain, cut, lost, lw, lg))
                some &= gain > 1e-6
            else:
                # Grown until nodes are pure: a feature can cut where its values fill two bins.
                some &= np.abs(all_g) * np.abs(all_w - all_g) > 1e-9
                tried = order(i, tree, node)
                f = np.take_along_axis(tried, np.take_along_axis((w > 0).sum(2) > 1, tried, 1).argmax(1)[:, None], 1)[:, 0]
                gain, cut, lost, lw, lg = (a[:, 0] for a in best_cuts(w[rows, f][:, None], g[rows, f][:, None], ridge, least))
                some &= gain > -np.inf
            cuts = np.flatnonzero(some)
            if not len(cuts):
                following.append((tree[:0], node[:0]))
                continue
            t, v, f, cut, lost, lw, lg = (a[cuts] for a in (tree, node, f, cut, lost, lw, lg))
            nth = np.arange(len(t)) - np.searchsorted(t, t)  # among the cuts of its tree; nodes are in order of trees
            width = trees.feature[i].shape[1]
            trees.widen(i, 2 * (int(nth.max()) + 1))
            left = width + 2 * nth
            trees.feature[i][t, v], trees.cut[i][t, v], trees.lost[i][t, v], trees.left[i][t, v] = f, cut, lost, left
            for side, (cw, cg) in enumerate(((lw, lg), (all_w[cuts] - lw, all_g[cuts] - lg))):
                trees.value[i][t, left + side] = cg / (cw + ridge)
            both = np.concatenate([t, t]), np.concatenate([left, left + 1])
            by = np.lexsort((both[1], both[0]))
            following.append((both[0][by], both[1][by]))
        front = following
    return trees


def _coded(view: View, cuts: list[np.ndarray]) -> Callable:
    """Bins of each run's columns: 0 where missing; runs with a scope impute have the bin of their median there."""

    def codes(block: Block, i: int) -> np.ndarray:
        def make():
            bare = block.keep(("codes",), lambda: np.stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(q, v)) for q, v in zip(cuts, block.x.T, strict=True)], 1))
            c = view.columns[i]
            if view.runs[i].get("impute") in ("train", "full"):
                fill = np.array([1 + np.searchsorted(cuts[j], view.middle[i][j]) for j in c])
                return np.where(bare[:, c] == 0, fill, bare[:, c])
            return bare[:, c]

        return block.keep(("codes", i), make)

    return codes


def _prepared(view: View):
    yield from view.borders()
    if any(r.get("impute") in ("train", "full") for r in view.runs):
        yield from view.medians()
    cuts = yield from bin_cuts(len(view.numeric))
    return _coded(view, cuts), 2 + max(map(len, cuts))


def _spread(view: View, block: Block, i: int, of: Callable) -> np.ndarray:
    """Values for the rows that the run trains or tests on, in the place of all rows."""
    train, test = view.sides(block, i)
    out = np.zeros(len(train))
    out[train | test] = of(train | test)
    return out


#: Chances that a row is taken more than so many times into a bag with one draw a row on average.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]))


def forest(runs: list[dict], numeric: list[str], depth: int = 24):
    """Random forests: bags are Poisson weights from a hash of (seed, tree, row), each node is cut at one feature, drawn by hash among those that can be cut.

    A run's trees (100 if not given) are grown down to pure nodes or the depth. With impute native, missing values go the way that gains more.
    """
    view = View(runs, numeric)
    codes, bins = yield from _prepared(view)
    counts = [r.get("trees", 100) for r in runs]
    trees = Trees(len(runs), max(counts))
    bag = [r.get("bag", r.get("split", 0)) for r in runs]

    def weights(block: Block, i: int) -> tuple[np.ndarray, np.ndarray]:
        u = (mixed(bag[i] + 1, block.key[:, None], np.arange(max(counts))[None, :]) >> np.uint64(11)).astype(float) / float(1 << 53)
        w = (np.searchsorted(_POISSON, u, side="right") * view.sides(block, i)[0][:, None]).astype(float)
        return w, w * view.label(block, i)[:, None]

    def order(i: int, tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        return np.argsort(mixed(bag[i] + 2, tree[:, None], node[:, None], np.arange(len(view.columns[i]))[None, :]), axis=1, kind="stable")

    yield from grow(trees, len(runs), codes, weights, [r.get("depth", depth) for r in runs], 0.0, 1.0, order, bins, [len(c) for c in view.columns])
    return view.scorer(lambda block, i: _spread(view, block, i, lambda rows: trees.leaves(codes(block, i), i, rows).mean(1)))


def decision_tree(runs: list[dict], numeric: list[str], depth: int = 24):
    """Single trees on the rows as they are, the best cut of all features at each node."""
    view = View(runs, numeric)
    codes, bins = yield from _prepared(view)

    def weights(block: Block, i: int) -> tuple[np.ndarray, np.ndarray]:
        w = view.sides(block, i)[0].astype(float)[:, None]
        return w, w * view.label(block, i)[:, None]

    trees = yield from grow(Trees(len(runs), 1), len(runs), codes, weights, [r.get("depth", depth) for r in runs], 0.0, 1.0, None, bins, [len(c) for c in view.columns])
    return view.scorer(lambda block, i: _spread(view, block, i, lambda rows: trees.leaves(codes(block, i), i, rows)[:, 0]))


def boosted(runs: list[dict], numeric: list[str]):
    """Logistic boosting: trees, depth and rate are the run's; second-order gains with ridge 1 and at least a weight of 1 a side.

    Runs grow their k-th trees together; runs with fewer trees are done earlier.
    """
    view = View(runs, numeric)
    codes, bins = yield from _prepared(view)
    counts, rates = [r.get("trees", 100) for r in runs], [r.get("rate", 0.1) for r in runs]
    made: list[Trees] = []

    def margin(block: Block, i: int) -> np.ndarray:
        done, f = block.held.get(("margin", i), (0, np.zeros(len(block.key))))
        for t in made[done : counts[i]]:
            f = f + rates[i] * t.leaves(codes(block, i), i, np.ones(len(f), bool))[:, 0]
        block.held["margin", i] = (min(len(made), counts[i]), f)
        return f

    for k in range(max(counts)):

        def weights(block: Block, i: int) -> tuple[np.ndarray, np.ndarray]:
            p, rows = sigmoid(margin(block, i)), view.sides(block, i)[0]
            return (p * (1 - p) * rows)[:, None], ((view.label(block, i) - p) * rows)[:, None]

        depth = [r.get("depth", 3) if k < counts[i] else -1 for i, r in enumerate(runs)]
        fresh = yield from grow(Trees(len(runs), 1), len(runs), codes, weights, depth, 1.0, 1.0, None, bins, [len(c) for c in view.columns])
        made.append(fresh)
    return view.scorer(lambda block, i: sigmoid(margin(block, i)))


def network(runs: list[dict], numeric: list[str], steps: int = 200, rate: float = 0.02, patience: int = 20):
    """Networks of rectified units by Adam on gradient sums with an l2 penalty; a tenth of the training rows, by hash, says when to stop.

    Layers and alpha are the run's. A run whose loss aside does not fall for so many steps keeps its best weights and drops out.
    """
    view = View(runs, numeric)
    yield from view.design()
    m = len(runs)
    shapes, weights = [], []
    for i, r in enumerate(runs):
        sizes, rng = [view.width(i), *r.get("layers", (16,)), 1], np.random.default_rng(r.get("seed", 0))
        shapes.append(list(zip(sizes, sizes[1:], strict=False)))
        weights.append(np.concatenate([np.concatenate([rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b)]) for a, b in shapes[i]]))
    width = max(map(len, weights))
    first, second, kept = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], [w.copy() for w in weights]
    best, since, open_ = np.full(m, np.inf), np.zeros(m, int), np.ones(m, bool)

    def layers(i: int, w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in shapes[i]:
            out.append((w[at : at + a * b].reshape(a, b), w[at + a * b : at + a * b + b]))
            at += a * b + b
        return out

    def forward(i: int, w: np.ndarray, x: np.ndarray) -> list[np.ndarray]:
        acts, own = [x], layers(i, w)
        for k, (a, c) in enumerate(own):
            z = acts[-1] @ a + c
            acts.append(np.maximum(z, 0) if k + 1 < len(own) else z)
        return acts

    def parted(block: Block, i: int) -> tuple:
        """The rows that are trained on and those aside, with their features."""

        def make():
            train, x = view.sides(block, i)[0], view.features(block, i)
            aside = train & (mixed(runs[i].get("seed", 0) + 3, block.key) % np.uint64(10) == 0)
            return (train & ~aside, x[train & ~aside]), (aside, x[aside])

        return block.keep(("parted", int(view.like[i]), runs[i].get("seed", 0)), make)

    for step in range(1, steps + 1):

        def sums(block: Block) -> np.ndarray:
            out = np.zeros((m, width + 3))
            for i in np.flatnonzero(open_):
                (rows, x), (aside, x_aside), y = *parted(block, i), view.label(block, i)
                acts = forward(i, weights[i], x)
                d, grads = sigmoid(acts[-1]) - y[rows][:, None], []
                for k, (a, _) in reversed(list(enumerate(layers(i, weights[i])))):
                    grads.append(np.concatenate([(acts[k].T @ d).ravel(), d.sum(0)]))
                    d = (d @ a.T) * (acts[k] > 0)
                g = np.concatenate(grads[::-1])
                p = np.clip(sigmoid(forward(i, weights[i], x_aside)[-1][:, 0]), 1e-9, 1 - 1e-9)
                out[i, : len(g)] = g
                out[i, width:] = rows.sum(), aside.sum(), -(y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p)).sum()
            return out

        got = yield sums
        for i in np.flatnonzero(open_):
            n, n_aside, loss = got[i, width:]
            if n_aside and loss / n_aside < best[i] - 1e-5:
                best[i], since[i], kept[i] = loss / n_aside, 0, weights[i].copy()
            elif n_aside:
                since[i] += 1
            if not n or since[i] >= patience:
                open_[i] = False
                continue
            penalty = np.concatenate([np.concatenate([a.ravel(), np.zeros(len(c))]) for a, c in layers(i, weights[i])]) * runs[i].get("alpha", 1e-4)
            g = (got[i, : len(weights[i])] + penalty) / n
            first[i], second[i] = 0.9 * first[i] + 0.1 * g, 0.999 * second[i] + 0.001 * g * g
            weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
        if not open_.any():
            break
    final = [kept[i] if np.isfinite(best[i]) else weights[i] for i in range(m)]
    return view.scorer(lambda block, i: sigmoid(forward(i, final[i], view.features(block, i))[-1][:, 0]))


# Trees from cells: rows of equal bins are alike for a tree, so a run is the sums of its rows by cell, and is grown in one task

#: Cells that a task holds; frames with more of them are fitted level by level from the rows.
CELLS = 16_384


class Cells:
    """The distinct combinations of bins of all measurements: their bins, and where each row of a block is among them."""

    def __init__(self, cuts: list[np.ndarray], named: np.ndarray):
        self.cuts, self.named, self.bins = cuts, named, 2 + max(map(len, cuts))
        self.codes = np.stack([named // self.bins**j % self.bins for j in range(len(cuts))], 1)

    def place(self, block: Block) -> np.ndarray:
        return block.keep(("place",), lambda: np.searchsorted(self.named, cell_names(block, self.cuts)))

    def ordered(self, block: Block) -> np.ndarray:
        return block.keep(("by cell",), lambda: np.argsort(self.place(block), kind="stable"))

    def features(self, view: View, i: int) -> np.ndarray:
        """The bins of a run's columns; with a scope impute, missing ones are the bin of the run's median."""
        c = view.columns[i]
        if view.runs[i].get("impute") in ("train", "full"):
            fill = np.array([1 + np.searchsorted(self.cuts[j], view.middle[i][j]) for j in c])
            return np.where(self.codes[:, c] == 0, fill, self.codes[:, c])
        return self.codes[:, c]


def cell_names(block: Block, cuts: list[np.ndarray]) -> np.ndarray:
    bins = 2 + max(map(len, cuts))
    return sum(np.where(np.isnan(v), 0, 1 + np.searchsorted(q, v)).astype(np.int64) * bins**j for j, (q, v) in enumerate(zip(cuts, block.x.T, strict=True)))


def _prepared_view(runs: list[dict], numeric: list[str]):
    view = View(runs, numeric)
    yield from view.borders()
    if any(r.get("impute") in ("train", "full") for r in runs):
        yield from view.medians()
    return view


def _poisson_table() -> np.ndarray:
    """How often a row is taken, by the top 16 bits of its hash; -1 where those do not tell."""
    low = np.searchsorted(_POISSON, np.arange(1 << 16) / (1 << 16), side="right")
    return np.where(low == np.searchsorted(_POISSON, np.arange(1, (1 << 16) + 1) / (1 << 16), side="left"), low, -1).astype(np.int8)


def bagged(seed: int, keys: np.ndarray, trees: int) -> np.ndarray:
    """(rows, trees): how often each row is taken into each tree's bag."""
    h = mixed(seed, keys[:, None], np.arange(trees)[None, :])
    w = _TAKEN[(h >> np.uint64(48)).astype(np.intp)]
    open_ = w < 0
    w[open_] = np.searchsorted(_POISSON, (h[open_] >> np.uint64(11)).astype(float) / float(1 << 53), side="right")
    return w


_TAKEN = _poisson_table()


def bag_sums(view: View, block: Block, i: int, cells: Cells, step: int = 2048) -> np.ndarray:
    """(2, cells, trees): weights of a forest's bags, and their label sums."""
    run, order = view.runs[i], cells.ordered(block)
    trees, bag = run.get("trees", 100), run.get("bag", run.get("split", 0))
    rows = order[view.sides(block, i)[0][order]]
    out = np.zeros((2, len(cells.named), trees))
    for at in range(0, len(rows), step):
        some = rows[at : at + step]
        w, place = bagged(bag + 1, block.key[some], trees).astype(float), cells.place(block)[some]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        out[0, place[first]] += np.add.reduceat(w, first, axis=0)
        w *= view.label(block, i)[some][:, None]
        out[1, place[first]] += np.add.reduceat(w, first, axis=0)
    return out


def row_sums(view: View, block: Block, i: int, cells: Cells) -> np.ndarray:
    """(2, cells, 1): training rows and their label sums."""
    rows, place = view.sides(block, i)[0], cells.place(block)
    return np.stack([np.bincount(place[rows], minlength=len(cells.named)), np.bincount(place[rows], view.label(block, i)[rows], len(cells.named))])[:, :, None].astype(float)


def sparse_cuts(slot: np.ndarray, code: np.ndarray, w: np.ndarray, g: np.ndarray, nodes: int, bins: int, ridge: float, least: float, slab: int = 2048) -> tuple[np.ndarray, ...]:
    """What best_cuts finds for nodes with one feature each, from entries (slot, code): only the codes that a node has are columns of its histogram."""
    key = slot * bins + code
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    own, codes, w, g = key[first] // bins, key[first] % bins, np.add.reduceat(w[order], first), np.add.reduceat(g[order], first)
    starts = np.searchsorted(own, np.arange(nodes))
    missing = codes[starts] == 0
    # Column 0 is for missing values, whether or not there are some.
    rank = np.arange(len(own)) - starts[own] + 1 - missing[own]
    sizes = np.diff(np.append(starts, len(own))) + 1 - missing
    out = np.zeros(nodes), np.zeros(nodes, np.int64), np.zeros(nodes, bool), np.zeros(nodes), np.zeros(nodes)
    lower = 0
    for upper in (4, 8, 16, 32, bins + 1):
        for some in (True, False):
            chosen = np.flatnonzero((lower < sizes) & (sizes <= upper) & (missing == some))
            for at in range(0, len(chosen), slab):
                part = chosen[at : at + slab]
                local = np.full(nodes, -1)
                local[part] = np.arange(len(part))
                here = local[own] >= 0
                places = local[own[here]], rank[here]
                hw, hg, named = np.zeros((len(part), upper)), np.zeros((len(part), upper)), np.zeros((len(part), upper), np.int64)
                hw[places], hg[places], named[places] = w[here], g[here], codes[here]
                gain, cut, lost, lw, lg = (x[:, 0] for x in best_cuts(hw[:, None], hg[:, None], ridge, least))
                for held, v in zip(out, (gain, named[np.arange(len(part)), cut], lost, lw, lg), strict=True):
                    held[part] = v
        lower = upper
    return out


def grown(codes: np.ndarray, w: np.ndarray, g: np.ndarray, depth: int, ridge: float, least: float, order: Callable | None, bins: int) -> np.ndarray:
    """(cells, trees): the value of the leaf that each cell comes to in each tree, grown from weights and targets (cells, trees) as grow does it."""
    (cells, trees), features = w.shape, codes.shape[1]
    cell, slot = np.tile(np.arange(cells), trees), np.repeat(np.arange(trees), cells)
    w, g = w.T.ravel(), g.T.ravel()
    entry, out = np.arange(cells * trees), np.zeros(cells * trees)
    tree, node, width = np.arange(trees), np.zeros(trees, np.int64), 1
    all_w, all_g = np.bincount(slot, w, trees), np.bincount(slot, g, trees)
    value = np.where(all_w + ridge > 0, all_g / np.maximum(all_w + ridge, 1e-300), 0.0)
    for level in range(depth + 1):
        n = len(tree)
        some = np.full(n, level < depth)
        if order is not None:
            some &= np.abs(all_g) * np.abs(all_w - all_g) > 1e-9
        # Entries of nodes that stay leaves are done.
        stays = some[slot]
        out[entry[~stays]] = value[slot[~stays]]
        cell, slot, w, g, entry = (v[stays] for v in (cell, slot, w, g, entry))
        if not len(entry):
            break
        kept = np.flatnonzero(some)
        slot = (np.cumsum(some) - 1)[slot]
        tree, node, value, n = tree[kept], node[kept], value[kept], len(kept)
        if order is not None:
            can, there = np.zeros((n, features), bool), (w > 0).astype(float)
            sized = np.bincount(slot, there, n)
            for j in range(features):
                c = codes[cell, j]
                once = np.bincount(slot, there * c, n)
                can[:, j] = sized * np.bincount(slot, there * c * c, n) - once * once > 0.5
            tried = order(tree, node)
            f = np.take_along_axis(tried, np.take_along_axis(can, tried, 1).argmax(1)[:, None], 1)[:, 0]
            all_w, all_g = np.bincount(slot, w, n), np.bincount(slot, g, n)
            gain, cut, lost, left_w, left_g = sparse_cuts(slot, codes[cell, f[slot]], w, g, n, bins, ridge, least)
        else:
            hists = np.zeros((2, n, features, bins))
            for j in range(features):
                at = slot * bins + codes[cell, j]
                for h, v in zip(hists, (w, g), strict=True):
                    h[:, j] = np.bincount(at, v, n * bins).reshape(n, bins)
            best = best_cuts(*hists, ridge, least)
            f = best[0].argmax(1)
            gain, cut, lost, left_w, left_g = (x[np.arange(n), f] for x in best)
            all_w, all_g = (h[:, 0].sum(1) for h in hists)
        some = gain > (1e-6 if order is None else -np.inf)
        stays = some[slot]
        out[entry[~stays]] = value[slot[~stays]]
        cell, slot, w, g, entry = (v[stays] for v in (cell, slot, w, g, entry))
        if not len(entry):
            break
        code = codes[cell, f[slot]]
        right = ~np.where(code == 0, lost[slot], code <= cut[slot])
        slot = 2 * (np.cumsum(some) - 1)[slot] + right
        t = tree[some]
        nth = np.arange(len(t)) - np.searchsorted(t, t)
        left, width = width + 2 * nth, width + 2 * (int(nth.max()) + 1)
        twice = lambda a, b: np.stack([a, b], 1).ravel()
        tree, node = np.repeat(t, 2), twice(left, left + 1)
        lw, lg, rw, rg = left_w[some], left_g[some], all_w[some] - left_w[some], all_g[some] - left_g[some]
        all_w, all_g, value = twice(lw, rw), twice(lg, rg), twice(lg / (lw + ridge), rg / (rw + ridge))
    return np.ascontiguousarray(out.reshape(trees, cells).T)


def forest_cells(run: dict, codes: np.ndarray, sums: np.ndarray, bins: int) -> np.ndarray:
    """The scores of a forest by cell."""
    bag, width = run.get("bag", run.get("split", 0)), codes.shape[1]
    order = lambda tree, node: np.argsort(mixed(bag + 2, tree[:, None], node[:, None], np.arange(width)[None, :]), axis=1, kind="stable")
    return grown(codes, sums[0], sums[1], run.get("depth", 24), 0.0, 1.0, order, bins).mean(1)


def tree_cells(run: dict, codes: np.ndarray, sums: np.ndarray, bins: int) -> np.ndarray:
    """The scores of a decision tree by cell."""
    return grown(codes, sums[0], sums[1], run.get("depth", 24), 0.0, 1.0, None, bins)[:, 0]


def boosted_cells(run: dict, codes: np.ndarray, sums: np.ndarray, bins: int) -> np.ndarray:
    """The scores of boosted trees by cell: rows of a cell share their margin, so gradients are sums over cells too."""
    n, s = sums
    f = np.zeros(len(n))
    for _ in range(run.get("trees", 100)):
        p = sigmoid(f)[:, None]
        f = f + run.get("rate", 0.1) * grown(codes, n * p * (1 - p), s - n * p, run.get("depth", 3), 1.0, 1.0, None, bins)[:, 0]
    return sigmoid(f)


def _cell_scorer(view: View, cells: Cells, scores: list[np.ndarray]) -> Callable:
    return view.scorer(lambda block, i: _spread(view, block, i, lambda rows: scores[i][cells.place(block)[rows]]))


def fitted_here(block: Block, runs: list[dict], numeric: list[str], learner: tuple[Callable, Callable]) -> Callable | None:
    """The scorer of tree runs whose rows are all in this block; None if they have too many cells."""
    here, (sums, fit) = lambda of: np.asarray(of(block), float), learner
    view, cuts = _driven(_prepared_view(runs, numeric), here), _driven(bin_cuts(len(numeric)), here)
    if not _nameable(cuts) or len(named := np.unique(cell_names(block, cuts))) > CELLS:
        return None
    cells = Cells(cuts, named)
    return _cell_scorer(view, cells, [fit(r, cells.features(view, i), sums(view, block, i, cells), cells.bins) for i, r in enumerate(runs)])


def _nameable(cuts: list[np.ndarray]) -> bool:
    return (2 + max(map(len, cuts))) ** len(cuts) < 1 << 62


def scored_by_cells(blocks: Blocks, runs: list[dict], learner: tuple[Callable, Callable], chunks: list[list[int]], rows_of: Callable) -> DataFrame | None:
    """The scores of tree runs over several blocks; None if they have too many cells.

    Blocks are summed by cell for each run, a run's sums meet in one task, which grows its trees, and the cells' scores go back to the blocks. What
    reaches the driver are splits, medians, cuts and the names of cells.
    """
    numeric, codes, (sums, fit) = blocks.numeric, blocks.codes, learner
    cuts = driven(blocks, bin_cuts(len(numeric)))
    if not _nameable(cuts):
        return None

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                yield pd.DataFrame({"cell": np.unique(cell_names(Block(row, numeric, codes), cuts))})

    named = [r.cell for r in blocks.frame.mapInPandas(names, "cell bigint").distinct().limit(CELLS + 1).collect()]
    if len(named) > CELLS:
        return None
    cells = Cells(cuts, np.array(sorted(named), np.int64))
    wave = max(1, SHARED // len(chunks[0]))
    views = [v for i in range(0, len(chunks), wave) for v in driven_together(blocks, [_prepared_view([runs[j] for j in at], numeric) for at in chunks[i : i + wave]])]
    work = blocks.frame.withColumn("work", F.explode(F.sequence(F.lit(0), F.lit(len(chunks) - 1)))).repartition(blocks.number * len(chunks))

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                block, view = Block(row, numeric, codes), views[row["work"]]
                for i, run in enumerate(chunks[row["work"]]):
                    yield pd.DataFrame([{"run": run, "data": _small(sums(view, block, i, cells)).tobytes()}])

    def grow_run(g: pd.DataFrame) -> pd.DataFrame:
        run, whole = int(g["run"].iloc[0]), None
        for d in g["data"]:
            part = np.frombuffer(d, np.float32).astype(float).reshape(2, len(cells.named), -1)
            whole = part if whole is None else whole + part
        chunk = run // len(chunks[0])
        return pd.DataFrame([{"run": run, "work": chunk, "scores": fit(runs[run], cells.features(views[chunk], run - chunks[chunk][0]), whole, cells.bins).tobytes()}])

    made = work.mapInPandas(summed, "run int, data binary").repartition(min(len(runs), 2000), "run").groupBy("run").applyInPandas(grow_run, "run int, work int, scores binary")
    made = settled(made).groupBy("work").agg(F.sort_array(F.collect_list(F.struct("run", "scores"))).alias("fits"))  # the runs of a chunk

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                scores = [np.frombuffer(x["scores"], float) for x in row["fits"]]
                yield from rows_of(Block(row, numeric, codes), _cell_scorer(views[row["work"]], cells, scores), chunks[row["work"]])

    return settled(work.join(made, "work").mapInPandas(apply, SCORES))


def _small(sums: np.ndarray) -> np.ndarray:
    """Sums of a block's rows as 32-bit numbers: whole ones below 2^24 stay exact."""
    return sums.astype(np.float32)


#: Learners that grow from cells: what is summed of a block, and what makes scores of the sums.
CELL_LEARNERS: dict[Callable, tuple[Callable, Callable]] = {decision_tree: (row_sums, tree_cells), forest: (bag_sums, forest_cells), boosted: (row_sums, boosted_cells)}
LEARNERS: dict[str, Callable] = {"logistic_regression": logistic, "decision_tree": decision_tree, "random_forest": forest, "boosted_trees": boosted, "mlp": network}
