"""Models fitted from sums, exact neighbours and multinomial draws against plain versions, and over one block or many."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.operators import nearest, sampling, statistics, study, sums

NUMERIC = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(360):
        a, b, c = float(rng.normal()), float(rng.integers(0, 5)), float(rng.normal())
        rows.append((i, int((a > 0) ^ (b > 2)) if i % 9 else int(rng.integers(0, 2)), a, None if i % 6 == 0 else b, c, "xyz"[i % 3], i % 3))
    return spark.createDataFrame(rows, "rid long, y int, a double, b double, c double, site string, site_code int")


@pytest.fixture(scope="module")
def packed(frame):
    return sums.pack_rows(frame, NUMERIC, ["site_code"]), sums.pack_rows(frame, NUMERIC, ["site_code"], block_rows=100)


def table(frame):
    rows = sorted(frame.collect(), key=lambda r: r.rid)
    x = np.array([[np.nan if r[c] is None else r[c] for c in NUMERIC] for r in rows])
    return np.array([r.rid for r in rows]), x, np.array([r.y for r in rows], float)


CASES = [
    ("logistic_regression", {"c": 0.5}), ("decision_tree", {"impute": "native"}), ("random_forest", {"trees": 7, "impute": "train"}), ("random_forest", {"trees": 5, "impute": "native", "depth": 4}),
    ("boosted_trees", {"trees": 5, "depth": 2, "impute": "native"}), ("boosted_trees", {"trees": 3, "impute": "full"}), ("mlp", {"layers": [4], "seed": 1}),
]


@pytest.mark.parametrize(("model", "point"), CASES)
def test_one_block_and_many_give_the_same_scores(packed, model, point):
    one, many = packed
    assert one.number == 1 and many.number > 3
    runs = [{"columns": NUMERIC, "split": s, **point} for s in (3, 4)]
    if model == "mlp":
        learner = lambda r, n: sums.network(r, n, steps=12)
    else:
        learner = sums.LEARNERS[model]
    a, b = ({(r.run, r.part, r.key): (r.y, r.score) for r in sums.scored(x, runs, learner, (0, 1), 1).collect()} for x in (one, many))
    assert a.keys() == b.keys() and len(a) == 2 * 360
    assert all(a[k][0] == b[k][0] and math.isclose(a[k][1], b[k][1], abs_tol=1e-9) for k in a)
    assert Counter(k[:2] for k in a)[0, 1] == math.ceil(0.2 * 360)


def test_logistic_is_the_best_fit(packed, frame):
    """At the weights the penalised gradient of the training rows is zero: fitted scores reproduce it."""
    key, x, y = table(frame)
    run = {"columns": ["a", "c"], "flags": ["b"], "train_not": [["site_code", 1]], "test_is": [["site_code", 1]], "c": 0.5}
    got = {(r.part, r.key): r.score for r in sums.scored(packed[0], [run], sums.logistic, (0, 1)).collect()}
    train = key % 3 != 1
    z = x[:, [0, 2]]
    z = (z - z[train].mean(0)) / z[train].std(0)
    design = np.column_stack([z, np.isnan(x[:, 1]), np.ones(len(x))])
    p = np.array([got[0, k] for k in key[train]])
    w = np.linalg.lstsq(design[train], np.log(p / (1 - p)), rcond=None)[0]
    assert np.abs(design[train].T @ (y[train] - p) - 2 * np.append(w[:3], 0)).max() < 1e-6
    q = 1 / (1 + np.exp(-(design[~train] @ w)))
    assert np.allclose([got[1, k] for k in key[~train]], q, atol=1e-8)


def plain_tree(codes, y, weight, depth=24):
    """A recursion over row sets: the best cut of all features, missing values on both sides."""

    def value(rows):
        return (weight[rows] * y[rows]).sum() / weight[rows].sum()

    def grow(rows, level):
        w, g = weight[rows].sum(), (weight[rows] * y[rows]).sum()
        best = (-np.inf,)
        for f in range(codes.shape[1]):
            for cut in range(codes.max() + 1):
                for lost in (True, False):
                    left = rows[np.where(codes[rows, f] == 0, lost, codes[rows, f] <= cut)]
                    lw, lg = weight[left].sum(), (weight[left] * y[left]).sum()
                    if lw >= 1 and w - lw >= 1:
                        gain = round(lg**2 / lw + (g - lg) ** 2 / (w - lw) - g**2 / w, 9)
                        if gain > best[0]:
                            best = (gain, f, cut, lost)
        if best[0] <= 1e-6 or level == depth:
            return value(rows)
        _, f, cut, lost = best
        go = np.where(codes[rows, f] == 0, lost, codes[rows, f] <= cut)
        return f, cut, lost, grow(rows[go], level + 1), grow(rows[~go], level + 1)

    def read(tree, row):
        while isinstance(tree, tuple):
            f, cut, lost, a, b = tree
            tree = a if (lost if codes[row, f] == 0 else codes[row, f] <= cut) else b
        return tree

    tree = grow(np.flatnonzero(weight > 0), 0)
    return np.array([read(tree, i) for i in range(len(codes))])


@pytest.mark.parametrize("depth", [1, 3])
def test_trees_equal_a_plain_builder(spark, depth):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 2)), float(rng.integers(0, 9)), None if i % 5 == 0 else float(rng.integers(0, 4))) for i in range(90)]
    blocks = sums.pack_rows(spark.createDataFrame(rows, "rid long, y int, a double, b double"), ["a", "b"], block_rows=40)
    run = {"columns": ["a", "b"], "train_not": [], "test_is": [], "impute": "native", "depth": depth}
    got = {r.key: r.score for r in sums.scored(blocks, [run], sums.decision_tree).collect()}
    x = np.array([[r[2], np.nan if r[3] is None else r[3]] for r in rows])
    codes = np.stack([np.where(np.isnan(v), 0, 1 + np.searchsorted(np.unique(v[~np.isnan(v)])[:-1], v)) for v in x.T], 1)
    want = plain_tree(codes, np.array([r[1] for r in rows], float), np.ones(90), depth)
    assert np.allclose([got[i] for i in range(90)], want)


def test_forest_and_boosting_learn_what_one_line_cannot(packed):
    runs = [{"columns": ["a", "b"], "split": s, "impute": "native"} for s in range(4)]
    scores = {m: study.accuracy_by(sums.scored(packed[0], runs, sums.LEARNERS[m]), []).first().accuracy for m in ("random_forest", "boosted_trees", "mlp", "logistic_regression")}
    assert scores["random_forest"] > 0.85 and scores["boosted_trees"] > 0.85 and scores["logistic_regression"] < 0.75


def test_selection_is_exact(packed, frame):
    key, x, y = table(frame)
    for blocks in packed:
        view = sums.View([{"columns": NUMERIC, "train_not": [["site_code", s]], "test_is": [["site_code", s]]} for s in (0, 1)], NUMERIC)
        sums.driven(blocks, view.design())
        for i in (0, 1):
            train = x[key % 3 != i]
            assert np.allclose(view.middle[i], np.nanmedian(train, 0))
            filled = np.where(np.isnan(train), np.nanmedian(train, 0), train)
            assert np.allclose(view.mean[i], filled.mean(0)) and np.allclose(view.sd[i], filled.std(0))
    values = np.array([-np.inf, -2.5, -0.0, 0.0, 1e-300, 3.0, np.inf])
    assert (np.diff(sums.ordered(values).astype(object)) >= 0).all() and (sums.back(sums.ordered(values)) == values).all()


def test_grouped_splits_keep_groups_whole(spark, frame):
    keyed = study.with_groups(frame.withColumn("g", F.when(F.col("rid") % 7 > 0, F.col("rid") % 40)), "g")
    blocks = sums.pack_rows(keyed, NUMERIC, ["group_code", "head"], block_rows=100)
    scores = sums.scored(blocks, [{"columns": NUMERIC, "split": 5, "group": "group_code"}], sums.logistic, (0, 1))
    sides = scores.join(keyed.select(F.col("rid").alias("key"), "g"), "key").groupBy("g").agg(F.min("part").alias("x"), F.max("part").alias("z")).collect()
    assert all(r.x == r.z for r in sides) and sum(r.x for r in sides) == math.ceil(0.2 * 41)


def test_empty_frames_and_lost_labels(spark, frame):
    blocks = sums.pack_rows(frame.limit(0), NUMERIC)
    assert blocks.number == 0 and sums.scored(blocks, [{"columns": NUMERIC, "split": 1}], sums.logistic).count() == 0
    some = frame.withColumn("y", F.when(F.col("rid") % 2 == 0, F.col("y")))
    assert sums.scored(sums.pack_rows(some, NUMERIC), [{"columns": NUMERIC, "split": 1}], sums.logistic, (0, 1)).count() == 180


def plain_nested(key, x, y, sites, flags):
    """Leave one site out, with the penalty chosen by leaving another out: one plain fit after another."""

    def fit(rows, tries, c):
        middle = np.array([np.nan_to_num(np.nanmedian(x[rows, j])) for j in range(3)])
        filled = np.where(np.isnan(x), middle, x)
        sd = filled[rows].std(0)
        z = np.column_stack([(filled - filled[rows].mean(0)) / np.where(sd == 0, 1, sd), np.isnan(x[:, flags]), np.ones(len(x))])
        w, ridge = np.zeros(z.shape[1]), np.diag([1 / c] * (z.shape[1] - 1) + [1e-9])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(z[rows] @ w, -30, 30)))
            w += np.clip(np.linalg.solve((z[rows].T * (p * (1 - p))) @ z[rows] + ridge, z[rows].T @ (y[rows] - p) - ridge @ w), -5, 5)
        return 1 / (1 + np.exp(-(z[tries] @ w)))

    def auc(t, s):
        pos, neg = s[t == 1], s[t == 0]
        return ((pos[:, None] > neg[None]).sum() + (pos[:, None] == neg[None]).sum() / 2) / (len(pos) * len(neg))

    out, grid = {}, [p["c"] for p in study.GRIDS["logistic_regression"]]
    for s in range(3):
        means = []
        for c in grid:
            means.append(np.mean([auc(y[sites == t], fit(np.flatnonzero((sites != s) & (sites != t)), np.flatnonzero(sites == t), c)) for t in range(3) if t != s]))
        c = grid[int(np.argmax(np.round(means, 12)))]
        tries = np.flatnonzero(sites == s)
        out |= {int(k): (p, c) for k, p in zip(key[tries], fit(np.flatnonzero(sites != s), tries, c), strict=True)}
    return out


def test_nested_search_equals_one_fit_after_another(spark, frame, monkeypatch):
    import json

    monkeypatch.setitem(study.ARMS, "T", (NUMERIC, ["b"]))
    blocks, sites = sums.pack_rows(frame, NUMERIC, ["site_code"], block_rows=100), ["x", "y", "z"]
    got = study.nested(blocks, sites, ("T",), {"logistic_regression": study.GRIDS["logistic_regression"]}, study.site_scheme(sites), per_task=64).collect()
    key, x, y = table(frame)
    want = plain_nested(key, x, y, key % 3, [1])
    assert len(got) == 360
    assert all(math.isclose(r.score, want[r.rid][0], abs_tol=1e-8) and json.loads(r.best)["c"] == want[r.rid][1] for r in got)


def test_shuffles_keep_the_labels(spark, frame):
    rows = study.with_shuffles(frame, 3, 9).collect()
    assert all(sum(r[f"label{i}"] for r in rows) == sum(r.y for r in rows) for i in range(3))
    assert len({tuple(r[f"label{i}"] for r in rows) for i in range(3)}) == 3


def neighbours(rows, k):
    out = {}
    for run in {r[0] for r in rows}:
        train = [r for r in rows if r[0] == run and r[3]]
        x, ids = np.array([r[5] for r in train]), np.array([r[1] for r in train])
        for r in (r for r in rows if r[0] == run and r[4]):
            d = np.round(((x - np.array(r[5])) ** 2).sum(1), 9)
            at = [i for i in np.lexsort((ids, d)) if ids[i] != r[1]][:k]
            out[run, r[1]] = [(int(ids[i]), float(d[i])) for i in at]
    return out


def test_nearest_rows_equal_brute_force(spark):
    rng, rows = np.random.default_rng(2), []
    for run in (0, 1):
        for i in range(900):
            x = [0.5, 0.5] if i % 3 == 0 else rng.normal(0, 1, 2).round(3).tolist()
            rows.append((run, i, int(x[0] > 0), i % 4 != run, i % 4 == run or run == 1, x))
    df = spark.createDataFrame(rows, "run int, key bigint, y int, train boolean, test boolean, x array<double>")
    told, got = {}, {}
    for r in nearest.nearest_rows(df, 5, cell_rows=40, part_rows=60, told=told).collect():
        got.setdefault((r.run, r.key), []).append((r.rank, r.near, r.d))
    assert {k: [x[1:] for x in sorted(v)] for k, v in got.items()} == neighbours(rows, 5)
    assert told["compared"] < 0.6 * told["pairs"]  # in two dimensions, a third of the rows at one point
    assert nearest.nearest_rows(df.limit(0), 5).count() == 0


def test_votes(spark):
    rows = [(0, 1, 1, 10, 0.0, 1, 1), (0, 1, 1, 11, 4.0, 0, 2), (0, 1, 1, 12, 4.0, 0, 3)]
    near = spark.createDataFrame(rows, "run int, key bigint, truth int, near bigint, d double, y int, rank int")
    got = {(r.k, r.weights): r.score for r in nearest.vote(near, [1, 3], ("uniform", "distance")).collect()}
    assert got[1, "uniform"] == 1 and got[3, "uniform"] == pytest.approx(1 / 3) and got[3, "distance"] == pytest.approx(1)


def test_splitting_tree_draws_multinomials(spark, monkeypatch):
    monkeypatch.setattr(sampling, "LEAF", 8)
    rows = [("u" if i < 600 else "v", i % 37 if i < 600 else i % 5, 0.5) for i in range(900)] + [(None, 1, 0.5)]
    df = spark.createDataFrame(rows, "g string, v int, s double")
    draws = 300
    got = sampling.split_weights(df, ["g"], ["v", "s"], draws, 7).collect()
    per = Counter()
    for r in got:
        per[r.g, r.b] += r.drawn
    assert per == Counter({("u", b): 600 for b in range(draws)} | {("v", b): 300 for b in range(draws)})
    sizes = Counter((g, v) for g, v, _ in rows if g)
    for cell, n in sizes.items():
        total = 600 if cell[0] == "u" else 300
        counts = np.zeros(draws)
        for r in got:
            if (r.g, r.v) == cell:
                counts[r.b] = r.drawn
        variance = n * (1 - n / total)
        assert abs(counts.mean() - n) < 5 * math.sqrt(variance / draws) and 0.6 < counts.var() / variance < 1.5
    again = sampling.split_weights(df.repartition(5), ["g"], ["v", "s"], draws, 7).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))


def test_draws_cost_values_not_rows(spark):
    """A hundred times the rows with the same distinct values are drawn as counts of the same number of cells."""
    base = spark.createDataFrame([(i % 50, i % 2) for i in range(200)], "v int, y int")
    few, many = (sampling.split_weights(base.withColumn("t", F.lit(t)), ["y"], ["v"], 40, 1, times="t") for t in (1, 100))
    assert many.count() <= 50 * 40 and few.agg(F.sum("drawn")).first()[0] == 200 * 40 and many.agg(F.sum("drawn")).first()[0] == 20_000 * 40


def test_null_labels_scores_and_p_values(spark):
    rows = [(0.1, 0, "a"), (0.4, 1, "a"), (0.35, None, "a"), (None, 1, "a"), (float("nan"), 0, "a"), (0.2, 1, None)]
    df = spark.createDataFrame(rows, "score double, y int, _s string").withColumns({c: F.col("_s") for c in ("s", "p", "q", "g0", "x")})
    for by in (["_s"], ["s"], ["p"], ["q", "x"], ["g0"]):
        got = {r[0]: (r.auc, r.n, r.n_pos) for r in statistics.auc_by(df, "score", by=by).select(by[0], "auc", "n", "n_pos").collect()}
        assert got == {"a": (1.0, 2, 1), None: (None, 1, 1)}
        assert {r[0]: r.threshold for r in statistics.youden(df, "score", by).collect()}["a"] == 0.4
        assert statistics.delong(df, "score", by).count() == 2
    ps = spark.createDataFrame([("u", 0.01, "k"), ("v", None, "k"), ("w", 0.04, "k")], "m string, p double, _s string")
    assert {r.m: r.p_holm for r in statistics.holm(ps, "p", "m", ["_s"]).collect()} == {"u": 0.02, "v": None, "w": 0.04}


def test_calibration_in_passes(spark):
    rng, rows = np.random.default_rng(5), []
    for i in range(3000):
        x = float(rng.normal())
        rows.append(("a", x, int(rng.random() < 1 / (1 + math.exp(-(0.5 + 0.7 * x))))))
    rows += [("one", float(i), 1) for i in range(5)] + [("apart", float(i), int(i > 4)) for i in range(10)] + [(None, float(i % 7), i % 2) for i in range(20)] + [("a", None, 1), ("a", 1.0, None)]
    df = spark.createDataFrame(rows, "g0 string, s double, y int")
    got = {r.g0: (r.intercept, r.slope) for r in statistics.calibration(df, "s", ["g0"], True).collect()}
    x, y = (np.array([r[i] for r in rows[:3000]]) for i in (1, 2))
    w = np.array([0.0, 1.0])
    a = np.column_stack([np.ones(3000), x])
    for _ in range(40):
        p = 1 / (1 + np.exp(-a @ w))
        w = w + np.linalg.solve((a.T * (p * (1 - p))) @ a, a.T @ (y - p))
    assert got["a"] == pytest.approx(tuple(w), abs=2e-6) and got["one"] == (None, None) and got["apart"] == (None, None) and got[None][0] is not None
    assert statistics.calibration(df.limit(0), "s", ["g0"], True).count() == 0


def test_binomial_gate(spark):
    from attestry.functions.scalars import binomial_quantile

    got = {r.n: r.required for r in statistics.binomial_gate(spark.createDataFrame([(n,) for n in (1, 20, 50, 400)], "n long"), "n", 0.025, 0.95).collect()}
    assert got == {n: binomial_quantile(0.025, n, 0.95) for n in (1, 20, 50, 400)}


@pytest.mark.parametrize(("learner", "point"), [(sums.forest, {"trees": 5, "impute": "native"}), (sums.forest, {"trees": 3, "depth": 3, "impute": "train"}), (sums.decision_tree, {"impute": "full"}), (sums.boosted, {"trees": 3, "depth": 2, "impute": "native"})])
def test_trees_from_cells_equal_trees_from_rows(packed, monkeypatch, learner, point):
    runs = [{"columns": c, "split": s, **point} for s, c in ((3, NUMERIC), (4, ["a", "b"]))]
    read = lambda x: {(r.run, r.part, r.key): r.score for r in sums.scored(x, runs, learner, (0, 1), 2).collect()}
    monkeypatch.setattr(sums, "CELLS", 0)
    want = read(packed[1])  # level by level, driven from here
    monkeypatch.undo()
    for blocks in packed:
        got = read(blocks)
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)


def test_bags_are_the_poisson_weights_of_the_hash():
    keys = np.arange(5000)
    u = (sums.mixed(8, keys[:, None], np.arange(40)[None, :]) >> np.uint64(11)).astype(float) / float(1 << 53)
    assert (sums.bagged(8, keys, 40) == np.searchsorted(sums._POISSON, u, side="right")).all()


def test_passes_of_many_blocks_do_not_grow_with_the_runs(packed, spark):
    """Forests of many blocks need as many jobs for eight chunks of runs as for one."""
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for n in (1, 8):
        spark.sparkContext.setJobGroup(f"runs{n}", "")
        for learner, point in ((sums.forest, {"trees": 3, "impute": "native"}), (sums.logistic, {})):
            sums.scored(packed[1], [{"columns": NUMERIC, "split": 1, **point}] * n, learner, (1,), 1)
        jobs.append(len(tracker.getJobIdsForGroup(f"runs{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_runs_of_one_design_share_it_and_keep_their_scores(packed):
    """Grid points and shuffles of one design are prepared once; alone or together, their scores are the same."""
    base = {"columns": NUMERIC, "flags": ["b"], "train_not": [["site_code", 1]], "test_is": [["site_code", 1]]}
    runs = [{**base, "c": 0.1}, {**base, "c": 10.0}, {**base, "c": 10.0, "train_not": [["site_code", 2]], "test_is": [["site_code", 2]]}, {**base, "c": 10.0}]
    assert sums.View(runs, NUMERIC).like.tolist() == [0, 0, 2, 0]
    read = lambda r, n: {(x.run, x.key): x.score for x in sums.scored(packed[0], r, sums.logistic, (1,), n).collect()}
    assert read(runs, 4) == read(runs, 1)
