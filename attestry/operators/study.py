"""Experiments over many fitted models: seed sweeps, and the nested baseline with its grids searched inside.

Both are lists of runs that the learners of sums fit together; k-nearest neighbours go by nearest. What comes back are scores in long
form, and only the grid points' mean AUCs, a few numbers a fold, reach the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.operators.nearest import nearest_rows, vote
from attestry.operators.sampling import permute, stratified_folds
from attestry.operators.statistics import auc_by, youden
from attestry.operators.sums import LEARNERS, SCORES, Blocks, design_rows, pack_rows, scored
from attestry.sources.readers import settled

#: Grids of the honest baseline, fixed before any result.
GRIDS: dict[str, list[dict]] = {
    "logistic_regression": [{"c": c} for c in (0.01, 0.1, 1.0, 10.0)],
    "knn": [{"k": k, "weights": w} for k in (5, 15, 31, 51) for w in ("uniform", "distance")],
    "boosted_trees": [{"depth": d, "trees": t, "rate": r} for d in (2, 3, 4) for t in (100, 300) for r in (0.05, 0.1)],
    "mlp": [{"layers": list(h), "alpha": a} for h in ((16,), (32,), (16, 16)) for a in (1e-4, 1e-2)],
}
#: The arms: A keeps a flag for each column that can be missing, B drops those and the column that marks the site even when filled.
ARMS: dict[str, tuple[list[str], list[str]]] = {"A": (["n_chars", "nsp", "slope"], ["nsp", "slope"]), "B": (["n_chars", "slope"], [])}
#: Learners whose trees send missing values themselves.
NATIVE = ("boosted_trees", "random_forest", "decision_tree")


def numbered(df: DataFrame, column: str, out: str) -> tuple[DataFrame, list]:
    """Adds the place of a column's value among its distinct values, which are few by contract; -1 for null."""
    values = sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())
    table = df.sparkSession.createDataFrame([(v, i) for i, v in enumerate(values)], f"_v {dict(df.dtypes)[column]}, {out} bigint")
    joined = df.join(F.broadcast(table), F.col(column) == F.col("_v"), "left").drop("_v")
    return joined.withColumn(out, F.coalesce(out, F.lit(-1).cast("bigint"))), values


def seed_runs(seeds: list[int], columns: list[str], **more) -> list[dict]:
    """A run a seed: a fifth of the rows is tested, chosen by the seed."""
    return [{"split": s, "columns": columns, **more} for s in seeds]


def run_scores(blocks: Blocks, runs: list[dict], model: str, parts: tuple[int, ...] = (1,), per_task: int = 16) -> DataFrame:
    """(run, part, key, y, score) of the runs by a model of LEARNERS, or by knn with k and weights of the run."""
    if model != "knn":
        return scored(blocks, runs, LEARNERS[model], parts, per_task)
    # Runs that differ only in k and weights share their neighbours.
    base = [json.dumps({k: v for k, v in r.items() if k not in ("k", "weights")}, sort_keys=True) for r in runs]
    first = {b: i for i, b in enumerate(dict.fromkeys(base))}
    out = blocks.frame.sparkSession.createDataFrame([], SCORES)
    if not runs:
        return out
    rows = settled(design_rows(blocks, [json.loads(b) for b in first]))
    ks, weights = sorted({r["k"] for r in runs}), sorted({r["weights"] for r in runs})
    told = blocks.frame.sparkSession.createDataFrame([(i, first[b], r["k"], r["weights"]) for i, (b, r) in enumerate(zip(base, runs, strict=True))], "_run int, run int, k int, weights string")
    for part in parts:
        asked = rows if part else rows.withColumn("test", F.col("train"))
        votes = vote(nearest_rows(asked, max(ks)), ks, tuple(weights))
        mine = votes.join(F.broadcast(told), ["run", "k", "weights"])  # a row a run
        out = out.unionByName(mine.select(F.col("_run").alias("run"), F.lit(part).alias("part"), "key", "y", "score"))
    return out


def told_runs(df: DataFrame, runs: list[dict], columns: dict[str, str]) -> DataFrame:
    """Joins each row with chosen fields of its run; columns gives their types. A row a run is sent to all tasks."""
    rows = [(i, *[r.get(c) for c in columns]) for i, r in enumerate(runs)]
    schema = ", ".join(["run int", *[f"{c} {t}" for c, t in columns.items()]])
    return df.join(F.broadcast(df.sparkSession.createDataFrame(rows, schema)), "run").drop("run")


def accuracy_by(scores: DataFrame, by: list[str], label: str = "y") -> DataFrame:
    """(by, accuracy, majority, n) at a half."""
    hit, y = ((F.col("score") >= 0.5).cast("int") == F.col(label)).cast("double"), F.avg(F.col(label).cast("double"))
    return scores.groupBy(*by).agg(F.avg(hit).alias("accuracy"), F.greatest(y, 1 - y).alias("majority"), F.count(F.lit(1)).alias("n"))


def sweep(blocks: Blocks, seeds: list[int], columns: list[str], model: str = "random_forest", per_task: int = 16, **more) -> DataFrame:
    """(seed, accuracy, majority, n): the model on an exact 80/20 split for each seed."""
    runs = seed_runs(seeds, columns, **more)
    return accuracy_by(told_runs(run_scores(blocks, runs, model, per_task=per_task), runs, {"split": "bigint"}), ["split"]).withColumnRenamed("split", "seed")


def with_groups(df: DataFrame, group: str, key: str = "rid") -> DataFrame:
    """Adds the codes that a grouped split needs: group_code, a hash of the group, and head, 1 for the group's first row by key. Null groups are one group."""
    first = df.groupBy(F.xxhash64(group).alias("group_code")).agg(F.min(key).alias("_first"))
    return df.withColumn("group_code", F.xxhash64(group)).join(first, "group_code").withColumn("head", (F.col(key) == F.col("_first")).cast("int")).drop("_first")


def with_folds(df: DataFrame, k: int, seeds: list[int], key: str = "rid", label: str = "y") -> DataFrame:
    """Adds fold0, fold1, ...: stratified folds for each seed."""
    for i, seed in enumerate(seeds):
        df = stratified_folds(df, key, label, seed, k).withColumnRenamed("fold", f"fold{i}")
    return df


def with_shuffles(df: DataFrame, shuffles: int, seed: int, key: str = "rid", label: str = "y") -> DataFrame:
    """Adds label0, label1, ...: the labels dealt anew, each shuffle over all rows."""
    long = df.select(key, label, F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))).alias("_s"))
    dealt = permute(long, key, label, F.col("_s") + F.lit(seed), ["_s"])
    wide = dealt.groupBy(key).pivot("_s", list(range(shuffles))).agg(F.first(label))
    return df.join(wide.select(key, *[F.col(str(i)).alias(f"label{i}") for i in range(shuffles)]), key)


def baseline_blocks(df: DataFrame, folds: int = 0, fold_seeds: list[int] | None = None, shuffles: int = 0, seed: int = 0) -> tuple[Blocks, list]:
    """The rows of the nested baseline, packed with their site, folds and shuffled labels; and the sites in order of their codes."""
    rows, sites = numbered(df, "site", "site_code")
    codes = ["site_code"]
    if fold_seeds:
        rows, codes = with_folds(rows, folds, fold_seeds), [*codes, *[f"fold{i}" for i in range(len(fold_seeds))]]
    if shuffles:
        rows, codes = with_shuffles(rows, shuffles, seed), [*codes, *[f"label{i}" for i in range(shuffles)]]
    return pack_rows(rows, sorted({c for a in ARMS.values() for c in a[0]}), codes), sites


FIELDS = {"arm_": "string", "model": "string", "scheme": "string", "fold": "bigint", "shuffle": "bigint"}


def nested(blocks: Blocks, sites: list, arms: tuple[str, ...], models: dict[str, list[dict]], schemes: dict[str, tuple[str, list[int]]], seed: int = 0, shuffles: int = 0, per_task: int = 16, cuts: bool = True) -> DataFrame:
    """(arm, model, scheme, fold, shuffle, rid, y, score, best[, threshold]): out-of-fold scores with the grid searched inside.

    schemes name a code column and its folds; loso is the site's. For every arm, model, fold and shuffle the grid point with the best mean AUC over inner folds
    that leave one site out is fitted on all training rows, first on ties; inner folds of one class are left out. All inner fits of a model share
    their passes, and so do all outer ones. threshold is Youden's on the training rows, which are scored for it; without cuts it is left out.
    """
    out = []
    for model, grid in models.items():
        outer = [
            {"columns": ARMS[a][0], "flags": ARMS[a][1], "arm_": a, "model": model, "scheme": s, "fold": f, "shuffle": k, "seed": seed, "code": c, **({"impute": "native"} if model in NATIVE else {}), **({"label": f"label{k}"} if shuffles else {})}
            for a in arms for s, (c, folds) in schemes.items() for f in folds for k in range(max(1, shuffles))
        ]
        inner, of = [], []
        for o, run in enumerate(outer if len(grid) > 1 else []):
            left = [s for s in range(len(sites)) if (run["code"], s) != ("site_code", run["fold"])]
            for p, point in enumerate(grid):
                for s in left:
                    inner.append({**run, **point, "train_not": [[run["code"], run["fold"]], ["site_code", s]], "test_is": [["site_code", s]], "test_not": [[run["code"], run["fold"]]]})
                    of.append({"outer": o, "point": p})
        best = [0] * len(outer)
        if inner:
            scores = settled(run_scores(blocks, inner, model, per_task=per_task))  # read more than once
            told = told_runs(auc_by(scores, "score", by=["run"]), of, {"outer": "int", "point": "int"})
            means: dict[int, list] = {}
            for r in told.groupBy("outer", "point").agg(F.round(F.avg("auc"), 12).alias("m")).collect():
                means.setdefault(r.outer, []).append((-(r.m or 0.0), r.point))
            best = [min(means.get(o, [(0.0, 0)]))[1] for o in range(len(outer))]
        runs = [{**run, **grid[b], "best": json.dumps(grid[b]), "train_not": [[run["code"], run["fold"]]], "test_is": [[run["code"], run["fold"]]]} for run, b in zip(outer, best, strict=True)]
        if cuts:
            scores = settled(run_scores(blocks, runs, model, (0, 1), per_task))
            cut = youden(scores.where("part = 0"), "score", ["run"]).select("run", "threshold")
            tested = scores.where("part = 1").join(F.broadcast(cut), "run", "left")  # a row a run
        else:
            tested = settled(run_scores(blocks, runs, model, (1,), per_task))
        out.append(told_runs(tested.select("run", F.col("key").alias("rid"), "y", "score", *(["threshold"] if cuts else [])), runs, {**FIELDS, "best": "string"}).withColumnRenamed("arm_", "arm"))
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def site_scheme(sites: list) -> dict[str, tuple[str, list[int]]]:
    return {"loso": ("site_code", list(range(len(sites))))}


def fold_schemes(folds: int, repeats: int) -> dict[str, tuple[str, list[int]]]:
    return {f"repeat{r}": (f"fold{r}", list(range(folds))) for r in range(repeats)}


def named_sites(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds the site of each row by its key."""
    return df.join(rows.select("rid", "site"), "rid")


def same_share(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, identical): the share of tested rows that two sets of scores (by, key, score) predict alike."""
    other = b.select(*by, "key", (F.col("score") >= 0.5).alias("_other"))
    met = a.select(*by, "key", (F.col("score") >= 0.5).alias("_one")).join(other, [*by, "key"])
    return met.groupBy(*by).agg(F.avg((F.col("_one") == F.col("_other")).cast("double")).alias("identical"))


def arm_codes(df: DataFrame, drops: dict[str, DataFrame], key: str = "rid") -> DataFrame:
    """Adds a code column for each arm: 1 for the rows it keeps, 0 for those it drops."""
    long = None
    for name, gone in drops.items():
        part = gone.select(key, F.lit(name).alias("_arm"))
        long = part if long is None else long.unionByName(part)
    flags = long.groupBy(key).agg(F.collect_set("_arm").alias("_gone"))
    has = lambda name: F.coalesce(F.array_contains("_gone", name), F.lit(False))
    return df.join(flags, key, "left").select(*df.columns, *[(~has(name)).cast("int").alias(name) for name in drops])


def matched_drops(pool: DataFrame, target: DataFrame, draws: int, seeds: list[int], key: str = "rid", label: str = "y") -> DataFrame:
    """(key, draw): for each draw as many rows of the pool as the target has in each class, without replacement; all draws in one shuffle."""
    from attestry.functions.scalars import hash32
    from attestry.operators.sampling import hash_rank

    want = target.groupBy(label).agg(F.count(F.lit(1)).alias("_want"))
    each = pool.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_seed", F.element_at(F.array(*[F.lit(int(s)) for s in seeds[:draws]]), F.col("draw") + 1))
    ranked = hash_rank(each, ["draw", label], hash32(F.col("_seed"), "matched", F.col(key)), key, "_rank")
    return ranked.join(F.broadcast(want), label).where("_rank <= _want").select(key, "draw")  # a row a class


