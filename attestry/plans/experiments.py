"""Queries over fitted models and simulations. Those with models have no SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.functions.scalars import clip_logit
from attestry.operators import learning as L
from attestry.operators import study as S
from attestry.operators.matching import filled_cells, match_sources, revert
from attestry.operators.nearest import nearest_rows, vote
from attestry.operators.replicates import replicate_aucs
from attestry.operators.sampling import contamination_by_seed, derive, normal, stratified_folds, uniform
from attestry.operators.statistics import auc_by, balanced_accuracy, binomial_gate, calibration_intercept, corrected_t, delong, holm, interval, negative_log_likelihood, site_weighted_auc
from attestry.operators.sums import pack_rows
from attestry.plans.registry import h32, query
from attestry.plans.resampling import _AUC, _RK
from attestry.sources.readers import published, recorded, settled

COLUMNS = ["n_chars", "nsp"]
ALL = ["n_chars", "nsp", "slope"]
#: Replicates of the bootstrap intervals here, and of the label gate's.
BOOTS, GATE_BOOTS = 2000, 200


def _frame(spark, sf):
    return recorded(spark, sf).select("rid", "site", "n_chars", "nsp", "y")


def _study(spark, sf):
    return recorded(spark, sf).select("rid", "site", "n_chars", "nsp", "slope", "y")


def _blocks(spark, sf, columns=COLUMNS):
    return pack_rows(_study(spark, sf), columns)


def _fold3(spark, sf):
    return _frame(spark, sf).withColumn("k", F.pmod(F.xxhash64("rid"), F.lit(3)))


@query("lr_oof_loso")
def lr_oof_loso(spark, sf):
    return L.oof(_frame(spark, sf), "site", COLUMNS, L.models()["logistic_regression"])


@query("rf_oof_loso")
def rf_oof_loso(spark, sf):
    return L.oof(_frame(spark, sf), "site", COLUMNS, L.models()["random_forest"])


@query("nested_lr_search")
def nested_lr_search(spark, sf):
    return L.nested_search(_frame(spark, sf), "site", COLUMNS, [0.1, 0.01, 0.001])


_T7 = {"logistic_regression": [{"c": 1.0}], "random_forest": [{"trees": 100}]}


def _t7(spark, sf, models):
    """(model, scheme, rid, site, y, score) with sites left out, and with ten stratified folds."""
    rows = settled(_study(spark, sf))
    blocks, sites = S.baseline_blocks(rows, 10, derive("t7_cv", 1))
    schemes = {**S.site_scheme(sites), "kfold": S.fold_schemes(10, 1)["repeat0"]}
    return S.named_sites(settled(S.nested(blocks, sites, ("A",), models, schemes, cuts=False)), rows)


@query("loso_vs_kfold")
def loso_vs_kfold(spark, sf):
    """For each model, pooled AUC with sites left out and with random folds, and the paired interval of their difference."""
    oof = settled(_t7(spark, sf, _T7))
    both = oof.groupBy("model", "rid", "y").pivot("scheme", ["loso", "kfold"]).agg(F.first("score"))
    pooled = [auc_by(both, c, by=["model"]).select("model", F.round("auc", 6).alias(f"auc_{c}")) for c in ("loso", "kfold")]
    drawn = replicate_aucs(both, ["model", "y"], ["loso", "kfold"], BOOTS, derive("t7_boot", 1)[0], ["model"], tree=True)
    ci = interval(drawn.withColumn("d", F.col("auc_loso") - F.col("auc_kfold")), "d", ["model"])
    out = pooled[0].join(pooled[1], "model").join(ci, "model")
    return out.select("model", "auc_loso", "auc_kfold", F.round(F.col("auc_loso") - F.col("auc_kfold"), 6).alias("diff"), "lo", "hi", F.when(F.col("hi") < 0, "supported").otherwise("falsified").alias("verdict"))


@query("site_dumbbell")
def site_dumbbell(spark, sf):
    """AUC of each site under both schemes, one row a site and model: the two ends of its line."""
    per = settled(auc_by(_t7(spark, sf, _T7), "score", by=["model", "scheme", "site"]))
    return per.groupBy("model", "site").pivot("scheme", ["loso", "kfold"]).agg(F.round(F.first("auc"), 6)).join(per.groupBy("model", "site").agg(F.max("n").alias("n"), F.max("n_pos").alias("n_pos")), ["model", "site"])


def _gate(runs):
    g = runs.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.stddev_samp("accuracy"), 6).alias("sd"), F.round(F.percentile("accuracy", F.lit(0.025)), 6).alias("lo"), F.round(F.percentile("accuracy", F.lit(0.975)), 6).alias("hi"))
    return g.withColumn("passes", F.lit(0.85).between(F.col("lo"), F.col("hi")))


@query("seed_sweep_forest")
def seed_sweep_forest(spark, sf):
    """The control: forests of 100 trees over the 1,000 named seeds, the central 95 % of their accuracy, and whether a target lies inside."""
    return _gate(S.sweep(_blocks(spark, sf), derive("control", 1000), COLUMNS, "random_forest", 8, impute="native"))


@query("seed_sweep_lr")
def seed_sweep_lr(spark, sf):
    """The same for logistic regression."""
    return _gate(S.sweep(_blocks(spark, sf), derive("control", 1000), COLUMNS, "logistic_regression", 64)).select(F.lit("logistic_regression").alias("model"), "*")


@query("seed_sweep_by_sums")
def seed_sweep_by_sums(spark, sf):
    """A few of those fits over blocks of 1,024 rows, so that tables of more rows are fitted pass by pass."""
    blocks = pack_rows(_study(spark, sf), COLUMNS, block_rows=1024)
    return S.sweep(blocks, derive("control", 20), COLUMNS, "logistic_regression", 20).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.stddev_samp("accuracy"), 6).alias("sd"))


_MODELS = ("logistic_regression", "decision_tree", "random_forest", "boosted_trees")


def _accuracies(spark, sf, seeds):
    blocks, out = _blocks(spark, sf), None
    for model in _MODELS:
        part = S.sweep(blocks, derive("control", seeds), COLUMNS, model, 4).withColumn("model", F.lit(model))
        out = part if out is None else out.unionByName(part)
    return out


@query("accuracy_table")
def accuracy_table(spark, sf):
    """Accuracy by seed, a column a model."""
    return _accuracies(spark, sf, 100).groupBy("seed").pivot("model", list(_MODELS)).agg(F.first("accuracy"))


@query("headline_accuracy")
def headline_accuracy(spark, sf):
    """The forest's accuracy by seed, and what it is ahead of the majority by."""
    return S.sweep(_blocks(spark, sf), derive("control", 100), COLUMNS, "random_forest", 4).select("seed", "accuracy", F.round(F.col("accuracy") - F.col("majority"), 9).alias("excess"))


@query("scaler_scope_identity")
def scaler_scope_identity(spark, sf):
    """Predictions that stay the same, and the paired difference, when the scaler sees the test rows too."""
    blocks, seeds, out = _blocks(spark, sf), derive("control", 200), None
    for model in ("logistic_regression", "mlp"):
        sides = []
        for scope in ("train", "full"):
            runs = S.seed_runs(seeds, COLUMNS, scale=scope)
            sides.append(settled(S.told_runs(S.run_scores(blocks, runs, model, per_task=8), runs, {"split": "bigint"})))
        same = S.same_share(*sides, ["split"])
        a, b = (S.accuracy_by(x, ["split"]).select("split", F.col("accuracy").alias(n)) for x, n in zip(sides, ("train", "full"), strict=True))
        part = same.join(a, "split").join(b, "split").withColumn("d", F.col("full") - F.col("train")).agg(F.lit(model).alias("model"), F.count(F.lit(1)).alias("n"), F.round(F.avg("identical"), 6).alias("identical"), F.round(F.median("d"), 6).alias("median_diff"), F.round(F.avg(F.abs("d")), 6).alias("mean_abs_diff"))
        out = part if out is None else out.unionByName(part)
    return out


@query("exact_rescaling")
def exact_rescaling(spark, sf):
    """Predictions of refitted trees that change when every measurement is multiplied by 4, which is exact, and when it is standardised over all rows."""
    rows, seeds = settled(_study(spark, sf)), derive("control", 200)
    told = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in COLUMNS], *[F.stddev_pop(c).alias(f"s_{c}") for c in COLUMNS])
    forms = {
        "as_is": rows, "times_4": rows.withColumns({c: F.col(c) * 4 for c in COLUMNS}),
        "standardised": rows.join(F.broadcast(told)).withColumns({c: (F.col(c) - F.col(f"m_{c}")) / F.nullif(F.col(f"s_{c}"), F.lit(0.0)) for c in COLUMNS}),  # one row
    }
    runs = S.seed_runs(seeds, COLUMNS, impute="native")
    scores = {k: settled(S.told_runs(S.run_scores(pack_rows(r, COLUMNS), runs, "decision_tree", per_task=8), runs, {"split": "bigint"})) for k, r in forms.items()}
    out = None
    for form in ("times_4", "standardised"):
        other = scores[form].select("split", "key", (F.col("score") >= 0.5).alias("_o"))
        part = scores["as_is"].join(other, ["split", "key"]).agg(F.lit(form).alias("form"), F.count(F.lit(1)).alias("predictions"), F.count_if((F.col("score") >= 0.5) != F.col("_o")).alias("changed"))
        out = part if out is None else out.unionByName(part)
    return out


@query("imputation_scope")
def imputation_scope(spark, sf):
    """The paired difference of forests when the imputer sees the test rows too."""
    blocks, seeds = _blocks(spark, sf), derive("control", 200)
    a, b = (S.sweep(blocks, seeds, COLUMNS, "random_forest", 4, impute=scope).select("seed", F.col("accuracy").alias(scope)) for scope in ("train", "full"))
    return interval(a.join(b, "seed").withColumn("d", F.col("full") - F.col("train")), "d").withColumn("verdict", F.when(F.abs("mid") < 0.005, "supported").otherwise("falsified"))


@query("boosted_missing_modes")
def boosted_missing_modes(spark, sf):
    """Boosted trees with missing values as they are, imputed from all rows, and imputed from the training rows."""
    blocks, out = _blocks(spark, sf, ALL), None
    for mode in ("native", "full", "train"):
        part = S.sweep(blocks, derive("control", 100), ALL, "boosted_trees", 4, impute=mode, trees=100, depth=3, rate=0.1).agg(F.lit(mode).alias("impute_scope"), F.count(F.lit(1)).alias("n"), F.round(F.median("accuracy"), 6).alias("median"))
        out = part if out is None else out.unionByName(part)
    return out


@query("filled_removed")
def filled_removed(spark, sf):
    """Accuracy of forests without the rows whose slope was filled, against 50 draws of as many rows of the same outcomes from the others."""
    draws, seeds = 50, derive("control", 20)
    pub = settled(published(spark, sf).withColumnRenamed("pid", "rid"))
    filled = recorded(spark, sf).where("slope is null").select("rid")
    target, pool = pub.join(filled, "rid", "left_semi"), pub.join(filled, "rid", "left_anti")
    gone = settled(S.matched_drops(pool, target, draws, derive("t1_removal", draws)))
    drops = {"full": target.limit(0), "filled_removed": target, **{f"null{i}": gone.where(F.col("draw") == i) for i in range(draws)}}
    arms = list(drops)
    blocks = pack_rows(S.arm_codes(pub, drops), ALL, arms)
    runs = [{"split": s, "columns": ALL, "arm": a, "trees": 50} for a in arms for s in seeds]
    per = S.accuracy_by(S.told_runs(S.run_scores(blocks, runs, "random_forest", per_task=10), runs, {"arm": "string", "split": "bigint"}), ["arm", "split"])
    medians = per.groupBy("arm").agg(F.median("accuracy").alias("median"), F.median(F.col("accuracy") - F.col("majority")).alias("excess"))
    kind = F.when(F.col("arm").startswith("null"), "null").otherwise(F.col("arm"))
    return medians.groupBy(kind.alias("arm")).agg(F.count(F.lit(1)).alias("draws"), F.round(F.percentile("median", F.lit(0.025)), 6).alias("lo"), F.round(F.median("median"), 6).alias("mid"), F.round(F.percentile("median", F.lit(0.975)), 6).alias("hi"), F.round(F.median("excess"), 6).alias("excess"))


@query("reverted_paired")
def reverted_paired(spark, sf):
    """Accuracy of forests on the frame with its filled cells null again, less that on the frame as published; the same seeds and splits."""
    rec, pub = settled(recorded(spark, sf)), settled(published(spark, sf))
    cells = filled_cells(rec, pub, match_sources(rec, pub, ["site", "y", "n_chars"], ["nsp"]))
    a, b = (S.sweep(pack_rows(d.withColumnRenamed("pid", "rid"), ALL), derive("control", 200), ALL, "random_forest", 4).select("seed", F.col("accuracy").alias(n)) for d, n in ((revert(pub, cells), "reverted"), (pub, "as_published")))
    return interval(a.join(b, "seed").withColumn("d", F.col("reverted") - F.col("as_published")), "d").withColumn("verdict", F.when(F.col("mid") < 0, "supported").otherwise("falsified"))


def _twice(spark, sf):
    """Every third row a second time, with a key over all of a row's values but its id."""
    r = recorded(spark, sf)
    twice = r.unionByName(r.where("rid % 3 = 0").withColumn("rid", -F.col("rid") - 1))
    return twice.withColumn("dup", F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ("site", "grp", "n_chars", "nsp", "slope", "y")])))


@query("duplicates_grouped")
def duplicates_grouped(spark, sf):
    """Accuracy of forests with random splits, and with splits that keep equal rows together."""
    blocks = pack_rows(S.with_groups(settled(_twice(spark, sf)), "dup"), ALL, ["group_code", "head"])
    seeds, out = derive("control", 100), None
    for name, more in (("random", {}), ("grouped", {"group": "group_code"})):
        part = S.sweep(blocks, seeds, ALL, "random_forest", 4, **more).agg(F.lit(name).alias("split"), F.count(F.lit(1)).alias("n"), F.round(F.median("accuracy"), 6).alias("median"))
        out = part if out is None else out.unionByName(part)
    return out


_SEEDS = 1000
_CONTAMINATION = f"""WITH @rec, t AS (SELECT * FROM rec UNION ALL SELECT -rid - 1, site, grp, n_chars, nsp, slope, y FROM rec WHERE rid % 3 = 0),
 s AS (SELECT seed, rid, dense_rank() OVER (ORDER BY site, grp, n_chars, nsp, slope, y) AS g, row_number() OVER (PARTITION BY seed ORDER BY {h32("seed", "'split'", "rid")}, rid) <= ceil(0.2 * count(*) OVER (PARTITION BY seed)) AS test FROM t, range(0, {_SEEDS}) r(seed)),
 c AS (SELECT seed, g, sum(CASE WHEN test THEN 1 ELSE 0 END) AS n_in, sum(CASE WHEN test THEN 0 ELSE 1 END) AS n_out FROM s GROUP BY seed, g),
 p AS (SELECT seed, sum(n_in) AS n_test, sum(CASE WHEN n_out > 0 THEN n_in ELSE 0 END) AS n_hit, round(sum(CASE WHEN n_out > 0 THEN n_in ELSE 0 END) / CAST(sum(n_in) AS DOUBLE), 9) AS share FROM c GROUP BY seed)
 SELECT count(*) AS seeds, CAST(sum(n_hit) AS BIGINT) AS hits, round(quantile_cont(share, 0.025), 9) AS lo, round(quantile_cont(share, 0.5), 9) AS mid, round(quantile_cont(share, 0.975), 9) AS hi FROM p"""


@query("contamination_by_seed", _CONTAMINATION)
def contamination_all_seeds(spark, sf):
    """Over 1,000 seeds: the share of test rows with an equal row outside the test set."""
    per = contamination_by_seed(settled(_twice(spark, sf)), "rid", "dup", list(range(_SEEDS)))
    p = lambda q: F.round(F.percentile("share", F.lit(q)), 9)
    return per.agg(F.count(F.lit(1)).alias("seeds"), F.sum("n_hit").alias("hits"), p(0.025).alias("lo"), p(0.5).alias("mid"), p(0.975).alias("hi"))


_KNN_SQL = """WITH @rec, d AS (SELECT a.rid, a.y AS truth, b.rid AS near, b.y, (a.n_chars - b.n_chars) * (a.n_chars - b.n_chars) + (a.k - b.k) * (a.k - b.k) AS d
  FROM (SELECT rid, site, n_chars, coalesce(nsp, 0) AS k, y FROM rec) a JOIN (SELECT rid, site, n_chars, coalesce(nsp, 0) AS k, y FROM rec) b ON a.site <> b.site),
 r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY d, near) AS rn FROM d)
 SELECT rid, truth, k, round(avg(y), 9) AS score FROM r JOIN (VALUES (5), (15)) v(k) ON rn <= k GROUP BY rid, truth, k"""


@query("knn_oof_loso", _KNN_SQL)
def knn_oof_loso(spark, sf):
    """Out-of-fold votes of all rows: each row's nearest rows of the other sites, exactly."""
    rows, sites = S.numbered(_frame(spark, sf), "site", "code")
    each = rows.withColumn("run", F.explode(F.array(*[F.lit(i) for i in range(len(sites))])) if sites else F.lit(0))
    x = F.array(F.col("n_chars").cast("double"), F.coalesce("nsp", F.lit(0)).cast("double"))
    near = nearest_rows(each.select("run", F.col("rid").alias("key"), "y", (F.col("code") != F.col("run")).alias("train"), (F.col("code") == F.col("run")).alias("test"), x.alias("x")), 15)
    return vote(near, [5, 15]).select(F.col("key").alias("rid"), F.col("y").alias("truth"), "k", F.round("score", 9).alias("score"))


_PATTERN = "CASE WHEN nsp IS NULL THEN 1 ELSE 0 END + 2 * CASE WHEN slope IS NULL THEN 1 ELSE 0 END"


@query("missingness_only", f"""WITH @rec, f AS (SELECT rid, y, {_PATTERN} AS pat, (row_number() OVER (PARTITION BY y ORDER BY {h32('7', chr(39) + 'fold' + chr(39), 'rid')}, rid) - 1) % 10 AS fold, 1 AS one FROM rec),
 g AS (SELECT pat, fold, sum(y) AS p, count(*) AS n FROM f GROUP BY pat, fold), t AS (SELECT pat, sum(p) AS p, sum(n) AS n FROM g GROUP BY pat),
 s AS (SELECT f.y, f.one, round((t.p - g.p) / nullif(CAST(t.n - g.n AS DOUBLE), 0), 9) AS s, CAST(f.pat % 2 AS DOUBLE) AS flag FROM f JOIN g ON g.pat = f.pat AND g.fold = f.fold JOIN t ON t.pat = f.pat),
 a AS (SELECT 'all_flags' AS design, y, {_RK.format(b='one', s='s')} AS rk FROM s WHERE s IS NOT NULL UNION ALL SELECT 'one_flag', y, {_RK.format(b='one', s='flag')} FROM s) SELECT design, round({_AUC}, 9) AS auc FROM a GROUP BY design""")
def missingness_only(spark, sf):
    """AUC of which cells are missing alone, out of fold; and of one such flag."""
    r = recorded(spark, sf).withColumn("pat", F.expr(_PATTERN)).select("rid", "y", "pat")
    f = stratified_folds(r, "rid", "y", 7, 10)
    g = f.groupBy("pat", "fold").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    t = g.groupBy("pat").agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    rate = F.round((F.col("tp") - F.col("p")) / F.nullif((F.col("tn") - F.col("n")).cast("double"), F.lit(0.0)), 9)
    s = f.join(g, ["pat", "fold"]).join(t, "pat").select("y", rate.alias("all_flags"), (F.col("pat") % 2).cast("double").alias("one_flag"))
    long = s.unpivot(["y"], ["all_flags", "one_flag"], "design", "s")
    return auc_by(long, "s", by=["design"]).select("design", F.round("auc", 9).alias("auc"))


#: One point a model, for the controls of ten folds five times over.
CONTROL = {"logistic_regression": [{"c": 1.0}], "knn": [{"k": 15, "weights": "uniform"}], "boosted_trees": [{"depth": 3, "trees": 100, "rate": 0.1}], "mlp": [{"layers": [16], "alpha": 1e-4}]}


def _baseline(spark, sf, arms=("A", "B"), models=None, cuts=False):
    """Out-of-fold scores of the arms and models, a site left out at a time, grids searched inside; with their site, and with cuts their threshold."""
    rows = settled(_study(spark, sf))
    blocks, sites = S.baseline_blocks(rows)
    return settled(S.named_sites(S.nested(blocks, sites, arms, models or S.GRIDS, S.site_scheme(sites), derive("baseline", 3)[0], cuts=cuts), rows))


def _control(spark, sf, arms=("A", "B"), models=None, folds=10, repeats=5):
    """Scores of repeated stratified folds at one point of each grid."""
    seed = derive("baseline", 3)[2] % 100_000
    blocks, sites = S.baseline_blocks(settled(_study(spark, sf)), folds, [seed + r for r in range(repeats)])
    return settled(S.nested(blocks, sites, arms, models or CONTROL, S.fold_schemes(folds, repeats), derive("baseline", 3)[0], per_task=8, cuts=False))


@query("honest_baseline")
def honest_baseline(spark, sf):
    """(arm, model, site, metric, value): AUC with its interval, DeLong bounds, calibration and balanced accuracy; site null for the whole."""
    oof, by = _baseline(spark, sf, cuts=True), ["arm", "model"]
    seed = derive("baseline", 3)[1]
    whole = site_weighted_auc(oof, "score", "site", by).select(*by, "auc")
    ci = interval(replicate_aucs(oof, [*by, "site", "y"], ["score"], BOOTS, seed, by, "site", tree=True), "site_score", by).select(*by, "lo", "hi")
    pooled = auc_by(oof, "score", by=by).select(*by, F.col("auc").alias("pooled_auc"))
    total = whole.join(ci, by).join(pooled, by).withColumn("site", F.lit(None).cast("string"))
    per = [*by, "site"]
    dl = delong(oof, "score", per)
    keyed = oof.withColumn("x", clip_logit(F.col("score")))
    cal = calibration_intercept(keyed, "x", per).join(L.calibration_slopes(keyed, "x", per).select(*per, "slope"), per)
    half = balanced_accuracy(oof, "score", F.lit(0.5), per).withColumnRenamed("balanced_accuracy", "balanced_half")
    cut = balanced_accuracy(oof, "score", F.col("threshold"), per).withColumnRenamed("balanced_accuracy", "balanced_youden")
    sizes = oof.groupBy(*per).agg(F.sum("y").cast("double").alias("n_pos"), F.sum(1 - F.col("y")).cast("double").alias("n_neg")).withColumn("underpowered", (F.col("n_neg") < 20).cast("double"))
    site = dl.join(cal, per).join(half, per).join(cut, per).join(sizes, per)
    long = lambda d: d.unpivot(per, [c for c in d.columns if c not in per], "metric", "value")
    return long(total).unionByName(long(site)).withColumn("value", F.round("value", 6))


@query("honest_estimates")
def honest_estimates(spark, sf):
    """The rows of the estimates figure: for each arm and model the within-site AUC with its interval, against random folds."""
    loso = _baseline(spark, sf, models={m: S.GRIDS[m] for m in ("logistic_regression", "knn")} | {m: CONTROL[m] for m in ("boosted_trees", "mlp")})
    cv, by = _control(spark, sf, folds=10, repeats=1), ["arm", "model"]
    ci = interval(replicate_aucs(loso, [*by, "site", "y"], ["score"], BOOTS, derive("baseline", 3)[1], by, "site", tree=True), "site_score", by).select(*by, "lo", "hi")
    out = site_weighted_auc(loso, "score", "site", by).select(*by, F.round("auc", 6).alias("loso")).join(ci, by).join(auc_by(cv, "score", by=by).select(*by, F.round("auc", 6).alias("cv")), by)
    return out.withColumn("label", F.concat_ws(" / ", "model", "arm"))


@query("baseline_significance")
def baseline_significance(spark, sf):
    """Fold AUCs of each model less logistic regression's, the corrected t-test over ten folds five times over, and Holm over the models of an arm."""
    per = settled(auc_by(_control(spark, sf), "score", by=["arm", "model", "scheme", "fold"]))
    base = per.where("model = 'logistic_regression'").select("arm", "scheme", "fold", F.col("auc").alias("base"))
    diffs = per.where("model <> 'logistic_regression'").join(base, ["arm", "scheme", "fold"]).withColumn("d", F.col("auc") - F.col("base"))
    t = corrected_t(diffs, "d", 1 / 9, ["arm", "model"])
    return holm(t, "p", "model", ["arm"])


@query("baseline_repeats")
def baseline_repeats(spark, sf):
    """Each repeat's folds put together to one score a row: pooled AUC by repeat, its mean and deviation."""
    rows = settled(_study(spark, sf))
    seed = derive("baseline", 3)[2] % 100_000
    blocks, sites = S.baseline_blocks(rows, 10, [seed + r for r in range(5)])
    oof = S.nested(blocks, sites, ("A",), {"logistic_regression": S.GRIDS["logistic_regression"]}, S.fold_schemes(10, 5), per_task=64, cuts=False)
    per = auc_by(oof, "score", by=["model", "scheme"])
    return per.groupBy("model").agg(F.count(F.lit(1)).alias("repeats"), F.max("n").alias("rows"), F.round(F.avg("auc"), 6).alias("mean"), F.round(F.stddev_samp("auc"), 6).alias("sd"))


@query("hyperparameter_stability")
def hyperparameter_stability(spark, sf):
    """The grid's choice of each model, a column for each site left out."""
    return _baseline(spark, sf, ("A",)).groupBy("model").pivot("site").agg(F.first("best"))


@query("dt_fit")
def dt_fit(spark, sf):
    return L.oof(_fold3(spark, sf), "k", COLUMNS, L.models()["decision_tree"])


@query("gbt_missing_modes")
def gbt_missing_modes(spark, sf):
    base = _fold3(spark, sf)
    flagged = base.withColumn("miss", F.col("nsp").isNull().cast("double")).withColumn("nsp", F.coalesce("nsp", F.lit(-1)))
    run = lambda d, cols, mode: auc_by(L.oof(d, "k", cols, L.models()["boosted_trees"]), "score").withColumn("mode", F.lit(mode))
    return run(base, COLUMNS, "imputed").unionByName(run(flagged, [*COLUMNS, "miss"], "flagged"))


@query("mlp_fit")
def mlp_fit(spark, sf):
    return L.oof(_fold3(spark, sf), "k", COLUMNS, L.models()["mlp"])


@query("svm_rff")
def svm_rff(spark, sf):
    return L.oof(_fold3(spark, sf), "k", COLUMNS, L.models()["linear_svm"], lambda d: L.fourier_features(d, 2))


@query("shuffled_label_gate")
def shuffled_label_gate(spark, sf):
    """The nested baseline fitted anew on 50 shuffles of the labels: how many intervals, of the pooled and of the within-site AUC, hold a half."""
    shuffles = 50
    rows = settled(_study(spark, sf))
    blocks, sites = S.baseline_blocks(rows, shuffles=shuffles, seed=50)
    oof = S.nested(blocks, sites, ("A",), {"logistic_regression": S.GRIDS["logistic_regression"]}, S.site_scheme(sites), shuffles=shuffles, per_task=64, cuts=False)
    oof = settled(S.named_sites(oof, rows))
    draws = settled(replicate_aucs(oof, ["shuffle", "site", "y"], ["score"], GATE_BOOTS, 50, ["shuffle"], "site", tree=True))
    forms = {"pooled": (auc_by(oof, "score", by=["shuffle"]), "auc_score"), "within_site": (site_weighted_auc(oof, "score", "site", ["shuffle"]), "site_score")}
    parts = []
    for form, (value, boots) in forms.items():
        held = interval(draws, boots, ["shuffle"]).withColumn("holds", F.lit(0.5).between(F.col("lo"), F.col("hi")).cast("int"))
        parts.append(value.select("shuffle", "auc").join(held.select("shuffle", "holds"), "shuffle").agg(F.lit(form).alias("form"), F.count(F.lit(1)).alias("shuffles"), F.round(F.avg("auc"), 6).alias("mean"), F.round(F.min("auc"), 6).alias("min"), F.round(F.max("auc"), 6).alias("max"), F.sum("holds").cast("bigint").alias("holding")))
    both = parts[0].unionByName(parts[1])
    required = binomial_gate(both.select(F.col("shuffles").alias("n")).distinct(), "n", 0.025, 0.95)
    return both.join(F.broadcast(required), both["shuffles"] == F.col("n")).drop("n").withColumn("passes", F.col("holding") >= F.col("required"))


_U = lambda seed, *parts: f"({h32(str(seed), *parts)} + 0.5) / 4294967296.0"
_N01 = lambda seed, *parts: f"sqrt(-2 * ln(CAST({_U(seed, chr(39) + 'r' + chr(39), *parts)} AS DOUBLE))) * cos(6.283185307179586 * CAST({_U(seed, chr(39) + 'a' + chr(39), *parts)} AS DOUBLE))"
#: Simulations of each row.
SIMS = 20


def _simulated(spark, sf):
    return recorded(spark, sf).select("rid", "y", F.explode(F.sequence(F.lit(0), F.lit(SIMS - 1))).alias("sim"))


@query("binormal_auc", f"WITH @rec, r AS (SELECT rid AS k, y, sim FROM rec, range(0, {SIMS}) t(sim)), s AS (SELECT sim, y, round(CASE WHEN y = 1 THEN 0.8 ELSE 0 END + {_N01(61, 'sim', 'k')}, 9) AS s FROM r), a AS (SELECT sim, y, {_RK.format(b='sim', s='s')} AS rk FROM s) SELECT CAST(sim AS INT) AS sim, round({_AUC}, 9) AS auc FROM a GROUP BY sim")
def binormal_auc(spark, sf):
    """Simulated scores of the labelled rows with a known AUC of about 0.714: what the estimator makes of each simulation."""
    sims = _simulated(spark, sf).withColumn("score", F.round(F.when(F.col("y") == 1, 0.8).otherwise(0.0) + normal(61, F.col("sim"), F.col("rid")), 9))
    return auc_by(sims, "score", by=["sim"]).select("sim", F.round("auc", 9).alias("auc"))


@query("logistic_nll", f"WITH @rec, r AS (SELECT rid AS k, sim FROM rec, range(0, {SIMS}) t(sim)), x AS (SELECT sim, k, {_N01(62, 'sim', 'k')} AS x FROM r), s AS (SELECT sim, CASE WHEN CAST({_U(62, chr(39) + 'y' + chr(39), 'sim', 'k')} AS DOUBLE) < 1 / (1 + exp(-(-0.5 + 1.5 * x))) THEN 1 ELSE 0 END AS y, -0.5 + 1.5 * x AS eta FROM x) SELECT CAST(sim AS INT) AS sim, round(sum(greatest(0, eta) + ln(1 + exp(-abs(eta))) - y * eta), 6) AS nll, count(*) AS n FROM s GROUP BY sim")
def logistic_nll(spark, sf):
    """Outcomes of a known logistic law, simulated for each labelled row, and their loss under it."""
    sims = _simulated(spark, sf).withColumn("eta", F.lit(-0.5) + 1.5 * normal(62, F.col("sim"), F.col("rid")))
    sims = sims.withColumn("y", (uniform(62, F.lit("y"), F.col("sim"), F.col("rid")) < 1 / (1 + F.exp(-F.col("eta")))).cast("int"))
    return negative_log_likelihood(sims, "eta", ["sim"])


_GATE_SQL = """WITH @rec, s AS (SELECT site, count(*) AS n FROM rec GROUP BY site),
 c AS (SELECT site, n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(CAST(0.95 AS DOUBLE)) + (n - k) * ln(CAST(0.05 AS DOUBLE)))) OVER (PARTITION BY site ORDER BY k) AS p FROM s, LATERAL (SELECT unnest(range(0, n + 1)) AS k) t)
 SELECT site, n, min(k) AS required FROM c WHERE p >= 0.025 GROUP BY site, n"""


@query("gate_requirement", _GATE_SQL)
def gate_requirement(spark, sf):
    """Of as many 95 % intervals as a site has rows, how many have to hold their value."""
    sizes = recorded(spark, sf).groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    return binomial_gate(sizes, "n", 0.025, 0.95)
