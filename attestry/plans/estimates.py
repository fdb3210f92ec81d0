"""Queries: AUC, intervals, tests, calibration, best-of-N bias."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.functions.scalars import clip_logit
from attestry.operators import statistics as T
from attestry.operators.replicates import replicate_aucs
from attestry.operators.sampling import bootstrap_weights
from attestry.plans.registry import h32, query
from attestry.plans.resampling import _AUC, _RK
from attestry.sources.readers import recorded, table

Z = 1.959963984540054
_SITE = "a AS (SELECT site, y, " + _RK.format(b="site", s="n_chars") + f" AS rk FROM rec), s AS (SELECT site, {_AUC} AS auc, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM a GROUP BY site)"


@query("site_weighted_auc", "WITH @rec, " + _SITE + " SELECT round(sum(auc * n) / nullif(sum(CASE WHEN auc IS NOT NULL THEN n END), 0), 9) AS auc, count(auc) AS n_sites, count(*) - count(auc) AS n_undefined FROM s")
def site_weighted_auc(spark, sf):
    return T.site_weighted_auc(recorded(spark, sf), "n_chars", "site").withColumn("auc", F.round("auc", 9))


@query("auc_by_site", "WITH @rec, " + _SITE + " SELECT site, round(auc, 9) AS auc, n, n_pos FROM s")
def auc_by_site(spark, sf):
    return T.auc_by(recorded(spark, sf), "n_chars", by=["site"]).withColumn("auc", F.round("auc", 9))


def _draws(seed, strata, values):
    """SQL of bootstrap draws: rows stand in order of their values, as for bootstrap_weights."""
    s = ", ".join(strata)
    eq = " AND ".join(f"p.{c} = k.{c}" for c in strata)
    return (f"base AS (SELECT rid, y, site, rec.n_chars, length(text) - length(replace(text, ' ', '')) AS sp FROM rec JOIN documents d ON d.doc_id = rid),"
            f" pos AS (SELECT *, row_number() OVER (PARTITION BY {s} ORDER BY {values}, rid) - 1 AS pos, row_number() OVER (PARTITION BY {s} ORDER BY rid) - 1 AS k, count(*) OVER (PARTITION BY {s}) AS size FROM base),"
            f" picks AS (SELECT b, {s}, {h32(str(seed), 'b', *strata, 'k')} % size AS pos FROM pos, range(0, 200) t(b)), draws AS (SELECT k.b, p.rid, p.y, p.site, p.n_chars, p.sp FROM picks k JOIN pos p ON {eq} AND p.pos = k.pos)")  # fmt: skip


_CI = "round(quantile_cont({v}, 0.025), 9) AS lo, round(quantile_cont({v}, 0.5), 9) AS mid, round(quantile_cont({v}, 0.975), 9) AS hi, count({v}) AS n"


def _base(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("rid"), (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("sp"))
    return recorded(spark, sf).select("rid", "y", "site", "n_chars").join(d, "rid")


@query("bootstrap_auc_ci", f"WITH @rec, {_draws(21, ['y'], 'n_chars')}, r AS (SELECT b, y, {_RK.format(b='b', s='n_chars')} AS rk FROM draws), a AS (SELECT b, {_AUC} AS auc FROM r GROUP BY b) SELECT {_CI.format(v='auc')} FROM a")
def bootstrap_auc_ci(spark, sf):
    return T.interval(replicate_aucs(recorded(spark, sf).select("y", "n_chars"), ["y"], ["n_chars"], 200, 21), "auc_n_chars")


@query("paired_auc_diff", f"WITH @rec, {_draws(22, ['y'], 'n_chars, sp')}, r AS (SELECT b, y, {_RK.format(b='b', s='n_chars')} AS rk, {_RK.format(b='b', s='sp')} AS rk2 FROM draws), a AS (SELECT b, {_AUC} - {_AUC.replace('rk', 'rk2')} AS d FROM r GROUP BY b) SELECT {_CI.format(v='d')} FROM a")
def paired_auc_diff(spark, sf):
    drawn = replicate_aucs(_base(spark, sf).select("y", "n_chars", "sp"), ["y"], ["n_chars", "sp"], 200, 22)
    return T.interval(drawn.withColumn("d", F.col("auc_n_chars") - F.col("auc_sp")), "d")


@query("site_weighted_auc_ci", f"WITH @rec, {_draws(23, ['site', 'y'], 'n_chars')}, r AS (SELECT b, site, y, {_RK.format(b='b, site', s='n_chars')} AS rk FROM draws), s AS (SELECT b, site, {_AUC} AS auc, count(*) AS n FROM r GROUP BY b, site), a AS (SELECT b, sum(auc * n) / nullif(sum(CASE WHEN auc IS NOT NULL THEN n END), 0) AS auc FROM s GROUP BY b) SELECT {_CI.format(v='auc')} FROM a")
def site_weighted_auc_ci(spark, sf):
    return T.interval(replicate_aucs(recorded(spark, sf).select("site", "y", "n_chars"), ["site", "y"], ["n_chars"], 200, 23, site="site"), "site_n_chars")


@query("delong_ci", f"""WITH @rec, z AS (SELECT site, y, sum(y) OVER (PARTITION BY site) AS n1, sum(1 - y) OVER (PARTITION BY site) AS n0, ({_RK.format(b='site', s='n_chars')}) - ({_RK.format(b='site, y', s='n_chars')}) AS d FROM rec),
 v AS (SELECT *, CASE WHEN y = 1 THEN d / nullif(n0, 0) ELSE 1 - d / nullif(n1, 0) END AS v FROM z), g AS (SELECT site, CASE WHEN min(y) < max(y) THEN avg(CASE WHEN y = 1 THEN v END) END AS auc, sqrt(var_samp(CASE WHEN y = 1 THEN v END) / nullif(max(n1), 0) + var_samp(CASE WHEN y = 0 THEN v END) / nullif(max(n0), 0)) AS se FROM v GROUP BY site)
 SELECT site, round(auc, 9) AS auc, round(se, 9) AS se, CASE WHEN se IS NOT NULL THEN round(greatest(CAST(0 AS DOUBLE), auc - {Z} * se), 9) END AS lo, CASE WHEN se IS NOT NULL THEN round(least(CAST(1 AS DOUBLE), auc + {Z} * se), 9) END AS hi FROM g""")
def delong_ci(spark, sf):
    return T.delong(recorded(spark, sf), "n_chars", ["site"])


_RULES = "CASE WHEN (n_chars > 1000) = (y = 1) THEN true ELSE false END AS ca, CASE WHEN (n_chars > 300) = (y = 1) THEN true ELSE false END AS cb"
_MCN = f"""c AS (SELECT grp, {_RULES} FROM rec), n AS (SELECT grp, sum(CASE WHEN ca AND NOT cb THEN 1 ELSE 0 END) AS n_a, sum(CASE WHEN cb AND NOT ca THEN 1 ELSE 0 END) AS n_b FROM c GROUP BY grp),
 p AS (SELECT grp, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, CASE WHEN n_a + n_b = 0 THEN CAST(1 AS DOUBLE) ELSE round(least(CAST(1 AS DOUBLE), 2 * (SELECT sum(exp(lgamma(n_a + n_b + 1) - lgamma(k + 1) - lgamma(n_a + n_b - k + 1) - (n_a + n_b) * ln(CAST(2 AS DOUBLE)))) FROM range(0, 5000) t(k) WHERE k <= least(n_a, n_b))), 9) END AS p FROM n)"""


def _mcnemar(spark, sf):
    r = recorded(spark, sf).withColumn("ca", (F.col("n_chars") > 1000) == (F.col("y") == 1)).withColumn("cb", (F.col("n_chars") > 300) == (F.col("y") == 1))
    return T.mcnemar(r, "ca", "cb", ["grp"])


@query("mcnemar_by_group", f"WITH @rec, {_MCN} SELECT grp, n_a, n_b, p FROM p")
def mcnemar_by_group(spark, sf):
    return _mcnemar(spark, sf)


@query("holm_adjust", f"WITH @rec, {_MCN}, s AS (SELECT grp, p, (count(*) OVER () - row_number() OVER (ORDER BY p, grp) + 1) * p AS sp FROM p) SELECT grp, p, round(least(CAST(1 AS DOUBLE), max(sp) OVER (ORDER BY p, grp ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM s")
def holm_adjust(spark, sf):
    return T.holm(_mcnemar(spark, sf).select("grp", "p"), "p", "grp")


# The SQL takes the p-value from the t density with the angle as variable, by Simpson's rule in 2,000 steps.
@query("nadeau_bengio_t", """WITH @rec, d AS (SELECT grp, avg(CASE WHEN (n_chars > 1000) = (y = 1) THEN CAST(1 AS DOUBLE) ELSE 0 END) - avg(CASE WHEN (n_chars > 300) = (y = 1) THEN CAST(1 AS DOUBLE) ELSE 0 END) AS d FROM rec GROUP BY grp),
 a AS (SELECT avg(d) AS m, var_samp(d) AS v, count(d) AS j FROM d), t AS (SELECT *, CASE WHEN v > 0 THEN m / sqrt(v * (1 / CAST(j AS DOUBLE) + CAST(0.1 AS DOUBLE))) WHEN v = 0 AND m = 0 THEN CAST(0 AS DOUBLE) WHEN v = 0 THEN sign(m) * CAST('inf' AS DOUBLE) END AS t FROM a),
 s AS (SELECT (SELECT sum((CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * power(cos(i * atan(abs(t.t) / sqrt(CAST(t.j - 1 AS DOUBLE))) / 2000), t.j - 2)) * atan(abs(t.t) / sqrt(CAST(t.j - 1 AS DOUBLE))) / 6000 FROM range(0, 2001) r(i)) AS area, t.* FROM t)
 SELECT round(m, 9) AS mean, round(t, 9) AS t, round(CASE WHEN v > 0 THEN 1 - 2 * area * exp(lgamma(CAST(j AS DOUBLE) / 2) - lgamma(CAST(j - 1 AS DOUBLE) / 2)) / sqrt(pi()) WHEN v = 0 AND m = 0 THEN CAST(1 AS DOUBLE) WHEN v = 0 THEN CAST(0 AS DOUBLE) END, 9) AS p, j FROM s""")
def nadeau_bengio_t(spark, sf):
    hit = lambda k: F.avg(((F.col("n_chars") > k) == (F.col("y") == 1)).cast("double"))
    return T.corrected_t(recorded(spark, sf).groupBy("grp").agg((hit(1000) - hit(300)).alias("d")), "d", 0.1)


@query("youden_threshold", """WITH @rec, g AS (SELECT site, n_chars, sum(y) AS p, sum(1 - y) AS q FROM rec GROUP BY site, n_chars),
 j AS (SELECT site, n_chars, round(sum(p) OVER w / nullif(CAST(sum(p) OVER f AS DOUBLE), 0) - sum(q) OVER w / nullif(CAST(sum(q) OVER f AS DOUBLE), 0), 9) AS j FROM g WINDOW w AS (PARTITION BY site ORDER BY n_chars DESC ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY site))
 SELECT site, CAST(n_chars AS DOUBLE) AS threshold, j FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY j DESC NULLS LAST, n_chars) AS rn FROM j) WHERE rn = 1""")
def youden_threshold(spark, sf):
    return T.youden(recorded(spark, sf), "n_chars", ["site"])


@query("balanced_accuracy", "WITH @rec SELECT site, round((avg(CASE WHEN y = 1 THEN CASE WHEN n_chars >= 1000 THEN CAST(1 AS DOUBLE) ELSE 0 END END) + avg(CASE WHEN y = 0 THEN CASE WHEN n_chars >= 1000 THEN CAST(0 AS DOUBLE) ELSE 1 END END)) / 2, 9) AS balanced_accuracy FROM rec GROUP BY site")
def balanced_accuracy(spark, sf):
    return T.balanced_accuracy(recorded(spark, sf), "n_chars", F.lit(1000), ["site"])


_P = "least(CAST(0.999999 AS DOUBLE), greatest(CAST(0.000001 AS DOUBLE), CAST(n_chars % 97 + 1 AS DOUBLE) / 99))"


@query("calibration_intercept", f"""WITH RECURSIVE @rec, x AS (SELECT site, y, ln({_P} / (1 - {_P})) AS x FROM rec), it AS (SELECT site, 0 AS k, CAST(0 AS DOUBLE) AS a FROM (SELECT DISTINCT site FROM rec)
 UNION ALL SELECT it.site, k + 1, a + greatest(-2, least(2, coalesce((SELECT (sum(y) - sum(1 / (1 + exp(-(a + x.x))))) / nullif(sum((1 / (1 + exp(-(a + x.x)))) * (1 - 1 / (1 + exp(-(a + x.x))))), 0) FROM x WHERE x.site = it.site), 0))) FROM it WHERE k < 30)
 SELECT site, CASE WHEN (SELECT min(y) < max(y) FROM x WHERE x.site = it.site) THEN round(a, 6) END AS intercept FROM it WHERE k = 30""")
def calibration_intercept(spark, sf):
    r = recorded(spark, sf).withColumn("x", clip_logit((F.col("n_chars") % 97 + 1).cast("double") / 99))
    return T.calibration_intercept(r, "x", ["site"])


_Q = "1 / (1 + exp(-(it.a + it.b * x.x)))"


@query("calibration_slope", f"""WITH RECURSIVE @rec, x AS (SELECT site, y, ln({_P} / (1 - {_P})) AS x FROM rec), it AS (SELECT site, 0 AS k, CAST(0 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS b FROM (SELECT DISTINCT site FROM rec)
 UNION ALL SELECT site, k + 1, a + greatest(-2, least(2, (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01))), b + greatest(-2, least(2, (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01)))
  FROM (SELECT it.site, it.k, it.a, it.b, sum(x.y - {_Q}) AS g0, sum((x.y - {_Q}) * x.x) AS g1, sum({_Q} * (1 - {_Q})) AS h00, sum({_Q} * (1 - {_Q}) * x.x) AS h01, sum({_Q} * (1 - {_Q}) * x.x * x.x) AS h11
        FROM it JOIN x ON x.site = it.site WHERE it.k < 30 GROUP BY it.site, it.k, it.a, it.b))
 SELECT it.site, CASE WHEN ok THEN round(a, 6) END AS intercept, CASE WHEN ok THEN round(b, 6) END AS slope FROM it JOIN (SELECT site, min(y) < max(y) AND min(CASE WHEN y = 1 THEN x END) < max(CASE WHEN y = 0 THEN x END)
   AND min(CASE WHEN y = 0 THEN x END) < max(CASE WHEN y = 1 THEN x END) AS ok FROM x GROUP BY site) g ON g.site = it.site WHERE k = 30""")
def calibration_slope(spark, sf):
    from attestry.operators.learning import calibration_slopes

    return calibration_slopes(recorded(spark, sf).withColumn("x", clip_logit((F.col("n_chars") % 97 + 1).cast("double") / 99)), "x", ["site"])


_CORRECT = "correct AS (SELECT rid, m, CASE WHEN (n_chars > m) = (y = 1) THEN 1 ELSE 0 END AS c FROM rec, (VALUES (100), (300), (1000), (3000)) t(m))"


@query("winners_curse", f"""WITH @rec, {_CORRECT}, code AS (SELECT rid, sum(c * CASE m WHEN 100 THEN 1 WHEN 300 THEN 2 WHEN 1000 THEN 4 ELSE 8 END) AS code FROM correct GROUP BY rid),
 pos AS (SELECT rid, row_number() OVER (ORDER BY code, rid) - 1 AS pos, count(*) OVER () AS size FROM code), picks AS (SELECT b, {h32('31', 'b', "'all'", 'pos')} % size AS pos FROM pos, range(0, 100) t(b)),
 w AS (SELECT b, rid, count(*) AS w FROM picks JOIN pos USING (pos) GROUP BY b, rid), full_w AS (SELECT t.b, r.rid, coalesce(w.w, 0) AS w FROM range(0, 100) t(b) CROSS JOIN rec r LEFT JOIN w ON w.b = t.b AND w.rid = r.rid),
 acc AS (SELECT b, m, sum(w * c) / CAST(sum(w) AS DOUBLE) AS inbag, avg(CASE WHEN w = 0 THEN CAST(c AS DOUBLE) END) AS oob FROM full_w JOIN correct USING (rid) GROUP BY b, m),
 best AS (SELECT b, avg(inbag - oob) AS bias FROM (SELECT *, max(inbag) OVER (PARTITION BY b) AS top FROM acc) WHERE inbag = top AND oob IS NOT NULL GROUP BY b) SELECT round(avg(bias), 9) AS bias, count(*) AS n FROM best""")
def winners_curse(spark, sf):
    rules = (100, 300, 1000, 3000)
    right = [((F.col("n_chars") > k) == (F.col("y") == 1)).cast("int") for k in rules]
    # What a row adds to any rule's accuracy is which rules are right on it.
    coded = recorded(spark, sf).select(F.lit("all").alias("all"), sum((c * (1 << i) for i, c in enumerate(right)), F.lit(0)).alias("code"))
    draws = bootstrap_weights(coded, ["all"], ["code"], 100, 31, seen=True)
    each = draws.withColumn("i", F.explode(F.array(*[F.lit(i) for i in range(len(rules))]))).withColumn("c", F.expr("cast(shiftright(code, i) & 1 as bigint)"))
    out = F.col("size") - F.col("seen")
    acc = each.groupBy("b", "i").agg((F.sum(F.col("drawn") * F.col("c")) / F.sum("drawn").cast("double")).alias("inbag"), (F.sum(out * F.col("c")) / F.nullif(F.sum(out), F.lit(0)).cast("double")).alias("oob"))
    best = acc.withColumn("top", F.max("inbag").over(Window.partitionBy("b"))).where("inbag = top and oob is not null").groupBy("b").agg(F.avg(F.col("inbag") - F.col("oob")).alias("bias"))
    return best.agg(F.round(F.avg("bias"), 9).alias("bias"), F.count(F.lit(1)).alias("n"))


_SEEDACC = f"""t AS (SELECT rid, y, n_chars, seed, row_number() OVER (PARTITION BY seed ORDER BY {h32('seed', "'split'", 'rid')}, rid) AS rn, count(*) OVER (PARTITION BY seed) AS n FROM rec, range(0, 50) s(seed)),
 acc AS (SELECT seed, m, avg(CASE WHEN (n_chars > m) = (y = 1) THEN CAST(1 AS DOUBLE) ELSE 0 END) AS acc FROM t, (VALUES (100), (300), (1000), (3000)) k(m) WHERE rn <= ceil(n * 0.2) GROUP BY seed, m)"""


def _seed_acc(spark, sf):
    from attestry.operators.sampling import hash_split

    r = recorded(spark, sf).select("rid", "y", "n_chars").withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(49))))
    test = hash_split(r, "rid", F.col("seed"), ["seed"]).where("is_test").withColumn("m", F.explode(F.array(*[F.lit(x) for x in (100, 300, 1000, 3000)])))
    return test.groupBy("seed", "m").agg(F.avg(((F.col("n_chars") > F.col("m")) == (F.col("y") == 1)).cast("double")).alias("acc"))


@query("win_share", f"WITH @rec, {_SEEDACC}, f AS (SELECT *, CASE WHEN acc = max(acc) OVER (PARTITION BY seed) THEN 1 ELSE 0 END AS win FROM acc), c AS (SELECT *, win / CAST(sum(win) OVER (PARTITION BY seed) AS DOUBLE) AS credit FROM f) SELECT m, round(avg(credit), 9) AS win_share, round(avg(acc), 9) AS mean_acc, round(stddev_samp(acc), 9) AS sd FROM c GROUP BY m")
def win_share(spark, sf):
    w = Window.partitionBy("seed")
    c = _seed_acc(spark, sf).withColumn("win", (F.col("acc") == F.max("acc").over(w)).cast("int")).withColumn("credit", F.col("win") / F.sum("win").over(w).cast("double"))
    return c.groupBy("m").agg(F.round(F.avg("credit"), 9).alias("win_share"), F.round(F.avg("acc"), 9).alias("mean_acc"), F.round(F.stddev_samp("acc"), 9).alias("sd"))


@query("gate_percentiles", f"WITH @rec, {_SEEDACC} SELECT m, round(quantile_cont(acc, 0.025), 9) AS lo, round(median(acc), 9) AS mid, round(quantile_cont(acc, 0.975), 9) AS hi, CAST(CASE WHEN 0.7 BETWEEN quantile_cont(acc, 0.025) AND quantile_cont(acc, 0.975) THEN 1 ELSE 0 END AS INT) AS passes FROM acc GROUP BY m")
def gate_percentiles(spark, sf):
    g = _seed_acc(spark, sf).groupBy("m").agg(F.percentile("acc", F.lit(0.025)).alias("lo"), F.median("acc").alias("mid"), F.percentile("acc", F.lit(0.975)).alias("hi"))
    return g.select("m", *[F.round(c, 9).alias(c) for c in ("lo", "mid", "hi")], F.lit(0.7).between(F.col("lo"), F.col("hi")).cast("int").alias("passes"))


@query("effect_rows", f"WITH @rec, {_SEEDACC}, d AS (SELECT a.seed, a.acc - b.acc AS d FROM acc a JOIN acc b ON a.seed = b.seed AND a.m = 300 AND b.m = 1000) SELECT round(median(d) * 100, 6) AS mid, round(quantile_cont(d, 0.025) * 100, 6) AS lo, round(quantile_cont(d, 0.975) * 100, 6) AS hi, round(avg(CASE WHEN d > 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS above, round(avg(CASE WHEN d < 0 THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS below FROM d")
def effect_rows(spark, sf):
    d = _diffs(spark, sf)
    return d.agg(F.round(F.median("d") * 100, 6).alias("mid"), F.round(F.percentile("d", F.lit(0.025)) * 100, 6).alias("lo"), F.round(F.percentile("d", F.lit(0.975)) * 100, 6).alias("hi"), F.round(F.avg((F.col("d") > 0).cast("double")), 9).alias("above"), F.round(F.avg((F.col("d") < 0).cast("double")), 9).alias("below"))


def _diffs(spark, sf):
    a = _seed_acc(spark, sf)
    return a.where("m = 300").select("seed", F.col("acc").alias("x")).join(a.where("m = 1000").select("seed", F.col("acc").alias("z")), "seed").select("seed", (F.col("x") - F.col("z")).alias("d"))


@query("paired_diff_bins", f"WITH @rec, {_SEEDACC}, d AS (SELECT round(a.acc - b.acc, 9) AS d FROM acc a JOIN acc b ON a.seed = b.seed AND a.m = 300 AND b.m = 1000), u AS (SELECT DISTINCT d FROM d), g AS (SELECT round(min(x), 9) AS step FROM (SELECT d - lag(d) OVER (ORDER BY d) AS x FROM u)) SELECT CAST(round((d.d - (SELECT min(d) FROM d)) / nullif(coalesce(g.step, 1), 0)) AS BIGINT) AS bin, count(*) AS n FROM d, g GROUP BY 1")
def paired_diff_bins(spark, sf):
    d = _diffs(spark, sf).select(F.round("d", 9).alias("d"))
    gaps = d.distinct().withColumn("x", F.col("d") - F.lag("d").over(Window.orderBy("d"))).agg(F.round(F.min("x"), 9).alias("step"), F.min("d").alias("least"))
    return d.join(F.broadcast(gaps)).groupBy(F.round((F.col("d") - F.col("least")) / F.nullif(F.coalesce("step", F.lit(1.0)), F.lit(0.0))).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row


@query("attainable_histogram", f"WITH @rec, {_SEEDACC}, n AS (SELECT ceil(count(*) * 0.2) AS n FROM rec) SELECT m, CAST(round(acc * n) AS BIGINT) AS bin, count(*) AS n FROM acc, n GROUP BY 1, 2")
def attainable_histogram(spark, sf):
    n = recorded(spark, sf).agg(F.ceil(F.count(F.lit(1)) * 0.2).alias("size"))
    return _seed_acc(spark, sf).join(F.broadcast(n)).groupBy("m", F.round(F.col("acc") * F.col("size")).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("excess_over_majority", "WITH @rec SELECT grp, round(avg(CASE WHEN (n_chars > 300) = (y = 1) THEN CAST(1 AS DOUBLE) ELSE 0 END) - greatest(avg(CAST(y AS DOUBLE)), 1 - avg(CAST(y AS DOUBLE))), 9) AS excess FROM rec GROUP BY grp")
def excess_over_majority(spark, sf):
    rate = F.avg(F.col("y").cast("double"))
    return recorded(spark, sf).groupBy("grp").agg(F.round(F.avg(((F.col("n_chars") > 300) == (F.col("y") == 1)).cast("double")) - F.greatest(rate, 1 - rate), 9).alias("excess"))


@query("site_majority", "WITH @rec, g AS (SELECT site, sum(y) AS p, count(*) AS n FROM rec GROUP BY site) SELECT round(CAST(sum(greatest(p, n - p)) AS DOUBLE) / sum(n), 9) AS accuracy FROM g")
def site_majority(spark, sf):
    g = recorded(spark, sf).groupBy("site").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    return g.agg(F.round(F.sum(F.greatest(F.col("p"), F.col("n") - F.col("p"))).cast("double") / F.sum("n"), 9).alias("accuracy"))


@query("prevalence_auc", f"WITH @rec, s AS (SELECT y, round(avg(CAST(y AS DOUBLE)) OVER (PARTITION BY site), 12) AS s, 1 AS one FROM rec), a AS (SELECT y, {_RK.format(b='one', s='s')} AS rk FROM s) SELECT round({_AUC}, 9) AS auc FROM a")
def prevalence_auc(spark, sf):
    s = recorded(spark, sf).select("y", F.round(F.avg(F.col("y").cast("double")).over(Window.partitionBy("site")), 12).alias("s"), F.lit(1).alias("one"))
    return T.auc_by(s, "s", by=["one"]).select(F.round("auc", 9).alias("auc"))


_FOLD = f"(row_number() OVER (PARTITION BY y ORDER BY {h32('7', chr(39) + 'fold' + chr(39), 'rid')}, rid) - 1) % 10"


@query("site_only_oof", f"WITH @rec, f AS (SELECT rid, site, y, {_FOLD} AS fold FROM rec), g AS (SELECT site, fold, sum(y) AS p, count(*) AS n FROM f GROUP BY site, fold), t AS (SELECT site, sum(p) AS p, sum(n) AS n FROM g GROUP BY site) SELECT f.rid, f.fold, round((t.p - g.p) / nullif(CAST(t.n - g.n AS DOUBLE), 0), 9) AS score FROM f JOIN g ON g.site = f.site AND g.fold = f.fold JOIN t ON t.site = f.site")
def site_only_oof(spark, sf):
    from attestry.operators.sampling import stratified_folds

    f = stratified_folds(recorded(spark, sf).select("rid", "site", "y"), "rid", "y", 7, 10)
    g = f.groupBy("site", "fold").agg(F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"))
    t = g.groupBy("site").agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    return f.join(g, ["site", "fold"]).join(t, "site").select("rid", "fold", F.round((F.col("tp") - F.col("p")) / F.nullif((F.col("tn") - F.col("n")).cast("double"), F.lit(0.0)), 9).alias("score"))


@query("verdicts", f"WITH @rec, {_SITE}, w AS (SELECT sum(auc * n) / nullif(sum(CASE WHEN auc IS NOT NULL THEN n END), 0) AS v FROM s), m AS (SELECT avg(CAST(y AS DOUBLE)) AS v FROM rec) SELECT 'length_predicts' AS claim, round(v, 9) AS value, CASE WHEN v >= 0.6 THEN 'supported' ELSE 'falsified' END AS verdict FROM w UNION ALL SELECT 'majority_above_half', round(v, 9), CASE WHEN v > 0.5 THEN 'supported' ELSE 'falsified' END FROM m")
def verdicts(spark, sf):
    r = recorded(spark, sf)
    told = lambda df, claim, ok: df.select(F.lit(claim).alias("claim"), F.round("v", 9).alias("value"), F.when(ok, "supported").otherwise("falsified").alias("verdict"))
    a = T.site_weighted_auc(r, "n_chars", "site").withColumnRenamed("auc", "v")
    b = r.agg(F.avg(F.col("y").cast("double")).alias("v"))
    return told(a, "length_predicts", F.col("v") >= 0.6).unionByName(told(b, "majority_above_half", F.col("v") > 0.5))


