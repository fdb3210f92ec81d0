"""Estimators and tests as aggregates and windows. Undefined values are null, never guessed."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.scalars import log_factorial, normal_quantile, softplus, t_two_sided
from attestry.operators.running import renamed, same_keys, sums_before


def _groups(by: list[str]) -> list[str]:
    """Private names of the groups: columns may be called anything."""
    return [f"g{i}" for i in range(len(by))]


def _named(by: list[str]) -> list[Column]:
    return [F.col(g).alias(c) for g, c in zip(_groups(by), by, strict=True)]


def _counted(df: DataFrame, score: str, label: str, by: list[str], weight: str | None = None) -> DataFrame:
    """(groups, s, p, q): positives and negatives of each distinct score, summed before the shuffle. Rows without a score, with NaN, or without a label go."""
    g = _groups(by)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    slim = df.select(*[F.col(c).alias(x) for c, x in zip(by, g, strict=True)], F.col(score).alias("s"), F.col(label).alias("y"), w.alias("w"))
    known = slim.where(F.col("s").isNotNull() & ~F.isnan(F.col("s").cast("double")) & F.col("y").isNotNull())
    return known.groupBy(*g, "s").agg(F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("y") == 1, 0.0).otherwise(F.col("w"))).alias("q"))


def _below(counts: DataFrame, by: list[str]) -> DataFrame:
    """Adds pb and qb, positives and negatives with a lower score in the group."""
    return sums_before(counts, _groups(by), ["s"], ["p", "q"]).withColumnsRenamed({"before_p": "pb", "before_q": "qb"})


def auc_by(df: DataFrame, score: str, label: str = "y", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(by, auc, n, n_pos) with ties averaged; null auc where a class is missing. weight counts a row so many times. Rows without a label do not count.

    Rows are counted by distinct score first, so what is sorted is the distinct scores, in ranges, not the rows of a group.
    """
    by = by or []
    placed = _below(_counted(df, score, label, by, weight), by)
    won = F.sum(F.col("p") * (F.col("qb") + F.col("q") / 2))
    pos, neg = F.sum("p"), F.sum("q")
    out = placed.groupBy(*_groups(by)).agg((won / F.nullif(pos * neg, F.lit(0.0))).alias("auc"), (pos + neg).cast("bigint").alias("n"), pos.cast("bigint").alias("n_pos"))
    return out.select(*_named(by), "auc", "n", "n_pos")


def site_weighted_auc(df: DataFrame, score: str, site: str, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Mean of site AUCs by rows; one-class sites are left out and counted."""
    per = auc_by(df, score, by=[*(by or []), site], weight=weight)
    ok = F.col("auc").isNotNull()
    return per.groupBy(*(by or [])).agg(
        (F.sum(F.col("auc") * F.col("n")) / F.nullif(F.sum(F.when(ok, F.col("n"))), F.lit(0))).alias("auc"), F.count_if(ok).alias("n_sites"), F.count_if(~ok).alias("n_undefined")
    )


def interval(df: DataFrame, value: str, by: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """Exact percentile interval with linear interpolation, and the number of values."""
    tail = (1 - level) / 2
    return df.groupBy(*(by or [])).agg(F.round(F.percentile(value, F.lit(tail)), 9).alias("lo"), F.round(F.percentile(value, F.lit(0.5)), 9).alias("mid"), F.round(F.percentile(value, F.lit(1 - tail)), 9).alias("hi"), F.count(value).alias("n"))


def delong(df: DataFrame, score: str, by: list[str], level: float = 0.95) -> DataFrame:
    """(by, auc, se, lo, hi) from placements, which are the same for all rows of a score; all null where a class is missing, se and bounds where it has one row."""
    g = _groups(by)
    placed = _below(_counted(df, score, "y", by), by)
    sizes = renamed(placed.groupBy(*g).agg(F.sum("p").alias("n1"), F.sum("q").alias("n0")), g, "n1", "n0")
    n1, n0 = F.col("n1"), F.col("n0")
    v1, v0 = (F.col("qb") + F.col("q") / 2) / F.nullif(n0, F.lit(0.0)), (n1 - F.col("pb") - F.col("p") / 2) / F.nullif(n1, F.lit(0.0))
    # Deviations from a half keep the sums of squares small beside each other.
    s1, q1 = F.sum(F.col("p") * (v1 - 0.5)), F.sum(F.col("p") * (v1 - 0.5) * (v1 - 0.5))
    s0, q0 = F.sum(F.col("q") * (v0 - 0.5)), F.sum(F.col("q") * (v0 - 0.5) * (v0 - 0.5))
    agg = placed.join(sizes, same_keys(g)).groupBy(*g).agg(F.max("n1").alias("n1"), F.max("n0").alias("n0"), *[x.alias(k) for k, x in (("s1", s1), ("q1", q1), ("s0", s0), ("q0", q0))])
    spread = lambda s, q, n: F.greatest(F.lit(0.0), F.col(q) - F.col(s) * F.col(s) / F.nullif(n, F.lit(0.0))) / F.nullif(n - 1, F.lit(0.0)) / F.nullif(n, F.lit(0.0))
    out = agg.withColumn("a", F.when((n1 > 0) & (n0 > 0), F.col("s1") / n1 + 0.5)).withColumn("e", F.when((n1 > 1) & (n0 > 1), F.sqrt(spread("s1", "q1", n1) + spread("s0", "q0", n0))))
    z = normal_quantile(0.5 + level / 2)
    low, high = F.col("a") - z * F.col("e"), F.col("a") + z * F.col("e")
    return out.select(*_named(by), F.round("a", 9).alias("auc"), F.round("e", 9).alias("se"), F.round(F.when(low.isNotNull(), F.greatest(F.lit(0.0), low)), 9).alias("lo"), F.round(F.when(high.isNotNull(), F.least(F.lit(1.0), high)), 9).alias("hi"))


def mcnemar(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, n_a, n_b, p): discordant counts of two correctness flags and the exact two-sided p.

    The tail is one fold per group: each term is the one before times a ratio, from the largest term down, whose log comes from Stirling's series.
    """
    agg = df.groupBy(*by).agg(F.count_if(F.col(a) & ~F.col(b)).alias("n_a"), F.count_if(~F.col(a) & F.col(b)).alias("n_b"))
    n, low = F.col("n_a") + F.col("n_b"), F.least("n_a", "n_b")
    top = F.exp(log_factorial(n) - log_factorial(low) - log_factorial(n - low) - n * F.ln(F.lit(2.0)))
    # The term at k - 1 is the term at k times k / (n - k + 1).
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        k = low - i + 1
        term = s["term"] * k / (n - k + 1).cast("double")
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    # Below the largest term by more than 1e-17 of it nothing changes a double; 40 standard deviations are past that.
    reach = F.least(low, F.ceil(F.sqrt(n.cast("double")) * 20 + 50).cast("bigint"))
    tail = F.when(reach > 0, F.aggregate(F.sequence(F.lit(1).cast("bigint"), reach), start, step)["sum"]).otherwise(1.0) * top
    return agg.withColumn("p", F.round(F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail)), 9))


def holm(df: DataFrame, p: str, key: str, by: list[str] | None = None) -> DataFrame:
    """Adds p_holm: step-down adjusted and never falling. A null p stays null and is no hypothesis."""
    w = Window.partitionBy(*(by or []))
    up = w.orderBy(F.col(p).asc_nulls_last(), key)
    scaled = (F.count(p).over(w) - F.row_number().over(up) + 1) * F.col(p)
    held = df.select("*", F.struct(scaled.alias("s")).alias("__holm"))
    most = F.max("__holm.s").over(up.rowsBetween(Window.unboundedPreceding, 0))
    return held.select(*df.columns, F.when(F.col(p).isNotNull(), F.round(F.least(F.lit(1.0), most), 9)).alias("p_holm"))


def corrected_t(df: DataFrame, diff: str, ratio: float, by: list[str] | None = None) -> DataFrame:
    """(by, mean, t, p, j): variance times (1/j + test/train), two-sided p with j - 1 degrees of freedom.

    Without any variance t is 0 and p 1 where the mean is 0, else t is infinite with the mean's sign and p 0. One value has neither.
    """
    from pyspark.sql import types

    two_sided = F.udf(lambda t, d: None if t is None or not d else t_two_sided(t, d), types.DoubleType())  # one row a group
    agg = df.groupBy(*(by or [])).agg(F.avg(diff).alias("_m"), F.var_samp(diff).alias("_v"), F.count(diff).alias("_j"))
    m, v, j = F.col("_m"), F.col("_v"), F.col("_j")
    t = F.when(v > 0, m / F.sqrt(v * (1 / j.cast("double") + F.lit(ratio)))).when((v == 0) & (m == 0), 0.0).when(v == 0, F.signum(m) * F.lit(float("inf")))
    p = F.when(v > 0, two_sided(F.col("_t"), j - 1)).when((v == 0) & (m == 0), 1.0).when(v == 0, 0.0)
    return agg.withColumn("_t", t).withColumn("_p", p).select(*(by or []), F.round("_m", 9).alias("mean"), F.when(F.abs("_t") == float("inf"), F.col("_t")).otherwise(F.round("_t", 9)).alias("t"), F.round("_p", 9).alias("p"), j.alias("j"))


def youden(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    """(by, threshold, j): the threshold with the largest sensitivity + specificity - 1; of equal ones the smallest. j is null where a class is missing."""
    g = _groups(by)
    placed = _below(_counted(df, score, "y", by), by)
    totals = renamed(placed.groupBy(*g).agg(F.sum("p").alias("tp"), F.sum("q").alias("tq")), g, "tp", "tq")
    tp, tq = F.col("tp"), F.col("tq")
    j = (tp - F.col("pb")) / F.nullif(tp, F.lit(0.0)) - (tq - F.col("qb")) / F.nullif(tq, F.lit(0.0))
    ranked = placed.join(totals, same_keys(g)).select(*g, F.col("s").cast("double").alias("s"), F.round(j, 9).alias("j"))
    best = ranked.groupBy(*g).agg(F.max(F.struct(F.coalesce("j", F.lit(-2.0)).alias("j"), (-F.col("s")).alias("s"))).alias("x"))
    return best.select(*_named(by), (-F.col("x.s")).alias("threshold"), F.when(F.col("x.j") > -2, F.col("x.j")).alias("j"))


#: A slope or intercept beyond this means that no finite one is best.
_FAR = 1e3


def calibration(df: DataFrame, logit: str, by: list[str], slope: bool, steps: int = 60) -> DataFrame:
    """(by, intercept[, slope]) of p = logistic(a + b logit), with b 1 where no slope is asked for; null where a class is missing or no finite fit is best.

    Newton steps for all groups at once: each is one aggregate of a few sums a group over the distinct logits, and groups that have settled leave. A
    step that raises the loss is halved. What reaches the driver is a row a group. Rows without a logit or a label do not count.
    """
    from attestry.sources.readers import settled

    g, spark = _groups(by), df.sparkSession
    per = settled(_counted(df, logit, "y", by).withColumn("n", F.col("p") + F.col("q")).drop("q"))
    found: dict[tuple, tuple] = {}
    sized = per.groupBy(*g).agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"), F.max(F.when(F.col("p") < F.col("n"), F.col("s"))).alias("neg_hi"), F.min(F.when(F.col("p") > 0, F.col("s"))).alias("pos_lo"), F.min(F.when(F.col("p") < F.col("n"), F.col("s"))).alias("neg_lo"), F.max(F.when(F.col("p") > 0, F.col("s"))).alias("pos_hi"))
    open_: dict[tuple, dict] = {}
    for r in sized.collect():
        key = tuple(r[c] for c in g)
        apart = slope and r.tp and r.tp < r.tn and (r.pos_lo >= r.neg_hi or r.neg_lo >= r.pos_hi)
        if not r.tp or r.tp == r.tn or apart:
            found[key] = (None, None)
        else:
            open_[key] = {"at": (0.0, 1.0), "loss": float("inf"), "step": (0.0, 0.0), "last": (0.0, 1.0)}
    types = dict(per.dtypes)
    schema = ", ".join([*[f"{c} {types[c]}" for c in g], "a double", "b double"])
    for _ in range(steps):
        if not open_:
            break
        table = spark.createDataFrame([(*k, *map(float, v["at"])) for k, v in open_.items()], schema)
        met = per.join(F.broadcast(renamed(table, g, "a", "b")), same_keys(g))  # a row a group
        eta = F.col("a") + F.col("b") * F.col("s")
        q = 1 / (1 + F.exp(-eta))
        x, w, d = F.col("s"), F.col("n") * q * (1 - q), F.col("p") - F.col("n") * q
        sums = {"d0": d, "d1": d * x, "h00": w, "h01": w * x, "h11": w * x * x, "loss": F.col("n") * softplus(eta) - F.col("p") * eta}
        for r in met.groupBy(*g).agg(*[F.sum(v).alias(k) for k, v in sums.items()]).collect():
            key = tuple(r[c] for c in g)
            state = open_[key]
            if r.loss > state["loss"] + 1e-9 * abs(state["loss"]):
                state["step"] = tuple(v / 2 for v in state["step"])
                state["at"] = tuple(l + v for l, v in zip(state["last"], state["step"], strict=True))
                if max(map(abs, state["step"])) < 1e-12:
                    found[key] = state["last"]
                    del open_[key]
                continue
            det = r.h00 * r.h11 - r.h01 * r.h01
            if slope and det > 1e-12 * max(r.h00 * r.h11, 1e-300):
                step = ((r.h11 * r.d0 - r.h01 * r.d1) / det, (r.h00 * r.d1 - r.h01 * r.d0) / det)
            else:
                step = (r.d0 / max(r.h00, 1e-12), 0.0)
            step = tuple(max(-2.0, min(2.0, v)) for v in step)
            state.update(loss=r.loss, last=state["at"], step=step)
            state["at"] = tuple(l + v for l, v in zip(state["last"], step, strict=True))
            if max(map(abs, step)) < 1e-10 or max(map(abs, state["at"])) > _FAR:
                found[key] = state["at"] if max(map(abs, state["at"])) <= _FAR else (None, None)
                del open_[key]
    found |= {k: v["at"] for k, v in open_.items()}
    rows = [(*k, *[None if v is None else round(v, 6) + 0.0 for v in ab]) for k, ab in found.items()]
    return spark.createDataFrame(rows, schema).select(*_named(by), F.col("a").alias("intercept"), *([F.col("b").alias("slope")] if slope else []))


def calibration_intercept(df: DataFrame, logit: str, by: list[str]) -> DataFrame:
    """(by, intercept) with the score as an offset."""
    return calibration(df, logit, by, False)


def binomial_gate(df: DataFrame, n: str, q: float, p: float) -> DataFrame:
    """Adds required: the q-quantile of a binomial with column n trials and chance p. Only terms within ten deviations of the mean are summed."""
    mean, reach = F.col(n) * F.lit(p), F.ceil(10 * F.sqrt(F.col(n) * F.lit(p * (1 - p)))) + 10
    low = F.greatest(F.lit(0), F.floor(mean - reach)).cast("bigint")
    term = lambda k: F.exp(log_factorial(F.col(n)) - log_factorial(k) - log_factorial(F.col(n) - k) + k * math.log(p) + (F.col(n) - k) * math.log(1 - p))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("bigint").alias("k"))

    def step(s: Column, k: Column) -> Column:
        total = s["sum"] + term(k)
        return F.struct(total.alias("sum"), F.coalesce(s["k"], F.when(total >= q - 1e-12, k)).alias("k"))

    return df.withColumn("required", F.aggregate(F.sequence(low, F.col(n).cast("bigint")), start, step)["k"])


def balanced_accuracy(df: DataFrame, score: str, threshold: Column, by: list[str]) -> DataFrame:
    """(by, balanced_accuracy): the mean of the two classes' recall at a threshold, which may be a column; null where a class is missing."""
    hit = (F.col(score) >= threshold).cast("int")
    return df.groupBy(*by).agg(F.round((F.avg(F.when(F.col("y") == 1, hit)) + F.avg(F.when(F.col("y") == 0, 1 - hit))) / 2, 9).alias("balanced_accuracy"))


def negative_log_likelihood(df: DataFrame, eta: str, by: list[str], label: str = "y") -> DataFrame:
    """(by, nll, n): the logistic loss of a linear score, stable for any size of it."""
    return df.groupBy(*by).agg(F.round(F.sum(softplus(F.col(eta)) - F.col(label) * F.col(eta)), 6).alias("nll"), F.count(F.lit(1)).alias("n"))
