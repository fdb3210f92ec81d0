"""Queries: recodes, missing values, encodings, duplicates, imputation, scaling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.functions.scalars import is_missing, one_hot, one_hot_seen, recode
from attestry.operators.matching import left_merge_flag
from attestry.operators.preparation import impute_values, scale_values
from attestry.plans.registry import query
from attestry.sources.readers import read_sites, recorded, scratch_dir, table

STATUS = {"O": "open", "F": "filled", "P": "partial"}
PRIORITY = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 4}


@query("recode_projection", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'filled' WHEN 'P' THEN 'partial' END AS status,
 CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 4 END AS INT) AS priority,
 round_even(o_totalprice / 1000, 1) AS price_key, CAST(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS INT) AS target, 'orders' AS source FROM orders""")
def recode_projection(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", recode(F.col("o_orderstatus"), STATUS).alias("status"), recode(F.col("o_orderpriority"), PRIORITY).alias("priority"), F.bround(F.col("o_totalprice") / 1000, 1).alias("price_key"), F.coalesce(F.col("o_totalprice") > 100000, F.lit(False)).cast("int").alias("target"), F.lit("orders").alias("source"))


@query("missing_mask_counts", """WITH @rec SELECT site, count(*) AS n, CAST(sum(CASE WHEN nsp IS NULL OR nsp = 0 THEN 1 ELSE 0 END) AS BIGINT) AS miss_nsp,
 CAST(sum(CASE WHEN slope IS NULL OR slope = 0 THEN 1 ELSE 0 END) AS BIGINT) AS miss_slope, CAST(sum(CASE WHEN slope IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_slope, CAST(count(nullif(slope, 0)) AS BIGINT) AS canonical_slope FROM rec GROUP BY site""")
def missing_mask_counts(spark, sf):
    r = recorded(spark, sf)
    return r.groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_if(is_missing("nsp", True)).alias("miss_nsp"), F.count_if(is_missing("slope", True)).alias("miss_slope"), F.count_if(is_missing("slope")).alias("null_slope"), F.count(F.nullif("slope", F.lit(0))).alias("canonical_slope"))


@query("missingness_design", """WITH @rec SELECT rid, CAST(CASE WHEN nsp IS NULL OR nsp = 0 THEN 1 ELSE 0 END AS DOUBLE) AS missing_nsp, CAST(CASE WHEN slope IS NULL OR slope = 0 THEN 1 ELSE 0 END AS DOUBLE) AS missing_slope,
 CAST(0 AS DOUBLE) AS missing_n_chars, y FROM rec""")
def missingness_design(spark, sf):
    flag = lambda c: is_missing(c, True).cast("double").alias(f"missing_{c}")
    return recorded(spark, sf).select("rid", flag("nsp"), flag("slope"), is_missing("n_chars").cast("double").alias("missing_n_chars"), "y")


@query("onehot_encode", "SELECT o_orderkey, " + ", ".join(f"CAST(CASE WHEN o_orderstatus = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS o_orderstatus_{v}" for v in STATUS) + " FROM orders")
def onehot_encode(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *one_hot("o_orderstatus", list(STATUS)))


@query("union_sites", "SELECT lang AS source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def union_sites(spark, sf):
    path = scratch_dir(spark)
    table(spark, sf, "documents").select("doc_id", "n_chars", "lang").write.partitionBy("lang").csv(path)
    sites = sorted(r.lang for r in table(spark, sf, "documents").select("lang").distinct().collect())  # sites are few, a file each
    out = read_sites(spark, {s: f"{path}/lang={s}" for s in sites}, "doc_id bigint, n_chars bigint")
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("statlog_style_left_merge", """WITH r AS (SELECT DISTINCT nullif(n_nationkey, 3) AS k FROM nation WHERE n_nationkey < 15), l AS (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer)
 SELECT c_custkey, l.k, CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.k IS NOT DISTINCT FROM l.k) THEN 'both' ELSE 'left_only' END AS merge FROM l""")
def statlog_style_left_merge(spark, sf):
    n = table(spark, sf, "nation").where("n_nationkey < 15").select(F.nullif("n_nationkey", F.lit(3)).alias("k"))
    c = table(spark, sf, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(3)).alias("k"))
    return left_merge_flag(c, n.unionByName(n), ["k"])


@query("duplicate_groups", """WITH g AS (SELECT md5(text || '|' || coalesce(source, 'NA')) AS k, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1)
 SELECT first_id, n, n - 1 AS extra FROM g WHERE n > 1""")
def duplicate_groups(spark, sf):
    key = F.md5(F.concat_ws("|", F.coalesce("text", F.lit("NA")), F.coalesce("source", F.lit("NA"))))
    return table(spark, sf, "documents").groupBy(key.alias("k")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("first_id", "n", (F.col("n") - 1).alias("extra"))


_IMPUTE = """, s AS (SELECT median(nullif(nsp, 0)) AS med FROM rec {w}), m AS (SELECT slope AS mode FROM rec {a} slope IS NOT NULL GROUP BY slope ORDER BY count(*) DESC, slope LIMIT 1)
 SELECT rid, CAST(coalesce(nullif(nsp, 0), med) AS DOUBLE) AS nsp, CAST(coalesce(slope, mode) AS INT) AS slope FROM rec, s, m"""


@query("impute_full", "WITH @rec" + _IMPUTE.format(w="", a="WHERE"))
def impute_full(spark, sf):
    r = recorded(spark, sf)
    return impute_values(r, r, median=["nsp"], mode=["slope"]).select("rid", "nsp", "slope")


@query("impute_train", "WITH @rec" + _IMPUTE.format(w="WHERE rid % 5 <> 0", a="WHERE rid % 5 <> 0 AND"))
def impute_train(spark, sf):
    r = recorded(spark, sf)
    return impute_values(r, r.where("rid % 5 <> 0"), median=["nsp"], mode=["slope"]).select("rid", "nsp", "slope")


@query("scale_full_vs_train", """WITH @rec, f AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s FROM rec), t AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS s, stddev_samp(n_chars) AS ss FROM rec WHERE rid % 5 <> 0)
 SELECT rid, round((n_chars - f.m) / f.s, 9) AS full_scaled, round((n_chars - t.m) / t.s, 9) AS train_scaled, round(t.ss / t.s, 9) AS sample_ratio FROM rec, f, t""")
def scale_full_vs_train(spark, sf):
    r = recorded(spark, sf)
    full = scale_values(r, r, ["n_chars"]).select("rid", F.round("n_chars", 9).alias("full_scaled"))
    train = r.where("rid % 5 <> 0")
    ratio = train.agg(F.round(F.stddev_samp("n_chars") / F.nullif(F.stddev_pop("n_chars"), F.lit(0.0)), 9).alias("sample_ratio"))
    return full.join(scale_values(r, train, ["n_chars"]).select("rid", F.round("n_chars", 9).alias("train_scaled")), "rid").join(F.broadcast(ratio))  # one row


@query("crosstab_fill", """WITH @rec SELECT coalesce(CAST(slope AS VARCHAR), 'NA') AS slope, CAST(sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n0, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n1 FROM rec GROUP BY 1""")
def crosstab_fill(spark, sf):
    r = recorded(spark, sf).select(F.coalesce(F.col("slope").cast("string"), F.lit("NA")).alias("slope"), "y")
    return r.groupBy("slope").pivot("y", [0, 1]).count().select("slope", F.coalesce(F.col("0"), F.lit(0)).alias("n0"), F.coalesce(F.col("1"), F.lit(0)).alias("n1"))


@query("shared_values", """WITH @rec, a AS (SELECT DISTINCT n_chars FROM rec WHERE y = 0), b AS (SELECT DISTINCT n_chars FROM rec WHERE y = 1) SELECT count(*) AS shared FROM a JOIN b ON a.n_chars = b.n_chars""")
def shared_values(spark, sf):
    r = recorded(spark, sf)
    return r.where("y = 0").select("n_chars").intersect(r.where("y = 1").select("n_chars")).agg(F.count(F.lit(1)).alias("shared"))


@query("value_counts", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def value_counts(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("describe_prices", """SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS sd, round(quantile_cont(c_acctbal, 0.25), 6) AS q1, round(median(c_acctbal), 6) AS med,
 round(quantile_cont(c_acctbal, 0.75), 6) AS q3, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer GROUP BY 1""")
def describe_prices(spark, sf):
    x = "c_acctbal"
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("sd"), F.round(F.percentile(x, F.lit(0.25)), 6).alias("q1"), F.round(F.median(x), 6).alias("med"), F.round(F.percentile(x, F.lit(0.75)), 6).alias("q3"), F.min(x).alias("lo"), F.max(x).alias("hi"))


@query("last_write_wins", """SELECT conv_id, turn, role FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1""")
def last_write_wins(spark, sf):
    w = Window.partitionBy("conv_id", "role").orderBy(F.col("turn").desc())
    return table(spark, sf, "conversations").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("conv_id", "turn", "role")


@query("onehot_unseen", "SELECT o_orderkey, " + ", ".join(f"CAST(CASE WHEN o_orderstatus = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS o_orderstatus_{v}" for v in ("F", "O")) + " FROM orders")
def onehot_unseen(spark, sf):
    """Levels learned from rows that do not have P: that level is zero in every column."""
    o = table(spark, sf, "orders")
    return one_hot_seen(o.where("o_orderstatus <> 'P'"), "o_orderstatus", o.select("o_orderkey", "o_orderstatus")).drop("o_orderstatus")


@query("arm_designs", "WITH @rec SELECT rid, n_chars, coalesce(nsp, -1) AS nsp, coalesce(slope, -1) AS slope, CAST(nsp IS NULL AS INT) AS missing_nsp, CAST(slope IS NULL AS INT) AS missing_slope, 'A' AS arm FROM rec UNION ALL SELECT rid, n_chars, NULL, coalesce(slope, -1), NULL, NULL, 'B' FROM rec")
def arm_designs(spark, sf):
    """Arm A has a flag for each column that can be missing; arm B drops those and nsp. -1 stands for a missing value."""
    r = recorded(spark, sf)
    shown = r.select("rid", "n_chars", F.coalesce("nsp", F.lit(-1)).alias("nsp"), F.coalesce("slope", F.lit(-1)).alias("slope"), F.col("nsp").isNull().cast("int").alias("missing_nsp"), F.col("slope").isNull().cast("int").alias("missing_slope"), F.lit("A").alias("arm"))
    return shown.unionByName(shown.select("rid", "n_chars", "slope", F.lit("B").alias("arm")), allowMissingColumns=True)


@query("site_design", "WITH @rec SELECT rid, " + ", ".join(f"CAST(CASE WHEN site = '{v}' THEN 1 ELSE 0 END AS DOUBLE) AS site_{v}" for v in ("de", "en", "es", "fr")) + " FROM rec")
def site_design(spark, sf):
    r = recorded(spark, sf).select("rid", "site")
    return one_hot_seen(r, "site", r).drop("site")


@query("drop_by_id", "WITH @rec SELECT rid, y FROM rec WHERE slope IS NOT NULL")
def drop_by_id(spark, sf):
    r = recorded(spark, sf)
    return r.join(r.where("slope is null").select("rid"), "rid", "left_anti").select("rid", "y")


@query("any_all", "WITH @rec SELECT site, bool_or(nsp IS NULL) AS any_missing, bool_and(n_chars > 0) AS all_filled, bool_and(slope IS NOT NULL) AS complete FROM rec GROUP BY site")
def any_all(spark, sf):
    return recorded(spark, sf).groupBy("site").agg(F.bool_or(F.col("nsp").isNull()).alias("any_missing"), F.bool_and(F.col("n_chars") > 0).alias("all_filled"), F.bool_and(F.col("slope").isNotNull()).alias("complete"))


_KEY = "coalesce(site, 'NA') || '|' || coalesce(grp, 'NA') || '|' || coalesce(CAST(n_chars AS VARCHAR), 'NA') || '|' || coalesce(CAST(nsp AS VARCHAR), 'NA') || '|' || coalesce(CAST(slope AS VARCHAR), 'NA') || '|' || coalesce(CAST(y AS VARCHAR), 'NA')"


@query("duplicate_keys", f"WITH @rec SELECT {_KEY} AS key, count(*) AS n, min(rid) AS first_id FROM rec GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    """Rows equal in all features and the target, missing equal to missing."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in ("site", "grp", "n_chars", "nsp", "slope", "y")])
    return recorded(spark, sf).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("first_id")).where("n > 1")


@query("first_rows", "WITH @rec SELECT rid, site, n_chars FROM rec ORDER BY n_chars DESC, rid LIMIT 3")
def first_rows(spark, sf):
    return recorded(spark, sf).select("rid", "site", "n_chars").orderBy(F.desc("n_chars"), "rid").limit(3)  # a report of three rows
