"""Queries: splits, folds, draws, permutations, contamination."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import sampling as S
from attestry.plans.registry import h32, query
from attestry.sources.readers import recorded, table


@query("hash_split_sizes", f"""WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS k, seed FROM lineitem, range(0, 3) t(seed)), r AS (SELECT seed, k, row_number() OVER (PARTITION BY seed ORDER BY {h32('seed', "'split'", 'k')}, k) AS rn, count(*) OVER (PARTITION BY seed) AS n FROM s)
 SELECT seed, count(*) AS n, CAST(sum(CASE WHEN rn <= ceil(n * 0.2) THEN 1 ELSE 0 END) AS BIGINT) AS n_test, CAST(sum(CASE WHEN rn <= ceil(n * 0.2) THEN k ELSE 0 END) AS BIGINT) AS key_sum FROM r GROUP BY seed""")
def hash_split_sizes(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k")).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(2).cast("bigint"))))
    return S.hash_split(rows, "k", F.col("seed"), ["seed"]).groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_test").alias("n_test"), F.sum(F.when(F.col("is_test"), F.col("k")).otherwise(0)).alias("key_sum"))


@query("group_split", f"""WITH @rec, g AS (SELECT grp, row_number() OVER (ORDER BY {h32('5', "'group'", 'grp')}, grp) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM rec))
 SELECT grp, CAST(r <= ceil(n * 0.2) AS INT) AS is_test, (SELECT count(*) FROM rec WHERE rec.grp = g.grp) AS n FROM g""")
def group_split(spark, sf):
    return S.group_split(recorded(spark, sf), "grp", 5).groupBy("grp").agg(F.max(F.col("is_test").cast("int")).alias("is_test"), F.count(F.lit(1)).alias("n"))


@query("stratified_folds", f"""WITH @rec, f AS (SELECT y, (row_number() OVER (PARTITION BY y ORDER BY {h32('7', "'fold'", 'rid')}, rid) - 1) % 10 AS fold FROM rec) SELECT fold, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM f GROUP BY fold""")
def stratified_folds(spark, sf):
    return S.stratified_folds(recorded(spark, sf), "rid", "y", 7, 10).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))


@query("repeated_folds", f"""WITH @rec, f AS (SELECT rep, y, (row_number() OVER (PARTITION BY rep, y ORDER BY {h32('rep', "'fold'", 'rid')}, rid) - 1) % 10 AS fold FROM rec, range(0, 5) t(rep)) SELECT rep, fold, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_pos FROM f GROUP BY rep, fold""")
def repeated_folds(spark, sf):
    r = recorded(spark, sf).withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))))
    return S.stratified_folds(r, "rid", "y", F.col("rep"), 10, ["rep"]).groupBy("rep", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos"))


@query("loso_folds", "WITH @rec, t AS (SELECT count(*) AS n FROM rec) SELECT site, count(*) AS n_test, any_value(t.n) - count(*) AS n_train, CAST(sum(y) AS BIGINT) AS pos_test FROM rec, t GROUP BY site")
def loso_folds(spark, sf):
    r = recorded(spark, sf)
    per = r.groupBy("site").agg(F.count(F.lit(1)).alias("n_test"), F.sum("y").alias("pos_test"))
    return per.join(F.broadcast(r.agg(F.count(F.lit(1)).alias("t")))).select("site", "n_test", (F.col("t") - F.col("n_test")).alias("n_train"), "pos_test")


@query("matched_removal", f"""WITH @rec, w AS (SELECT y, count(*) AS want FROM rec WHERE slope IS NULL GROUP BY y), p AS (SELECT rid, y, row_number() OVER (PARTITION BY y ORDER BY {h32('3', "'matched'", 'rid')}, rid) AS r FROM rec WHERE slope IS NOT NULL)
 SELECT p.y, count(*) AS n, CAST(sum(rid) AS BIGINT) AS id_sum FROM p JOIN w ON w.y = p.y WHERE r <= want GROUP BY p.y""")
def matched_removal(spark, sf):
    r = recorded(spark, sf)
    return S.matched_draw(r.where("slope is not null"), r.where("slope is null"), "rid", "y", 3).groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("rid").alias("id_sum"))


_AUC = "(sum(CASE WHEN y = 1 THEN rk END) - CAST(sum(y) AS DOUBLE) * (sum(y) + 1) / 2) / nullif(CAST(sum(y) AS DOUBLE) * (count(*) - sum(y)), 0)"
_RK = "rank() OVER (PARTITION BY {b} ORDER BY {s}) + (count(*) OVER (PARTITION BY {b}, {s}) - 1) / CAST(2 AS DOUBLE)"


@query("label_permutation", f"""WITH @rec, k AS (SELECT rid, n_chars, seed, row_number() OVER (PARTITION BY seed ORDER BY {h32('seed', "'place'", 'rid')}, rid) AS r FROM rec, range(0, 20) t(seed)), l AS (SELECT y, seed, row_number() OVER (PARTITION BY seed ORDER BY {h32('seed', "'perm'", 'rid')}, rid) AS r FROM rec, range(0, 20) t(seed)),
 j AS (SELECT k.seed, k.n_chars, l.y FROM k JOIN l ON l.seed = k.seed AND l.r = k.r), a AS (SELECT seed, y, {_RK.format(b='seed', s='n_chars')} AS rk FROM j)
 SELECT seed, CAST(sum(y) AS BIGINT) AS n_pos, round({_AUC}, 9) AS auc FROM a GROUP BY seed""")
def label_permutation(spark, sf):
    from attestry.operators.statistics import auc_by

    r = recorded(spark, sf).select("rid", "n_chars", "y").withColumn("seed", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(19).cast("bigint"))))
    return auc_by(S.permute(r, "rid", "y", F.col("seed"), ["seed"]), "n_chars", by=["seed"]).select("seed", "n_pos", F.round("auc", 9).alias("auc"))


@query("contamination", f"""WITH d AS (SELECT doc_id, md5(text) AS g FROM documents), t AS (SELECT doc_id, row_number() OVER (ORDER BY {h32('1', "'split'", 'doc_id')}, doc_id) <= ceil((SELECT count(*) FROM d) * 0.2) AS is_test, g FROM d),
 o AS (SELECT DISTINCT g FROM t WHERE NOT is_test) SELECT count(*) AS n_test, count(o.g) AS n_hit, round(CAST(count(o.g) AS DOUBLE) / count(*), 9) AS share FROM t LEFT JOIN o ON o.g = t.g WHERE is_test""")
def contamination(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("g"), F.lit(0).alias("one"))
    split = S.hash_split(d, "doc_id", F.lit(1), ["one"])
    return S.contamination(d, "doc_id", "g", split.where("is_test"))


@query("screening_order", f"""SELECT conv_id, turn, dense_rank() OVER (ORDER BY {h32('9', "'repo'", 'conv_id')}, conv_id) AS position, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role <> 'system')""")
def screening_order(spark, sf):
    from attestry.operators.survey import screening_order as order

    return order(table(spark, sf, "conversations").where("role <> 'system'"), "conv_id", "turn", 9)
