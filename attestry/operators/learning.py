"""Learners by Spark ML, and nearest neighbours of a stated query set; many models at once are fitted in sums."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.preparation import impute_values, scale_values
from attestry.operators.statistics import calibration
from attestry.sources.readers import settled


def knn_vote(queries: DataFrame, rows: DataFrame, key: str, vector: str, label: str, ks: list[int], weights: tuple[str, ...] = ("uniform",), block_rows: int = 20_000) -> DataFrame:
    """(k, weights, key, truth, predicted) by squared distance, ties by key; the label with the most weight, ties to the smallest.

    Weights are uniform or by inverse distance, where a label at distance 0 outweighs all others. A stated query set against all rows: queries
    are sent to the row blocks, whose number grows with the rows, in groups; each block keeps its nearest max(ks) per query, and those are merged.
    """
    most = max(ks)
    # As many blocks as rows need, and as few groups of queries as keep tasks busy.
    blocks_n, parts = max(1, -(-rows.count() // block_rows)), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups_n = max(1, -(-parts // blocks_n))
    groups = queries.select(F.col(key).alias("q"), F.col(vector).alias("qv"), F.col(label).alias("truth")).withColumn("g", F.pmod(F.xxhash64("q"), F.lit(groups_n)))
    blocks = rows.select(F.col(key).alias("near"), F.col(vector).alias("v"), F.col(label).alias("l")).withColumn("block", F.pmod(F.xxhash64("near"), F.lit(blocks_n)))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left, right = groups.withColumn("block", upto(blocks_n)), blocks.withColumn("g", upto(groups_n))

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            x, y, ids = np.stack(a["qv"].to_numpy()).astype(float), np.stack(b["v"].to_numpy()).astype(float), b["near"].to_numpy()
            for i in range(len(a)):
                d = np.round(((x[i] - y) ** 2).sum(1), 9)
                edge = np.partition(d, min(most, len(d) - 1))[min(most, len(d) - 1)]
                some = np.flatnonzero(d <= edge)  # the query itself may be among them
                for j in [j for j in some[np.lexsort((ids[some], d[some]))][: most + 1] if ids[j] != a["q"].iloc[i]][:most]:
                    out.append((int(a["q"].iloc[i]), int(a["truth"].iloc[i]), int(ids[j]), int(b["l"].iloc[j]), float(d[j])))
        return pd.DataFrame(out, columns=["q", "truth", "near", "l", "d"])

    near = left.groupBy("g", "block").cogroup(right.groupBy("g", "block")).applyInPandas(nearest, "q bigint, truth int, near bigint, l int, d double")
    ranked = near.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy("d", "near")))
    each = ranked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rn <= k").withColumn("weights", F.explode(F.array(*[F.lit(w) for w in weights])))
    worth = F.when(F.col("weights") == "uniform", 1.0).otherwise(F.coalesce(F.try_divide(F.lit(1.0), F.sqrt("d")), F.lit(1e30)))
    votes = each.groupBy("k", "weights", "q", "truth", "l").agg(F.round(F.sum(worth), 9).alias("n"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("k", "weights", "q").orderBy(F.desc("n"), "l"))).where("r = 1")
    return best.select("k", "weights", F.col("q").alias(key), "truth", F.col("l").alias("predicted"))


def calibration_slopes(df: DataFrame, logit: str, by: list[str]) -> DataFrame:
    """(by, intercept, slope) of the target on the score's logit."""
    return calibration(df, logit, by, True)


def design(df: DataFrame, train: DataFrame, columns: list[str]) -> DataFrame:
    """Imputed and scaled by the training rows, as a features vector."""
    from pyspark.ml.feature import VectorAssembler

    filled = impute_values(df, train, columns, [])
    base = impute_values(train, train, columns, [])
    return VectorAssembler(inputCols=columns, outputCol="features").transform(scale_values(filled, base, columns).withColumn("label", F.col("y").cast("double")))


def models(seed: int = 0) -> dict:
    """Factories of the conventional learners. The kernel machine is a linear one on random Fourier features."""
    from pyspark.ml import classification as C

    return {
        "decision_tree": lambda: C.DecisionTreeClassifier(maxDepth=30, seed=seed), "logistic_regression": lambda: C.LogisticRegression(regParam=0.01, standardization=False),
        "random_forest": lambda: C.RandomForestClassifier(numTrees=100, maxDepth=20, seed=seed), "boosted_trees": lambda: C.GBTClassifier(maxDepth=2, maxIter=20, stepSize=0.1, seed=seed),
        "mlp": lambda: C.MultilayerPerceptronClassifier(layers=[2, 16, 2], maxIter=50, seed=seed), "linear_svm": lambda: C.LinearSVC(maxIter=50, regParam=0.01),
    }


def fourier_features(df: DataFrame, width: int, outputs: int = 32, gamma: float = 0.5, seed: int = 0) -> DataFrame:
    """Replaces features by cosines that approximate the radial kernel."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, np.sqrt(2 * gamma), (outputs, width)), rng.uniform(0, 2 * np.pi, outputs)
    x = vector_to_array("features")
    waves = [F.cos(sum((F.get(x, F.lit(j)) * float(w[i, j]) for j in range(width)), F.lit(float(b[i])))) * float(np.sqrt(2 / outputs)) for i in range(outputs)]
    return df.withColumn("features", array_to_vector(F.array(*waves)))


def oof(df: DataFrame, fold: str, columns: list[str], make, transform=lambda d: d) -> DataFrame:
    """(rid, fold, y, score): every row scored by the model fitted without its fold. Folds are few, by contract."""
    from pyspark.ml.functions import vector_to_array

    df, parts = settled(df), []  # every fold reads it several times
    for r in df.select(fold).distinct().orderBy(fold).collect():
        train = df.where(~F.col(fold).eqNullSafe(F.lit(r[0])))
        ready = transform(design(train, train, columns)).persist()
        fitted = make().fit(ready)
        ready.unpersist()
        scored = fitted.transform(transform(design(df.where(F.col(fold).eqNullSafe(F.lit(r[0]))), train, columns)))
        column = "probability" if "probability" in scored.columns else "rawPrediction"
        parts.append(scored.select("rid", F.col(fold).cast("string").alias("fold"), "y", vector_to_array(column)[1].alias("score")))
    return reduce(DataFrame.unionByName, parts)


def nested_search(df: DataFrame, fold: str, columns: list[str], grid: list[float]) -> DataFrame:
    """(rid, fold, y, score, best): the penalty of each outer fold is chosen by inner leave-one-fold-out AUC, first on ties."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    df, parts = settled(df), []
    for r in df.select(fold).distinct().orderBy(fold).collect():
        train = df.where(F.col(fold) != r[0])
        names = [x[0] for x in train.select(fold).distinct().orderBy(fold).collect()]
        index = F.create_map(*[v for i, s in enumerate(names) for v in (F.lit(s), F.lit(i))])
        ready = design(train, train, columns).withColumn("inner", index[F.col(fold)]).persist()
        lr = LogisticRegression(standardization=False)
        search = CrossValidator(estimator=lr, estimatorParamMaps=ParamGridBuilder().addGrid(lr.regParam, grid).build(), evaluator=BinaryClassificationEvaluator(numBins=0), numFolds=len(names), foldCol="inner", parallelism=4)
        fitted = search.fit(ready)
        ready.unpersist()
        best = grid[int(np.argmax(fitted.avgMetrics))]
        scored = fitted.transform(design(df.where(F.col(fold) == r[0]), train, columns))
        parts.append(scored.select("rid", F.col(fold).alias("fold"), "y", vector_to_array("probability")[1].alias("score"), F.lit(best).alias("best")))
    return reduce(DataFrame.unionByName, parts)
