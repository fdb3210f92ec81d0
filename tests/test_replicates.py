"""Replicates drawn where their values lie give what draws as rows give."""

import pytest
from pyspark.sql import functions as F

from attestry.operators import replicates, sampling

ROWS = [("uv"[i % 2], int(i % 3 == 0), i * 7 % 23, None if i % 10 == 0 else i * 5 % 11) for i in range(240)] + [(None, 1, 3, 2), ("u", None, 3, 2)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "site string, y int, a long, k long")


def both(df, **more):
    got = [{(*(r[c] for c in more["by"]), r.b): [r[c] for c in r.asDict() if c not in ("b", *more["by"])] for r in replicates.replicate_aucs(df, draws=70, seed=5, held=held, **more).collect()} for held in (None, 0)]
    assert got[0].keys() == got[1].keys() and got[0]
    for k, v in got[0].items():
        assert v == pytest.approx(got[1][k], abs=1e-12)


@pytest.mark.parametrize("tree", [False, True])
def test_aucs_in_tasks_equal_those_of_draws_as_rows(rows, monkeypatch, tree):
    known = rows.where("k is not null")
    both(known, strata=["y"], values=["a", "k"], by=[], tree=tree)
    both(known, strata=["site", "y"], values=["a"], by=[], site="site", tree=tree)
    both(known.withColumn("g", F.col("a") % 2), strata=["g", "site", "y"], values=["a", "k"], by=["g"], site="site", tree=tree)


def test_one_class_is_null_and_nothing_gives_nothing(rows):
    one = replicates.replicate_aucs(rows.where("y = 1"), ["y"], ["a"], 3, 1).collect()
    assert len(one) == 3 and all(r.auc_a is None for r in one)
    assert replicates.replicate_aucs(rows.limit(0), ["y"], ["a"], 3, 1).count() == 0


@pytest.mark.parametrize("seen", [False, True])
def test_few_combinations_in_tasks_equal_draws_as_rows(rows, seen):
    counted = rows.groupBy("site", "y", "a").agg(F.count(F.lit(1)).alias("n"))
    for df, times in ((rows, None), (counted, "n")):
        here, there = (sorted(map(tuple, sampling.bootstrap_weights(df, ["site", "y"], ["a"], 9, 4, seen, times, few).collect())) for few in (None, 0))
        assert here == there and here


def test_leaves_draw_as_the_tree_of_rows(spark, monkeypatch):
    """More values than a leaf: the AUCs are those of split_weights' draws."""
    df = spark.range(3000).select((F.col("id") % 2).cast("int").alias("y"), (F.col("id") * 7919 % 2741).alias("a"))
    both(df, strata=["y"], values=["a"], by=[], tree=True)
