"""Hand-computed answers, sentinels and determinism."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from attestry.functions import scalars as X
from attestry.operators import matching, sampling, statistics, survey
from attestry.operators.preparation import impute_values, require_complete
from attestry.sources import readers


def test_mcnemar_known(spark):
    rows = [("a", True, False)] * 5 + [("a", True, True)] * 5 + [("b", True, True)] * 3 + [("c", True, False)] * 3 + [("c", False, True)] * 3
    got = {r.g: r.p for r in statistics.mcnemar(spark.createDataFrame(rows, "g string, x boolean, y boolean"), "x", "y", ["g"]).collect()}
    assert got == {"a": pytest.approx(2 * 0.5**5), "b": 1.0, "c": 1.0}


def test_holm_known(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r.k: r.p_holm for r in statistics.holm(df, "p", "k").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}


def test_youden_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 0, 0.4), (1, 1, 0.35), (1, 1, 0.8)], "g int, y int, p double")
    assert statistics.youden(df, "p", ["g"]).first().threshold == 0.35


def test_auc_undefined_is_null(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0)], "y int, s double").withColumn("g", F.lit(1))
    assert statistics.auc_by(df, "s", by=["g"]).first().auc is None


def test_t_and_binomial():
    assert X.t_two_sided(2.0, 10) == pytest.approx(0.0733880348, abs=1e-9)
    assert X.binomial_quantile(0.025, 50, 0.95) == 44


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(997).withColumnRenamed("id", "k").withColumn("g", F.lit(1))
    picks = []
    for n in (1, 3, 8):
        s = sampling.hash_split(df.repartition(n), "k", F.lit(3), ["g"]).where("is_test")
        picks.append(sorted(r.k for r in s.select("k").collect()))
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == 200


def test_split_meets_its_borders_without_moving_rows(spark):
    """Few borders go to the rows; very many are joined by key, as they are never forced into a broadcast."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(limit)
    spark.conf.set(limit, "100k")
    try:
        df = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
        split = sampling.hash_split(df, "k", F.col("g"), ["g"])
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert {r.g: (r.n, r.t) for r in split.groupBy("g").agg(F.count("k").alias("n"), F.count_if("is_test").alias("t")).collect()} == {0: (13334, 2667), 1: (13333, 2667), 2: (13333, 2667)}
        many = sampling.hash_split(df, "k", F.lit(3), ["k"])
        assert "Broadcast" not in many._jdf.queryExecution().executedPlan().toString() and many.where("is_test").count() == 40_000
    finally:
        spark.conf.set(limit, was)


def test_split_of_null_and_repeated_keys_and_of_no_rows(spark):
    """Each group has ceil(share n) test rows, the first by (hash, key), though keys and groups are null or come twice."""
    rows = [(None if i % 10 == 0 else i // 2, None if i % 4 == 0 else i % 3) for i in range(600)]
    got = sampling.hash_split(spark.createDataFrame(rows, "k long, g int"), "k", F.lit(7), ["g"]).collect()
    code = lambda k: int(hashlib.md5((b"7:split" if k is None else f"7:split:{k}".encode())).hexdigest()[:8], 16)
    for g in (None, 0, 1, 2):
        ranked = sorted((code(k), k is not None, k or 0) for k, h in rows if h == g)
        mine = [(code(r.k), r.k is not None, r.k or 0) for r in got if r.g == g and r.is_test]
        assert sorted(mine) == ranked[: math.ceil(0.2 * len(ranked))] and len(ranked) == sum(r.g == g for r in got)
    empty = sampling.hash_split(spark.createDataFrame([], "k long, g int"), "k", F.lit(7), ["g"])
    assert empty.columns == ["k", "g", "is_test"] and empty.count() == 0


def test_derive_is_prefix_stable():
    assert sampling.derive("control", 5) == sampling.derive("control", 9)[:5]


def test_bootstrap_keeps_class_counts(spark):
    df = spark.createDataFrame([(i, i % 3 == 0) for i in range(60)], "k int, y boolean").withColumn("y", F.col("y").cast("int"))
    got = sampling.bootstrap_weights(df, ["y"], ["k"], 7, 1).groupBy("b").agg(F.sum(F.col("y") * F.col("drawn")).alias("p"), F.sum("drawn").alias("n")).collect()
    assert len(got) == 7 and all((r.p, r.n) == (20, 60) for r in got)


def test_bootstrap_equals_drawing_rows(spark):
    """Weights over equal values are those of drawing rows one by one, at any partitioning, and seen counts different rows."""
    rows = [(i, i % 2, (i * 7) % 5) for i in range(700)]
    df = spark.createDataFrame(rows, "k int, g int, v int")
    want = {}
    for g in (0, 1):
        line = sorted(v for _, h, v in rows if h == g)
        for b in range(3):
            for k in range(len(line)):
                at = int(hashlib.md5(f"9:{b}:{g}:{k}".encode()).hexdigest()[:8], 16) % len(line)
                want.setdefault((b, g, line[at]), []).append(at)
    for n in (1, 5):
        got = {(r.b, r.g, r.v): (r.drawn, r.seen, r.size) for r in sampling.bootstrap_weights(df.repartition(n), ["g"], ["v"], 3, 9, seen=True).collect()}
        assert len(got) == 30 and all(got[key] == (len(at), len(set(at)), 70) for key, at in want.items())


def test_auc_and_delong_against_all_pairs(spark):
    """Ties, weights and columns named like the ones used inside."""
    import random

    rnd = random.Random(3)
    rows = [(g, int(rnd.random() < 0.4), float(rnd.choice([-3, -1.5, 0, 0, 0.25, 2, 1e9]) if g else rnd.gauss(0, 2))) for g in (0, 1) for _ in range(60)]
    df = spark.createDataFrame(rows, "p int, y int, n double").withColumn("q", F.lit(1))
    got = {r.p: r for r in statistics.auc_by(df, "n", by=["p"]).collect()}
    dl = {r.p: r for r in statistics.delong(df, "n", ["p"]).collect()}
    for g in (0, 1):
        pos, neg = [s for h, y, s in rows if h == g and y], [s for h, y, s in rows if h == g and not y]
        psi = [[(a > b) + (a == b) / 2 for b in neg] for a in pos]
        auc = sum(map(sum, psi)) / len(pos) / len(neg)
        v1, v0 = [sum(r) / len(neg) for r in psi], [sum(r[j] for r in psi) / len(pos) for j in range(len(neg))]
        var = lambda v: sum((x - sum(v) / len(v)) ** 2 for x in v) / (len(v) - 1)
        assert got[g].auc == pytest.approx(auc) and (got[g].n, got[g].n_pos) == (60, len(pos))
        assert dl[g].auc == pytest.approx(auc) and dl[g].se == pytest.approx((var(v1) / len(pos) + var(v0) / len(neg)) ** 0.5)
    one = spark.createDataFrame([(1, 1, 0.1), (1, 1, 0.2), (2, 1, 0.3), (2, 0, 0.1)], "g int, y int, s double")
    lone = {r.g: r for r in statistics.delong(one, "s", ["g"]).collect()}
    assert lone[1][1:] == (None, None, None, None) and (lone[2].auc, lone[2].se, lone[2].lo) == (1.0, None, None)


def test_youden_and_calibration_of_clashing_names(spark):
    df = spark.createDataFrame([("a", 0, 0.2), ("a", 1, 0.7), ("a", 1, 0.9), ("a", 0, 0.6), ("b", 1, 0.5)], "n string, y int, p double").withColumn("x", F.col("p"))
    got = {r.n: (r.threshold, r.j) for r in statistics.youden(df, "p", ["n"]).collect()}
    assert got == {"a": (0.7, 1.0), "b": (0.5, None)}
    cal = {r.n: r.intercept for r in statistics.calibration_intercept(df, "p", ["n"]).collect()}
    assert cal["b"] is None and sum(1 / (1 + math.exp(-(cal["a"] + x))) for x in (0.2, 0.7, 0.9, 0.6)) == pytest.approx(2, abs=1e-5)


def test_corrected_t_branches(spark):
    df = spark.createDataFrame([("flat", 0.0), ("flat", 0.0), ("up", 0.5), ("up", 0.5), ("down", -1.0), ("down", -1.0), ("one", 2.0), ("real", 0.1), ("real", 0.3), ("real", 0.2)], "g string, d double")
    got = {r.g: (r.t, r.p, r.j) for r in statistics.corrected_t(df, "d", 0.25, ["g"]).collect()}
    assert got["flat"] == (0.0, 1.0, 2) and got["up"] == (float("inf"), 0.0, 2) and got["down"] == (float("-inf"), 0.0, 2) and got["one"] == (None, None, 1)
    t = 0.2 / (0.01 * (1 / 3 + 0.25)) ** 0.5
    assert got["real"][0] == pytest.approx(t) and got["real"][1] == pytest.approx(X.t_two_sided(t, 2), abs=1e-8)


def test_mcnemar_of_many_rows(spark):
    df = spark.range(40000).select(F.lit("g").alias("g"), (F.col("id") % 2 == 0).alias("x"), ((F.col("id") % 2 == 1) & (F.col("id") % 40 != 1)).alias("y"))
    r = statistics.mcnemar(df, "x", "y", ["g"]).first()
    n, low = r.n_a + r.n_b, min(r.n_a, r.n_b)
    top = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) - n * math.log(2)
    want, term = 0.0, math.exp(top)
    for k in range(low, -1, -1):
        want, term = want + term, term * k / (n - k + 1)
    assert r.p == pytest.approx(min(1, 2 * want), abs=1e-8)


def test_matching_unknown_and_ambiguous(spark):
    rec = spark.createDataFrame([(1, "a", 10, 5, 1, 1), (2, "a", 20, None, None, 0), (3, "b", 30, 7, 1, 1), (4, "c", 30, 7, 1, 1)], "rid long, site string, n_chars long, nsp long, slope int, y int")
    pub = spark.createDataFrame([(1, "a", 10, 5, 1, 1), (2, "a", 20, 9, 0, 0), (3, "b", 30, 7, 1, 1), (9, "z", 1, 1, 1, 1)], "pid long, site string, n_chars long, nsp long, slope int, y int")
    m = {r.pid: r for r in matching.match_sources(rec, pub, ["y", "n_chars"], ["nsp"]).collect()}
    assert (m[1].source, m[1].rid, m[2].rid) == ("a", 1, 2)
    assert (m[3].source, m[3].n_candidates, m[3].rid) == ("unknown", 2, None)
    assert (m[9].source, m[9].n_candidates) == ("unknown", 0)


def test_imputation_sees_training_rows_only(spark):
    df = spark.createDataFrame([(1, 2.0, 1), (2, 4.0, 1), (3, None, None), (4, 1e9, 7)], "rid int, a double, b int")
    got = impute_values(df, df.where("rid < 3"), ["a"], ["b"]).where("rid = 3").first()
    assert (got.a, got.b) == (3.0, 1)
    with pytest.raises(ValueError, match="a"):
        require_complete(df, ["a"])


def test_modes_and_screening(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y"), (4, "x"), (5, None)], "pos int, v string")
    r = survey.modal_values(df, ["v"], "pos").first()
    assert (r.value, r.tied) == ("x", 1)
    rows = spark.createDataFrame([(i, i % 2) for i in range(20)], "p int, inc int")
    assert survey.screen_until(rows, "p", F.col("inc") == 1, 3).count() == 6 and survey.screen_until(rows, "p", F.col("inc") == 1, 30).count() == 20


def test_multi_value_modes_need_two(spark):
    frame = lambda rows: spark.createDataFrame([(r.split(";"),) for r in rows], "v array<string>")
    got = lambda rows: sorted(r.value for r in survey.multi_value_modes(frame(rows), "v").collect())
    assert got(["knn;rf", "rf;knn", "svm"]) == ["knn", "rf"]
    assert got(["a;b;c", "a;d", "a;e;f", "b;c", "d;e;f"]) == ["a", "b", "c", "d", "e", "f"]


def test_rubric_kinds(spark):
    rules = {"u": ("unit",), "f": ("fraction",), "c": ("count",), "m": ("subset", "rf", "knn"), "e": ("one_of", "yes", "no")}
    df = spark.createDataFrame([(1, 0.5, None, 1, "rf;knn", "yes"), (2, 1.5, 1.0, 0, "", None), (3, None, 0.2, 3, "rf;x", "no")], "k int, u double, f double, c int, m string, e string")
    bad = {(r.k, r.field): r.value for r in survey.rubric_violations(df, "k", rules).collect()}
    assert bad == {(2, "u"): "1.5", (2, "f"): "1.0", (2, "c"): "0", (2, "m"): "", (2, "e"): None, (3, "u"): None, (3, "m"): "rf;x"}


def test_screening_order_keeps_every_path(spark):
    rows = [("a/x", "z"), ("a/x", "b"), ("a/x", "z"), ("c/z", "q")]
    got = [survey.screening_order(spark.createDataFrame(r, "repo string, path string"), "repo", "path", 5) for r in (rows, rows[::-1])]
    seen = [sorted((r.repo, r.k, r.path, r.position) for r in g.collect()) for g in got]
    assert seen[0] == seen[1] and [x[:3] for x in seen[0]] == [("a/x", 1, "b"), ("a/x", 2, "z"), ("c/z", 1, "q")] and {x[3] for x in seen[0]} == {1, 2}


def test_fetch_takes_the_first_valid_mirror(tmp_path):
    good = hashlib.sha256(b"good").hexdigest()
    get = lambda url, dest: dest.write_bytes(url.encode())
    out = readers.fetch_first_valid(["bad", "good"], tmp_path / "f", "sha256", good, get)
    assert out.read_bytes() == b"good" and not list(tmp_path.glob("*.part"))
    with pytest.raises(readers.DigestMismatch):
        readers.fetch_first_valid(["bad"], tmp_path / "g", "sha256", good, get)


def test_digest_mismatch_raises(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"1")
    found = readers.file_digests(spark, str(tmp_path))
    with pytest.raises(readers.DigestMismatch):
        readers.verify_digests(found, readers.pins_frame(spark, [readers.Pin("a", (), "sha256", "00")]))
    readers.verify_digests(found, readers.pins_frame(spark, [readers.Pin("a", (), "md5", hashlib.md5(b"1").hexdigest())]))


def test_fetch_all_and_paged_sources(tmp_path):
    pins = [readers.Pin(n, (f"u/{n}",), "sha256", hashlib.sha256(f"u/{n}".encode()).hexdigest()) for n in ("a", "b")]
    get = lambda url, dest: dest.write_bytes(url.encode())
    assert {k: v.read_text() for k, v in readers.fetch_all(pins, tmp_path, get).items()} == {"a": "u/a", "b": "u/b"}
    (tmp_path / "a").write_bytes(b"x")
    with pytest.raises(readers.DigestMismatch):
        readers.fetch_all(pins, tmp_path, get)
    asked, pauses = [], []
    page = lambda n: asked.append(n) or [{"n": n}] * (3 if n < 3 else 1)
    assert len(readers.read_pages(page, 10, 3, lambda: pauses.append(1))) == 7 and asked == [1, 2, 3] and len(pauses) == 2

    def content(path):
        if "bad" in path:
            raise OSError("gone")
        return path

    rows = readers.fetch_notebooks([{"position": p, "k": 1, "repo": "r", "path": q} for p, q in ((1, "a b.ipynb"), (2, "bad"), (9, "c"))], content, 1, 3)
    assert [(r["file"], r["content"], r["error"]) for r in rows] == [("001-1", "r/contents/a%20b.ipynb", None), ("002-1", None, "gone")]


def test_bundles_and_texts_are_read_back(spark, tmp_path):
    rows = [(s, m, i, i % 2, (i + s) % 2) for s in (1, 2) for m in ("lr", "rf") for i in range(4)]
    df = spark.createDataFrame(rows, "seed long, model string, row_id long, y int, predicted int")
    readers.write_predictions(df, str(tmp_path / "p"))
    assert sorted(tuple(r[c] for c in ("seed", "model", "row_id", "y", "predicted")) for r in readers.read_predictions(spark, str(tmp_path / "p")).collect()) == sorted(rows)
    readers.write_texts(spark.createDataFrame([("001-1", "### [0] code\nx = 1")], "file string, flat string"), str(tmp_path / "t"), "file", "flat")
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["### [0] code", "x = 1"]
    assert "model" in readers.console_table(df, 2)


def test_matching_with_every_key_tolerant_equals_the_dense_matrix(spark):
    rng = __import__("random").Random(3)
    some = lambda *v: rng.choice([None, *v])
    rec = [(i, some("a", "b"), some(1, 2), some(5, 6, 7), some(0, 1), some(0, 1)) for i in range(60)] + [(90, "a", None, None, None, None)]
    pub = [(i, rng.choice("ab"), rng.choice((1, 2)), rng.choice((5, 6, 7, None)), rng.choice((0, 1)), rng.choice((0, 1))) for i in range(40)]
    columns = "site string, n_chars long, nsp long, slope int, y int"
    for bare in ([], [(99, None, None, None, None, None)]):
        r, p = spark.createDataFrame(rec + bare, "rid long, " + columns), spark.createDataFrame(pub, "pid long, " + columns)
        keys = ["site", "n_chars", "nsp", "slope", "y"]
        fits = {(a[0], b[0]) for a in pub for b in rec if any(v is not None for v in b[1:]) and all(v is None or v == w for v, w in zip(b[1:], a[1:], strict=True))}
        df = matching.compatible_pairs(r, p, [], keys)
        assert {(x.pid, x.rid) for x in df.collect()} == fits
        plan = df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        whole = fits | {(a[0], b[0]) for a in pub for b in rec + bare if all(v is None for v in b[1:])}
        got = {x.pid: x for x in matching.match_sources(r, p, [], keys).collect()}
        for a in pub:
            mine = [i for q, i in whole if q == a[0]]
            pair = mine[0] if len(mine) == 1 and sum(i == mine[0] for _, i in whole) == 1 else None
            assert (got[a[0]].n_candidates, got[a[0]].rid) == (len(mine), pair)


@pytest.mark.parametrize("equal", [[], ["site"]])
def test_matching_of_null_and_repeated_ids_equals_all_pairs(spark, equal):
    """Ids that are null or come twice, with rows equal or different, and rows without any key; what is told of a published row is told by its id."""
    rng = __import__("random").Random(5)
    some = lambda *v: rng.choice([None, *v])
    rec = [(some(*range(30)), some("a", "b"), some(5, 6, 7, 8), some(0, 1), some(0, 1)) for _ in range(30)]
    pub = [(some(*range(40)), some("a", "b"), some(5, 6, 7, 8), some(0, 1), some(0, 1)) for _ in range(40)]
    rec, pub = [*rec, *rec[:6], (77, "a", 99, None, 1), (None, "b", 98, 1, 0)], [*pub, *pub[:6], (88, "a", 99, 0, 1), (89, "b", 98, 1, 0)]
    keys, columns = [k for k in ("site", "nsp", "y") if k not in equal], "site string, nsp long, slope int, y int"
    at = {"site": 1, "nsp": 2, "y": 4}
    one_null = [r for r in rec[:-1] if r[0] is not None and r[2] is not None] + rec[-1:]
    for some_rec, bare in ((rec, []), (one_null, []), (rec, [(None, None, None, 1, None), (99, None, None, 0, None)])):
        rows = [r for r in some_rec if equal or any(r[at[k]] is not None for k in keys)] + bare
        r, p = spark.createDataFrame(rows, "rid long, " + columns), spark.createDataFrame(pub, "pid long, " + columns)
        fits = [(a, b) for a in pub for b in rows if (equal or any(b[at[k]] is not None for k in keys)) and all(b[at[k]] is not None and b[at[k]] == a[at[k]] for k in equal) and all(b[at[k]] in (None, a[at[k]]) for k in keys)]
        n_bare = 0 if equal else len(bare)
        want = []
        for a in pub:
            mine = [b for q, b in fits if a[0] is not None and q[0] == a[0]]
            sites = {b[1] for b in mine if b[1] is not None}
            one = mine[0] if len(mine) == 1 and not n_bare and sum(b[0] == mine[0][0] for _, b in fits) == 1 else (None,) * 5
            want.append((a[0], len(mine) + n_bare, sites.pop() if len(sites) == 1 else "unknown", one[0], one[3], a[3], one[4], a[4]))
        got = matching.match_sources(r, p, equal, keys).select("pid", "n_candidates", "source", "rid", "rec_slope", "pub_slope", "rec_y", "pub_y").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
        assert some_rec is rec or {(88, 77, None), (89, None, 1)} <= {(w[0], w[3], w[4]) for w in want}  # the latter's recorded row has no id
    assert matching.match_sources(r.limit(0), p, equal, keys).where("n_candidates = 0 and source = 'unknown' and rid is null").count() == len(pub)


def test_recorded_rows_of_equal_keys_are_joined_as_one(spark, monkeypatch):
    """200 x 100 pairs of one common key are 100 rows of the join; counts and the lone pair are those of all rows."""
    made = []
    pairs = matching.compatible_pairs
    monkeypatch.setattr(matching, "compatible_pairs", lambda *a: made.append(pairs(*a)) or made[-1])
    rec = spark.createDataFrame([*((i, "a", 5, i % 3, 1) for i in range(200)), (900, "b", 6, 2, 1)], "rid long, site string, nsp long, slope int, y int")
    pub = spark.createDataFrame([*((i, "a", 5, 0, 1) for i in range(100)), (900, "b", 6, 0, 1)], "pid long, site string, nsp long, slope int, y int")
    got = {r.pid: (r.n_candidates, r.source, r.rid, r.rec_slope) for r in matching.match_sources(rec, pub, ["y"], ["site", "nsp"]).collect()}
    assert got == {**{i: (200, "a", None, None) for i in range(100)}, 900: (1, "b", 900, 2)} and made[0].count() == 101


@pytest.mark.parametrize(("name", "scans"), [("match_all_tolerant", 3), ("reverted_frame", 4)])
def test_study_frames_are_made_once(spark, name, scans):
    """The plans read what was settled, not documents and labels again."""
    from attestry.plans.catalog import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == scans and "documents.parquet" not in plan and "labels.parquet" not in plan


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_reverted_frame_of_odd_rows(spark, tmp_path, kind):
    """Null languages, counts, texts, labels and ids, ids that come twice, and tables without rows: as counted row by row."""
    from attestry.plans.catalog import QUERIES

    docs = [(i if i % 11 else None, None if i % 13 == 0 else "ab"[i % 2] * (i % 5), None if i % 8 == 0 else ("de", "en")[i % 2], f"s{i % 3}", None if i % 10 == 0 else 100 + i) for i in range(90)]
    docs = [] if kind == "empty" else [*docs, *docs[14:20]]
    marks = [] if kind == "empty" else [(i if i % 12 else None, None if i % 9 == 0 else i % 2) for i in range(70)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    rec = [(d[0], d[2], d[4], d[1].count(" ") if d[0] % 7 and d[1] is not None else None, d[4] % 3 if d[0] % 3 and d[4] is not None else None, y) for d in docs for k, y in marks if d[0] is not None and d[0] == k]
    pub = [(*r[:3], r[3] if r[3] is not None else r[5] and r[5] * 100, r[4] if r[4] is not None else r[5], r[5]) for r in rec]
    fits = [(p, r) for p in pub for r in rec if None not in (p[1], p[2], p[5]) and (p[1], p[2], p[5]) == (r[1], r[2], r[5]) and r[3] in (None, p[3])]
    lone = [(p, r) for p, r in fits if sum(q[0] == p[0] for q, _ in fits) == 1 == sum(s[0] == r[0] for _, s in fits)]
    gone = {(p[0], c) for p, r in lone for c in (3, 4) if r[c] is None}
    want = {}
    for p in pub:
        n = want.setdefault(p[1], [0, 0, 0])
        n[0] += 1
        for k, c in ((1, 3), (2, 4)):
            n[k] += p[c] is None or (p[0], c) in gone
    got = QUERIES["reverted_frame"](spark, str(tmp_path)).collect()
    assert {r.site: [r.n, r.null_nsp, r.null_slope] for r in got} == want and len(got) == len(want) and (kind == "empty" or (None in want and len(gone) > 9))


@pytest.mark.parametrize("values", ["id + 1000000000", "pow(1.001, id)", "if(id % 2 = 0, 5, id)", "-id * id"])
def test_ranges_of_running_sums_are_even(spark, values):
    from attestry.operators.running import order_range, range_cuts, sums_before

    df = spark.range(40_000).select(F.expr(values).cast("double").alias("v")).distinct().withColumn("n", F.lit(1))
    sizes = [r["count"] for r in df.join(F.broadcast(range_cuts(df, "v"))).groupBy(order_range(F.col("v"))).count().collect()]
    assert max(sizes) <= 4 * sum(sizes) / 1024 + 8
    assert all(r.before_n == i for i, r in enumerate(sums_before(df, [], ["v"], ["n"]).orderBy("v").limit(2000).collect()))


def test_contamination_by_seed_equals_splits_one_by_one(spark):
    df = spark.createDataFrame([(i, None if i % 9 == 0 else f"g{i % 23}" if i % 3 else f"own{i}") for i in range(140)], "rid long, dup string")
    seeds = [5, 11, *range(100, 170)]
    got = {r.seed: (r.n_test, r.n_hit) for r in sampling.contamination_by_seed(df, "rid", "dup", seeds).collect()}
    assert len(got) == len(seeds)
    rows = [tuple(r) for r in df.collect()]
    for seed in seeds[:12]:
        ranked = sorted(rows, key=lambda r: (int(hashlib.md5(f"{seed}:split:{r[0]}".encode()).hexdigest()[:8], 16), r[0]))
        test, rest = ranked[:28], {g for _, g in ranked[28:]}
        assert got[seed] == (28, sum(g in rest for _, g in test))


def test_null_groups_and_labels_keep_their_rows(spark):
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2, None if i % 5 == 0 else f"g{i % 7}") for i in range(60)], "rid long, y int, g string")
    folds = sampling.stratified_folds(df, "rid", "y", 3, 5).collect()
    assert len(folds) == 60 and {r.fold for r in folds if r.y is None} == {0, 1, 2, 3, 4}
    split = sampling.group_split(df, "g", 3).collect()
    assert len(split) == 60 and len({r.is_test for r in split if r.g is None}) == 1 and len({r.g for r in split if r.is_test}) == 2
    dealt = sampling.permute(df.withColumn("b", F.lit(None).cast("int")), "rid", "y", F.lit(1), ["b"]).collect()
    count = lambda rows: sorted(str(r.y) for r in rows)
    assert len(dealt) == 60 and count(dealt) == count(df.collect())


def test_overrides_and_places(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k long, v string")
    told = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (None, "z")], "k long, v string")
    assert sorted(map(tuple, survey.override(df, told, ["k"], "v").collect()), key=str) == [(1, "y"), (2, None), (None, "c")]
    rows = spark.createDataFrame([(2, 1, "include"), (1, 2_000_001, "include"), (1, 1, "exclude"), (3, 1, "include")], "p long, k long, d string").withColumn("at", F.struct("p", "k"))
    got = survey.screen_until(rows, "at", F.col("d") == "include", 2).collect()
    assert {(r.p, r.k): r.before for r in got} == {(1, 1): 0, (1, 2_000_001): 0, (2, 1): 1}


def test_json_is_read_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2])], "id long, name string, more array<int>")
    readers.write_json(df, str(tmp_path / "j"))
    assert spark.read.schema(df.schema).json(str(tmp_path / "j")).collect() == df.collect()
