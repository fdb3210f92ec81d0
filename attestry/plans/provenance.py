"""Queries: matching rows to their source, filled cells, fill gaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from attestry.operators import matching as M
from attestry.operators.sampling import bootstrap_weights
from attestry.plans.registry import h32, query
from attestry.sources.readers import published, recorded, settled

EQUAL, FREE = ["site", "y", "n_chars"], ["nsp"]
_PAIRS = """pairs AS (SELECT p.pid, r.rid, r.site, r.slope AS rec_slope, p.slope AS pub_slope, r.y AS rec_y, p.y AS pub_y FROM pub p JOIN rec r ON r.site = p.site AND r.n_chars = p.n_chars {y} AND (r.nsp IS NULL OR r.nsp = p.nsp))"""
_MATCH = """c AS (SELECT *, count(*) OVER (PARTITION BY pid) AS np, count(*) OVER (PARTITION BY rid) AS nr FROM pairs),
 m AS (SELECT p.pid, count(c.rid) AS n_candidates, coalesce(CASE WHEN min(c.site) = max(c.site) THEN min(c.site) END, 'unknown') AS source, max(CASE WHEN np = 1 AND nr = 1 THEN rid END) AS rid,
 max(CASE WHEN np = 1 AND nr = 1 THEN rec_slope END) AS rec_slope, any_value(p.slope) AS pub_slope, max(CASE WHEN np = 1 AND nr = 1 THEN rec_y END) AS rec_y, any_value(p.y) AS pub_y FROM pub p LEFT JOIN c ON c.pid = p.pid GROUP BY p.pid)"""
_ALL = "WITH @rec, @pub, " + _PAIRS.format(y="AND r.y = p.y") + ", " + _MATCH
_CELLS = """, cells AS (SELECT m.pid, 'nsp' AS "column", CAST(p.nsp AS VARCHAR) AS "value", m.source FROM m JOIN pub p ON p.pid = m.pid JOIN rec r ON r.rid = m.rid WHERE r.nsp IS NULL
 UNION ALL SELECT m.pid, 'slope', CAST(p.slope AS VARCHAR), m.source FROM m JOIN pub p ON p.pid = m.pid JOIN rec r ON r.rid = m.rid WHERE r.slope IS NULL)"""


def _frames(spark, sf):
    rec, pub = settled(recorded(spark, sf)), settled(published(spark, sf))
    m = settled(M.match_sources(rec, pub, EQUAL, FREE))  # the cells and what is made of them read all three again
    return rec, pub, m, M.filled_cells(rec, pub, m)


@query("compatible_pairs", "WITH @rec, @pub, " + _PAIRS.format(y="AND r.y = p.y") + " SELECT pid, rid FROM pairs")
def compatible_pairs(spark, sf):
    return M.compatible_pairs(recorded(spark, sf), published(spark, sf), EQUAL, FREE).select("pid", "rid")


@query("match_sources", _ALL + " SELECT pid, n_candidates, source, rid FROM m")
def match_sources(spark, sf):
    return M.match_sources(recorded(spark, sf), published(spark, sf), EQUAL, FREE).select("pid", "n_candidates", "source", "rid")


@query("match_without_label", "WITH @rec, @pub, " + _PAIRS.format(y="") + ", " + _MATCH + " SELECT count(rid) AS n_pairs, CAST(sum(CASE WHEN rec_y = pub_y THEN 1 ELSE 0 END) AS BIGINT) AS label_agrees FROM m")
def match_without_label(spark, sf):
    m = M.match_sources(recorded(spark, sf), published(spark, sf), ["site", "n_chars"], FREE)
    return m.agg(F.count("rid").alias("n_pairs"), F.count_if(F.col("rec_y") == F.col("pub_y")).alias("label_agrees"))


@query("holdout_disagreements", _ALL + """ SELECT CAST(sum(CASE WHEN rec_slope IS NOT NULL AND rec_slope <> pub_slope THEN 1 ELSE 0 END) AS BIGINT) AS disagree,
 CAST(sum(CASE WHEN rec_slope = pub_slope THEN 1 ELSE 0 END) AS BIGINT) AS agree, CAST(sum(CASE WHEN rid IS NOT NULL AND rec_slope IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS filled FROM m""")
def holdout_disagreements(spark, sf):
    m = M.match_sources(recorded(spark, sf), published(spark, sf), EQUAL, FREE)
    return m.agg(F.count_if(F.col("rec_slope") != F.col("pub_slope")).alias("disagree"), F.count_if(F.col("rec_slope") == F.col("pub_slope")).alias("agree"), F.count_if(F.col("rid").isNotNull() & F.col("rec_slope").isNull()).alias("filled"))


@query("filled_cells", _ALL + _CELLS + ' SELECT pid, "column", "value", source FROM cells')
def filled_cells(spark, sf):
    return _frames(spark, sf)[3]


@query("fill_table", _ALL + _CELLS + """, every AS (SELECT m.pid, m.source, m.pub_y AS y, k.c FROM m, (VALUES ('nsp'), ('slope')) k(c) WHERE m.rid IS NOT NULL),
 f AS (SELECT e.*, cells.pid IS NOT NULL AS filled FROM every e LEFT JOIN cells ON cells.pid = e.pid AND cells."column" = e.c)
 SELECT c AS "column", source, CAST(sum(CASE WHEN filled THEN 1 ELSE 0 END) AS BIGINT) AS n_filled, round(avg(CASE WHEN filled THEN CAST(y AS DOUBLE) END), 9) AS rate_filled,
 CAST(sum(CASE WHEN filled THEN 0 ELSE 1 END) AS BIGINT) AS n_observed, round(avg(CASE WHEN filled THEN NULL ELSE CAST(y AS DOUBLE) END), 9) AS rate_observed FROM f GROUP BY 1, 2 HAVING sum(CASE WHEN filled THEN 1 ELSE 0 END) > 0""")
def fill_table(spark, sf):
    _, pub, m, cells = _frames(spark, sf)
    return M.fill_table(pub, m, cells)


@query("reverted_frame", _ALL + _CELLS + """ SELECT site, count(*) AS n, CAST(sum(CASE WHEN nsp IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_nsp, CAST(sum(CASE WHEN slope IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_slope FROM (
 SELECT p.site, CASE WHEN a.pid IS NULL THEN p.nsp END AS nsp, CASE WHEN b.pid IS NULL THEN p.slope END AS slope FROM pub p LEFT JOIN cells a ON a.pid = p.pid AND a."column" = 'nsp' LEFT JOIN cells b ON b.pid = p.pid AND b."column" = 'slope') GROUP BY site""")
def reverted_frame(spark, sf):
    _, pub, _, cells = _frames(spark, sf)
    return M.revert(pub, cells).groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("nsp").isNull()).alias("null_nsp"), F.count_if(F.col("slope").isNull()).alias("null_slope"))


SMALL = 20
#: Sources whose filled cells the gap is about; the others have no filled rows by rule of the study.
SCOPE = ("de", "en", "fr")


def _gap(filled, weight):
    rate = lambda s: F.sum(F.when((F.col("filled") == filled) & (F.col("slope") == s), weight * F.col("y"))) / F.nullif(F.sum(F.when((F.col("filled") == filled) & (F.col("slope") == s), weight)), F.lit(0)).cast("double")
    return rate(1) - rate(0)


_GAPS = "avg(CASE WHEN filled = {f} AND slope = 1 THEN CAST(y AS DOUBLE) END) - avg(CASE WHEN filled = {f} AND slope = 0 THEN CAST(y AS DOUBLE) END)"
_N = "sum(CASE WHEN filled = {f} AND slope = {s} THEN 1 ELSE 0 END)"


@query("fill_gap_ci", _ALL + _CELLS + ", base AS (SELECT m.pid, coalesce(m.pub_slope, -1) AS slope, m.pub_y AS y, CAST(CASE WHEN cells.pid IS NULL THEN 0 ELSE 1 END AS INT) AS filled FROM m LEFT JOIN cells ON cells.pid = m.pid AND cells.\"column\" = 'slope' WHERE m.rid IS NOT NULL AND m.source IN ('de', 'en', 'fr')),"
 + " pos AS (SELECT *, row_number() OVER (PARTITION BY filled ORDER BY slope, y, pid) - 1 AS pos, count(*) OVER (PARTITION BY filled) AS size FROM base),"
 + f" picks AS (SELECT b, filled, {h32('11', 'b', 'filled', 'pos')} % size AS pos FROM pos, range(0, 200) t(b)), draws AS (SELECT k.b, p.* FROM picks k JOIN pos p ON p.filled = k.filled AND p.pos = k.pos),"
 + f" g AS (SELECT b, ({_GAPS.format(f=1)}) AS gf, ({_GAPS.format(f=0)}) AS go FROM draws GROUP BY b), o AS (SELECT ({_GAPS.format(f=1)}) AS gf, ({_GAPS.format(f=0)}) AS go, CAST(CASE WHEN least({', '.join(_N.format(f=f, s=x) for f in (1, 0) for x in (1, 0))}) < 20 THEN 1 ELSE 0 END AS INT) AS sg FROM base)"
 + " SELECT round(o.gf, 9) AS gap_filled, round(o.go, 9) AS gap_observed, round(o.gf - o.go, 9) AS difference, round(quantile_cont(g.gf - g.go, 0.025), 9) AS lo, round(quantile_cont(g.gf - g.go, 0.975), 9) AS hi, count(g.gf - g.go) AS n, o.sg AS small_group FROM g, o GROUP BY o.gf, o.go, o.sg")
def fill_gap_ci(spark, sf):
    _, _, m, cells = _frames(spark, sf)
    scoped = m.where(F.col("rid").isNotNull() & F.col("source").isin(*SCOPE)).select("pid", F.coalesce("pub_slope", F.lit(-1)).alias("slope"), F.col("pub_y").alias("y"))
    flagged = scoped.join(cells.where(F.col("column") == "slope").select("pid", F.lit(1).alias("filled")), "pid", "left").select(F.coalesce("filled", F.lit(0)).alias("filled"), "slope", "y")
    # All that counts of a row is these three values, so the match is made once and only their counts go on.
    counts = settled(flagged.groupBy("filled", "slope", "y").agg(F.count(F.lit(1)).alias("rows")))
    drawn = bootstrap_weights(counts, ["filled"], ["slope", "y"], 200, 11, times="rows")
    draws = drawn.groupBy("b").agg((_gap(1, F.col("drawn")) - _gap(0, F.col("drawn"))).alias("d"))
    ci = draws.agg(F.round(F.percentile("d", F.lit(0.025)), 9).alias("lo"), F.round(F.percentile("d", F.lit(0.975)), 9).alias("hi"), F.count("d").alias("n"))
    held = [F.coalesce(F.sum(F.when((F.col("filled") == f) & (F.col("slope") == s), F.col("rows"))), F.lit(0)) for f in (1, 0) for s in (1, 0)]
    whole = counts.agg(_gap(1, F.col("rows")).alias("gf"), _gap(0, F.col("rows")).alias("go"), (F.least(*held) < SMALL).cast("int").alias("small_group"))
    return whole.join(F.broadcast(ci)).select(F.round("gf", 9).alias("gap_filled"), F.round("go", 9).alias("gap_observed"), F.round(F.col("gf") - F.col("go"), 9).alias("difference"), "lo", "hi", "n", "small_group")  # one row each


#: Recorded rows whose every key may be missing.
_LOOSE = """loose AS (SELECT rid, CASE WHEN rid % 11 <> 0 THEN site END AS site, CASE WHEN rid % 13 <> 0 THEN grp END AS grp, CASE WHEN rid % 5 <> 0 THEN n_chars END AS n_chars, nsp, slope,
  CASE WHEN rid % 17 <> 0 THEN y END AS y FROM rec WHERE rid % 11 <> 0 OR rid % 5 <> 0 OR rid % 13 <> 0)"""
_TOLERANT = ["site", "grp", "n_chars", "nsp", "slope", "y"]
_LOOSE_PAIRS = "pairs AS (SELECT p.pid, r.rid, r.site, r.slope AS rec_slope, p.slope AS pub_slope, r.y AS rec_y, p.y AS pub_y FROM pub p JOIN loose r ON " + " AND ".join(f"(r.{k} IS NULL OR r.{k} = p.{k})" for k in _TOLERANT) + ")"


def _loose(spark, sf):
    keep = lambda c, n: F.when(F.col("rid") % n != 0, F.col(c)).alias(c)
    rec = recorded(spark, sf).where("rid % 11 <> 0 or rid % 5 <> 0 or rid % 13 <> 0")
    return rec.select("rid", keep("site", 11), keep("grp", 13), keep("n_chars", 5), "nsp", "slope", keep("y", 17))


@query("compatible_all_tolerant", f"WITH @rec, @pub, {_LOOSE}, {_LOOSE_PAIRS} SELECT pid, rid FROM pairs")
def compatible_all_tolerant(spark, sf):
    """Pairs where any key may be missing on the recorded side."""
    return M.compatible_pairs(_loose(spark, sf), published(spark, sf), [], _TOLERANT).select("pid", "rid")


@query("match_all_tolerant", f"WITH @rec, @pub, {_LOOSE}, {_LOOSE_PAIRS}, {_MATCH} SELECT pid, n_candidates, source, rid FROM m")
def match_all_tolerant(spark, sf):
    pub = settled(published(spark, sf))  # the match reads it twice
    return M.match_sources(_loose(spark, sf), pub, [], _TOLERANT).select("pid", "n_candidates", "source", "rid")
