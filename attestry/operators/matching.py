"""Row provenance: null-tolerant matching, mutual pairing, recovered cells, reversal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.sources.readers import settled

CELLS = ("nsp", "slope")


def _masked(df: DataFrame, tolerant: list[str]) -> DataFrame:
    """Adds _mask: bit i is 1 where the row holds tolerant key i."""
    bits = [F.when(F.col(k).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, k in enumerate(tolerant)]
    return df.withColumn("_mask", sum(bits[1:], bits[0]) if bits else F.lit(0))


def compatible_pairs(rec: DataFrame, pub: DataFrame, equal: list[str], tolerant: list[str], masks: list[int] | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """Pairs that agree on the equal keys, which neither side may lack, and on each tolerant key unless the recorded side lacks it.

    One equi-join, whichever keys are missing: recorded rows are told apart by the mask of tolerant keys that they hold, a published row is
    repeated for each mask that occurs, and both sides meet on the mask and the keys it holds. A recorded row that holds no key at all fits every
    published row; such rows are left out here, and match_sources counts them. masks names the masks that occur, where they are known,
    and more recorded columns that the pairs get besides.
    """
    masked = _masked(rec, tolerant)
    if masks is None:
        masks = sorted(r[0] for r in masked.select("_mask").distinct().collect())  # as many as patterns of missing keys
    masks = [m for m in masks if m or equal]
    if not masks:
        return rec.join(pub.limit(0), F.lit(False)).select(pub["pid"], rec["rid"], rec["site"].alias("site"), rec["slope"].alias("rec_slope"), pub["slope"].alias("pub_slope"), rec["y"].alias("rec_y"), pub["y"].alias("pub_y"), *[rec[c] for c in more])
    left = masked.where(F.col("_mask").isin(masks)).select(
        F.col("_mask").alias("r_mask"), *[F.col(k).alias(f"r_e{i}") for i, k in enumerate(equal)], *[F.col(k).alias(f"r_t{i}") for i, k in enumerate(tolerant)], "rid", "site", F.col("slope").alias("rec_slope"), F.col("y").alias("rec_y"), *more
    )
    right = pub.select("*", F.explode(F.array(*[F.lit(m) for m in masks])).alias("p_mask"))
    right = right.select(
        "p_mask", *[F.col(k).alias(f"p_e{i}") for i, k in enumerate(equal)], *[F.when(F.col("p_mask").bitwiseAND(F.lit(1 << i)) > 0, F.col(k)).alias(f"p_t{i}") for i, k in enumerate(tolerant)],
        "pid", F.col("slope").alias("pub_slope"), F.col("y").alias("pub_y"), sum([F.when((F.col("p_mask").bitwiseAND(F.lit(1 << i)) > 0) & F.col(k).isNull(), 1).otherwise(0) for i, k in enumerate(tolerant)], F.lit(0)).alias("_lost"),
    ).where("_lost = 0")  # fmt: skip  a published row that lacks a key of the mask fits none of its rows
    cond = F.col("r_mask") == F.col("p_mask")
    for i in range(len(equal)):
        cond = cond & (F.col(f"r_e{i}") == F.col(f"p_e{i}"))
    for i in range(len(tolerant)):
        cond = cond & F.col(f"r_t{i}").eqNullSafe(F.col(f"p_t{i}"))
    return right.join(left, cond).select("pid", "rid", "site", "rec_slope", "pub_slope", "rec_y", "pub_y", *more)


def _alike(rec: DataFrame, keys: list[str]) -> DataFrame:
    """One row for all recorded rows of equal keys, with their number _n and the first and last site, _lo and _hi. Rows whose id comes again go by id too.

    _sole: all its rows have one id, which is rid. In other rows rid is the id of no other row, and so are the values that are not keys one of several.
    """
    again = F.count(F.lit(1)).over(Window.partitionBy("rid")) > 1
    rows = rec.withColumn("_again", again).groupBy(*keys, "_again", F.when(F.col("_again"), F.col("rid")).alias("_own"))
    some = [F.max(c).alias(c) for c in ("rid", "site", "slope", "y") if c not in keys]
    out = rows.agg(F.count(F.lit(1)).alias("_n"), F.min("site").alias("_lo"), F.max("site").alias("_hi"), *some)
    return out.withColumn("_sole", F.col("_again") | (F.col("_n") == 1)).drop("_again", "_own")


def match_sources(rec: DataFrame, pub: DataFrame, equal: list[str], tolerant: list[str]) -> DataFrame:
    """(pid, n_candidates, source, rid, slopes): source if all candidates agree, rid only if the pair is each other's only one.

    Recorded rows without any key are candidates of every published row: they are counted, not joined. With more than one published row they pair with none.
    Recorded rows of equal keys fit the same published rows, so they are joined as one. The published frame is read twice: where it is dear to make, it should come settled.
    """
    rec = settled(_alike(rec, list(dict.fromkeys([*equal, *tolerant]))))
    kinds = {}
    if not equal:  # rows without any key, and the masks, in one pass: as many rows as patterns of missing keys
        kinds = {r["_mask"]: r for r in _masked(rec, tolerant).groupBy("_mask").agg(F.sum("_n").alias("n"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi")).collect()}
    pairs = compatible_pairs(rec, pub, equal, tolerant, None if equal else sorted(kinds), ("_n", "_lo", "_hi", "_sole"))
    # How many pairs the id has. Rows of several ids are no one's only candidate; they are dealt by pid too, as no count of theirs is needed.
    per_r = Window.partitionBy("rid", F.when(~F.col("_sole"), F.col("pid")))
    told = pairs.withColumn("nr", F.sum("_n").over(per_r)).groupBy("pid").agg(
        F.sum("_n").alias("n_candidates"), F.min("_lo").alias("lo"), F.max("_hi").alias("hi"), *[F.max(F.when(F.col("nr") == 1, F.col(c))).alias(c) for c in ("rid", "rec_slope", "rec_y")]
    )
    told = told.withColumns({c: F.when(F.col("n_candidates") == 1, F.col(c)) for c in ("rid", "rec_slope", "rec_y")})
    base = pub.select("pid", F.col("slope").alias("pub_slope"), F.col("y").alias("pub_y")).join(told, "pid", "left")
    if bare := kinds.get(0):
        base = base.withColumns({"n_candidates": F.coalesce("n_candidates", F.lit(0)) + F.lit(bare["n"]), "lo": F.least("lo", F.lit(bare["lo"])), "hi": F.greatest("hi", F.lit(bare["hi"]))})
        base = base.withColumns({c: F.when(F.lit(False), F.col(c)) for c in ("rid", "rec_slope", "rec_y")})
    return base.select("pid", F.coalesce("n_candidates", F.lit(0)).cast("bigint").alias("n_candidates"), F.coalesce(F.when(F.col("lo") == F.col("hi"), F.col("lo")), F.lit("unknown")).alias("source"), "rid", "rec_slope", "pub_slope", "rec_y", "pub_y")


def filled_cells(rec: DataFrame, pub: DataFrame, matches: DataFrame, columns: tuple[str, ...] = CELLS) -> DataFrame:
    """(pid, column, value, source): cells of paired rows that the recorded side lacks."""
    long = lambda df, key, value: df.select(key, *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(key, list(columns), "column", value)
    pairs = matches.where("rid is not null").select("pid", "rid", "source")
    return pairs.join(long(pub, "pid", "value"), "pid").join(long(rec, "rid", "was"), ["rid", "column"]).where("was is null").select("pid", "column", "value", "source")


def revert(pub: DataFrame, cells: DataFrame, columns: tuple[str, ...] = CELLS) -> DataFrame:
    """The published frame with its filled cells null again."""
    flags = cells.groupBy("pid").agg(F.collect_set("column").alias("cols"))
    back = lambda c: F.when(~F.coalesce(F.array_contains("cols", c), F.lit(False)), F.col(c)).alias(c)
    return pub.join(flags, "pid", "left").select(*[back(c) if c in columns else c for c in pub.columns])


def fill_table(pub: DataFrame, matches: DataFrame, cells: DataFrame, columns: tuple[str, ...] = CELLS) -> DataFrame:
    """By column and source: filled and observed cells and the target's rate in each."""
    names = F.explode(F.array(*[F.lit(c) for c in columns])).alias("column")
    every = matches.where("rid is not null").select("pid", "source", F.col("pub_y").alias("y"), names)
    flagged = every.join(cells.select("pid", "column", F.lit(True).alias("filled")), ["pid", "column"], "left")
    filled = F.coalesce("filled", F.lit(False))
    return flagged.groupBy("column", "source").agg(
        F.count_if(filled).alias("n_filled"), F.round(F.avg(F.when(filled, F.col("y").cast("double"))), 9).alias("rate_filled"),
        F.count_if(~filled).alias("n_observed"), F.round(F.avg(F.when(~filled, F.col("y").cast("double"))), 9).alias("rate_observed"),
    ).where("n_filled > 0")


def left_merge_flag(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left merge on null-safe keys with a deduplicated right side, and whether it was found there."""
    r = right.select(*[F.col(k).alias(f"_{k}") for k in keys]).dropDuplicates().withColumn("_flag", F.lit(True))
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(r, cond, "left").withColumn("merge", F.when(F.col("_flag"), "both").otherwise("left_only")).drop("_flag", *[f"_{k}" for k in keys])
