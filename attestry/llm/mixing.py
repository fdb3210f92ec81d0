"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Golden-ratio points, one per slot, go through the cumulative slot weights of the sources; slots are ranked within
their source; slot r of a source takes block r modulo the source's blocks, where the source's texts lie end to end
in a hash-shuffled order and are cut into blocks of equal size. Every step is an equi-join or a two-level running
sum, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import WORD, write_table

WEIGHTS = (5.0, 2.0, 1.0)
#: No source gives more than so many times its own words.
MOST_PASSES = 3
#: Words in a block: a source's total is off its target by about two blocks.
BLOCK_WORDS = 16
#: The fractional part of the golden ratio in units of 2^-32; odd, so 2^32 slots have distinct points.
GOLDEN = 2654435769
_FULL = 1 << 32
#: Cells that the unit interval is cut into for the equi-join of points with weights.
CELLS = 4096
#: Rows of a source that share one running sum.
RUN_ROWS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, target) for a frame (source, size).

    Sources, in code point order with null last, get the weights in turn and share all words. A target never passes
    most times the source's own size; the excess goes to the others by weight. In closed form: the target is
    least(cap, level * weight), and the level follows from running sums of caps and weights by cap over weight.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weighed = total.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))).withColumn("cap", (F.col("source_size") * most).cast("double"))
    full = Window.partitionBy()
    rise = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = rise.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        weighed.withColumn("all_words", F.sum("source_size").over(full).cast("double"))
        .withColumn("level", (F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(full) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
        .withColumn("first", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("source").isNull().alias("x"), "source", "level"))).over(full))
        .withColumn("level", F.col("first.level"))
    )
    return level.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def _running(df: DataFrame, key: str, chunk: str, order: list, value: Column, out: str) -> DataFrame:
    """Exclusive running sum of value within key, by chunk and then by order: sums of chunks first, then inside each."""
    sums = df.groupBy(key, chunk).agg(F.sum(value).alias("_s"))
    ahead = Window.partitionBy(key).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, chunk, F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(key, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(offsets, [key, chunk]).withColumn(out, (F.col("_in") + F.col("_o")).cast("bigint")).drop("_in", "_o")


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS, most: int = MOST_PASSES) -> DataFrame:
    """(sid, block, passes) for sources (sid, source_size, target): how often each block of a source is taken.

    Slot i has the golden-ratio point of i; the source whose cumulative slot weight covers it takes it. A source
    with no words takes no slot. Slots beyond most passes over a source's blocks, which rounding may bring, are void.
    """
    spark = sources.sparkSession
    cut = (
        sources.where("source_size > 0 and target > 0")
        .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block_words)))
        .withColumn("slots", F.col("target") * F.col("blocks") / F.col("source_size"))
    )
    order = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)
    edges = cut.withColumn("_to", F.sum("slots").over(order)).withColumn("_all", F.sum("slots").over(Window.partitionBy()))
    spans = write_table(
        edges.select(
            "sid", "blocks", F.round("_all").cast("bigint").alias("n"),
            F.round((F.col("_to") - F.col("slots")) / F.col("_all") * _FULL).cast("bigint").alias("lo"), F.round(F.col("_to") / F.col("_all") * _FULL).cast("bigint").alias("hi"),
        )
    )
    n = spans.agg(F.max("n")).first()[0] or 0
    width = _FULL // CELLS
    by_cell = spans.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    run = 1 << max(6, (n.bit_length() + 1) // 2)
    point = F.pmod(F.pmod(F.col("id"), F.lit(_FULL)) * F.lit(GOLDEN), F.lit(_FULL))
    slots = spark.range(n).select("id", point.alias("u"), F.expr(f"id div {run}").alias("chunk")).withColumn("cell", F.floor(F.col("u") / width))
    taken = slots.join(by_cell, "cell").where("u >= lo and u < hi").select("sid", "chunk", "id", "blocks")
    ranked = _running(taken, "sid", "chunk", ["id"], F.lit(1), "rank").where(F.col("rank") < F.col("blocks") * most)
    return ranked.groupBy("sid", F.expr("rank % blocks").alias("block")).agg(F.count(F.lit(1)).alias("passes"))


def mix_sources(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_PASSES, keep: str | None = None) -> DataFrame:
    """(id, size, source_size, target, taken) for every row: the words it has and the words the mix takes of it.

    Null texts and texts without words have size 0 and are never taken. Null sources are one source. Rows that
    repeat an id count each. The shuffle orders a source's texts by a hash of id, size and text, so reruns agree.
    keep names a column that is carried along.
    """
    own = F.col(keep) if keep else F.lit(None).cast("bigint")
    sized = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(id_col, text_col).alias("h"), own.alias("own"))
    sized = write_table(sized)
    sources = source_targets(sized.select("source", "size"), weights, most)
    totals = sized.groupBy(F.col("source").alias("s2")).agg(F.count(F.lit(1)).alias("rows"))
    sources = write_table(
        sources.join(totals, F.col("source").eqNullSafe(F.col("s2"))).select(
            "source", "source_size", "target", F.ceil(F.col("rows") / RUN_ROWS).alias("runs"), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).alias("sid")
        )
    )
    plan = schedule(sources.select("sid", "source_size", "target"), block_words, most)
    known = sized.join(sources.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2", "source")
    chunk = F.floor(F.pmod("h", F.lit(1 << 20)) * F.col("runs") / F.lit(1 << 20))
    laid = _running(known.withColumn("chunk", chunk), "sid", "chunk", ["h", "id", "size"], F.col("size"), "start")
    laid = write_table(laid.select("id", "own", "size", "source_size", "target", "sid", "start"))
    pieces = laid.where("size > 0").select("sid", "start", (F.col("start") + F.col("size")).alias("stop")).withColumn(
        "block", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(stop - 1) div {block_words}")))
    )
    words = F.least("stop", (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words)
    # A row a block: few bytes when shuffled, many in a broadcast, so it is never sent through the driver.
    got = pieces.join(plan.hint("merge"), ["sid", "block"]).groupBy("sid", "start").agg(F.sum(words * F.col("passes")).cast("bigint").alias("taken"))
    with_words = laid.where("size > 0").join(got, ["sid", "start"], "left")
    none = laid.where("size = 0").withColumn("taken", F.lit(0).cast("bigint"))
    columns = [F.col("id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), *([F.col("own").alias(keep)] if keep else [])]
    return with_words.select(*columns).unionByName(none.select(*columns))


def apply_mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of df as the mix takes them: each as often as its taken words make whole texts, to the nearest.

    Texts without words, null ones too, are not part of a mix of words and go. Rows that repeat an id, or are equal, are
    taken each for itself; rows without an id are rows like others. Columns stay as they are.
    """
    # Row numbers are fixed by writing them; the mix itself goes by hashes of id and text.
    held = write_table(df.select(F.struct(*df.columns).alias("row"), F.monotonically_increasing_id().alias("at")))
    slim = held.select(F.col("row")[id_col].alias("id"), F.col("row")[text_col].alias("text"), F.col("row")[source_col].alias("source"), "at")
    times = F.round(F.col("taken") / F.nullif(F.col("size"), F.lit(0))).cast("int").alias("n")
    taken = mix_sources(slim, "id", "text", "source", keep="at").select("at", times).where("n > 0")
    return held.join(taken, "at").select("row", F.explode(F.sequence(F.lit(1), "n"))).select("row.*")
