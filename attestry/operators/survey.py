"""Coded surveys: screening order, modal record, rubric, agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.scalars import hash32, normalise
from attestry.operators.running import sums_before
from attestry.operators.sampling import hash_rank


def screening_order(df: DataFrame, group: str, path: str, seed: int) -> DataFrame:
    """(group, path, position, k): every entry of each group once, in path order k, the groups at places of a seeded order that does not depend on the input's."""
    entries = df.select(group, path).distinct()
    places = hash_rank(entries.select(group).distinct().withColumn("_all", F.lit(0)), ["_all"], hash32(seed, "repo", F.col(group)), group, "position").select(group, F.col("position").cast("bigint").alias("position"))
    return entries.join(places, group).withColumn("k", F.row_number().over(Window.partitionBy(group).orderBy(path)).cast("bigint"))


def screen_until(df: DataFrame, position: str, included: Column, n: int) -> DataFrame:
    """Rows up to and with the n-th included one; before counts the included ones ahead of each. Positions are unique numbers, or structs of numbers.

    The n-th included row is found first, so that only rows up to it are summed, and those in ranges of the position.
    """
    flagged = df.withColumn("_in", F.coalesce(included.cast("bigint"), F.lit(0)))
    first = flagged.where("_in = 1").orderBy(position).limit(n).agg(F.when(F.count(F.lit(1)) == n, F.max(position)).alias("_last"))
    near = flagged.join(F.broadcast(first)).where(F.col("_last").isNull() | (F.col(position) <= F.col("_last"))).drop("_last")  # one row
    order = [f"{position}.{c}" for c in near.schema[position].dataType.names] if near.schema[position].dataType.typeName() == "struct" else [position]
    held = near.select(*near.columns, *[F.col(c).alias(f"_at{i}") for i, c in enumerate(order)])
    out = sums_before(held, [], [f"_at{i}" for i in range(len(order))], ["_in"]).withColumn("before", F.col("before__in").cast("bigint"))
    return out.select(*df.columns, "before")


def override(df: DataFrame, changes: DataFrame, key: list[str], value: str) -> DataFrame:
    """df with its value column taken from changes (key, value) where those name the row; a change to null makes it null.

    Rows stay as many as they are: of several changes for one key the greatest value counts, null last. Keys with nulls name no row.
    """
    last = changes.groupBy(*key).agg(F.max(value).alias(value))
    told = last.select(*[F.col(k).alias(f"_{k}") for k in key], F.col(value).alias("_value"), F.lit(True).alias("_told"))
    cond = F.lit(True)
    for k in key:
        cond = cond & (F.col(k) == F.col(f"_{k}"))
    return df.join(told, cond, "left").withColumn(value, F.when(F.col("_told"), F.col("_value")).otherwise(F.col(value))).select(*df.columns)


def screen_records(order: DataFrame, records: DataFrame, copies: DataFrame, group: str, path: str, n: int) -> DataFrame:
    """(file, position, k, group, path, decision, criterion, known, before) of records (file, decision) up to the n-th inclusion.

    A file is named position-k; the order says which entry that is, and known whether the record names the same. An inclusion whose file is
    among copies (file, copy_of) is excluded under E4. Records of entries that the order does not hold are left out. Files go by position and k.
    """
    at = F.split("file", "-")
    placed = records.withColumn("position", at[0].cast("bigint")).withColumn("k", at[1].cast("bigint"))
    placed = placed.join(order.select(F.col(group).alias("_g"), F.col(path).alias("_p"), "position", "k"), ["position", "k"])
    copied = placed.join(copies.select("file", F.lit(True).alias("_copy")), "file", "left").withColumn("_copy", F.coalesce("_copy", F.lit(False)) & (F.col("decision") == "include"))
    decided = copied.withColumn("criterion", F.when(F.col("_copy"), "E4")).withColumn("decision", F.when(F.col("_copy"), "exclude").otherwise(F.col("decision")))
    decided = decided.select("file", "position", "k", F.col("_g").alias(group), F.col("_p").alias(path), "decision", "criterion", F.col(path).eqNullSafe(F.col("_p")).alias("known"), F.struct("position", "k").alias("_at"))
    return screen_until(decided, "_at", F.col("decision") == "include", n).drop("_at")


def modal_values(df: DataFrame, fields: list[str], position: str) -> DataFrame:
    """(field, value, n, tied): the most frequent non-null value; of equal ones the first seen."""
    long = df.select(position, *[F.col(f).cast("string").alias(f) for f in fields]).unpivot([position], fields, "field", "value").where("value is not null")
    counts = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    w = Window.partitionBy("field")
    top = counts.withColumn("top", F.max("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), "first")))
    top = top.withColumn("ties", F.sum((F.col("n") == F.col("top")).cast("int")).over(w))
    return top.where("rn = 1").select("field", "value", "n", (F.col("ties") > 1).cast("int").alias("tied"))


def multi_value_modes(df: DataFrame, values: str, top: int = 4) -> DataFrame:
    """(value, n): values held by at least half the rows; if fewer than two are, the most frequent `top` with all that tie with the last of them."""
    rows = df.agg(F.count(F.lit(1)).alias("rows"))
    counts = df.select(F.explode(F.array_distinct(values)).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(rows))
    least = counts.select("n").orderBy(F.desc("n")).limit(top).agg(F.min("n").alias("cut"))
    half = counts.agg(F.count_if(F.col("n") * 2 >= F.col("rows")).alias("halves"))
    told = counts.join(F.broadcast(least)).join(F.broadcast(half))  # one row each
    return told.where(F.when(F.col("halves") >= 2, F.col("n") * 2 >= F.col("rows")).otherwise(F.col("n") >= F.col("cut"))).select("value", "n")


def rubric_violations(df: DataFrame, key: str, rules: dict[str, tuple]) -> DataFrame:
    """(key, field, value) of each value outside its rule; value is null where it is missing.

    Kinds: unit (0 to 1), unit_or_blank, fraction (between 0 and 1, or blank), count (a whole number from 1), one_of, subset (a semicolon list, not
    blank), filled and free.
    """
    checks = []
    for name, (kind, *allowed) in rules.items():
        c = F.col(name)
        blank = c.isNull() | (c.cast("string") == "")
        x = c.try_cast("double")
        good = {
            "unit": lambda x=x: x.between(0, 1), "unit_or_blank": lambda x=x, b=blank: b | x.between(0, 1), "fraction": lambda x=x, b=blank: b | ((x > 0) & (x < 1)), "count": lambda x=x: (x >= 1) & (x == F.floor(x)),
            "one_of": lambda c=c, a=allowed: c.isin(*a), "subset": lambda c=c, a=allowed, b=blank: ~b & (F.size(F.array_except(F.split(c, ";"), F.array(*[F.lit(v) for v in a]))) == 0), "filled": lambda b=blank: ~b, "free": lambda: F.lit(True),
        }[kind]()
        checks.append(F.when(~F.coalesce(good, F.lit(False)), F.struct(F.lit(name).alias("field"), c.cast("string").alias("value"))))
    return df.select(key, F.explode(F.filter(F.array(*checks), lambda v: v.isNotNull())).alias("_x")).select(key, "_x.field", "_x.value")


def agreement(first: DataFrame, second: DataFrame, key: str, fields: list[str], least: int = 80) -> DataFrame:
    """(field, n, agree, pct, low): over rows coded twice, with a row for all fields, named overall.

    Null and blank are alike, numbers with fractions agree to 4 places, semicolon lists as sets in order. pct is rounded half-even, to a whole percent
    for a field and to a tenth overall; low marks fields below the least.
    """
    long = lambda df, v: df.select(key, *[normalise(F.format_string("%.4f", f) if dict(df.dtypes)[f] in ("double", "float") else F.col(f).cast("string")).alias(f) for f in fields]).unpivot([key], fields, "field", v)
    both = long(first, "a").join(long(second, "b"), [key, "field"]).withColumn("same", F.col("a") == F.col("b"))
    each = both.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if("same").alias("agree"), F.bround(100 * F.avg(F.col("same").cast("double")), 0).alias("pct"))
    every = both.agg(F.lit("overall").alias("field"), F.count(F.lit(1)).alias("n"), F.count_if("same").alias("agree"), F.bround(100 * F.avg(F.col("same").cast("double")), 1).alias("pct"))
    return each.unionByName(every).withColumn("low", (F.col("pct") < least).cast("int"))


def summarise(df: DataFrame, fields: list[str], multi: str, accuracy: str, position: str) -> DataFrame:
    """(part, field, value): one report of modal values, their shares k/n, ties, model counts and the accuracy's summary."""
    modal = modal_values(df, fields, position)
    filled = df.agg(*[F.count(f).alias(f) for f in fields]).unpivot([], fields, "field", "of")
    shares = modal.join(filled, "field")
    row = lambda d, part, field, value: d.select(F.lit(part).alias("part"), field.alias("field"), value.cast("string").alias("value"))
    lists = df.select(F.split(multi, ";").alias("v"))
    counts = lists.select(F.explode(F.array_distinct("v")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    q = [F.round(F.percentile(accuracy, F.lit(p)), 4) for p in (0.5, 0.25, 0.75)]
    told = df.agg(F.count(accuracy).cast("double").alias("n"), q[0].alias("median"), q[1].alias("q1"), q[2].alias("q3"), F.round(F.min(accuracy), 4).alias("min"), F.round(F.max(accuracy), 4).alias("max"))
    told = told.unpivot([], ["n", "median", "q1", "q3", "min", "max"], "field", "value")
    parts = [
        row(shares, "modal", F.col("field"), F.col("value")), row(shares, "share", F.col("field"), F.concat(F.col("n").cast("string"), F.lit("/"), F.col("of").cast("string"))), row(shares.where("tied = 1"), "tie", F.col("field"), F.lit("")),
        row(counts, "count", F.col("v"), F.col("n")), row(multi_value_modes(lists, "v"), "modal_model", F.col("value"), F.col("n")), row(told, "accuracy", F.col("field"), F.format_string("%.4f", "value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def differing_fields(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.alias("a").join(b.alias("b"), key).where(~F.col("a.value").eqNullSafe(F.col("b.value"))).select(key, F.col("a.value").alias("first"), F.col("b.value").alias("second"))
