"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The white space that separates words: space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where it is unset: a temporary one in local mode, an error on a cluster."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="attestry-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def write_table(df: DataFrame, partition_by: list[str] | None = None, spark_schema=None) -> DataFrame:
    """Writes the frame to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/attestry-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._attestry_path = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Deletes a table made by write_table once nothing reads it any more."""
    path = getattr(df, "_attestry_path", None)
    if path is None:
        return
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


#: Stand-ins of rows without an id are at least this; ids are below it.
NO_ID = 1 << 62
#: A key with more than this share of all rows is joined by broadcast; there can be fewer than so many of them.
HOT = 1024


def join_told(rows: DataFrame, told: DataFrame, key: str, times: str) -> DataFrame:
    """Inner join of rows with one told row a key, which says how many rows hold the key; the column times goes.

    Keys that hold a large share of all rows, of which there are fewer than HOT, are sent to every task, so that no
    task gets all rows of one key; all other keys are shuffled.
    """
    total = F.broadcast(told.agg(F.sum(times).alias("_all")))  # one row
    hot = told.join(total).where(F.col(times) * HOT > F.col("_all")).drop("_all", times)
    cold = told.join(total).where(F.col(times) * HOT <= F.col("_all")).drop("_all", times)
    frequent = rows.join(F.broadcast(hot), key)
    return frequent.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


#: Parts that the rows of every key are dealt into where a key may be hot and its told row is narrow.
PARTS = 16


def join_dealt(rows: DataFrame, told: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Join of rows with one narrow told row a key: the rows of a key are dealt into PARTS by a hash of a column, and the told row goes to each."""
    left = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)).cast("int"))
    right = told.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    # Merged, as the told rows are many although each is narrow.
    return left.join(right.hint("merge"), [key, "_part"], how).drop("_part")


def hash_sample(df: DataFrame, by: list[str], number: int, rows: int | None = None) -> DataFrame:
    """About number rows of df, by the hash of some columns: the same rows at every partitioning, chosen where they lie.

    All rows where there are no more than number of them. rows is df's number of rows, counted if not given.
    """
    total = df.count() if rows is None else rows
    share = 1 << 31
    return df if total <= number else df.where(F.pmod(F.xxhash64(*by), F.lit(share)) < int(number / total * share))


def text_of(column: str = "text"):
    """A null text counts as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node of (u, v), u above v and no edge twice, is either above one other node or below others."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("x")).select("x.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for an edge list (a, b) of bigints: component is the smallest node reachable.

    Large stars and small stars in turn: every node hands its larger neighbours, and then its smaller ones, to the
    smallest node beside it. That leaves ever fewer edges and ends in one star a component. Each round is a written
    table; nothing reaches the driver but whether all are stars. An empty edge list gives an empty result; loops and
    repeated edges are harmless. A round reads its table once and has no joins, and none is made once all are stars:
    each exchange and each broadcast holds a thread of the driver for a minute, and megabytes of its memory, however
    small the tables are.
    """
    beside = Window.partitionBy("u")
    stars = write_table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while not _all_stars(stars):
        both = stars.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        least = both.withColumn("m", F.least("u", F.min("v").over(beside)))
        larger = least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Every node of larger is above what it holds to, so a small star is a node, the least beside it, and the others.
        smallest = larger.withColumn("m", F.min("v").over(beside))
        fresh = write_table(smallest.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())
        drop_table(stars)
        stars = fresh
    ends = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out = write_table(ends.unionByName(ends.select(F.col("component").alias("node"), "component").distinct()))
    drop_table(stars)
    return out
