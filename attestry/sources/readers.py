"""Sources: explicit schemas, declared null tokens, digest gates, nested JSON. Nothing is inferred."""

from __future__ import annotations

import hashlib
import os
import tempfile
import urllib.request
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = "rid bigint, site string, nsp double, slope double"


class DigestMismatch(ValueError):
    """A file is not the one that was pinned."""


@dataclass(frozen=True)
class Pin:
    """A raw file: its name, where it can be fetched, and the digest it has to have."""

    file: str
    urls: tuple[str, ...]
    algorithm: str
    digest: str


def pins_frame(spark: SparkSession, pins: Iterable[Pin]) -> DataFrame:
    """(file, algorithm, digest) of the registry."""
    return spark.createDataFrame([(p.file, p.algorithm, p.digest) for p in pins], "file string, algorithm string, digest string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, or where that is unset and the session is local, under a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="attestry-")
    return f"{base.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read back, for what several steps use."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as recorded: site, group, two measurements with missing cells, and the target."""
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    spaces = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    return d.join(l, "doc_id").select(
        F.col("doc_id").alias("rid"), F.col("lang").alias("site"), F.col("source").alias("grp"), "n_chars",
        F.when(F.col("doc_id") % 7 != 0, spaces).cast("bigint").alias("nsp"), F.when(F.col("doc_id") % 3 != 0, F.col("n_chars") % 3).cast("int").alias("slope"), F.col("quality").alias("y"),
    )


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows after their missing cells were silently filled from the target."""
    r = recorded(spark, sf_dir)
    return r.select(F.col("rid").alias("pid"), "site", "grp", "n_chars", F.coalesce("nsp", F.col("y") * 100).cast("bigint").alias("nsp"), F.coalesce("slope", "y").cast("int").alias("slope"), "y")


def read_csv(spark: SparkSession, path, schema: str, null: str = "", header: bool = False, **literals) -> DataFrame:
    """Headered or headerless CSV whose null token alone is null; literals become columns."""
    df = spark.read.csv(path, schema=schema, header=header, nullValue=null, emptyValue="\u0000" if null else "", mode="FAILFAST")
    return df.withColumns({k: F.lit(v) for k, v in literals.items()}) if literals else df


def read_sites(spark: SparkSession, paths: dict[str, str], schema: str, null: str = "?") -> DataFrame:
    """One headerless file per site, united under the site's name."""
    frames = [read_csv(spark, p, schema, null, source=site) for site, p in sorted(paths.items())]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def read_whitespace(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table whose fields are separated by runs of white space; blank lines are skipped, malformed numbers are null."""
    fields = T.StructType.fromDDL(schema).fields
    cells = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(*[F.try_element_at(cells, F.lit(i + 1)).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])


def read_json_records(spark: SparkSession, path, schema: str, suffix: str = ".txt") -> DataFrame:
    """JSON arrays of records from many files, without the suffix of their file field, in its order."""
    df = spark.read.json(path, schema=schema, multiLine=True)
    return df.withColumn("file", F.regexp_replace("file", f"{suffix.replace('.', chr(92) + '.')}$", "")).orderBy("file") if "file" in df.columns else df


def read_items(spark: SparkSession, path: str, item: str) -> DataFrame:
    """One row per element of the object's items array."""
    return spark.read.json(path, schema=f"items array<struct<{item}>>", multiLine=True).select(F.explode("items").alias("item")).select("item.*")


NOTEBOOK = "cells array<struct<cell_type:string,source:array<string>,outputs:array<struct<text:array<string>>>>>"


def flatten_notebooks(df: DataFrame, content: str = "content", limit: int = 3000) -> DataFrame:
    """Adds flat: each cell as a numbered heading with its source, and its outputs cut to the limit (a report format)."""
    cells = F.from_json(content, NOTEBOOK)["cells"]
    part = lambda c, i: F.concat(
        F.lit("### ["), i.cast("string"), F.lit("] "), c["cell_type"], F.lit("\n"), F.coalesce(F.array_join(c["source"], ""), F.lit("")),
        F.when(F.size(c["outputs"]) > 0, F.concat(F.lit("\n"), F.substring(F.array_join(F.flatten(F.transform(c["outputs"], lambda o: F.coalesce(o["text"], F.array().cast("array<string>")))), ""), 1, limit))).otherwise(""),
    )
    return df.withColumn("flat", F.array_join(F.transform(cells, part), "\n"))


def file_digests(spark: SparkSession, path) -> DataFrame:
    """(file, sha256, md5, bytes) of whole files."""
    df = spark.read.format("binaryFile").load(path)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"), F.col("length").alias("bytes"))


def verify_digests(found: DataFrame, pins: DataFrame) -> None:
    """Raises unless every pinned (file, algorithm, digest) is there and equal; algorithms are sha256 and md5."""
    had = F.when(F.col("p.algorithm") == "md5", F.col("f.md5")).when(F.col("p.algorithm") == "sha256", F.col("f.sha256"))
    wrong = pins.alias("p").join(found.alias("f"), "file", "left").where(~had.eqNullSafe(F.col("p.digest"))).select("file").limit(5).collect()
    if wrong:
        raise DigestMismatch(", ".join(r.file for r in wrong))


def _download(url: str, dest: Path, timeout: int = 60) -> None:
    with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "attestry"}), timeout=timeout) as got, dest.open("wb") as out:
        while block := got.read(1 << 20):
            out.write(block)


def fetch_first_valid(urls: Iterable[str], dest: Path, algorithm: str, digest: str, get: Callable[[str, Path], None] = _download) -> Path:
    """The first mirror whose bytes have the digest, put in place in one step; an existing file is only verified."""
    check = lambda p: hashlib.new(algorithm, p.read_bytes()).hexdigest() == digest
    if dest.exists():
        if not check(dest):
            raise DigestMismatch(dest.name)
        return dest
    dest.parent.mkdir(parents=True, exist_ok=True)
    part, last = dest.with_suffix(dest.suffix + ".part"), None
    for url in urls:
        try:
            get(url, part)
            if not check(part):
                raise DigestMismatch(url)
            os.replace(part, dest)
            return dest
        except Exception as error:  # noqa: BLE001  the next mirror may do
            last = error
        finally:
            part.unlink(missing_ok=True)
    raise last or DigestMismatch("no mirror")


def fetch_all(pins: Iterable[Pin], folder: Path, get: Callable[[str, Path], None] = _download) -> dict[str, Path]:
    """Every pinned file in the folder, fetched where it is missing and then verified; one that is there and differs raises and stays."""
    return {p.file: fetch_first_valid(p.urls, Path(folder) / p.file, p.algorithm, p.digest, get) for p in pins}


def read_pages(page: Callable[[int], list[dict]], pages: int = 10, size: int = 100, pause: Callable[[], None] = lambda: None) -> list[dict]:
    """The items of a paged source, from page 1 until a short page or the last one; pause runs between pages."""
    items: list[dict] = []
    for n in range(1, pages + 1):
        if n > 1:
            pause()
        got = page(n)
        items += got
        if len(got) < size:
            break
    return items


def fetch_notebooks(entries: Iterable[dict], get: Callable[[str], str], first: int, last: int) -> list[dict]:
    """(file, content, error) for the entries whose position is in the range; paths are quoted, failures recorded."""
    out = []
    for e in entries:
        if first <= e["position"] <= last:
            row = {"file": f"{e['position']:03d}-{e['k']}", "content": None, "error": None}
            try:
                row["content"] = get(f"{e['repo']}/contents/{quote(e['path'])}")
            except Exception as error:  # noqa: BLE001  recorded, as one failure should not end the run
                row["error"] = str(error)
            out.append(row)
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_predictions(df: DataFrame, path: str) -> None:
    """(seed, model, row_id, y, predicted) in long form, labels as single bytes: the bundle of a run's arrays."""
    df.select("seed", "model", "row_id", F.col("y").cast("tinyint").alias("y"), F.col("predicted").cast("tinyint").alias("predicted")).write.partitionBy("model").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("seed bigint, row_id bigint, y tinyint, predicted tinyint, model string").parquet(path)


def write_texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """The texts under a folder for each name, so that every text is in files of its own."""
    df.select(F.col(name).alias("name"), F.col(text).alias("value")).write.partitionBy("name").text(path)


def console_table(df: DataFrame, rows: int = 20) -> str:
    """The first rows as the table that show prints."""
    return df._jdf.showString(rows, 20, False)
