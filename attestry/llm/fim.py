"""Fill-in-the-middle transformation: texts are cut at line ends into prefix, middle and suffix and put together in another order.

A Split pre-tokenizer with isolated matches of the unit pattern gives the code-point offsets of the units; nothing is trained.
Two hashes of the row's id, ranked, pick the units where the prefix and the middle end, and their offsets give the slices.
All else is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import text_of

#: A unit is a line with its end, or what follows the last end.
UNIT = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of 100 texts, so many are transformed, and so many of those have the suffix first.
RATE, SUFFIX_FIRST = 100, 50


def unit_ends(text: Column, pattern: str = UNIT) -> Column:
    """The code-point offsets where the units of a text end, in order; the empty text has none."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        cut = Split(Regex(pattern), "isolated").pre_tokenize_str
        for batch in batches:
            yield pa.array([[end for _, (_, end) in cut(text)] for text in batch.to_pylist()], pa.list_(pa.int32()))

    return run(text)


def id_hashes(key: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers: the first groups of eight hex digits of the sha256 of seed:key. A null key counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """(id, text, n, form, prefix_chars, middle_chars, output) for every row; the other columns go.

    n is the number of units. The form is plain, and the output the text itself, for empty texts, for those that hold one of the marks, and
    for those that the rate leaves out; else it is psm (prefix, suffix, middle) or spm (suffix, prefix, middle), and the characters of prefix
    and middle are told. A null text counts as empty, a null id as the empty string. The cut depends on seed, id and the text's units only: equal
    rows have equal outputs and stay as many, reruns agree. Texts are never shortened; an empty table gives an empty one.
    """
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    units = rows.select("id", "text", unit_ends(F.col("text")).alias("ends"), *[h.alias(f"h{i}") for i, h in enumerate(id_hashes(F.col("id"), seed))])
    n = F.size("ends").cast("bigint")
    first, second = F.col("h0") % (n + 1), F.col("h1") % (n + 1)
    at = lambda k: F.coalesce(F.get("ends", (k - 1).cast("int")), F.lit(0))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((n == 0) | marked | (F.col("h2") % 100 >= rate), "plain").when(F.col("h3") % 100 < suffix_first, "spm").otherwise("psm")
    cut = units.select("id", "text", n.alias("n"), form.alias("form"), at(F.least(first, second)).alias("p"), at(F.greatest(first, second)).alias("m"))
    text, p, m = F.col("text"), F.col("p"), F.col("m")
    prefix, middle, suffix = F.substring(text, F.lit(1), p), F.substring(text, p + 1, m - p), F.substring(text, m + 1, F.length(text) - m)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    told = lambda x: F.when(F.col("form") != "plain", x.cast("bigint"))
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(text)
    return cut.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n", "form", told(p).alias("prefix_chars"), told(m - p).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text of an output: cut at the marks, which a transformed text cannot hold itself, its parts go back to their order."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def fim_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256) of fill_in_middle for every row."""
    made = fill_in_middle(df, id_col, text_col)
    digest = lambda x: F.sha2(F.encode(x, "UTF-8"), 256)
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
