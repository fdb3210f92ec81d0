"""Cross-tokenizer alignment: where the tokens of two tokenizers end at the same byte of a text.

Each text is encoded by both in mapInPandas. A two-pointer merge of the cumulative token ends finds the bytes where a token of either ends: they cut both
sequences into groups, and the two tokens that end there are linked. A text leaves its counts, the digest of its groups and
its distinct linked pairs with their number. Spark counts the pairs over all texts, finds the highest count of each token of either side, and joins both back.

Of two linked tokens the shorter is the end of the longer, so the vocabularies bound how many pairs there can be, whatever the texts are
(PAIRS_SENT says up to which bound the counts are sent to all tasks; beyond it they are joined by key).
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import drop_table, join_told, text_of, write_table

BYTE_MODEL = os.environ.get("BYTE_MODEL", "/opt/tokenizers/byte_bpe_50k.json")
PIECE_MODEL = os.environ.get("PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
# Fixed value: how the byte-level vocabulary cuts texts into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"
#: Pairs that may be sent to all tasks, 24 bytes each.
PAIRS_SENT = 4_000_000
#: Texts whose rows are held at a time.
_TEXTS = 256


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level entry stands for: printable bytes stand for themselves, the others for the letters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteSide:
    """Ids and token bytes of a byte-level BPE file. Its ranks are its ids, so its entries alone say how words are merged; special entries are no tokens."""

    def __init__(self, path: str = BYTE_MODEL):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        special = {x["content"] for x in told.get("added_tokens", [])}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in entry): i for entry, i in told["model"]["vocab"].items() if entry not in special}
        model = tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})
        self.encode, self.join = model.encode_ordinary, model.decode_bytes
        self.bytes = [b""] * (max(ranks.values()) + 1)
        for raw, i in ranks.items():
            self.bytes[i] = raw


class PieceSide:
    """Ids and token bytes of a SentencePiece file, which puts a space before the text."""

    def __init__(self, path: str = PIECE_MODEL):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self._encode = model.encode
        piece = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        none = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(len(piece))]
        self.bytes = [b"" if none[i] else bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(piece)]

    def encode(self, text: str) -> list[int]:
        return self._encode(text[1:], num_threads=1)

    def join(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def sides(byte_path: str = BYTE_MODEL, piece_path: str = PIECE_MODEL) -> tuple[ByteSide, PieceSide]:
    return ByteSide(byte_path), PieceSide(piece_path)


def pair_bound(left: list[bytes], right: list[bytes]) -> int:
    """How many pairs of entries can end together: those of which one is the end of the other."""
    many: list[dict[bytes, int]] = [{}, {}]
    for side, held in zip((left, right), many, strict=True):
        for raw in side:
            if raw:
                held[raw] = held.get(raw, 0) + 1
    whole = sum(n * many[1].get(raw[i:], 0) for raw, n in many[0].items() for i in range(len(raw)))
    return whole + sum(n * many[0].get(raw[i:], 0) for raw, n in many[1].items() for i in range(1, len(raw)))


def common_ends(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """The positions of the values that two rising lists share, in each of them: one walk through both."""
    i, j, n, m = 0, 0, len(a), len(b)
    at_a, at_b = [], []
    while i < n and j < m:
        x, y = a[i], b[j]
        if x == y:
            at_a.append(i)
            at_b.append(j)
            i += 1
            j += 1
        elif x < y:
            i += 1
        else:
            j += 1
    return at_a, at_b


class _Named(dict):
    """The group of one A and one B token as text, by its link; forgets all when it holds too many."""

    def __missing__(self, link: int) -> str:
        if len(self) > 500_000:
            self.clear()
        out = self[link] = f"{link >> 32}|{link & 0xFFFFFFFF}"
        return out


class Aligner:
    """Groups and links of one text after another."""

    def __init__(self, left: ByteSide, right: PieceSide):
        self.left, self.right = left, right
        self.size_a, self.size_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (left, right))
        self.names, self.pairs = [str(i) for i in range(max(len(left.bytes), len(right.bytes)))], _Named()

    def __call__(self, text: str) -> tuple[list[int], list[int], np.ndarray, np.ndarray, np.ndarray]:
        """(A ids, B ids, positions of the last token of each group in A, in B, links as A id * 2^32 + B id); all empty if a side does not give the bytes of the text back."""
        none = np.zeros(0, np.int64)
        if not text:
            return [], [], none, none, none
        spaced = " " + text
        raw = spaced.encode("utf-8", "surrogatepass")
        a, b = self.left.encode(spaced), self.right.encode(spaced)
        if self.left.join(a) != raw or self.right.join(b) != raw:
            return [], [], none, none, none
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        at_a, at_b = (np.array(x, np.int64) for x in common_ends(self.size_a[ids_a].cumsum().tolist(), self.size_b[ids_b].cumsum().tolist()))
        return a, b, at_a, at_b, ids_a[at_a] << 32 | ids_b[at_b]

    def groups(self, a: list[int], b: list[int], at_a: np.ndarray, at_b: np.ndarray, links: np.ndarray) -> str:
        """The groups in order as a1,a2|b1;a3|b2,b3."""
        out = list(map(self.pairs.__getitem__, links.tolist()))
        first_a, first_b = np.append(0, at_a[:-1] + 1), np.append(0, at_b[:-1] + 1)
        name, more = self.names.__getitem__, np.flatnonzero((first_a < at_a) | (first_b < at_b))  # groups of more than a token on a side
        for g, i, p, j, q in zip(more.tolist(), first_a[more].tolist(), (at_a[more] + 1).tolist(), first_b[more].tolist(), (at_b[more] + 1).tolist(), strict=True):
            out[g] = ",".join(map(name, a[i:p])) + "|" + ",".join(map(name, b[j:q]))
        return ";".join(out)


def aligned_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_path: str = BYTE_MODEL, piece_path: str = PIECE_MODEL) -> DataFrame:
    """(at, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) for every row: pairs are the distinct links as A id * 2^32 + B id."""
    schema = "at bigint, id string, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        align = Aligner(*sides(byte_path, piece_path))
        for batch in batches:
            for start in range(0, len(batch), _TEXTS):
                part, out = batch.iloc[start : start + _TEXTS], []
                for at, ident, text in zip(part["at"], part["id"], part["text"], strict=True):
                    a, b, at_a, at_b, links = align(text)
                    digest = hashlib.sha256(align.groups(a, b, at_a, at_b, links).encode()).hexdigest() if a else ""
                    pairs, times = np.unique(links, return_counts=True)
                    # Every common end is the end of one token a side: as many links as groups.
                    out.append((at, ident, len(a), len(b), len(at_a), len(links), digest, pairs, times))
                yield pd.DataFrame(out, columns=names)

    # As text, so that no id goes through a float where another is null.
    rows = df.select(F.monotonically_increasing_id().alias("at"), F.col(id_col).cast("string").alias("id"), text_of(text_col).alias("text"))
    return rows.mapInPandas(run, schema).withColumn("id", F.col("id").cast("bigint"))


def align_tokenizers(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_path: str = BYTE_MODEL, piece_path: str = PIECE_MODEL) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, n_best_a, count_sum, groups_sha256) for every row.

    A link's count is how many links of all rows hold its pair of ids. n_best are the links whose count is the highest of their B id over all rows, n_best_a
    of their A id, ties included; count_sum adds the counts. Null and empty texts, and those that a side does not give back byte for byte, have zeros and an
    empty digest. Equal rows and repeated ids are rows like others and count each; rows without an id stay. Texts are encoded whole; other columns
    go; an empty table gives an empty one.
    """
    table = write_table(aligned_rows(df, id_col, text_col, byte_path, piece_path))
    exploded = lambda *c: table.select(*c, F.explode(F.arrays_zip("pairs", "times")).alias("x")).select(*c, F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    counts = write_table(exploded().groupBy("pair").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("rows")))
    a, b = F.shiftright("pair", 32), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    # One row a token: bounded by the vocabularies.
    best_b, best_a = (F.broadcast(counts.groupBy(k.alias(c)).agg(F.max("count").alias(f"most_{c}"))) for k, c in ((b, "b"), (a, "a")))
    told = counts.withColumn("a", a).withColumn("b", b).join(best_b, "b").join(best_a, "a")
    told = told.select("pair", "count", "rows", (F.col("count") == F.col("most_b")).alias("top_b"), (F.col("count") == F.col("most_a")).alias("top_a"))
    left, right = sides(byte_path, piece_path)
    links = exploded("at")
    if pair_bound(left.bytes, right.bytes) <= PAIRS_SENT:
        met = links.join(F.broadcast(told.drop("rows")), "pair")
    else:
        met = join_told(links, told, "pair", "rows")
    sums = met.groupBy("at").agg(F.sum(F.when(F.col("top_b"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.when(F.col("top_a"), F.col("n")).otherwise(0)).alias("n_best_a"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    sums = write_table(sums)
    drop_table(counts)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return table.drop("pairs", "times").join(sums, "at", "left").select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", *[zero(c) for c in ("n_best", "n_best_a", "count_sum")], "groups_sha256")
