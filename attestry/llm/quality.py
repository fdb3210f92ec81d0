"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees, one feature at a time and then one pair at a time, adds up to a lookup table per
feature and per chosen pair. A score is the logistic of the sum of a text's bins. All inputs are counts over the
whole text; labels, language, source and id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import text_of
from attestry.llm.html import STOP_WORDS

FEATURES = (
    "log_words", "log_chars", "word_length", "longest_word", "distinct_share", "stop_share", "upper_share", "lower_share", "digit_share", "punct_share",
    "space_share", "wide_share", "pipe_rate", "bang_rate", "hash_rate", "noise_rate", "comma_rate", "stop_mark_rate", "line_length", "line_repeat", "word_repeat", "top_word_share", "ended_lines", "capital_words",
)
#: Labelled texts the model is fitted on, first by hash of the id; a documented bound, the only one.
TRAIN_ROWS = 20_000
#: The split of the contract: rows whose crc32 of the id leaves 0 are never learned from.
FOLDS = 5
THRESHOLD = 0.3
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 48, 8, 120, 40, 8, 0.15


def text_features(text: str) -> list[float]:
    """One number for each of FEATURES; an empty text gives zeros."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    h = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(h[:128].sum() + h[192:].sum()))  # code points
    upper, lower, digit = int(h[65:91].sum()), int(h[97:123].sum()), int(h[48:58].sum())
    space = int(h[32] + h[9:14].sum())
    punct = int(h[33:127].sum()) - upper - lower - digit
    lines = [x for x in text.split("\n") if x.strip()]
    count: dict[str, int] = {}
    for w in words:
        count[w] = count.get(w, 0) + 1
    stops = sum(c for w, c in count.items() if w in STOP_WORDS)
    capital = sum(c for w, c in count.items() if w[0].isupper())
    letters = max(1, upper + lower)
    return [
        float(np.log1p(n)), float(np.log1p(size)), (size - space) / n, float(min(200, max(map(len, count)))), len(count) / n, stops / n, upper / letters, lower / size, digit / size, punct / size,
        space / size, float(h[192:].sum()) / size, h[124] / n, h[33] / n, h[35] / n, float(h[36] + h[37] + h[38] + h[42]) / n, h[44] / n, h[46] / n, size / len(lines), 1 - len(set(lines)) / len(lines),
        sum(map(eq, words, words[1:])) / n, max(count.values()) / n, sum(x.rstrip()[-1] in ".!?\"'" for x in lines) / len(lines), capital / n,
    ]


@dataclass
class Additive:
    """Cut points and tables: score = logistic(base + main tables + pair tables)."""

    base: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    mains: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.mains):
            out += table[np.searchsorted(self.cuts[j], x[:, j], side="right")]
        low = {j: np.searchsorted(self.coarse[j], x[:, j], side="right") for j in {k for a, b, _ in self.pairs for k in (a, b)}}
        for a, b, table in self.pairs:
            out += table[low[a], low[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best place to split a run of bins, and what it gains."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gains = _gain(gl, hl) + _gain(g.sum() - gl, h.sum() - hl) - _gain(g.sum(), h.sum())
    at = int(gains.argmax())
    return float(gains[at]), at + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Newton steps of a shallow tree over ordered bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, i = max((*_best_cut(g[s:e], h[s:e]), i) for i, (s, e) in enumerate(parts))
        if gain <= 1e-9:
            break
        s, e = parts[i]
        parts[i : i + 1] = [(s, s + at), (s + at, e)]
    out = np.empty(len(g))
    for s, e in parts:
        out[s:e] = g[s:e].sum() / (h[s:e].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """A two-level tree over a grid: one split on either axis, then one split of each half on the other; (gain, steps)."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros_like(g))
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, gg.shape[0]):
            out, gain = np.empty_like(gg), -_gain(gg.sum(), hh.sum())
            for part in (slice(0, cut), slice(cut, None)):
                gs, hs = gg[part].sum(0), hh[part].sum(0)
                _, at = _best_cut(gs, hs)
                for cols in (slice(0, at), slice(at, None)) if at else (slice(0, None),):
                    a, b = gs[cols].sum(), hs[cols].sum()
                    gain += _gain(a, b)
                    out[part, cols] = a / (b + 1.0)
            if gain > best[0]:
                best = (float(gain), out.T if flip else out)
    return best


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fits the model; no rows give the model that scores 0.5 everywhere."""
    if not len(y):
        return Additive()
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Additive(base=float(np.log(share / (1 - share))))
    quantiles = lambda v, k: np.unique(np.quantile(v, np.linspace(0, 1, k + 1)[1:-1]))
    model.cuts = [quantiles(x[:, j], BINS) for j in range(x.shape[1])]
    model.coarse = [quantiles(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    model.mains = [np.zeros(len(c) + 1) for c in model.cuts]
    fine = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.cuts)]
    low = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(model.coarse)]
    f = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for j, bins in enumerate(fine):
            g, h = slopes()
            step = RATE * np.clip(_tree(np.bincount(bins, g, len(model.mains[j])), np.bincount(bins, h, len(model.mains[j]))), -4, 4)
            model.mains[j] += step
            f += step[bins]
    g, h = slopes()
    ranked = []
    for a in range(x.shape[1]):
        for b in range(a + 1, x.shape[1]):
            shape = (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1)
            cell = low[a] * shape[1] + low[b]
            grids = [np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]
            ranked.append((_pair_tree(*grids)[0], a, b, cell, shape))
    chosen = sorted(ranked, key=lambda r: (-r[0], r[1], r[2]))[:PAIRS]
    tables = [np.zeros(shape) for *_, shape in chosen]
    for _ in range(PAIR_ROUNDS):
        for i, (_, _, _, cell, shape) in enumerate(chosen):
            g, h = slopes()
            _, step = _pair_tree(*(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)))
            step = RATE * np.clip(step, -4, 4)
            tables[i] += step
            f += step.ravel()[cell]
    model.pairs = [(a, b, t) for (_, a, b, _, _), t in zip(chosen, tables, strict=True)]
    return model


def with_features(df: DataFrame, text_col: str = "text", out_col: str = "features") -> DataFrame:
    """Adds array<float> of FEATURES over the whole text; null texts count as empty."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([np.array(text_features(t), np.float32) for t in batch], dtype=object)

    return df.withColumn(out_col, run(text_of(text_col)))


def fold_of(id_col: str, folds: int = FOLDS):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Additive:
    """Learns from at most train_rows labelled ids outside the held-out fold, first by hash. A repeated id has its largest label."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("y"))
    sample = known.where(~fold_of("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most train_rows ids
    rows = with_features(labelled).select("doc_id", "features", "y").toPandas()
    # Of texts that share an id, the one with the smallest features teaches, so that reruns agree.
    rows = rows.loc[rows["features"].map(tuple).sort_values(kind="stable").index].sort_values("doc_id", kind="stable").drop_duplicates("doc_id")
    if rows.empty:
        return Additive()
    return fit(np.stack(rows["features"].to_numpy()).astype(float), rows["y"].to_numpy(float))


def with_score(df: DataFrame, model: Additive, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Adds the model's score of each whole text, 0 to 1."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.array([text_features(t) for t in batch], np.float32).reshape(-1, len(FEATURES))
            yield pd.Series(model.score(x.astype(float)))

    return df.withColumn(out_col, run(text_of(text_col)))


def score_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs. Null and empty texts score as texts of zeros."""
    scored = with_score(docs.select("doc_id", "text"), fit_quality(docs, labels, train_rows))
    return scored.select("doc_id", fold_of("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that the classifier accepts, with their columns as they are."""
    scored = with_score(docs, fit_quality(docs, labels, train_rows), out_col="_attestry_score")
    return scored.where(F.col("_attestry_score") >= THRESHOLD).select(*docs.columns)
