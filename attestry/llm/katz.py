"""Katz backoff language model: Good-Turing discounted counts and exactly normalised backoff weights.

    P(w | h) = d(r) r / c(h)      if the pair (h, w) was seen r > 0 times
             = a(h) P(w)          otherwise
    P(w)     = e(c) c / N         if the word was seen c > 0 times, else the mass that discounting leaves

d and e are Good-Turing discounts up to K and nearly one above it, so every context keeps some mass; a(h) makes the
probabilities of all words after h sum to one. Words are 64-bit hashes, with short codes for frequent ones.

Counts live in tables of packed arrays, dealt by the predicted word (frequent words also by their context), and are
evaluated where they lie: a bucket gives each text its share of the score with the discounts still open, since the
log of each factor is a sum. Words after unseen pairs go on to their context's bucket for a(h). What is moved is
about the distinct pairs of each chunk of texts, and nothing but scalars reaches the driver.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import drop_table, hash_sample, text_of, write_table

K, KEPT = 5, 0.999
FOLDS, HELD = 7, 2
#: Words with a short code, from a sample of about so many texts; and how many there are at most. Codes change sizes, never results.
SAMPLE_ROWS, CODES = 2000, 60_000
#: A word with more than this share of all tokens is dealt by its context too; there can be 1,024 of them at most.
HOT = 1024
CHUNK_ROWS, CHUNK_TOKENS, BUCKET_TOKENS = 6144, 3_000_000, 2_000_000
#: Tokens whose bucket is found at a time.
BLOCK = 1 << 18
END, START = np.uint64(1), np.uint64(2)
_TOP = 1 << 63
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def tokens_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


class _Codes(dict):
    """Short codes of frequent words, else 63-bit hashes with the top bit set; forgets all but the codes when full."""

    def __init__(self, short: dict[bytes, int]):
        super().__init__(short)
        self.short = short

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > len(self.short) + 200_000:
            self.clear()
            self.update(self.short)
        out = self[word] = xxhash.xxh64_intdigest(word) | _TOP
        return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K2
    return x ^ (x >> np.uint64(29))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed."""
    import zstandard

    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts.append(f"{a.dtype.str}:{len(a)};".encode())
        parts.append(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(raw: bytes) -> list[np.ndarray]:
    import zstandard

    data, at, out = zstandard.ZstdDecompressor().decompress(raw), 0, []
    while at < len(data):
        stop = data.index(b";", at)
        kind, n = data[at:stop].decode().split(":")
        dtype, n = np.dtype(kind), int(n)
        size = n * dtype.itemsize
        planes = np.frombuffer(data, np.uint8, size, stop + 1).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
        at = stop + 1 + size
    return out


def _small(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint16 if not len(a) or a.max() < 65536 else np.uint32)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(keys[0]), bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


def _chunks(triples, codes: _Codes, buckets: int, hot: np.ndarray, part: int) -> Iterator[tuple]:
    """Packed rows of chunks of texts: one of kind 0 with the texts' ids, and one of kind 1 for each bucket."""
    k = 0

    def emit(rows: list, tokens: array) -> Iterator[tuple]:
        lengths = np.array([r[0] for r in rows])
        flags = np.array([r[1] for r in rows], bool)
        chunk = part * 1_000_000 + k
        empty = np.array([r[2] is None for r in rows], np.uint8)
        yield chunk, 0, int(chunk % buckets), pack(np.array([0 if r[2] is None else r[2] for r in rows], np.int64), empty, flags.astype(np.uint8), lengths.astype(np.int64))
        words = np.frombuffer(tokens, np.uint64)
        before = np.empty_like(words)
        before[1:] = words[:-1]
        before[np.cumsum(lengths) - lengths] = START
        texts = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
        bucket = np.empty(len(words), np.uint16 if buckets < 65536 else np.uint32)
        for s in range(0, len(words), BLOCK):  # in blocks and then bucket by bucket, so that few numbers a token are held at a time
            w, h = words[s : s + BLOCK], before[s : s + BLOCK]
            spread = _mix(w * _K1)
            if len(hot):
                common = hot[np.minimum(np.searchsorted(hot, w), len(hot) - 1)] == w
                spread[common] = _mix(spread[common] + _mix(h[common] * _K1))
            bucket[s : s + BLOCK] = (spread >> np.uint64(20)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable").astype(np.int32)
        edges = np.append(0, np.cumsum(np.bincount(bucket, minlength=buckets)))
        del bucket
        for b in range(buckets):
            at = order[edges[b] : edges[b + 1]]
            if not len(at):
                continue
            w, h = words[at], before[at]
            at = at[np.argsort(_mix(w * _K1 + h), kind="stable")]
            w, h, doc = words[at], before[at], texts[at]
            entry = _starts(w, h, doc)
            n = np.diff(np.append(entry, len(w)))
            w, h, doc = w[entry], h[entry], doc[entry]
            pair = _starts(w, h)
            width = np.diff(np.append(pair, len(w)))
            learned = np.add.reduceat(np.where(flags[doc], 0, n), pair)
            yield chunk, 1, b, pack(w[pair], h[pair], learned.astype(np.uint32), _small(width), _small(doc), _small(n))

    rows, tokens = [], array("Q")
    for text, flag, key in triples:
        own = tokens_of(text)
        tokens.extend(map(codes.__getitem__, own))
        tokens.append(int(END))
        rows.append((len(own) + 1, flag, key))
        if len(rows) >= CHUNK_ROWS or len(tokens) >= CHUNK_TOKENS:
            yield from emit(rows, tokens)
            rows, tokens, k = [], array("Q"), k + 1
    if rows:
        yield from emit(rows, tokens)


def _bucket(rows: pd.DataFrame, buckets: int, hot: dict[int, int]) -> Iterator[tuple]:
    """What one bucket gives: counts of counts (kind 2), shares of texts (3), context masses (4), unseen words (5)."""
    loaded = [(c, unpack(x)) for c, x in zip(rows["chunk"], rows["data"], strict=True)]
    w, h = (np.concatenate([x[i] for _, x in loaded]) for i in (0, 1))
    counts = np.concatenate([x[2] for _, x in loaded]).astype(np.int64)
    order = np.lexsort((h, w))
    start = _starts(w[order], h[order])
    ids = np.empty(len(w), np.int64)
    ids[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(w))))
    r = np.add.reduceat(counts[order], start)
    w, h = w[order[start]], h[order[start]]
    ws = _starts(w)
    c = np.add.reduceat(r, ws)
    words = w[ws]
    cold = ~np.isin(words, np.array(list(hot), np.uint64))
    for i in np.flatnonzero(~cold):
        c[i] = hot[int(words[i])]
    of_word = np.repeat(np.arange(len(ws)), np.diff(np.append(ws, len(w))))
    known = c[cold & (c > 0)]
    yield -1, 2, 0, pack(np.concatenate([np.bincount(np.minimum(r, K + 2), minlength=K + 3), np.bincount(np.minimum(known, K + 2), minlength=K + 3)]).astype(np.int64))
    cw = c[of_word]
    low_r, low_c = np.minimum(r, K + 1), np.minimum(cw, K + 1)
    with np.errstate(divide="ignore"):
        log_r, log_c, log_c1 = (np.where(v > 0, np.log10(np.maximum(v, 1)), 0.0) for v in (r, cw, cw + 1))
    unseen_rows = []
    at = 0
    for chunk, x in loaded:
        n_pairs = len(x[0])
        p = np.repeat(ids[at : at + n_pairs], x[3])
        at += n_pairs
        doc, n = x[4].astype(np.int64), x[5].astype(np.int64)
        size = int(doc.max()) + 1
        seen = r[p] > 0
        add = lambda mask, weight=None: np.bincount(doc[mask], (n if weight is None else n * weight)[mask], size)
        base = add(cw[p] >= 0, log_c1[p])
        logs = add(seen, log_r[p]) + add(~seen, log_c[p]) - add((w[p] != END) & (cw[p] > 0), log_c[p])
        whole = [add(cw[p] > 0)] + [add(seen & (low_r[p] == i)) for i in range(1, K + 2)] + [add(~seen & (low_c[p] == i)) for i in range(K + 2)]
        touched = np.flatnonzero(np.bincount(doc, minlength=size))
        yield chunk, 3, 0, pack(_small(touched), base[touched], logs[touched], *(_small(v[touched].astype(np.int64)) for v in whole))
        if (~seen).any():
            unseen_rows.append((np.full(int((~seen).sum()), chunk), h[p[~seen]], doc[~seen], n[~seen]))
    learned = np.flatnonzero(r > 0)
    hs = h[learned]
    order = np.argsort(hs, kind="stable")
    learned, hs = learned[order], hs[order]
    s = _starts(hs)
    if len(s):
        mass = [np.add.reduceat(np.where(low_r[learned] == i, 1, 0), s) for i in range(1, K + 1)] + [np.add.reduceat(np.where(r[learned] > K, r[learned], 0), s)]
        mass += [np.add.reduceat(np.where(low_c[learned] == i, 1, 0), s) for i in range(1, K + 1)] + [np.add.reduceat(np.where(cw[learned] > K, cw[learned], 0), s)]
        contexts = hs[s]
        to = ((_mix(contexts * _K1) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(buckets + 1))
        for b in range(buckets):
            i = order[edges[b] : edges[b + 1]]
            if len(i):
                yield -1, 4, b, pack(contexts[i], *(_small(m[i]) for m in mass))
    if unseen_rows:
        chunk, context, doc, n = (np.concatenate(v) for v in zip(*unseen_rows, strict=True))
        to = ((_mix(context * _K1) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((doc, chunk, context, to))
        context, chunk, doc, n, to = context[order], chunk[order], doc[order], n[order], to[order]
        t = _starts(context, chunk, doc)
        context, chunk, doc, n, to = context[t], chunk[t], doc[t], np.add.reduceat(n, t), to[t]
        order, edges = np.arange(len(to)), np.searchsorted(to, np.arange(buckets + 1))
        for b in range(buckets):
            i = order[edges[b] : edges[b + 1]]
            if len(i):
                yield -1, 5, b, pack(context[i], chunk[i].astype(np.int64), _small(doc[i]), _small(n[i]))


def discounts(counts: np.ndarray, k: int = K) -> np.ndarray:
    """d(1..k) by Good-Turing from counts of counts n(0), n(1), ...; absolute discounts of a half where those are not in (0, 1)."""
    n = counts.astype(float)
    if n[1] > 0 and n[k + 1] > 0 and (n[1 : k + 1] > 0).all():
        cut = (k + 1) * n[k + 1] / n[1]
        r = np.arange(1, k + 1)
        if cut < 1:
            d = ((r + 1) * n[2 : k + 2] / (r * n[1 : k + 1]) - cut) / (1 - cut)
            if ((d > 0) & (d < 1)).all():
                return d
    return 1 - 0.5 / np.arange(1, k + 1)


class Model:
    """The scalars: discounts of pairs and of words, N, V and the mass of unknown words."""

    def __init__(self, pair_counts: np.ndarray, word_counts: np.ndarray, tokens: int, texts: int):
        self.tokens, self.texts, self.words = tokens, texts, int(word_counts[1:].sum())
        self.d = np.concatenate([discounts(pair_counts), [KEPT]])
        self.e = np.concatenate([discounts(word_counts), [KEPT]])
        small = word_counts[1 : K + 1] * np.arange(1, K + 1)
        used = (small * self.e[:K]).sum() + (tokens - small.sum()) * KEPT
        self.unknown = float(1 - used / tokens) if tokens else 1.0

    def backoff(self, mass: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(c(h), a(h)) from the summed masses of contexts."""
        m = [x.astype(float) for x in mass]
        ranks = np.arange(1, K + 1)
        total = sum(ranks[i] * m[i] for i in range(K)) + m[K]
        seen = sum(ranks[i] * self.d[i] * m[i] for i in range(K)) + self.d[K] * m[K]
        lower = (sum(ranks[i] * self.e[i] * m[K + 1 + i] for i in range(K)) + self.e[K] * m[2 * K + 1]) / self.tokens
        return total, (1 - seen / total) / (1 - lower)


def _contexts(rows: pd.DataFrame, model: Model) -> Iterator[tuple]:
    """Kind 6: for each chunk with unseen words, the backoff weights' logs by text."""
    held = [unpack(x) for x in rows["data"][rows["kind"] == 5]]
    if not held:
        return
    asked, chunk, doc, n = (np.concatenate([x[i] for x in held]) for i in range(4))
    loaded = [unpack(x) for x in rows["data"][rows["kind"] == 4]]
    logs = np.zeros(len(asked))
    if loaded:
        h = np.concatenate([x[0] for x in loaded])
        order = np.argsort(h, kind="stable")
        s = _starts(h[order])
        total, weight = model.backoff([np.add.reduceat(np.concatenate([x[i] for x in loaded])[order].astype(np.int64), s) for i in range(1, 2 * K + 3)])
        contexts = h[order][s]
        at = np.minimum(np.searchsorted(contexts, asked), len(contexts) - 1)
        # c(h) goes back as well: the shares of texts divide every word by it, and unseen pairs do not have that factor.
        logs = np.where(contexts[at] == asked, np.log10(weight[at]) + np.log10(total[at]), 0.0)
    order = np.lexsort((doc, chunk))
    chunk, doc, value = chunk[order], doc[order].astype(np.int64), (logs * n.astype(np.int64))[order]
    s = _starts(chunk)
    for i, j in zip(s, np.append(s[1:], len(chunk)), strict=True):
        t = _starts(doc[i:j])
        yield int(chunk[i]), 6, 0, pack(_small(doc[i:j][t]), np.add.reduceat(value[i:j], t))


def _texts(rows: pd.DataFrame, model: Model) -> pd.DataFrame:
    """The scores of a chunk's texts."""
    meta = unpack(rows["data"][rows["kind"] == 0].iloc[0])
    size = len(meta[0])
    base, logs, known = np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
    log_d, log_e, log_n = np.log10(model.d), np.log10(model.e), np.log10(max(model.tokens, 1))
    for raw in rows["data"][rows["kind"] == 3]:
        doc, b, s, k, *whole = unpack(raw)
        base[doc] += b
        known[doc] += k.astype(np.int64)
        logs[doc] += s + sum(log_d[i] * whole[i] for i in range(K + 1)) + whole[K + 1] * np.log10(model.unknown) + sum((log_e[i] - log_n) * whole[K + 2 + i] for i in range(K + 1))
    for raw in rows["data"][rows["kind"] == 6]:
        doc, s = unpack(raw)
        logs[doc] += s
    if model.texts:
        logs -= np.log10(model.texts)
    base -= meta[3] * np.log10(float(model.tokens + model.words + 1))
    return pd.DataFrame(
        {
            "key": pd.Series([None if none else str(i) for i, none in zip(meta[0], meta[1], strict=True)], dtype=object), "held_out": meta[2] == 1, "n_tokens": meta[3],
            "n_known": known, "train_tokens": np.full(size, model.tokens), "base_score": base, "score": logs,
        }
    )


def katz_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Null texts count as empty: their one token is the end. Null ids are learned from. A table without rows to learn
    from gives every word the mass of the unknown, 1.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == held, F.lit(False)).alias("held"))
    sample = hash_sample(df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")), ["id", "text"], SAMPLE_ROWS, df.count()).where("text <> ''")
    words = sample.select(F.explode(F.split(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+")).alias("w")).where("w <> ''")
    common = words.groupBy("w").count().where("count > 1").orderBy(F.desc("count"), "w").limit(CODES).collect()
    short = spark.sparkContext.broadcast({r.w.encode(): i + 16 for i, r in enumerate(common)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, total, size, texts = short.value, {}, 0, 0
        for batch in batches:
            for text, out in zip(batch["text"], batch["held"], strict=True):
                if out:
                    continue
                own = tokens_of(text)
                size += len(own) + 1
                texts += 1
                for t in own:
                    if t in codes:
                        total[t] = total.get(t, 0) + 1
        yield pd.DataFrame([(-1, size), (int(END), texts), *((codes[t], n) for t, n in total.items())], columns=["code", "n"])

    coded = write_table(rows.select("text", "held").mapInPandas(count, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")))
    tokens = coded.where("code = -1").agg(F.sum("n")).first()[0] or 0
    texts = coded.where(f"code = {int(END)}").agg(F.sum("n")).first()[0] or 0
    hot = {r.code: r.n for r in coded.where((F.col("code") > 0) & (F.col("n") * HOT > tokens) & (F.col("n") > 0)).collect()}  # HOT rows at most
    buckets = max(1, -(-tokens // BUCKET_TOKENS))
    hot_codes = np.array(sorted(hot), np.uint64)
    shape = "chunk bigint, kind int, bucket bigint, data binary"
    names = ["chunk", "kind", "bucket", "data"]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        triples = ((t, f, None if k is None else int(k)) for batch in batches for t, f, k in zip(batch["text"], batch["held"], batch["key"], strict=True))
        for row in _chunks(triples, _Codes(short.value), buckets, hot_codes, TaskContext.get().partitionId()):
            yield pd.DataFrame([row], columns=names)

    def judge(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["kind"] == 1]
        out = pd.DataFrame(list(_bucket(own, buckets, hot)) if len(own) else [], columns=names)
        return pd.concat([group[group["kind"] == 0][names], out], ignore_index=True)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum((unpack(raw)[0] for batch in batches for raw in batch["data"]), np.zeros(2 * (K + 3), np.int64))
        yield pd.DataFrame({"i": np.arange(len(total)), "n": total})

    dealt = rows.select("text", "held", F.col("id").cast("string").alias("key")).mapInPandas(deal, shape)
    judged = write_table(dealt.groupBy("bucket").applyInPandas(judge, shape))
    gathered = np.zeros(2 * (K + 3), np.int64)
    for r in judged.where("kind = 2").select("data").mapInPandas(sums, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).collect():
        gathered[r.i] = r.n
    for n in hot.values():
        gathered[K + 3 + min(n, K + 2)] += 1
    model = Model(gathered[: K + 3], gathered[K + 3 :], int(tokens), int(texts))

    def weigh(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(_contexts(group, model)), columns=names)

    fields = "key string, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    weighed = judged.where("kind in (4, 5)").groupBy("bucket").applyInPandas(weigh, shape)
    shares = judged.where("kind in (0, 3)").unionByName(weighed)
    scored = shares.groupBy("chunk").applyInPandas(lambda group: _texts(group, model), fields)
    return scored.select(F.col("key").cast("bigint").alias(id_col), *(x.split()[0] for x in fields.split(", ")[1:]))
