"""Near-duplicate texts by order MinHash.

A text is a sequence of words. Its k-mers are five-word shingles, each labelled with its occurrence. A sketch draws the
ROW shingles with the least hashes and keeps their order in the text, so its chance to agree falls with edits and with
moved passages alike. Texts that agree in any of BANDS sketches, or in any of WORD_BANDS sketches of single labelled words, of which no kind of
edit leaves less than the similarity, are candidates; a banded alignment of their words then gives the exact similarity: aligned / (len a + len b - aligned), an order-keeping Jaccard of words. An edited word costs
one word, not the five shingles that hold it, so a copy with scattered edits stays alike.

Of short texts a sketch would agree too rarely or never, so their candidates are exact: alike texts share one of the
rarest word pairs of each (a prefix filter). They are the texts of SHORT words and those that can be alike to one.

Equal texts are joined first and sketched once. Each text is first compared with the smallest leader of all its buckets,
then with the leader of each, which puts most of a group of copies into one class by a line of pairs. What is then outside its leader's class meets
some leaders of its own. Last, in every bucket that still holds several classes, all members outside its largest class are compared with all members of
other classes. So every pair of a bucket is compared or of one class already, and no bucket is cut off. Only pairs and members outside
a large class leave the joins, so a large class costs no more than its rows in each round.

Before texts are fetched, a candidate must pass an exact bound: bitmaps of word counts modulo 2 differ in no more bits
than the two texts differ in words, so too many different bits prove a similarity below the least.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import NO_ID, connected_components, drop_table, join_dealt, join_told, text_of, write_table

SHINGLE, SIMILARITY = 5, 0.8
#: Sketches of shingles in text order find texts that share a part J of their shingles with chance 1 - (1 - J ** ROW) ** BANDS. Scattered edits that leave words 0.8
#: alike leave far less of the shingles (and 0.5 of the word pairs, where words were only put in). Sketches of labelled words hold for all edits: aligned words are common to
#: both multisets, so their Jaccard is the similarity at least, and two texts of similarity 0.8 meet with chance 0.9995 or more (0.9998 where they are long).
ROW, BANDS = 6, 16
WORD_ROW, WORD_BANDS = 8, 48
#: A key with more than this share of all members is joined apart; there can be fewer than so many of them. SPLIT: parts of such a bucket in the last round.
HOT, SPLIT = 1024, 32
#: Pairs with a text of at most so many words are found by prefixes, all others by sketches.
SHORT = 48
#: 64-bit words of a parity bitmap.
PARITY = 16
_RNG = np.random.default_rng(20240229)
_SEEDS = _RNG.integers(1, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _K2
    return x ^ (x >> np.uint64(29))


class _Cut(dict):
    """Word hashes of texts, so that a text of many pairs is cut once; forgets all when it holds too many characters."""

    def __init__(self) -> None:
        super().__init__()
        self.words, self.held = _Words(), 0

    def __missing__(self, text: str) -> list[int]:
        if self.held > 4_000_000:
            self.clear()
            self.held = 0
        self.held += len(text)
        out = self[text] = [self.words[t] for t in text.lower().split()]
        return out


class _Words(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        out = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


def word_hashes(text: str, words: _Words) -> np.ndarray:
    return np.array([words[t] for t in text.lower().split()], np.uint64)


def shingles(w: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """The labelled k-mers of a sequence in order. One of fewer than k words is one k-mer; an empty one has none."""
    if not len(w):
        return np.zeros(0, np.uint64)
    n = max(1, len(w) - k + 1)
    h = np.full(n, np.uint64(min(len(w), k)))
    for i in range(min(k, len(w))):
        h = h * _K1 + w[i : i + n]
    h = _mix(h)
    order = np.argsort(h, kind="stable")
    same = np.concatenate([[False], h[order][1:] == h[order][:-1]])
    if same.any():
        at = np.arange(n)
        occurrence = np.empty(n, np.uint64)
        occurrence[order] = at - np.maximum.accumulate(np.where(same, 0, at))
        h = np.where(occurrence > 0, _mix(h + occurrence * _K1), h)
    return h


def sketch(h: np.ndarray, bands: int = BANDS, row: int = ROW, first: int = 0, ordered: bool = True) -> list[int]:
    """One key a band, from band first on: a hash of the row least shingles, in text order or as a set."""
    if not len(h):
        return []
    take = min(row, len(h))
    out = np.empty(bands, np.uint64)
    step = max(1, min(bands, 2_000_000 // len(h)))
    for s in range(0, bands, step):
        seeds = _SEEDS[first + s : first + min(s + step, bands)]
        least = h[None, :] * seeds[:, None]
        least ^= least >> np.uint64(32)
        least *= _K2
        if not ordered:
            drawn = np.sort(np.partition(least, take - 1, axis=1)[:, :take], axis=1)
        elif take < len(h):
            drawn = h[np.sort(np.argpartition(least, take - 1, axis=1)[:, :take], axis=1)]
        else:
            drawn = np.tile(h, (len(seeds), 1))
        key = np.arange(first + s, first + s + len(seeds), dtype=np.uint64)
        for i in range(take):
            key = _mix(key * _K1 + drawn[:, i])
        out[s : s + len(seeds)] = key
    return out.view(np.int64).tolist()


def parity(h: np.ndarray, words: int = PARITY) -> list[int]:
    """A bitmap of 64 * words bins of labelled words: a bit is 1 where the bin holds an odd number."""
    bins = (h % np.uint64(64 * words)).astype(np.int64)
    return np.packbits((np.bincount(bins, minlength=64 * words) & 1).astype(np.uint8)).view(np.int64).tolist()


def _may_reach(least: float) -> Column:
    """False only if similarity `least` is impossible for sizes n, m and parities p, q: of n + m words at most a share (1 - least) / (1 + least) differs."""
    differ = sum((F.bit_count(F.get("p", F.lit(i)).bitwiseXOR(F.get("q", F.lit(i)))) for i in range(1, PARITY)), F.bit_count(F.get("p", F.lit(0)).bitwiseXOR(F.get("q", F.lit(0)))))
    return differ <= (F.col("n") + F.col("m")) * ((1 - least) / (1 + least)) + 1e-6


#: Words of the first text that are aligned with one window of the second.
_ROWS = 4096


def alignment(a: list[int], b: list[int], least: float = SIMILARITY) -> float:
    """Similarity of two word sequences by their longest common subsequence inside the band that `least` allows.

    Bit-parallel: bit j of `state` is 0 where the subsequence grows at word j of b, so a word of a costs a few operations
    on one long integer. Only matches inside the band count, and only the band's window of b is held. The alignment
    stops as soon as `least` is out of reach; a value below `least` is a lower bound. Two empty sequences are alike.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    if min(n, m) < least * max(n, m):
        return 0.0
    need, band = least / (1 + least) * (n + m) - 1e-9, int((1 - least) / (1 + least) * (n + m)) + 1
    head, most = 0, min(n, m)
    while head < most and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < most - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    x, y = a[head : n - tail], b[head : m - tail]
    done, low, state = head + tail, 0, 0  # state holds words low.. of y; ones above what it holds
    held = 0
    for start in range(0, len(x), _ROWS):
        rows = x[start : start + _ROWS]
        fresh_low, high = min(len(y), max(0, start - band)), min(len(y), start + len(rows) + band)
        done += (fresh_low - low) - (state & ((1 << (fresh_low - low)) - 1)).bit_count()  # what leaves the window
        state >>= fresh_low - low
        held, low = held - (fresh_low - low), fresh_low
        state |= ((1 << (high - low)) - 1) >> held << held
        held = high - low
        full, wanted, at = (1 << held) - 1, set(rows), {}
        for j in range(low, high):
            if y[j] in wanted:
                at[y[j]] = at.get(y[j], 0) | 1 << (j - low)
        for i, word in enumerate(rows, start):
            match = at.get(word)
            if match:
                left = i - band - low
                if left > 0:
                    match = match >> left << left
                match &= (1 << (i + band + 1 - low)) - 1
                grown = state & match
                state = ((state + grown) | (state - grown)) & full
            if i & 63 == 63 and done + held - state.bit_count() + len(x) - 1 - i < need:
                return 0.0
    same = done + held - state.bit_count()
    return same / (n + m - same)


def _sketched(df: DataFrame, id_col: str, text_col: str, least: float) -> DataFrame:
    """(id, copy, n, keys, items, p): n is words, keys are sketches, items all word pairs of a text that needs a prefix."""

    @F.pandas_udf("n int, keys array<bigint>, items array<bigint>, p array<bigint>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = _Words()
        for batch in batches:
            rows = []
            for text in batch:
                w = word_hashes(text, words)
                n = len(w)
                single = shingles(w, 1)
                keys = sketch(shingles(w)) + sketch(single, WORD_BANDS, WORD_ROW, BANDS, ordered=False) if n > SHORT else []
                rows.append((n, keys, shingles(w, 2).view(np.int64).tolist() if n * least <= SHORT else [], parity(single)))
            yield pd.DataFrame(rows, columns=["n", "keys", "items", "p"])

    text = text_of(text_col)
    return df.select(F.col(id_col).cast("bigint").alias("id"), F.unhex(F.md5(text)).alias("copy"), run(text).alias("s")).select("id", "copy", "s.n", "s.keys", "s.items", "s.p")


def _prefixes(short: DataFrame, least: float) -> DataFrame:
    """(id, n, key) for (copy, id, n, items): the rarest word pairs of each text, one more than alignment can break.

    A text alike to another has at most (1 - least) n words beside it, and each breaks at most two of its pairs (a word
    put between two breaks one). So not all of its rarest 2 (1 - least) n + 1 pairs can be missing from the other. This
    holds for any one order of all pairs, and the rarest first meet the fewest others.
    """
    items = short.select("copy", "id", "n", F.explode("items").alias("key"))
    often = write_table(items.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1"))
    ordered = join_dealt(items, often, "key", "id", "left").groupBy("copy").agg(F.first("id").alias("id"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct(F.coalesce("times", F.lit(1)).alias("times"), "key"))).alias("items"))
    taken = F.slice("items", F.lit(1), (F.floor(F.col("n") * (2 * (1 - least)) + 1e-9) + 1).cast("int"))
    return ordered.select("id", "n", F.explode(taken).alias("x")).select("id", "n", "x.key")


def _buckets(banded: DataFrame) -> DataFrame:
    """(key, hot, id), written: the buckets of several members. Of buckets that hold the same ids one stays, as each would meet the same pairs.

    Two near copies share most of their sketches, so nearly all buckets are such repeats. Equal number, least and largest id, xor and sum of hashes
    tell that two buckets hold the same ids; they add up in parts, so that no bucket comes to one task.
    """
    shared = write_table(banded.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("key"))
    held = write_table(join_dealt(banded, shared, "key", "id").select("key", "id"))
    told = [F.count(F.lit(1)).alias("members"), F.min("id").alias("least"), F.max("id").alias("most"), F.bit_xor(F.xxhash64("id")).alias("either"), F.sum(F.shiftright(F.xxhash64("id", F.lit(1)), 32)).alias("all")]
    sets = held.groupBy("key").agg(*told).groupBy("members", "least", "most", "either", "all").agg(F.min("key").alias("key"))
    kept = write_table(sets.select("key", "members"))
    every = kept.agg(F.sum("members")).first()[0] or 0
    out = write_table(join_dealt(held, kept.select("key", (F.col("members") * HOT > every).alias("hot")), "key", "id").select("key", "hot", "id"))
    for table in (shared, held, kept):
        drop_table(table)
    return out


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Adds whether the pair (a, b) is alike. Only texts of pairs are moved: where these are few, none but they leave their tasks."""

    @F.pandas_udf("boolean")
    def alike(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        cut = _Cut()
        for left, right in batches:
            yield pd.Series([alignment(cut[x], cut[y], least) >= least for x, y in zip(left, right, strict=True)], dtype=bool)

    texts = texts.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    full = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    return full.select(*pairs.columns, alike("ta", "tb").alias("alike"))


def _led() -> list[Column]:
    return [F.col("id").alias("b"), F.col("n").alias("m"), F.col("class").alias("led"), F.col("p").alias("q")]


def _leaders(named: DataFrame) -> DataFrame:
    """(key, hot, b, m, led, q): the first member by id of each bucket that holds several classes, with size, class and parity."""
    first = named.groupBy("key", "hot").agg(F.min(F.struct("id", "n", "class", "p")).alias("x"), F.min("class").alias("y"), F.max("class").alias("z"))
    return first.where("y < z").select("key", "hot", "x.*").select("key", "hot", *_led())


def _some_leaders(others: DataFrame, number: int = 8) -> DataFrame:
    """The same for the first few members of each bucket; two steps, so that no bucket meets in one task."""
    salted = others.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("key", "salt").orderBy("id"))).where(F.col("r") <= number)
    top = first.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("r") <= number)
    return top.select("key", "hot", *_led())


def _outside(named: DataFrame, told: DataFrame) -> DataFrame:
    """The members outside the class (key, most) that is told of their bucket; members of a bucket without one are left out."""
    return join_dealt(named, told, "key", "id").where("class <> most")


def _by_leaders(active: DataFrame, lead: DataFrame) -> DataFrame:
    """Members with the leaders of their bucket; those of hot keys are sent to all tasks: fewer than HOT keys, a few leaders each."""
    cold = active.where("not hot").drop("hot").join(lead.where("not hot").drop("hot").hint("merge"), "key")
    return cold.unionByName(active.where("hot").drop("hot").join(F.broadcast(lead.where("hot").drop("hot")), "key"))


def _by_others(named: DataFrame, others: DataFrame) -> DataFrame:
    """Members with others of their bucket; hot buckets are dealt over SPLIT parts of their members, to each of which all others go."""
    salted = named.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SPLIT))).otherwise(F.lit(0).cast("bigint")))
    parts = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("hot"), F.lit(SPLIT - 1)).otherwise(F.lit(0)).cast("bigint"))
    dealt = others.withColumn("salt", F.explode(parts)).select("key", "salt", "most", *_led())
    return salted.drop("hot").join(dealt, ["key", "salt"]).drop("salt")


def _compared(met: DataFrame, done: DataFrame | None, texts: DataFrame, parts: int, least: float) -> DataFrame:
    """(a, b, class, led, alike), written, for the pairs (id, b) with their classes that are not in done."""
    # Few bytes a pair but much work: a set number of partitions, which adaptive planning does not merge into one.
    pairs = met.select(F.col("id").alias("a"), "b", "class", "led").repartition(parts, "a", "b").dropDuplicates(["a", "b"])
    pairs = pairs if done is None else pairs.join(done.select("a", "b"), ["a", "b"], "left_anti")
    # Written first, so that Spark knows how few they are before it moves texts.
    pairs = write_table(pairs)
    out = write_table(_verified(pairs, texts, least))
    drop_table(pairs)
    return out


def _merged(classes: DataFrame | None, fresh: DataFrame) -> DataFrame:
    """The classes (node, component) after the links of a round: links join classes, so only classes meet again."""
    joined = connected_components(fresh.where("alike").select(F.col("class").alias("a"), F.col("led").alias("b")))
    if classes is None:
        return joined
    moved = classes.join(joined.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    old = moved.select("node", F.coalesce("to", "component").alias("component"))
    out = write_table(old.unionByName(joined.join(classes.select("node"), "node", "left_anti")))
    drop_table(classes)
    drop_table(joined)
    return out


def _classed(members: DataFrame, classes: DataFrame) -> DataFrame:
    """The members with their class, which is their own id where they have no link."""
    return members.join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("class", F.coalesce("component", "id")).drop("component")


def _text_classes(df: DataFrame, id_col: str, text_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """Rows (id, copy, n, ...) and, for each distinct text, (copy, component, rows): its class and how many rows hold it."""
    rows = write_table(_sketched(df, id_col, text_col, least))
    stand_in = F.pmod(F.xxhash64("copy"), F.lit(NO_ID)) + NO_ID
    distinct = rows.groupBy("copy").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"), *[F.first(c).alias(c) for c in ("n", "keys", "items", "p")]).withColumn("id", F.coalesce("id", stand_in))
    distinct = write_table(distinct)
    prefixed = write_table(_prefixes(distinct.select("copy", "id", "n", "items").where(F.size("items") > 0), least))
    banded = distinct.select("id", F.explode("keys").alias("key")).unionByName(prefixed.select("id", "key"))
    buckets = _buckets(banded)
    # An id that two texts share is one row in either's buckets: what either links to, both do.
    members = write_table(buckets.join(distinct.select("id", "n", "p"), "id").select("key", "hot", "id", "n", "p"))
    drop_table(buckets)
    drop_table(prefixed)
    wanted = members.select("id").distinct()
    named = df.select(F.col(id_col).cast("bigint").alias("id"), text_of(text_col).alias("text"))
    named = named.select(F.coalesce("id", F.pmod(F.xxhash64(F.unhex(F.md5("text"))), F.lit(NO_ID)) + NO_ID).alias("id"), "text")
    texts = write_table(named.join(wanted, "id", "left_semi"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Two texts of one class need no comparison: the answer is the class.
    sized = (F.col("class") != F.col("led")) & (F.least("n", "m") >= F.greatest("n", "m") * least) & _may_reach(least)
    classes, rounds = None, []

    def compare(met: DataFrame) -> None:
        """Compares the pairs (id, b) that no round had; links join classes."""
        nonlocal classes
        fresh = _compared(met, reduce(DataFrame.unionByName, rounds) if rounds else None, texts, parts, least)
        rounds.append(fresh)
        # A round without links leaves the classes as they are.
        if classes is None or not fresh.where("alike").isEmpty():
            classes = _merged(classes, fresh)

    later = F.col("id") > F.col("b")
    named = members.withColumn("class", F.col("id"))
    lead = write_table(_leaders(named))
    met = _by_leaders(named, lead).where(sized & later)
    compare(met.groupBy("id").agg(F.min(F.struct("b", "class", "led")).alias("x")).select("id", "x.*"))
    drop_table(lead)
    named = write_table(_classed(members, classes))
    lead = write_table(_leaders(named))
    compare(_by_leaders(named, lead).where(sized & later))
    drop_table(named)
    first = _classed(lead.select("key", F.col("b").alias("id")), classes).select("key", F.col("class").alias("most"))
    others = write_table(_outside(_classed(members, classes), first).drop("most"))
    compare(_by_leaders(others, _some_leaders(others)).where(sized & later))
    drop_table(lead)
    drop_table(others)
    # The last round leaves no pair of a bucket out: what is not of its largest class meets all of the other classes.
    named = write_table(_classed(members, classes))
    sizes = named.groupBy("key", "class").agg(F.count(F.lit(1)).alias("size"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("size", "class")).alias("x"), F.count(F.lit(1)).alias("classes")).where("classes > 1").select("key", F.col("x.class").alias("most"))
    others = write_table(_outside(named, largest))
    # Two members outside the largest class would meet twice.
    once = (F.col("class") == F.col("most")) | later
    met = _by_others(named, others).where(sized & once)
    compare(met.select(F.greatest("id", "b").alias("id"), F.least("id", "b").alias("b"), "class", "led"))
    for table in (named, others, members, texts, *rounds):
        drop_table(table)
    told = distinct.select("copy", "id", "rows").join(classes.withColumnRenamed("node", "id"), "id", "left")
    told = write_table(told.select("copy", F.coalesce("component", "id").alias("component"), "rows"))
    drop_table(distinct)
    drop_table(classes)
    return rows, told


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(id, component_id, kept): the class of every row; kept is true for the smallest id of each class.

    Null texts count as empty; empty texts are copies of each other. Repeated ids with different texts are one
    row each and share what either links to; equal rows stay as many rows. A row without an id is classed by its text; a
    class without any id has a null component_id and is kept. Ids are below 2^62. No text is cut and no bucket is capped.
    """
    rows, told = _text_classes(df, id_col, text_col, least)
    out = join_told(rows.select("id", "copy"), told, "copy", "rows")
    own = F.when(F.col("component") < NO_ID, F.col("component"))
    return out.select(F.col("id").alias(id_col), own.alias("component_id"), F.coalesce(F.col("id") == own, own.isNull()).alias("kept"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row of df for each class: its smallest id, or where no row of the class has an id, one of the rows without.

    Of equal rows one stays, and of rows that share the class's smallest id and its text the one whose hash is the least, so that reruns agree;
    columns stay as they are. Null and empty texts are one class.
    """
    rows, told = _text_classes(df, id_col, text_col, least)
    # The first text of each class by (id, text); each text has its smallest id, so rows need no second look.
    first = rows.groupBy("copy").agg(F.min("id").alias("id")).join(told.select("copy", "component"), "copy")
    first = first.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "copy")).alias("x")).select(F.col("x.id").alias("_id"), F.col("x.copy").alias("_copy"))
    held = df.select(F.struct(*df.columns).alias("row"), F.col(id_col).cast("bigint").alias("id"), F.unhex(F.md5(text_of(text_col))).alias("copy"))
    chosen = held.join(first, (F.col("copy") == F.col("_copy")) & F.col("id").eqNullSafe(F.col("_id")), "left_semi")
    return chosen.groupBy("copy").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
