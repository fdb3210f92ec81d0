"""Alignment of tokenizers, exact dedup and fill-in-the-middle against brute force, and their edge cases."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
TEXTS = [None, "", "two words", "two  words", " two\twords\n", "<P>marked", "a <S> b", "x<M>", "tail <", "S> head\nP>\n<P\n", "line\n\nline\nend", "\n\n", "é中\U0001f600 a\nb", "▁ mark", "x\x00y\n", "<|endoftext|> plain <s>", "\r\na\x0bb\x0cc", "W" * 20_000 + "\n" + "w " * 20_000]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, t) for i, t in enumerate(TEXTS)] + [(2, "two words"), (2, "two words"), (None, "two words and more"), (None, None), (7, "same id")]
    return spark.createDataFrame(data, "doc_id long, text string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def clashing(df):
    """Columns that operators use inside."""
    return df.select("*", *[F.lit("x").alias(c) for c in ("id", "at", "digest", "n", "bucket", "pair", "pairs", "ends", "h0", "form", "output", "member", "rows", "old")])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_dedup(data):
    """One dict over all rows."""
    groups = {}
    for place, (i, text) in enumerate(data):
        groups.setdefault(sha(re.sub(r"[\x20\x09-\x0D]", "", text or "")), []).append((-len(text or ""), i is None, i or 0, place))
    out = []
    for digest, members in groups.items():
        best = min(members)
        out += [(None if m[1] else m[2], None if best[1] else best[2], len(members), m == best, digest) for m in members]
    return Counter(out)


@pytest.mark.parametrize("history", [None, "true", "false", "doc_id % 3 = 0"])
def test_exact_dedup_equals_one_dict(spark, rows, history):
    from attestry.llm.exact import exact_duplicates

    got = exact_duplicates(clashing(rows), history=None if history is None else F.expr(history))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "member", "text_sha256"]
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == plain_dedup([tuple(r) for r in rows.collect()])
    assert exact_duplicates(rows.limit(0)).count() == 0


def test_exact_dedup_tells_members(spark, rows):
    from attestry.llm.exact import exact_duplicates

    got = exact_duplicates(rows, history=F.col("doc_id") == 3).collect()
    assert {r.text_sha256 for r in got if r.member} == {sha("twowords")} and sum(r.member for r in got) == 5


def test_exact_dedup_of_documents(documents):
    from attestry.llm.exact import exact_duplicates

    data = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    got = exact_duplicates(documents.repartition(7))
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == plain_dedup(data)


def test_exact_dedup_with_one_hot_text(spark):
    from attestry.llm.exact import exact_duplicates

    df = spark.range(20_000).select((F.lit(20_000) - F.col("id")).alias("doc_id"), F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 4001)).alias("text"))
    kept = exact_duplicates(df).where("kept")
    assert kept.count() == 4002
    assert kept.where("group_size = 10000").first().doc_id == 2


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash_is_minimal_and_checks_nonmembers(n):
    from attestry.llm.exact import perfect_hash, slots_of

    rng = np.random.default_rng(n)
    digests = rng.integers(0, 256, (n, 32), dtype=np.uint8)
    levels = perfect_hash(digests)
    assert sorted(slots_of(levels, digests)) == list(range(n))
    assert sum(map(len, levels)) * 8 <= 5 * n + 64 * max(1, len(levels))
    others = slots_of(levels, rng.integers(0, 256, (1000, 32), dtype=np.uint8))
    assert len(others) == 1000 and others.max() < max(n, 1)
    if n > 1:
        with pytest.raises(ValueError, match="equal digests"):
            perfect_hash(np.concatenate([digests, digests[:1]]))


def plain_fim(i, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'' if i is None else i}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    p, m = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, len(units), "plain", None, None, text
    prefix, middle, suffix = "".join(units[:p]), "".join(units[p:m]), "".join(units[m:])
    if h[3] % 100 < spm:
        return i, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return i, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize(("rate", "spm"), [(100, 50), (60, 0), (100, 100), (0, 50)])
def test_fill_in_middle_equals_plain_cut(spark, rows, documents, rate, spm):
    from attestry.llm.fim import fill_in_middle, restored

    both = rows.unionByName(documents.select("doc_id", "text"))
    got = fill_in_middle(clashing(both), rate=rate, suffix_first=spm).withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    assert Counter(tuple(r)[:1] + tuple(r)[2:7] for r in got) == Counter(plain_fim(*r, rate, spm) for r in both.collect())
    assert all(r.back == r.text for r in got)
    assert fill_in_middle(rows.limit(0)).count() == 0


def test_fim_digests(rows):
    from attestry.llm.fim import fim_digests

    got = {(r.doc_id, r.restored_sha256): r for r in fim_digests(rows).collect()}
    for i, text in enumerate(TEXTS):
        want = plain_fim(i, text)
        r = got[i, sha(text or "")]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256) == (*want[1:5], sha(want[5]))


def plain_alignment(data):
    """Tokens by the tokenizers library itself, ends as sets, counts in one dict."""
    import sentencepiece
    from tokenizers import Tokenizer

    from attestry.llm.align import BYTE_MODEL, PIECE_MODEL, byte_letters

    a_model, b_model = Tokenizer.from_file(BYTE_MODEL), sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    a_model.encode_special_tokens = True
    letters = byte_letters()

    def b_bytes(i):
        p = b_model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()

    told, count = [], Counter()
    for i, text in data:
        want = (" " + (text or "")).encode()
        a = a_model.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        raw_a, raw_b = [bytes(letters[c] for c in a_model.id_to_token(x)) for x in a], [b_bytes(x) for x in b]
        if b"".join(raw_a) != want or b"".join(raw_b) != want:
            told.append((i, 0, 0, [], ""))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        at_b = {e: k for k, e in enumerate(ends_b)}
        both = [(k, at_b[e]) for k, e in enumerate(ends_a) if e in at_b]
        links = [(a[x], b[y]) for x, y in both]
        count.update(links)
        starts = [(0, 0)] + [(x + 1, y + 1) for x, y in both]
        text_of = ";".join(",".join(map(str, a[s : x + 1])) + "|" + ",".join(map(str, b[t : y + 1])) for (s, t), (x, y) in zip(starts, both, strict=False))
        told.append((i, len(a), len(b), links, sha(text_of)))
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    return Counter((i, n, m, len(links), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), digest) for i, n, m, links, digest in told)


@pytest.mark.parametrize("sent", [4_000_000, 0])
def test_alignment_equals_sets_of_ends(spark, rows, documents, monkeypatch, sent):
    from attestry.llm import align

    monkeypatch.setattr(align, "PAIRS_SENT", sent)
    both = rows.unionByName(documents.select("doc_id", "text"))
    got = align.align_tokenizers(clashing(both))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == plain_alignment([tuple(r) for r in both.collect()])
    assert align.align_tokenizers(rows.limit(0)).count() == 0


def test_alignment_side_equals_the_library():
    """Words are cut by the class of each character alone, so texts that show every class stand for all texts."""
    from tokenizers import Tokenizer

    from attestry.llm.align import BYTE_MODEL, sides

    model = Tokenizer.from_file(BYTE_MODEL)
    model.encode_special_tokens = True
    texts = [f" a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}b  {chr(c)}" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 61 == 0)]
    want = model.encode_batch(texts, add_special_tokens=False)
    assert all(sides()[0].encode(t) == w.ids for t, w in zip(texts, want, strict=True))


def test_pair_bound_covers_all_pairs():
    from attestry.llm.align import PAIRS_SENT, common_ends, pair_bound, sides

    assert pair_bound([b"ab", b"b"], [b"b", b"cab", b""]) == 4
    left, right = sides()
    assert pair_bound(left.bytes, right.bytes) <= PAIRS_SENT
    assert common_ends([1, 3, 6], [2, 3, 5, 6]) == ([1, 2], [1, 3])


@pytest.fixture(scope="module")
def edited():
    """(words, share of edited words, text, copy): scattered edits to texts of many lengths, all 0.8 alike or more by alignment."""
    from attestry.llm.near_text import alignment

    rng, out = np.random.default_rng(11), []
    for words in (60, 120, 400, 1000, 2000):
        for share in (0.04, 0.07, 0.09, 0.105):
            while sum(x[:2] == (words, share) for x in out) < 20:
                text = [f"w{i}" for i in rng.integers(0, 20_000, words)]
                copy = list(text)
                for i in rng.choice(words, int(share * words), replace=False):
                    copy[i] = f"x{rng.integers(1 << 40)}"
                if alignment([hash(t) for t in text], [hash(t) for t in copy]) >= 0.8:
                    out.append((words, share, " ".join(text), " ".join(copy)))
    return out


def test_near_text_recall_of_scattered_edits(spark, edited):
    """At least 0.9 of the pairs of each length and share of edits are found, each pair for itself."""
    from attestry.llm.near_text import near_duplicates

    rows = [(2 * i + j, pair[2 + j]) for i, pair in enumerate(edited) for j in (0, 1)]
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    cells = {}
    for i, (words, share, _, _) in enumerate(edited):
        cells.setdefault((words, share), []).append(found[2 * i + 1] == 2 * i)
        assert found[2 * i] == 2 * i
    assert {cell: sum(v) / len(v) for cell, v in cells.items() if sum(v) < 0.9 * len(v)} == {}


def test_secrets_leave_urls_identifiers_and_product_numbers(spark):
    """Of each kind of decoy at most 1 in 50 is taken for a secret, while keys among the same words are found."""
    import random
    import string

    from attestry.llm.secrets import fit_field, spans_of

    field = fit_field(spark.read.parquet(f"{SF}/documents.parquet"))
    r = random.Random(4)
    words = "get user name from http request handler parse value order item list make index total count first last".split()
    some = lambda n: "".join(r.choice(string.ascii_letters + string.digits) for _ in range(n))
    kinds = {
        "identifier": lambda: (lambda w: w[0] + "".join(x.capitalize() for x in w[1:]) + str(r.randint(1, 9)))(r.sample(words, r.randint(3, 7))),
        "product": lambda: "".join(r.choice(string.ascii_uppercase) + r.choice(string.ascii_uppercase) + str(r.randint(10, 99)) for _ in range(3)),
        "url": lambda: f"https://example.com/{some(20)}/page", "key": lambda: some(32), "prefixed": lambda: "ghp_" + some(36), "told": lambda: "pwd: " + some(10),
    }
    found = {kind: sum(bool(spans_of(f"we looked at {make()} in the long list of the things there", field)[1]) for _ in range(100)) for kind, make in kinds.items()}
    assert max(found[k] for k in ("identifier", "product", "url")) <= 2
    assert min(found[k] for k in ("key", "prefixed", "told")) >= 92


def test_base_spans_of_documents_equal_plain_matching(documents):
    """Every base span of the documents, by patterns written anew."""
    from attestry.llm.secrets import base_spans

    assign = re.compile("(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?[ ]*[:=][ ]*[\"']?([A-Za-z0-9+/_.=-]+)")
    for r in documents.select("text").collect():
        text = r.text or ""
        want = [(m.start(), "assign", m.end()) for m in assign.finditer(text) if len(m.group(1)) >= 6]
        want += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
        want += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
        assert base_spans(text) == sorted(want, key=lambda s: (s[0], ("assign", "access", "hex").index(s[1])))


def test_judged_rows_keep_columns_of_any_name(spark):
    from attestry.llm.urls import judge_urls

    df = spark.createDataFrame([(1, "http://a.net/x", "m", "b", "r")], "page_id long, url string, _maps string, _best string, row string")
    for most in (1 << 20, 1):
        got = judge_urls(df.withColumn("rule", F.lit("old")).withColumn("a.b", F.lit(1)), most_bytes=most).first()
        assert (got._maps, got._best, got.row, got["a.b"], got.host, got.rule, got.verdict) == ("m", "b", "r", 1, "a.net", "net/", "block")


def test_near_text_recall_of_lost_words(spark):
    """Copies that lost a fifth of their words all over the text, similarity 0.8: two words that stay are rarely neighbours still, but single words are found."""
    from attestry.llm.near_text import near_duplicates

    rng, rows = np.random.default_rng(5), []
    for words in (65, 120, 400, 1000):
        for _ in range(40):
            text = [f"w{i}" for i in rng.integers(0, 20_000, words)]
            gone = set(rng.choice(words, words // 5, replace=False).tolist())
            rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join(t for i, t in enumerate(text) if i not in gone))]
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    lost = [i for i in range(0, len(rows), 2) if found[i + 1] != i]
    assert all(found[i] == i for i in range(0, len(rows), 2)) and len(lost) <= 1


def chunk_bytes_a_token(katz):
    """The most memory that cutting a chunk into buckets holds beside its texts, in bytes a token."""
    import tracemalloc

    rng = np.random.default_rng(3)
    vocabulary = np.array([f"word{i}" for i in range(500)])
    texts = [(" ".join(vocabulary[rng.integers(0, 500, 2000)]), i % 7 == 2, i) for i in range(600)]
    codes = katz._Codes({w.encode(): i + 16 for i, w in enumerate(vocabulary.tolist())})
    tracemalloc.start()
    try:
        made = sum(1 for _ in katz._chunks(texts, codes, 8, np.arange(16, 48, dtype=np.uint64), 0))
        return made, tracemalloc.get_traced_memory()[1] / (600 * 2001)
    finally:
        tracemalloc.stop()


def test_lm_chunks_hold_few_bytes_a_token():
    """Two numbers of eight bytes, and little more: executors run two of these tasks beside Spark."""
    from attestry.llm import katz

    made, size = chunk_bytes_a_token(katz)
    assert made == 9 and size < 45


def test_near_text_buckets_of_the_same_texts_are_one(spark, monkeypatch):
    """Two near copies share most of their sketches; they meet in one bucket, not in each."""
    from attestry.llm import near_text

    words = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:200], "changed", *words[201:]])), (3, " ".join(f"v{i}" for i in range(400)))]
    written, write = [], near_text.write_table

    def seen(df):
        out = write(df)
        if out.columns == ["key", "hot", "id", "n", "p"]:
            written.append(sorted(r.id for r in out.collect()))
        return out

    monkeypatch.setattr(near_text, "write_table", seen)
    found = {r.doc_id: r.component_id for r in near_text.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: 1, 2: 1, 3: 3}
    assert written == [[1, 2]]


def test_near_text_buckets_keep_every_set_of_ids(spark):
    from attestry.llm.near_text import _buckets

    sets = [(1, 2, 3), (1, 2, 3), (3, 2, 1), (1, 2), (1, 3), (1, 1, 4), (1, 2, 2, 4), (1, 3, 3, 4), (1, 4), (9,), (5, 6, 8), (5, 7, 8), tuple(range(200)), tuple(range(200))]
    rows = [(i, key) for key, ids in enumerate(sets) for i in ids]
    out = {}
    for r in _buckets(spark.createDataFrame(rows, "id long, key long")).collect():
        out.setdefault(r.key, []).append(r.id)
    assert sorted(sorted(x) for x in out.values()) == sorted(list(x) for x in {tuple(sorted(x)) for x in sets if len(x) > 1})


def test_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    """Each scan and each broadcast takes megabytes of the driver, however small the tables are; rounds come by the dozen."""
    from attestry.llm import common

    plans, write = [], common.write_table

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(common, "write_table", seen)
    found = {r.node: r.component for r in common.connected_components(spark.createDataFrame([(1, 2), (2, 3), (4, 3), (9, 8), (7, 7)], "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}
    assert not [p for p in plans if "Broadcast" in p]
    assert max(p.count("Scan parquet") for p in plans) <= 8


def test_components_make_few_exchanges_and_no_round_on_stars(spark, monkeypatch):
    """Each exchange holds a thread of the driver for a minute; near-dedup on a small table made more of them in a minute than the driver had memory for."""
    from attestry.llm import common

    plans, write = [], common.write_table

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(common, "write_table", seen)
    found = {r.node: r.component for r in common.connected_components(spark.createDataFrame([(1, 2), (3, 1), (1, 3), (7, 8), (5, 5)], "a long, b long")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}
    assert len(plans) == 2
    plans.clear()
    edges = [(i, i + 1) for i in range(40)] + [(i, 100 + i % 7) for i in range(100, 140)] + [(200 + i, 200 + j) for i in range(9) for j in range(9)]
    found = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    head = {i: i for i in [*range(41), *range(100, 140), *range(200, 209)]}
    for _ in head:
        for a, b in edges:
            head[a] = head[b] = min(head[a], head[b])
    assert found == head
    assert max(p.count("Exchange") for p in plans) <= 4 and len(plans) > 2
