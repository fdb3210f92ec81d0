"""Queries: coded surveys, term counts, sources read back, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from attestry.functions.scalars import normalise
from attestry.operators import survey as Q
from attestry.operators.sampling import second_sample
from attestry.plans.registry import h32, query
from attestry.sources import readers as R
from attestry.sources.readers import recorded, table

FIELDS = ["o_orderstatus", "o_orderpriority"]
_LONG = "l AS (SELECT o_orderkey AS pos, 'o_orderstatus' AS field, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders), c AS (SELECT field, v, count(*) AS n, min(pos) AS first FROM l GROUP BY field, v), r AS (SELECT *, max(n) OVER (PARTITION BY field) AS top, row_number() OVER (PARTITION BY field ORDER BY n DESC, first) AS rn FROM c)"


@query("modal_pipeline", f'WITH {_LONG} SELECT field, v AS "value", n FROM r WHERE rn = 1')
def modal_pipeline(spark, sf):
    return Q.modal_values(table(spark, sf, "orders"), FIELDS, "o_orderkey").select("field", "value", "n")


@query("modal_ties", f"WITH {_LONG} SELECT field, CAST(CASE WHEN sum(CASE WHEN n = top THEN 1 ELSE 0 END) > 1 THEN 1 ELSE 0 END AS INT) AS tied FROM r GROUP BY field")
def modal_ties(spark, sf):
    return Q.modal_values(table(spark, sf, "orders"), FIELDS, "o_orderkey").select("field", "tied")


@query("multi_value_counts", 'WITH u AS (SELECT DISTINCT user_id, event_type FROM events), t AS (SELECT count(DISTINCT user_id) AS m FROM events), c AS (SELECT event_type AS v, count(*) AS n FROM u GROUP BY 1), k AS (SELECT v, n, n * 2 >= m AS half, sum(CASE WHEN n * 2 >= m THEN 1 ELSE 0 END) OVER () AS halves, rank() OVER (ORDER BY n DESC) AS rk FROM c, t) SELECT v AS "value", n FROM k WHERE CASE WHEN halves >= 2 THEN half ELSE rk <= 4 END')
def multi_value_counts(spark, sf):
    return Q.multi_value_modes(table(spark, sf, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("values")), "values")


RULES = {"lang": ("one_of", "en", "de", "fr"), "n_chars": ("count",), "share": ("unit",), "part": ("fraction",), "maybe": ("unit_or_blank",), "tags": ("subset", "a", "b"), "source": ("filled",), "note": ("free",)}


@query("rubric_violations", """WITH d AS (SELECT doc_id, lang, n_chars - 100 AS n_chars, (doc_id % 12) / CAST(10 AS DOUBLE) AS share, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 4) / CAST(3 AS DOUBLE) END AS part, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 7) / CAST(5 AS DOUBLE) END AS maybe,
 CASE doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'a;b' WHEN 2 THEN 'b;c' ELSE '' END AS tags, nullif(source, 'src1') AS source FROM documents)
 SELECT doc_id, 'lang' AS field, lang AS "value" FROM d WHERE lang NOT IN ('en', 'de', 'fr') UNION ALL SELECT doc_id, 'n_chars', CAST(n_chars AS VARCHAR) FROM d WHERE n_chars < 1 UNION ALL SELECT doc_id, 'share', CAST(share AS VARCHAR) FROM d WHERE share > 1
 UNION ALL SELECT doc_id, 'part', CAST(part AS VARCHAR) FROM d WHERE part <= 0 OR part >= 1 UNION ALL SELECT doc_id, 'maybe', CAST(maybe AS VARCHAR) FROM d WHERE maybe > 1 UNION ALL SELECT doc_id, 'tags', tags FROM d WHERE tags IN ('b;c', '') UNION ALL SELECT doc_id, 'source', NULL FROM d WHERE source IS NULL""")
def rubric_violations(spark, sf):
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select(
        "doc_id", "lang", (F.col("n_chars") - 100).alias("n_chars"), ((k % 12) / F.lit(10.0)).alias("share"), F.when(k % 5 != 0, (k % 4) / F.lit(3.0)).alias("part"), F.when(k % 5 != 0, (k % 7) / F.lit(5.0)).alias("maybe"),
        F.element_at(F.array(F.lit("a"), F.lit("a;b"), F.lit("b;c"), F.lit("")), (k % 4 + 1).cast("int")).alias("tags"), F.nullif("source", F.lit("src1")).alias("source"), F.lit("x").alias("note"),
    )
    return Q.rubric_violations(d, "doc_id", RULES)


@query("screen_until_n", "WITH s AS (SELECT o_orderkey, o_orderstatus, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders) SELECT o_orderkey, o_orderstatus, CAST(b AS BIGINT) AS before FROM s WHERE b < 30")
def screen_until_n(spark, sf):
    return Q.screen_until(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", F.col("o_orderstatus") == "F", 30)


_TWICE = """a AS (SELECT doc_id, lang, source, CAST(n_chars AS VARCHAR) AS n, 'x;y' AS tags, printf('%.4f', n_chars / CAST(7 AS DOUBLE)) AS share FROM documents), b AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS lang, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS source,
 CAST(CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE n_chars + 1 END AS VARCHAR) AS n, 'x;y' AS tags, printf('%.4f', (n_chars + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0.00001 END) / CAST(7 AS DOUBLE)) AS share FROM documents WHERE doc_id % 3 = 0)"""


@query("agreement_by_field", "WITH " + _TWICE + """, j AS (SELECT 'lang' AS field, coalesce(a.lang, '') = coalesce(b.lang, '') AS s FROM a JOIN b USING (doc_id) UNION ALL SELECT 'source', coalesce(a.source, '') = coalesce(b.source, '') FROM a JOIN b USING (doc_id) UNION ALL SELECT 'n', a.n = b.n FROM a JOIN b USING (doc_id)
 UNION ALL SELECT 'tags', a.tags = b.tags FROM a JOIN b USING (doc_id) UNION ALL SELECT 'share', a.share = b.share FROM a JOIN b USING (doc_id)),
 r AS (SELECT field, count(*) AS n, CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) AS BIGINT) AS agree, round_even(100 * avg(CASE WHEN s THEN CAST(1 AS DOUBLE) ELSE 0 END), 0) AS pct FROM j GROUP BY field
 UNION ALL SELECT 'overall', count(*), CAST(sum(CASE WHEN s THEN 1 ELSE 0 END) AS BIGINT), round_even(100 * avg(CASE WHEN s THEN CAST(1 AS DOUBLE) ELSE 0 END), 1) FROM j) SELECT *, CAST(CASE WHEN pct < 80 THEN 1 ELSE 0 END AS INT) AS low FROM r""")
def agreement_by_field(spark, sf):
    d = table(spark, sf, "documents")
    a = d.select("doc_id", "lang", "source", F.col("n_chars").alias("n"), F.lit("x;y").alias("tags"), (F.col("n_chars") / F.lit(7.0)).alias("share"))
    k = F.col("doc_id")
    b = d.where("doc_id % 3 = 0").select(
        "doc_id", F.when(k % 11 == 0, "xx").otherwise(F.col("lang")).alias("lang"), F.when(k % 7 != 0, F.col("source")).alias("source"), (F.col("n_chars") + F.when(k % 2 == 0, 0).otherwise(1)).alias("n"), F.lit("y;x").alias("tags"),
        ((F.col("n_chars") + F.when(k % 13 == 0, 1.0).otherwise(0.00001)) / F.lit(7.0)).alias("share"),
    )
    return Q.agreement(a, b, "doc_id", ["lang", "source", "n", "tags", "share"])


@query("normalised_lists", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN '' WHEN o_orderstatus < o_orderpriority THEN o_orderstatus || ';' || o_orderpriority ELSE o_orderpriority || ';' || o_orderstatus END AS v FROM orders")
def normalised_lists(spark, sf):
    raw = F.when(F.col("o_orderkey") % 5 != 0, F.concat_ws(";", "o_orderstatus", "o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", normalise(raw).alias("v"))


@query("differing_fields", f'WITH {_LONG}, a AS (SELECT field, v FROM r WHERE rn = 1), b AS (SELECT field, v FROM (SELECT field, v, row_number() OVER (PARTITION BY field ORDER BY n, first) AS rn FROM c) WHERE rn = 1) SELECT a.field, a.v AS first, b.v AS second FROM a JOIN b ON a.field = b.field WHERE a.v <> b.v')
def differing_fields(spark, sf):
    o = table(spark, sf, "orders")
    a = Q.modal_values(o, FIELDS, "o_orderkey").select("field", "value")
    long = o.select("o_orderkey", *FIELDS).unpivot(["o_orderkey"], FIELDS, "field", "value").groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))
    b = long.withColumn("rn", F.row_number().over(Window.partitionBy("field").orderBy("n", "first"))).where("rn = 1").select("field", "value")
    return Q.differing_fields(a, b, "field")


@query("accuracy_summary", "WITH @rec, a AS (SELECT grp, avg(CASE WHEN (n_chars > 300) = (y = 1) THEN CAST(1 AS DOUBLE) ELSE 0 END) AS acc FROM rec GROUP BY grp) SELECT count(acc) AS n, round(median(acc), 4) AS med, round(quantile_cont(acc, 0.25), 4) AS q1, round(quantile_cont(acc, 0.75), 4) AS q3, round(min(acc), 4) AS lo, round(max(acc), 4) AS hi FROM a")
def accuracy_summary(spark, sf):
    a = recorded(spark, sf).groupBy("grp").agg(F.avg(((F.col("n_chars") > 300) == (F.col("y") == 1)).cast("double")).alias("acc"))
    return a.agg(F.count("acc").alias("n"), F.round(F.median("acc"), 4).alias("med"), F.round(F.percentile("acc", F.lit(0.25)), 4).alias("q1"), F.round(F.percentile("acc", F.lit(0.75)), 4).alias("q3"), F.round(F.min("acc"), 4).alias("lo"), F.round(F.max("acc"), 4).alias("hi"))


@query("share_strings", "WITH @rec SELECT site, CAST(sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS VARCHAR) || '/' || CAST(count(y) AS VARCHAR) AS share FROM rec GROUP BY site")
def share_strings(spark, sf):
    return recorded(spark, sf).groupBy("site").agg(F.concat(F.count_if(F.col("y") == 1).cast("string"), F.lit("/"), F.count("y").cast("string")).alias("share"))


#: Practices as conditions on the study frame, the same text for both engines.
PRACTICES = {"long_rows": "n_chars > 1000", "no_slope": "slope IS NULL", "spaced": "nsp > 100", "english": "site = 'en'", "zero_kept": "slope = 0", "no_spaces_known": "nsp IS NULL", "one_source": "grp = 'src1'"}
_PRACTICES = "p AS (" + " UNION ALL ".join(f"SELECT '{k}' AS practice, CAST(sum(CASE WHEN {v} THEN 1 ELSE 0 END) AS BIGINT) AS n, count(*) AS of_n FROM rec" for k, v in PRACTICES.items()) + ")"


@query("practice_counts", f"WITH @rec, {_PRACTICES} SELECT practice, n FROM p")
def practice_counts(spark, sf):
    return recorded(spark, sf).agg(*[F.count_if(F.expr(v)).alias(k) for k, v in PRACTICES.items()]).unpivot([], list(PRACTICES), "practice", "n")


@query("practice_bars", f"WITH @rec, {_PRACTICES} SELECT practice, n, of_n, row_number() OVER (ORDER BY n, practice) AS place, n || ' of ' || of_n AS label FROM p")
def practice_bars(spark, sf):
    """The bars of the practice figure, in order of their counts; as many rows as practices."""
    bars = recorded(spark, sf).agg(F.count(F.lit(1)).alias("of_n"), *[F.count_if(F.expr(v)).alias(k) for k, v in PRACTICES.items()]).unpivot(["of_n"], list(PRACTICES), "practice", "n")
    place = F.row_number().over(Window.orderBy("n", "practice"))
    return bars.select("practice", "n", "of_n", place.cast("bigint").alias("place"), F.concat(F.col("n").cast("string"), F.lit(" of "), F.col("of_n").cast("string")).alias("label"))


# Terms that are counted in a description, and those that count as disclosure.
TERMS = ("missing", "imput", "fill", "?", "NaN", "null", "zero", "duplicat", "1190", "918")
DISCLOSING = ("missing", "imput", "fill", "?", "NaN", "null")
#: Terms that the pages here do hold, counted in the same way.
PAGE_TERMS = ("article", "the", "&amp;", "example.")


def _terms(column, terms):
    low = F.lower(column)
    return [F.regexp_count(low, F.lit("\\Q" + t.lower() + "\\E")).cast("bigint") for t in terms]


def _terms_sql(column, terms):
    return [f"CAST((length(lower({column})) - length(replace(lower({column}), '{t.lower()}', ''))) / {len(t)} AS BIGINT)" for t in terms]


@query("term_counts", "SELECT page_id, " + ", ".join(f"{c} AS t{i}" for i, c in enumerate(_terms_sql("html", PAGE_TERMS))) + ", CAST(CASE WHEN contains(lower(html), 'track(') THEN 1 ELSE 0 END AS INT) AS disclosed FROM pages")
def term_counts(spark, sf):
    counts = [c.alias(f"t{i}") for i, c in enumerate(_terms("html", PAGE_TERMS))]
    return table(spark, sf, "pages").select("page_id", *counts, F.contains(F.lower("html"), F.lit("track(")).cast("int").alias("disclosed"))


@query("disclosure_check", "SELECT page_id, length(html) AS chars, " + ", ".join(f"{c} AS t{i}" for i, c in enumerate(_terms_sql("html", TERMS))) + f", CAST(CASE WHEN {' OR '.join(f'contains(lower(html), {chr(39)}{t.lower()}{chr(39)})' for t in DISCLOSING)} THEN 1 ELSE 0 END AS INT) AS disclosed FROM pages")
def disclosure_check(spark, sf):
    counts = _terms("html", TERMS)
    told = sum((c for c, t in zip(counts, TERMS, strict=True) if t in DISCLOSING), F.lit(0).cast("bigint")) > 0
    return table(spark, sf, "pages").select("page_id", F.length("html").cast("bigint").alias("chars"), *[c.alias(f"t{i}") for i, c in enumerate(counts)], told.cast("int").alias("disclosed"))


_SUMMARY = """f AS (SELECT rid, site, grp, CAST(slope AS VARCHAR) AS slope, CASE rid % 3 WHEN 0 THEN 'lr' WHEN 1 THEN 'lr;rf' ELSE 'rf;svm' END AS models, (n_chars % 100) / CAST(100 AS DOUBLE) AS acc FROM rec),
 l AS (SELECT rid AS pos, 'site' AS field, site AS v FROM f UNION ALL SELECT rid, 'slope', slope FROM f), c AS (SELECT field, v, count(*) AS n, min(pos) AS first FROM l WHERE v IS NOT NULL GROUP BY field, v),
 r AS (SELECT *, max(n) OVER (PARTITION BY field) AS top, row_number() OVER (PARTITION BY field ORDER BY n DESC, first) AS rn, sum(n) OVER (PARTITION BY field) AS of_n FROM c), t AS (SELECT field, sum(CASE WHEN n = top THEN 1 ELSE 0 END) AS ties FROM r GROUP BY field),
 m AS (SELECT v, count(*) AS n FROM (SELECT unnest(string_split(models, ';')) AS v FROM f) GROUP BY v), k AS (SELECT *, sum(CASE WHEN n * 2 >= (SELECT count(*) FROM f) THEN 1 ELSE 0 END) OVER () AS halves, rank() OVER (ORDER BY n DESC) AS rk FROM m)"""


@query("survey_summary", f"""WITH @rec, {_SUMMARY} SELECT 'modal' AS part, field, v AS "value" FROM r WHERE rn = 1 UNION ALL SELECT 'share', field, n || '/' || of_n FROM r WHERE rn = 1 UNION ALL SELECT 'tie', field, '' FROM t WHERE ties > 1 UNION ALL SELECT 'count', v, CAST(n AS VARCHAR) FROM m
 UNION ALL SELECT 'modal_model', v, CAST(n AS VARCHAR) FROM k WHERE CASE WHEN halves >= 2 THEN n * 2 >= (SELECT count(*) FROM f) ELSE rk <= 4 END
 UNION ALL SELECT 'accuracy', u.k, printf('%.4f', round(u.x, 4)) FROM (SELECT unnest(['n', 'median', 'q1', 'q3', 'min', 'max']) AS k, unnest([CAST(count(acc) AS DOUBLE), median(acc), quantile_cont(acc, 0.25), quantile_cont(acc, 0.75), min(acc), max(acc)]) AS x FROM f) u""")
def survey_summary(spark, sf):
    models = F.element_at(F.array(F.lit("lr"), F.lit("lr;rf"), F.lit("rf;svm")), (F.col("rid") % 3 + 1).cast("int"))
    f = recorded(spark, sf).select("rid", "site", F.col("slope").cast("string").alias("slope"), models.alias("models"), ((F.col("n_chars") % 100) / F.lit(100.0)).alias("acc"))
    return Q.summarise(f, ["site", "slope"], "models", "acc", "rid")


_ORDER = f"""o AS (SELECT conv_id, turn, dense_rank() OVER (ORDER BY {h32('9', "'repo'", 'conv_id')}, conv_id) AS position, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM (SELECT DISTINCT conv_id, turn FROM conversations WHERE role <> 'system'))"""


@query("screen_records", f"""WITH {_ORDER}, r AS (SELECT position || '-' || k AS file, turn + CASE WHEN conv_id % 9 = 0 THEN 1 ELSE 0 END AS turn, position, k, conv_id AS cid, o.turn AS ot, CASE WHEN conv_id % 3 = 0 THEN 'exclude' ELSE 'include' END AS decision FROM o WHERE k = 1),
 d AS (SELECT file, position, k, cid AS conv_id, ot AS turn, CASE WHEN decision = 'include' AND cid % 5 = 0 THEN 'exclude' ELSE decision END AS decision, CASE WHEN decision = 'include' AND cid % 5 = 0 THEN 'E4' END AS criterion, ot = turn AS known FROM r),
 b AS (SELECT *, coalesce(sum(CASE WHEN decision = 'include' THEN 1 ELSE 0 END) OVER (ORDER BY position, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d) SELECT file, position, k, conv_id, turn, decision, criterion, known, CAST(before AS BIGINT) AS before FROM b WHERE before < 30""")
def screen_records(spark, sf):
    order = Q.screening_order(table(spark, sf, "conversations").where("role <> 'system'"), "conv_id", "turn", 9)
    first = order.where("k = 1").withColumn("file", F.concat(F.col("position").cast("string"), F.lit("-"), F.col("k").cast("string")))
    records = first.select("file", (F.col("turn") + F.when(F.col("conv_id") % 9 == 0, 1).otherwise(0)).alias("turn"), F.when(F.col("conv_id") % 3 == 0, "exclude").otherwise("include").alias("decision"))
    copies = first.where("conv_id % 5 = 0").select("file")
    return Q.screen_records(order, records, copies, "conv_id", "turn", 30)


@query("override_by_key", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 AND doc_id % 20 = 0 THEN NULL WHEN doc_id % 10 = 0 THEN 'resolved' ELSE lang END AS lang FROM documents")
def override_by_key(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang")
    changes = d.where("doc_id % 10 = 0").select("doc_id", F.when(F.col("doc_id") % 20 != 0, "resolved").alias("lang"))
    return Q.override(d, changes, ["doc_id"], "lang")


@query("second_coder_sample", f"SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (ORDER BY {h32('4', chr(39) + 'second' + chr(39), 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= 10")
def second_coder_sample(spark, sf):
    return second_sample(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id", 4, 10)


@query("url_fields", "SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, replace(replace(replace(replace(replace(replace(url, ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), '#', '%23'), '&', '%26') AS quoted FROM pages")
def url_fields(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.coalesce(F.expr("try_parse_url(url, 'QUERY', 'page')"), F.lit("")).alias("page"), F.expr("try_parse_url(url, 'PROTOCOL')").alias("protocol"), F.url_encode("url").alias("quoted"))


@query("null_token_csv", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 4 = 1 THEN NULL ELSE o_orderstatus END AS status, 'orders' AS source FROM orders")
def null_token_csv(spark, sf):
    o = table(spark, sf, "orders")
    path = R.scratch_dir(spark)
    out = o.select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice").cast("string")).otherwise("?").alias("p"), F.when(F.col("o_orderkey") % 4 != 1, F.col("o_orderstatus")).otherwise("?").alias("s"))
    out.write.csv(path)
    return R.read_sites(spark, {"orders": path}, "o_orderkey bigint, price double, status string")


@query("blank_null_csv", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'NA' ELSE c_mktsegment END AS segment, coalesce(CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'x' END, 'none') AS dropped FROM customer")
def blank_null_csv(spark, sf):
    path = R.scratch_dir(spark)
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 1, "NA").when(F.col("c_custkey") % 3 == 2, F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_custkey") % 3 != 0, "x").alias("dropped"))
    R.write_csv(c, path)
    return R.read_csv(spark, path, "c_custkey bigint, segment string, dropped string", header=True).withColumn("dropped", F.coalesce("dropped", F.lit("none")))


@query("whitespace_scan", "SELECT s_suppkey, CAST(s_nationkey AS INT) AS nation, CAST(s_acctbal AS DOUBLE) AS balance, CAST(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS INT) AS target, 'statlog' AS source FROM supplier")
def whitespace_scan(spark, sf):
    path = R.scratch_dir(spark)
    s = table(spark, sf, "supplier")
    s.select(F.concat(F.lit("  "), F.col("s_suppkey"), F.lit("   "), F.col("s_nationkey"), F.lit("\t"), F.col("s_acctbal"), F.lit(" "), F.when(F.col("s_suppkey") % 2 == 0, 2).otherwise(1)).alias("value")).write.text(path)
    return R.read_whitespace(spark, path, "s_suppkey bigint, nation int, balance double, cls int").withColumn("target", (F.col("cls") == 2).cast("int")).drop("cls").withColumn("source", F.lit("statlog"))


@query("json_explode", "SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id")
def json_explode(spark, sf):
    path = R.scratch_dir(spark)
    c = table(spark, sf, "conversations").groupBy((F.col("conv_id") % 8).alias("g")).agg(F.collect_list(F.struct("conv_id", "turn", "role", "text")).alias("items"))
    c.select("items").write.option("maxRecordsPerFile", 1).json(path)  # one object a file, as a snapshot is
    back = R.read_items(spark, path, "conv_id:bigint,turn:bigint,role:string,text:string")
    return back.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).cast("bigint").alias("chars"))


@query("json_records", "SELECT conv_id || '-' || turn AS file, role AS decision FROM conversations WHERE conv_id % 4 = 0")
def json_records(spark, sf):
    """Records of JSON arrays in many files, the suffix of their file name taken off."""
    path = R.scratch_dir(spark)
    c = table(spark, sf, "conversations").where("conv_id % 4 = 0")
    rows = c.groupBy((F.col("conv_id") % 8).alias("g")).agg(F.collect_list(F.struct(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".txt")).alias("file"), F.col("role").alias("decision"))).alias("r"))
    rows.select(F.to_json("r").alias("value")).write.option("maxRecordsPerFile", 1).text(path)  # one array a file
    return R.read_json_records(spark, path, "file string, decision string")


@query("date_parts", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def date_parts(spark, sf):
    return table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.unix_timestamp("ts").alias("seconds"))


@query("event_props", "SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def event_props(spark, sf):
    return table(spark, sf, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


@query("notebook_flatten", "SELECT conv_id, '### [0] markdown' || chr(10) || string_agg(text, '' ORDER BY turn) || chr(10) || '### [1] code' || chr(10) || 'x' || chr(10) || substr(string_agg(text, '' ORDER BY turn), 1, 3000) AS flat FROM conversations GROUP BY conv_id")
def notebook_flatten(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    none = F.array().cast("array<struct<text:array<string>>>")
    cells = F.array(F.struct(F.lit("markdown").alias("cell_type"), F.col("t").alias("source"), none.alias("outputs")), F.struct(F.lit("code").alias("cell_type"), F.array(F.lit("x")).alias("source"), F.array(F.struct(F.col("t").alias("text"))).alias("outputs")))
    return R.flatten_notebooks(c.select("conv_id", F.to_json(F.struct(cells.alias("cells"))).alias("content"))).select("conv_id", "flat")


#: Digests that are pinned: of files written here, whose bytes follow from the tables.
_LINES = "string_agg(r_regionkey || ',' || r_name || chr(10), '' ORDER BY r_regionkey)"


@query("digest_check", f"SELECT 'pinned' AS state, sha256({_LINES}) AS sha256, md5({_LINES}) AS md5 FROM region UNION ALL SELECT 'tampered', NULL, NULL")
def digest_check(spark, sf):
    """The digest of a written file against its pin; a pin of other bytes has to be refused."""
    path = R.scratch_dir(spark)
    body = table(spark, sf, "region").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(",", "r_regionkey", "r_name"))), "\n").alias("value"))
    body.coalesce(1).write.text(path)
    found = R.file_digests(spark, f"{path}/*.txt")
    pin = body.select(F.sha2(F.concat("value", F.lit("\n")), 256).alias("sha256")).first()[0]
    named = found.withColumn("file", F.lit("region.csv"))
    R.verify_digests(named, R.pins_frame(spark, [R.Pin("region.csv", (), "sha256", pin)]))
    try:
        R.verify_digests(named, R.pins_frame(spark, [R.Pin("region.csv", (), "sha256", "0" * 64)]))
        state = "accepted"
    except R.DigestMismatch:
        state = "tampered"
    return named.select(F.lit("pinned").alias("state"), "sha256", "md5").unionByName(spark.createDataFrame([(state, None, None)], "state string, sha256 string, md5 string"))


@query("knn_predict", """WITH q AS (SELECT vec_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0), e AS (SELECT q.vec_id, q.label AS truth, e.label, e.vec_id AS near, round(list_sum(list_transform(list_zip(q.embedding, e.embedding), lambda x: power(CAST(x[1] AS DOUBLE) - CAST(x[2] AS DOUBLE), 2))), 9) AS d FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
 d AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, near) AS rn FROM e),
 v AS (SELECT k, weights, vec_id, truth, label, round(sum(CASE WHEN weights = 'uniform' THEN CAST(1 AS DOUBLE) WHEN d = 0 THEN CAST(1e30 AS DOUBLE) ELSE 1 / sqrt(d) END), 9) AS n FROM d, (VALUES (5), (15), (31), (51)) t(k), (VALUES ('uniform'), ('distance')) u(weights) WHERE rn <= k GROUP BY k, weights, vec_id, truth, label)
 SELECT k, weights, vec_id, truth, label AS predicted FROM (SELECT *, row_number() OVER (PARTITION BY k, weights, vec_id ORDER BY n DESC, label) AS r FROM v) WHERE r = 1""")
def knn_predict(spark, sf):
    from attestry.operators.learning import knn_vote

    e = table(spark, sf, "embeddings")
    return knn_vote(e.where("vec_id % 50 = 0"), e, "vec_id", "embedding", "label", [5, 15, 31, 51], ("uniform", "distance"))
