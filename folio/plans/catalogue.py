"""The registered catalogue queries over the driver tables, and the SQL that each agrees with.

The driver tables hold no books, so `part` stands for catalogue records and mentions, `customer` for records to compare,
`events` for observations, `embeddings` for 8 by 8 images, `documents` and `conversations` for recognised text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, similarity as sim, text
from ..operators import images, mentions, observe, resolve, segment, triage, views
from ..operators.ranking import numbered
from ..sources import export, recognition, records
from . import oracle as o

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_units(ts: Column, ms: int) -> Column:
    """Whole units of so many milliseconds since 1970, towards it on both sides, as the SQL's // has them."""
    return F.call_function("div", F.unix_millis(ts.cast("timestamp")), F.lit(ms))


def book_isbn(key: Column) -> Column:
    body = F.concat(F.lit("978"), F.lpad(key.cast("string"), 9, "0"))
    return F.concat(body, ids.check_digit_13(body))


@query(f"""
SELECT p_partkey, code13, substr(code13, 13, 1) = {o.check13('code13')} AS valid13,
       code10, substr(code10, 10, 1) = {o.check10('code10')} AS valid10,
       CASE WHEN substr(code10, 10, 1) = {o.check10('code10')} THEN {o.isbn13("substr(code10, 1, 9)")} END AS from10
FROM (SELECT p_partkey, '978' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || CAST(p_size % 10 AS VARCHAR) AS code13,
             lpad(CAST(p_partkey AS VARCHAR), 9, '0') || CASE WHEN p_size % 11 = 10 THEN 'X' ELSE CAST(p_size % 11 AS VARCHAR) END AS code10 FROM part)""")
def isbn_validate(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    key, r = F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.col("p_size") % 11
    p = p.select("p_partkey", F.concat(F.lit("978"), key, (F.col("p_size") % 10).cast("string")).alias("code13"), F.concat(key, F.when(r == 10, "X").otherwise(r.cast("string"))).alias("code10"))
    return p.select("p_partkey", "code13", ids.is_isbn13(F.col("code13")).alias("valid13"), "code10", ids.is_isbn10(F.col("code10")).alias("valid10"), ids.isbn10_to_13(F.col("code10")).alias("from10"))


@query(f"""
SELECT p_partkey, {o.isbn13("lpad(CAST(p_partkey AS VARCHAR), 9, '0')")} AS isbn13 FROM part""")
def isbn_extract(spark, sf_dir):
    # A row costs much for its bytes: dealt by key, as a small file is read by few tasks. Codes are columns of their own, so each is made once.
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name").repartition("p_partkey")
    p = p.select("*", book_isbn(F.col("p_partkey")).alias("code"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("key"))
    p = p.withColumn("last", ids.check_digit_10(F.col("key")))
    code, key = F.col("code"), F.col("key")
    long = F.concat(F.substring(code, 1, 3), F.lit("-"), F.substring(code, 4, 5), F.lit("-"), F.substring(code, 9, 4), F.lit("-"), F.substring(code, 13, 1))
    short = F.concat(F.substring(key, 1, 4), F.lit(" "), F.substring(key, 5, 5), F.lit("-"), F.col("last"))
    line = F.concat(F.col("p_name"), F.lit(" ISBN"), F.when(F.col("p_partkey") % 2 == 0, long).otherwise(short), F.lit(" C3047"))
    return p.select("p_partkey", ids.extract_isbn13(line).alias("isbn13"))


@query(f"""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN {o.isbn13("lpad(CAST(o_orderkey AS VARCHAR), 9, '0')")} END AS isbn13 FROM orders""")
def barcode_pick(spark, sf_dir):
    d = table(spark, sf_dir, "orders")
    good = book_isbn(F.col("o_orderkey"))
    wrong = F.concat(F.substring(good, 1, 12), F.pmod(F.substring(good, 13, 1).cast("int") + 1, F.lit(10)).cast("string"))
    book = F.when(F.col("o_orderkey") % 3 == 0, wrong).otherwise(good)
    price = F.concat(F.lit("192"), F.substring(good, 4, 10))
    return d.select("o_orderkey", ids.pick_isbn13(F.when(F.col("o_orderkey") % 2 == 0, F.array(price, book)).otherwise(F.array(book, price))).alias("isbn13"))


@query(f"""
SELECT p_partkey, p_name || ' : ' || p_type || ' Vol. ' || CAST(p_size AS VARCHAR) AS tidied, {o.key('p_name || p_type')} || 'vol' || CAST(p_size AS VARCHAR) AS key,
       p_name AS main, p_type AS sub, CAST(p_size AS VARCHAR) AS volume FROM part""")
def title_keys(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    t = F.concat(F.lit(" \t"), F.col("p_name"), F.lit("  : "), F.col("p_type"), F.lit("　 Vol. "), F.col("p_size").cast("string"), F.lit("\n"))
    s = text.split_title(t)
    return p.select("p_partkey", text.tidy(t).alias("tidied"), text.match_key(t, folded=True).alias("key"), s["main"].alias("main"), s["sub"].alias("sub"), s["volume"].alias("volume"))


@query(f"""
WITH n AS (SELECT DISTINCT {o.key('p_name')} AS k FROM part), g AS (SELECT k, {o.grams('k')} AS gs FROM n)
SELECT a.k AS a, b.k AS b, round({o.dice('a.gs', 'b.gs')}, 6) AS dice, round({o.lev('a.k', 'b.k')}, 6) AS edit, round({o.contain('a.k', 'b.k')}, 6) AS contained,
       round({o.title('a.k', 'b.k', 'a.gs', 'b.gs')}, 6) AS title_sim FROM g a, g b WHERE list_has_any(a.gs, b.gs)""")
def title_similarity_pairs(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(sim.title_key(F.col("p_name"), True).alias("k")).distinct()
    pairs = resolve.blocked_pairs(n.toDF("a"), "a", n.toDF("b"), "b")
    a, b = F.col("a"), F.col("b")
    return pairs.select("a", "b", F.round(sim.dice(a, b), 6).alias("dice"), F.round(sim.levenshtein_ratio(a, b), 6).alias("edit"), F.round(sim.containment(a, b), 6).alias("contained"), F.round(sim.title_similarity(a, b), 6).alias("title_sim"))


@query(f"""
WITH k AS (SELECT DISTINCT p_brand, p_type, {o.key('p_brand')} AS b, {o.key('p_type')} AS t FROM part), g AS (SELECT *, {o.grams('b')} AS gb, {o.grams('t')} AS gt FROM k)
SELECT p_brand, p_type, round((greatest({o.dice('gb', 'gt')}, {o.lev('b', 't')}, {o.contain('b', 't')}) + 1.0) / 2, 6) AS both_of_one, 1.0 AS one_of_both, 0.5 AS none FROM g""")
def author_similarity(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_brand", "p_type").distinct()
    both, one, none = sim.author_keys(F.array("p_brand", "p_type")), sim.author_keys(F.array("p_type")), F.array().cast("array<string>")
    d = d.withColumn("both", both).withColumn("one", one)
    return d.select("p_brand", "p_type", F.round(sim.author_similarity(F.col("both"), F.col("one")), 6).alias("both_of_one"), F.round(sim.author_similarity(F.col("one"), F.col("both")), 6).alias("one_of_both"), sim.author_similarity(none, F.col("one")).alias("none"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'googleBooks' WHEN 1 THEN 'googleBooks' ELSE 'ndl' END AS route,
       c_custkey % 4 IN (1, 3) AS publisher, c_custkey % 4 IN (0, 2) AS author, CASE c_custkey % 4 WHEN 2 THEN '山田太郎' ELSE name END AS stripped
FROM (SELECT *, CASE c_custkey % 4 WHEN 0 THEN upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Smith' WHEN 1 THEN c_mktsegment || ' Press'
      WHEN 2 THEN '山田太郎／著' ELSE '第' || CAST(c_nationkey AS VARCHAR) || '出版会' END AS name FROM customer)""")
def role_classify(spark, sf_dir):
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat(F.initcap("c_mktsegment"), F.lit(" Smith"))).when(k == 1, F.concat("c_mktsegment", F.lit(" Press"))).when(k == 2, "山田太郎／著").otherwise(F.concat(F.lit("第"), F.col("c_nationkey").cast("string"), F.lit("出版会")))
    c = c.select("c_custkey", name.alias("name"))
    n = F.col("name")
    return c.select("c_custkey", text.language_route(n).alias("route"), text.looks_like_publisher(n).alias("publisher"), text.looks_like_author(n).alias("author"), text.strip_author_role(n).alias("stripped"))


@query(f"""
SELECT doc_id, CAST(u.i - 1 AS INTEGER) AS pos, ls[u.i] AS text, 1.0 AS confidence
FROM (SELECT doc_id, {o.lines('text')} AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)""")
def fragments_from_text(spark, sf_dir):
    return mentions.fragments_from_text(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS raw_text FROM conversations GROUP BY conv_id")
def raw_text(spark, sf_dir):
    return mentions.raw_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


def _queries(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type").distinct()
    lines = F.array("p_name", "p_brand", "p_type")
    return p.select("p_name", "p_brand", "p_type", mentions.build_queries(F.col("p_name"), F.array("p_brand"), lines).alias("q"))


@query(f"""
WITH p AS (SELECT DISTINCT p_name, p_brand, p_type, length(p_name) AS n FROM part),
s AS (SELECT *, [struct_pack(t := p_name, m := 'title', a := {o.key('p_brand')}), struct_pack(t := substr(p_name, 1, n - 1), m := 'title', a := ''),
  struct_pack(t := CASE WHEN {o.publisher('p_brand')} THEN '' ELSE p_name || ' ' || p_brand END, m := 'title', a := ''),
  struct_pack(t := array_to_string(list_filter([p_name, p_brand, p_type], lambda x: NOT {o.publisher('x')}), ' '), m := 'title', a := ''),
  struct_pack(t := p_name || ' ' || p_brand || ' ' || p_type, m := 'any', a := ''),
  struct_pack(t := CASE WHEN greatest(4, n // 2) < n - 1 THEN substr(p_name, 1, greatest(4, n // 2)) ELSE '' END, m := 'any', a := '')] AS q FROM p WHERE n > 5),
f AS (SELECT p_name, p_brand, p_type, list_filter(q, lambda x: trim(x.t) <> '') AS q FROM s),
k AS (SELECT *, list_transform(q, lambda x: x.m || '|' || {o.key('x.t')} || '|' || x.a) AS ks FROM f),
d AS (SELECT p_name, p_brand, p_type, list_filter(q, lambda x, i: list_position(ks, ks[i]) = i) AS q FROM k)
SELECT p_name, p_brand, p_type, CAST(u.i - 1 AS INTEGER) AS pos, trim(q[u.i].t) AS title, q[u.i].m AS mode, len(q) <= 3 OR u.i < 3 OR u.i = len(q) AS tried
FROM d, unnest(range(1, len(q) + 1)) AS u(i)""")
def build_queries(spark, sf_dir):
    d = _queries(spark, sf_dir).filter(F.length("p_name") > 5).withColumn("tried", mentions.attempts(F.col("q")))
    d = d.select("p_name", "p_brand", "p_type", "tried", F.posexplode("q").alias("pos", "x"))
    return d.select("p_name", "p_brand", "p_type", "pos", "x.title", "x.mode", F.array_contains("tried", F.col("x")).alias("tried"))


@query("""
WITH q AS (SELECT DISTINCT p_name, p_brand FROM part), r AS (SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey % 3 <> 0),
m AS (SELECT q.p_name, q.p_brand, r.p_partkey, CASE WHEN q.p_name = r.p_name AND q.p_brand = r.p_brand THEN 1 WHEN list_has_all(string_split(r.p_name, ' '), string_split(q.p_name, ' ')) THEN 2 ELSE 3 END AS step
      FROM q JOIN r ON list_has_any(string_split(q.p_name, ' '), string_split(r.p_name, ' '))),
b AS (SELECT *, min(step) OVER (PARTITION BY p_name, p_brand) AS best FROM m),
n AS (SELECT *, CASE WHEN step = best THEN 1 END AS hit FROM b)
SELECT p_name, p_brand, p_partkey AS record_id, step, CAST(row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) AS INTEGER) AS rank FROM n WHERE hit = 1
QUALIFY row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) <= 10""")
def relaxed_search(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    words, author = F.split("p_name", " "), sim.author_keys(F.array("p_brand"))[0]
    q = p.select("p_name", "p_brand").distinct().select(F.struct("p_name", "p_brand").alias("query_id"), words.alias("words"), author.alias("author_key"))
    r = p.filter("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("record_id"), words.alias("words"), author.alias("author_key"))
    return resolve.relaxed_search(q, r).select("query_id.*", "record_id", "step", "rank")


@query("""
WITH q AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 2 THEN p_name || ' zzz' ELSE p_name END AS p_name, CASE WHEN p_partkey % 3 = 1 THEN 'nobody' ELSE p_brand END AS p_brand FROM part),
m AS (SELECT q.p_name, q.p_brand, r.p_partkey, CASE WHEN NOT list_has_all(string_split(r.p_name, ' '), string_split(q.p_name, ' ')) THEN 3 WHEN q.p_brand = r.p_brand THEN 1 ELSE 2 END AS step
      FROM q JOIN part r ON list_has_any(string_split(q.p_name, ' '), string_split(r.p_name, ' ')))
SELECT p_name, p_brand, p_partkey AS record_id, step, CAST(row_number() OVER (PARTITION BY p_name, p_brand ORDER BY step, p_partkey) AS INTEGER) AS rank FROM m
QUALIFY step = min(step) OVER (PARTITION BY p_name, p_brand) AND row_number() OVER (PARTITION BY p_name, p_brand ORDER BY step, p_partkey) <= 10""")
def relaxed_search_all(spark, sf_dir):
    """relaxed_search over every record; a third of the queries names another author, a third has a word more."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    words, author = F.split("p_name", " "), sim.author_keys(F.array("p_brand"))[0]
    altered = p.select(F.when(k == 2, F.concat("p_name", F.lit(" zzz"))).otherwise(F.col("p_name")).alias("p_name"), F.when(k == 1, "nobody").otherwise(F.col("p_brand")).alias("p_brand"))
    q = altered.distinct().select(F.struct("p_name", "p_brand").alias("query_id"), words.alias("words"), author.alias("author_key"))
    r = p.select(F.col("p_partkey").alias("record_id"), words.alias("words"), author.alias("author_key"))
    return resolve.relaxed_search(q, r).select("query_id.*", "record_id", "step", "rank")


def _catalog(p: DataFrame) -> DataFrame:
    sources = F.array_compact(F.array(F.when(F.col("p_partkey") % 2 == 0, "openbd"), F.when(F.col("p_partkey") % 3 == 0, "googleBooks"), F.when(F.col("p_partkey") % 5 == 0, "ndl")))
    return p.select(F.explode(sources).alias("source"), F.col("p_partkey").alias("ordinal"), book_isbn(F.col("p_partkey")).alias("isbn13"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"), F.col("p_type").alias("publisher"))


@query(f"""
SELECT p_partkey AS entry_id, {o.isbn13("lpad(CAST(p_partkey AS VARCHAR), 9, '0')")} AS isbn13, s AS source, CASE WHEN s IS NOT NULL THEN p_name END AS title,
       CASE WHEN s IS NOT NULL THEN p_type END AS publisher, CASE WHEN s IS NULL THEN 'notFound' ELSE 'confirmed' END AS status
FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'openbd' WHEN p_partkey % 3 = 0 THEN 'googleBooks' WHEN p_partkey % 5 = 0 THEN 'ndl' END AS s FROM part)""")
def isbn_cascade(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    m = p.select(F.col("p_partkey").alias("entry_id"), book_isbn(F.col("p_partkey")).alias("isbn13"))
    return resolve.isbn_cascade(m, _catalog(p)).select("entry_id", "isbn13", "source", "title", "publisher", "status")


def _fuzzy(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    one = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("k"), F.min("p_type").alias("p_type"))
    r = one.select(F.col("k").alias("record_id"), F.when(F.col("k") % 2 == 0, "googleBooks").otherwise("ndl").alias("source"), F.col("k").alias("ordinal"), sim.title_key(F.col("p_name"), True).alias("r_key"), sim.author_keys(F.array("p_brand")).alias("r_authors"), text.match_key(F.col("p_type"), True).alias("r_publisher"))
    first = p.groupBy("p_name").agg(F.min_by("p_brand", "p_partkey").alias("p_brand"), F.min_by("p_type", "p_partkey").alias("p_type"))
    q = first.select(F.col("p_name").alias("entry_id"), sim.title_key(F.expr("substr(p_name, 1, length(p_name) - 1)"), True).alias("q_key"), sim.author_keys(F.array("p_brand")).alias("q_authors"), text.match_key(F.col("p_type"), True).alias("q_publisher"))
    return resolve.fuzzy_candidates(q, r)


@query(f"""
WITH one AS (SELECT p_name, p_brand, min(p_partkey) AS k, min(p_type) AS p_type FROM part GROUP BY ALL),
r AS (SELECT k, {o.key('p_name')} AS rk, {o.key('p_brand')} AS ra, {o.key('p_type')} AS rp FROM one),
e AS (SELECT p_name, arg_min(p_brand, p_partkey) AS b, arg_min(p_type, p_partkey) AS t FROM part GROUP BY p_name),
q AS (SELECT p_name, {o.key('substr(p_name, 1, length(p_name) - 1)')} AS qk, {o.key('b')} AS qa, {o.key('t')} AS qp FROM e),
x AS (SELECT p_name AS entry_id, k AS record_id, k % 2 AS odd, {o.title('qk', 'rk', o.grams('qk'), o.grams('rk'))} AS ts,
  greatest({o.dice(o.grams('qa'), o.grams('ra'))}, {o.lev('qa', 'ra')}, {o.contain('qa', 'ra')}) AS au, CASE WHEN {o.dice(o.grams('qp'), o.grams('rp'))} > 0.6 THEN 0.05 ELSE 0 END AS bonus FROM q, r),
s AS (SELECT entry_id, record_id, odd, round(CASE WHEN ts < 0.3 THEN ts * 0.5 ELSE least(1.0, 0.75 * ts + 0.25 * au + bonus) END, 9) AS score FROM x)
SELECT entry_id, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, odd, record_id) AS INTEGER) AS rank, record_id, round(score, 6) AS score,
       CASE WHEN score >= 0.82 THEN 'confirmed' ELSE 'needsReview' END AS status FROM s WHERE score >= 0.35
QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY score DESC, odd, record_id) <= 5""")
def fuzzy_top5(spark, sf_dir):
    top = resolve.top_per(_fuzzy(spark, sf_dir), ["entry_id"], resolve.by_score(), 5)
    return top.select("entry_id", "rank", "record_id", F.round("score", 6).alias("score"), resolve.status_from_score(F.col("score")).alias("status"))


@query(f"""
WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN {o.isbn13("lpad(CAST(p_partkey % 40 AS VARCHAR), 9, '0')")} END AS isbn13,
  CASE WHEN p_partkey % 3 = 0 THEN 'u/' || CAST(p_partkey % 30 AS VARCHAR) END AS url, {o.key('p_name')} || '|' || {o.key('p_brand')} AS ta FROM part)
SELECT min(p_partkey) AS p_partkey FROM r GROUP BY coalesce(isbn13, url, ta)""")
def dedupe_records(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 4 == 0, book_isbn(k % 40)).alias("isbn13"), F.when(k % 3 == 0, F.concat(F.lit("u/"), (k % 30).cast("string"))).alias("sourceUrl"), F.col("p_name").alias("title"), F.array("p_brand").alias("authors"))
    return resolve.dedupe_records(p, [], [F.col("p_partkey")]).select("p_partkey")


@query(f"""
WITH c AS (SELECT p_partkey AS entry_id, p_size AS query_length, 1 + p_partkey % 3 AS observations, {o.key('p_name')} AS rk,
  CASE WHEN p_partkey % 5 = 0 THEN 0.9 ELSE 1.0 END AS gs, CASE WHEN p_partkey % 7 = 0 THEN 0.95 ELSE 0.8 END AS ns, CASE WHEN p_partkey % 4 = 0 THEN 'B' ELSE 'A' END AS ni FROM part),
t AS (SELECT *, gs >= ns AS g_first FROM c)
SELECT entry_id, CASE WHEN g_first THEN 'googleBooks' ELSE 'ndl' END AS top_source, ni = 'A' AS isbn_agreement, ni = 'B' AS disagreement,
  CASE WHEN query_length < 4 THEN 'needsReview' WHEN ni = 'A' THEN 'confirmed' ELSE 'conflict' END AS status FROM t""")
def evidence_agreement(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").withColumn("r_key", sim.title_key(F.col("p_name"), True))
    g = F.struct(F.lit("googleBooks").alias("source"), F.when(k % 5 == 0, 0.9).otherwise(1.0).alias("score"), F.lit("A").alias("isbn13"))
    n = F.struct(F.lit("ndl").alias("source"), F.when(k % 7 == 0, 0.95).otherwise(0.8).alias("score"), F.when(k % 4 == 0, "B").otherwise("A").alias("isbn13"))
    c = p.select(k.alias("entry_id"), "r_key", F.explode(F.array(g, n)).alias("c")).select("entry_id", "r_key", "c.*", F.lit(0).alias("ordinal"), F.col("c.score").alias("title_sim"), F.lit(1.0).alias("author_sim"))
    e = p.select(k.alias("entry_id"), F.col("p_size").alias("query_length"), (1 + k % 3).alias("observations"), F.lit(None).cast("string").alias("previous_isbn"))
    return resolve.evidence(c, e).select("entry_id", "top_source", "isbn_agreement", "disagreement", "status")


@query("""
SELECT p_partkey AS entry_id, CASE WHEN p_size < 4 THEN 'needsReview' WHEN p_partkey % 2 = 0 AND p_partkey % 3 = 0 THEN 'confirmed'
  WHEN p_partkey % 2 = 0 AND p_partkey % 5 <> 0 THEN 'confirmed' ELSE 'needsReview' END AS status FROM part""")
def evidence_repeated(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part")
    c = p.select(k.alias("entry_id"), F.lit("googleBooks").alias("source"), F.lit(0).alias("ordinal"), F.lit(0.9).alias("score"), F.when(k % 2 == 0, 0.97).otherwise(0.9).alias("title_sim"), F.when(k % 3 == 0, 0.8).otherwise(0.7).alias("author_sim"), F.lit("A").alias("isbn13"), F.col("p_name").alias("r_key"))
    e = p.select(k.alias("entry_id"), F.col("p_size").alias("query_length"), F.when(k % 5 == 0, 1).otherwise(2).alias("observations"), F.lit("A").alias("previous_isbn"))
    return resolve.evidence(c, e).select("entry_id", "status")


@query("""
SELECT c_custkey, list_filter(['title', 'publisher', 'isbn13'], lambda f: (f = 'title' AND c_custkey % 3 = 1) OR (f = 'publisher' AND c_custkey % 5 = 1) OR (f = 'isbn13' AND c_custkey % 7 = 1)) AS fields FROM customer""")
def record_diff(spark, sf_dir):
    k = F.col("c_custkey")
    none = F.lit(None).cast("string")
    a = F.struct(F.col("c_name").alias("title"), F.array("c_mktsegment").alias("authors"), F.col("c_mktsegment").alias("publisher"), none.alias("published"), k.cast("string").alias("isbn13"), F.lit("googleBooks").alias("source"))
    b = F.struct(
        F.when(k % 3 == 1, F.concat("c_name", F.lit("x"))).otherwise(F.concat(F.lit(" "), F.upper("c_name"), F.lit("!"))).alias("title"), F.array(F.lower("c_mktsegment")).alias("authors"),
        F.when(k % 5 == 1, "other").when(k % 5 == 2, "").otherwise(F.col("c_mktsegment")).alias("publisher"), F.lit("2005").alias("published"), F.when(k % 7 == 1, "0").otherwise(k.cast("string")).alias("isbn13"), F.lit("ndl").alias("source"),
    )
    d = table(spark, sf_dir, "customer").select("c_custkey", a.alias("a"), b.alias("b"))
    return d.select("c_custkey", F.transform(resolve.diff_records(F.col("a"), F.col("b")), lambda c: c["field"]).alias("fields"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'house' ELSE c_mktsegment END AS publisher, CASE WHEN c_custkey % 3 = 0 THEN 'cover' WHEN c_custkey % 3 = 1 THEN 'own' ELSE '' END AS cover,
  CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 THEN 'coverUrl,publisher' WHEN c_custkey % 2 = 0 THEN 'publisher' WHEN c_custkey % 3 = 0 THEN 'coverUrl' ELSE '' END AS filled FROM customer""")
def fill_missing(spark, sf_dir):
    k = F.col("c_custkey")
    current = {"publisher": F.when(k % 2 == 1, F.col("c_mktsegment")), "coverUrl": F.when(k % 3 == 1, "own").otherwise("")}
    incoming = {"publisher": F.lit("house"), "coverUrl": F.when(k % 3 == 0, "cover").otherwise("")}
    fields, provenance = resolve.fill_missing(current, incoming, F.lit("ndl"), F.create_map(F.lit("title"), F.lit("googleBooks")))
    d = table(spark, sf_dir, "customer").select("c_custkey", fields["publisher"].alias("publisher"), fields["coverUrl"].alias("cover"), provenance.alias("p"))
    return d.select("c_custkey", "publisher", "cover", F.array_join(F.sort_array(F.map_keys(F.map_filter("p", lambda _, v: v == "ndl"))), ",").alias("filled"))


@query("""
SELECT c_custkey, CASE WHEN hit AND c_custkey % 2 = 0 THEN s.s_name ELSE CASE WHEN c_custkey % 2 = 1 THEN 'own' END END AS publisher, hit AND c_custkey % 2 = 0 AS enriched
FROM (SELECT *, c_nationkey % 3 <> 0 AS confirmed FROM customer) c LEFT JOIN (SELECT min(s_name) AS s_name, s_nationkey FROM supplier GROUP BY s_nationkey) s ON c_nationkey = s_nationkey,
LATERAL (SELECT confirmed AND s.s_nationkey IS NOT NULL AS hit)""")
def enrich(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("isbn13"), F.when(F.col("c_custkey") % 2 == 1, "own").alias("publisher"), F.lit("cover").alias("coverUrl"), F.when(F.col("c_nationkey") % 3 != 0, "confirmed").otherwise("conflict").alias("status"))
    s = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").cast("string").alias("isbn13")).agg(F.min("s_name").alias("publisher")).withColumn("coverUrl", F.lit("c"))
    return resolve.enrich(c, s).select("c_custkey", "publisher", "enriched")


ENTRY_STATUS = ("unverified", "confirmed", "needsReview", "conflict", "notFound", "excluded")
ENTRY_SQL = f"""(SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'unverified' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'needsReview' WHEN 3 THEN 'conflict' WHEN 4 THEN 'notFound' ELSE 'excluded' END AS status,
  p_size % 7 = 0 AS pinned, CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN p_name || ', "' || p_type || '" | x' ELSE p_name END AS title, p_brand, p_type,
  CASE WHEN p_partkey % 3 = 0 THEN CAST(1990 + p_size AS VARCHAR) || '-03' ELSE '' END AS published, {o.isbn13("lpad(CAST(p_partkey % 500 AS VARCHAR), 9, '0')")} AS isbn13 FROM part)"""
EXPORTED_SQL = f"(SELECT * FROM {ENTRY_SQL} WHERE status <> 'excluded' AND title <> '' AND (status = 'confirmed' OR pinned))"


def _entries(spark, sf_dir) -> DataFrame:
    k = F.col("p_partkey")
    status = F.element_at(F.array(*[F.lit(s) for s in ENTRY_STATUS]), (k % 6).cast("int") + 1)
    title = F.when(k % 11 == 0, "").when(k % 13 == 0, F.concat("p_name", F.lit(', "'), "p_type", F.lit('" | x'))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(
        "p_partkey", status.alias("status"), (F.col("p_size") % 7 == 0).alias("pinned"), title.alias("title"), F.array("p_brand").alias("authors"), F.col("p_type").alias("publisher"),
        F.when(k % 3 == 0, F.concat((F.col("p_size") + 1990).cast("string"), F.lit("-03"))).otherwise("").alias("published"), book_isbn(k % 500).alias("isbn13"),
    )


def _exported(spark, sf_dir) -> DataFrame:
    return _entries(spark, sf_dir).filter(triage.exportable(F.col("status"), F.col("pinned"), F.col("title")))


def _record() -> dict[str, Column]:
    none = F.lit(None).cast("string")
    return {c: F.col(c) for c in ("title", "authors", "publisher", "published", "isbn13")} | {"subtitle": none, "series": none, "source": F.lit("googleBooks")}


@query(f"""
SELECT count(*) AS n, count_if(status NOT IN ('confirmed', 'excluded')) AS attention, count_if(status IN ('notFound', 'unverified')) AS unresolved, count_if(status = 'confirmed') AS confirmed,
  count_if(status <> 'excluded' AND title <> '' AND status <> 'confirmed' AND NOT pinned) AS unconfirmed FROM {ENTRY_SQL}""")
def triage_counts(spark, sf_dir):
    return triage.triage_counts(_entries(spark, sf_dir))


@query(f"SELECT status, count(*) AS n, count_if(pinned) AS pinned FROM {ENTRY_SQL} GROUP BY status")
def status_counts(spark, sf_dir):
    return _entries(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"), F.count_if("pinned").alias("pinned"))


@query(f"""SELECT p_partkey, CASE WHEN title = '' AND NOT pinned AND status <> 'excluded' THEN 'notFound' ELSE status END AS settled, pinned OR status = 'excluded' AS untouchable FROM {ENTRY_SQL}""")
def settle_entries(spark, sf_dir):
    s, p, t = F.col("status"), F.col("pinned"), F.col("title")
    return _entries(spark, sf_dir).select("p_partkey", triage.settle(s, p, t).alias("settled"), triage.is_untouchable(s, p).alias("untouchable"))


@query(f"""
SELECT p_partkey, {o.csv('title')} || ',,' || p_brand || ',' || p_type || ',' || published || ',' || isbn13 || ',,googleBooks,' || status AS line FROM {EXPORTED_SQL}""")
def export_csv(spark, sf_dir):
    return _exported(spark, sf_dir).select("p_partkey", export.csv_row(_record(), F.col("status")).alias("line"))


@query(f"""
SELECT p_partkey, '| ' || replace(title, '|', '\\|') || ' | ' || p_brand || ' | ' || p_type || ' | ' || published || ' | ' || isbn13 || ' |' AS line FROM {EXPORTED_SQL}""")
def export_markdown(spark, sf_dir):
    return _exported(spark, sf_dir).select("p_partkey", export.markdown_row(_record()).alias("line"))


@query(f"""
SELECT p_partkey, '@book{{' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || substr(published, 1, 4) || '_' || CAST(row_number() OVER (ORDER BY p_partkey) AS VARCHAR) || ',' || chr(10) || '  title = {{' || title || '}},' || chr(10) ||
  '  author = {{' || p_brand || '}},' || chr(10) || '  publisher = {{' || p_type || '}},' || chr(10) || CASE WHEN published <> '' THEN '  year = {{' || substr(published, 1, 4) || '}},' || chr(10) ELSE '' END ||
  '  isbn = {{' || isbn13 || '}}' || chr(10) || '}}' AS entry FROM {EXPORTED_SQL}""")
def export_bibtex(spark, sf_dir):
    return numbered(_exported(spark, sf_dir), "p_partkey").select("p_partkey", export.bibtex_entry(_record(), F.col("index")).alias("entry"))


@query(f"SELECT isbn13, min(p_partkey) AS first FROM {EXPORTED_SQL} GROUP BY isbn13")
def export_isbn_list(spark, sf_dir):
    return export.isbn_list(_exported(spark, sf_dir), "p_partkey")


@query(f"""
SELECT p_partkey, '{{"p_partkey":' || CAST(p_partkey AS VARCHAR) || ',"status":"' || status || '","pinned":' || CAST(pinned AS VARCHAR) || ',"isbn13":"' || isbn13 || '"}}' AS json FROM {ENTRY_SQL}""")
def export_json(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return e.select("p_partkey", F.to_json(F.struct("p_partkey", "status", "pinned", "isbn13")).alias("json"))


@query("""
WITH e AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: CAST(floor(abs(x) * 2000) AS INTEGER)) AS v FROM embeddings),
s AS (SELECT vec_id, k, v[4 * k + 1] AS t, v[4 * k + 2] AS l, v[4 * k + 3] AS b, v[4 * k + 4] AS r FROM e, unnest([0, 1]) AS u(k)),
c AS (SELECT vec_id, k, least(1000, t) / 1000.0 AS t, least(1000, l) / 1000.0 AS l, least(1000, b) / 1000.0 AS b, least(1000, r) / 1000.0 AS r FROM s)
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY l, k) - 1 AS INTEGER) AS pos, 'book ' || CAST(k AS VARCHAR) AS title, round(l, 6) AS x, round(t, 6) AS y, round(r - l, 6) AS width, round(b - t, 6) AS height, CAST(k AS DOUBLE) AS confidence
FROM c WHERE r > l AND b > t""")
def vision_mentions(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    v = F.transform(F.slice("embedding", 1, 8), lambda x: F.floor(F.abs(x.cast("double")) * 2000).cast("int"))
    spine = lambda k: F.struct(F.slice(v, 4 * k + 1, 4).alias("box_2d"), F.lit(f" book {k}\nmore").alias("raw_visible_text"), F.lit("").alias("title"), F.lit(float(7 * k)).alias("confidence"))
    d = e.select("vec_id", F.to_json(F.struct(F.array(spine(0), spine(1)).alias("spines"))).alias("payload"))
    m = records.vision_mentions(d, "vec_id", "payload")
    return m.select("vec_id", "pos", "title", *[F.round(f"box.{c}", 6).alias(c) for c in ("x", "y", "width", "height")], "confidence")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y') END AS published,
  [o_orderstatus || 'a', o_orderpriority] AS authors FROM orders""")
def openbd_records(spark, sf_dir):
    d, k = table(spark, sf_dir, "orders"), F.col("o_orderkey") % 3
    date = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy")).otherwise("n.d.")
    summary = F.struct(F.lit("t").alias("title"), date.alias("pubdate"), F.concat("o_orderstatus", F.lit("a／著, "), "o_orderpriority").alias("author"))
    r = records.openbd_record(F.to_json(F.struct(summary.alias("summary"))))
    return d.select("o_orderkey", r.alias("r")).select("o_orderkey", "r.published", "r.authors")


@query("""
SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<p>')) AS paragraphs, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages""")
def page_items(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(h, "(?s)<title>(.*?)</title>", 1).alias("title"), F.size(F.regexp_extract_all(h, F.lit("<p>"), 0)).cast("bigint").alias("paragraphs"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"))


@query("""
SELECT page_id, 'https://relay.example/?u=' || replace(replace(replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D'), '#', '%23') AS encoded, 'https://relay.example/' || url AS joined
FROM (SELECT page_id, replace(url, '&', '') AS url FROM pages)""")
def proxied_urls(spark, sf_dir):
    u = F.replace("url", F.lit("&"), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", records.proxied_url(F.lit("https://relay.example/?u="), u).alias("encoded"), records.proxied_url(F.lit(" https://relay.example// "), u).alias("joined"))


HALF_DAY_MS = 12 * 3600 * 1000


@query(f"""
WITH l AS (SELECT *, epoch_ms(ts) AS ms, lag(epoch_ms(ts)) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))
SELECT event_id, coalesce(ms - before > {HALF_DAY_MS}, true) AS captured, CAST(sum(CASE WHEN coalesce(ms - before > {HALF_DAY_MS}, true) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM l""")
def capture_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    return observe.capture_sessions(e, ["user_id", "event_type"], "at", HALF_DAY_MS, "event_id").select("event_id", "captured", "session")


def _grids(spark, sf_dir) -> DataFrame:
    """vec_id, label, grid: embeddings as 64 bytes of an 8 by 8 image."""
    v = F.transform(F.slice("embedding", 1, 64), lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((x.cast("double") + 1) * 127.5).cast("int"))))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", v.alias("grid"))


GRID_SQL = "(SELECT vec_id, label, list_transform(embedding[1:64], lambda x: least(255, greatest(0, CAST(floor((CAST(x AS DOUBLE) + 1) * 127.5) AS INTEGER)))) AS g FROM embeddings)"
HASH_SQL = f"(SELECT vec_id, label, {o.average_hash('g')} AS h FROM {GRID_SQL})"


@query(f"SELECT vec_id, h AS hash FROM {HASH_SQL}")
def average_hash(spark, sf_dir):
    return _grids(spark, sf_dir).select("vec_id", images.visual_hash(F.col("grid")).alias("hash"))


@query(f"""
WITH h AS (SELECT * FROM {HASH_SQL}), l AS (SELECT *, lag(h) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM h),
d AS (SELECT *, CASE WHEN p IS NOT NULL AND {o.hamming('h', 'p')} > 18 THEN 1 ELSE 0 END AS far FROM l)
SELECT vec_id, CAST(sum(far) OVER (PARTITION BY label ORDER BY vec_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS shelf FROM d""")
def shelf_generation(spark, sf_dir):
    d = _grids(spark, sf_dir).select("vec_id", "label", images.visual_hash(F.col("grid")).alias("hash"))
    return observe.shelf_generation(d, "label", "vec_id", "hash").select("vec_id", "shelf")


@query(f"""
WITH h AS (SELECT vec_id, repeat(substr(h, 1, 4), 4) AS h FROM {HASH_SQL})
SELECT a.vec_id AS "left", b.vec_id AS "right", {o.hamming('a.h', 'b.h')} AS bits FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE {o.hamming('a.h', 'b.h')} <= 6""")
def hash_pairs(spark, sf_dir):
    d = _grids(spark, sf_dir).select("vec_id", F.repeat(F.substring(images.visual_hash(F.col("grid")), 1, 4), F.lit(4)).alias("hash"))
    return observe.hamming_join(d, "vec_id", "hash").select("left", "right", F.col("bits").cast("bigint").alias("bits"))


@query(f"""
WITH h AS (SELECT * FROM {HASH_SQL})
SELECT a.vec_id AS "left", b.vec_id AS "right", {o.hamming('a.h', 'b.h')} AS bits FROM h a JOIN h b ON a.vec_id < b.vec_id WHERE {o.hamming('a.h', 'b.h')} <= 6""")
def hash_pairs_64(spark, sf_dir):
    """hash_pairs over all 64 bits."""
    d = _grids(spark, sf_dir).select("vec_id", images.visual_hash(F.col("grid")).alias("hash"))
    return observe.hamming_join(d, "vec_id", "hash").select("left", "right", F.col("bits").cast("bigint").alias("bits"))


@query(f"""
WITH p AS (SELECT vec_id, g, list_transform(list_filter(range(64), lambda i: i >= 8 AND i < 56 AND i % 8 > 0 AND i % 8 < 7), lambda i: CAST(g[i] + g[i + 2] + g[i - 7] + g[i + 9] - 4 * g[i + 1] AS DOUBLE)) AS lap FROM {GRID_SQL}),
q AS (SELECT vec_id, round(list_sum(g) / 64.0 / 255, 6) AS brightness, round(len(list_filter(g, lambda v: v >= 254)) / 64.0, 6) AS blowout, round(least(1.0, (list_sum(list_transform(lap, lambda x: x * x)) / 36.0 - power(list_sum(lap) / 36.0, 2)) / 2000.0), 6) AS sharpness FROM p)
SELECT *, brightness BETWEEN 0.15 AND 0.95 AND blowout <= 0.45 AND sharpness >= 0.035 AS usable FROM q""")
def quality_metrics(spark, sf_dir):
    g = F.col("grid")
    d = _grids(spark, sf_dir).select("vec_id", F.round(images.brightness(g), 6).alias("brightness"), F.round(images.blowout(g), 6).alias("blowout"), F.round(images.sharpness(g, F.lit(8), F.lit(8)), 6).alias("sharpness"))
    return d.withColumn("usable", images.is_usable(F.col("brightness"), F.col("blowout"), F.col("sharpness")))


@query(f"""
SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: abs(a.g[i] - b.g[i]))) / 64.0 / 255, 6) AS difference FROM {GRID_SQL} a JOIN {GRID_SQL} b ON b.vec_id = a.vec_id - 1""")
def frame_difference(spark, sf_dir):
    g = _grids(spark, sf_dir)
    before = g.select((F.col("vec_id") + 1).alias("vec_id"), F.col("grid").alias("before"))
    return g.join(before, "vec_id").select("vec_id", F.round(images.frame_difference(F.col("grid"), F.col("before")), 6).alias("difference"))


@query(f"SELECT vec_id, v, count(*) AS n FROM (SELECT vec_id, unnest(g) AS v FROM {GRID_SQL}) GROUP BY ALL")
def gray_histogram(spark, sf_dir):
    return images.histogram(_grids(spark, sf_dir), "vec_id", "grid")


@query(f"""
WITH h AS (SELECT vec_id, v, count(*) AS n FROM (SELECT vec_id, unnest(g) AS v FROM {GRID_SQL}) GROUP BY ALL),
c AS (SELECT *, CAST(sum(n) OVER u AS DOUBLE) AS w0, CAST(sum(n * v) OVER u AS DOUBLE) AS s0, sum(n) OVER (PARTITION BY vec_id) AS w, sum(n * v) OVER (PARTITION BY vec_id) AS s FROM h WINDOW u AS (PARTITION BY vec_id ORDER BY v ROWS UNBOUNDED PRECEDING)),
b AS (SELECT vec_id, v, round(w0 * (w - w0) * power(s0 / w0 - (s - s0) / (w - w0), 2), 6) AS b FROM c WHERE w0 < w)
SELECT vec_id, v AS threshold FROM b QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY b DESC, v) = 1""")
def otsu_threshold(spark, sf_dir):
    return images.otsu(images.histogram(_grids(spark, sf_dir), "vec_id", "grid"), "vec_id")


@query(f"""
WITH p AS (SELECT vec_id, CAST(i % 8 AS INTEGER) AS x, abs(g[i + 2] - g[i + 1]) AS d FROM {GRID_SQL}, unnest(range(64)) AS u(i) WHERE i % 8 < 7)
SELECT vec_id, x, round(avg(CASE WHEN d >= 18 THEN 1.0 ELSE 0.0 END), 6) AS density FROM p GROUP BY ALL""")
def edge_density(spark, sf_dir):
    return images.edge_density(_grids(spark, sf_dir), "vec_id", "grid", 8).select("vec_id", "x", F.round("density", 6).alias("density"))


HOURS_SQL = "(SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL)"


def _hours(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))


@query(f"""
SELECT event_type, hour, round(avg(n) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth,
  round(CASE WHEN max(n) OVER t - min(n) OVER t = 0 THEN 0.0 ELSE (n - min(n) OVER t) * 1.0 / (max(n) OVER t - min(n) OVER t) END, 6) AS level FROM {HOURS_SQL} WINDOW t AS (PARTITION BY event_type)""")
def smooth_profile(spark, sf_dir):
    d = images.normalize_profile(images.smooth_profile(_hours(spark, sf_dir), "event_type", "hour", "n", 2), "event_type", "n")
    return d.select("event_type", "hour", F.round("smooth", 6).alias("smooth"), F.round("level", 6).alias("level"))


@query(f"""
WITH w AS (SELECT *, max(n) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS l, max(n) OVER (PARTITION BY event_type ORDER BY hour ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS r FROM {HOURS_SQL})
SELECT event_type, hour, n FROM w WHERE (l IS NULL OR n > l) AND (r IS NULL OR n >= r)""")
def local_peaks(spark, sf_dir):
    return images.local_peaks(_hours(spark, sf_dir), "event_type", "hour", "n", 3)


@query("""
WITH e AS (SELECT user_id, event_id, epoch_ms(ts) // 60000 AS head, CAST(30 AS BIGINT) AS size FROM events),
g AS (SELECT *, head - max(head + size) OVER (PARTITION BY user_id ORDER BY head, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM e),
m AS (SELECT user_id, list_sort(list(CAST(gap AS DOUBLE)) FILTER (WHERE gap > 0)) AS gs FROM g GROUP BY user_id),
l AS (SELECT g.*, greatest(2.0 * coalesce(gs[len(gs) // 2 + 1], 0), 0.35 * 30) AS lim FROM g JOIN m USING (user_id))
SELECT user_id, event_id, CAST(sum(CASE WHEN gap > lim THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY head, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chunk FROM l""")
def gap_chunks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", whole_units(F.col("ts"), 60_000).alias("head"), F.lit(30).cast("bigint").alias("size"))
    return mentions.gap_chunks(e, "user_id", "event_id", "head", "size").select("user_id", "event_id", "chunk")


@query("""
WITH i AS (SELECT *, CASE WHEN value > 20 THEN 1 ELSE 0 END AS moving FROM events),
s AS (SELECT *, sum(moving) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM i)
SELECT event_id, CAST(island AS BIGINT) AS island, CAST(sum(1 - moving) OVER (PARTITION BY user_id, island ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stable,
  max(value) OVER (PARTITION BY user_id, island ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS best FROM s""")
def still_ticks(spark, sf_dir):
    d = observe.still_ticks(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 20)
    return observe.running_best(d, ["user_id", "island"], "event_id", "value").select("event_id", "island", "stable", "best")


BANDS_SQL = "(SELECT l_partkey AS shelf, l_orderkey AS frame, l_orderkey * 10 + l_linenumber AS id, l_quantity AS s, l_quantity + 2 + floor(l_tax * 100) AS e FROM lineitem)"


@query(f"""
SELECT a.id AS "left", b.id AS "right", round((least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s), 6) AS overlap FROM {BANDS_SQL} a JOIN {BANDS_SQL} b ON a.shelf = b.shelf AND a.id < b.id AND a.frame <> b.frame
WHERE (least(a.e, b.e) - greatest(a.s, b.s)) / least(a.e - a.s, b.e - b.s) >= 0.5""")
def band_overlap_join(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("shelf"), F.col("l_orderkey").alias("frame"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_quantity").alias("s"), (F.col("l_quantity") + 2 + F.floor(F.col("l_tax") * 100)).alias("e"))
    return observe.overlap_join(d, "shelf", "frame", "id", "s", "e").select("left", "right", F.round("overlap", 6).alias("overlap"))


@query(f"""
WITH n AS (SELECT DISTINCT {o.key('p_name')} AS k FROM part), q AS (SELECT k AS entry, substr(k, 1, length(k) - 2) || 'x' AS qk FROM n),
s AS (SELECT entry, k, round({o.dice(o.grams('qk'), o.grams('k'))}, 9) AS score FROM q, n)
SELECT entry, k AS known, round(score, 6) AS score FROM s WHERE score >= 0.72 QUALIFY row_number() OVER (PARTITION BY entry ORDER BY score DESC, k) = 1""")
def dice_join(spark, sf_dir):
    n = table(spark, sf_dir, "part").select(sim.title_key(F.col("p_name"), True).alias("known")).distinct()
    q = n.select(F.col("known").alias("entry"), F.concat(F.expr("substr(known, 1, length(known) - 2)"), F.lit("x")).alias("o_key"))
    return observe.text_join(q, n.withColumn("k_key", F.col("known")), "entry", "o_key", "known", "k_key").select("entry", "known", F.round("score", 6).alias("score"))


@query("""
SELECT user_id, arg_max(event_id, ts) AS event_id, arg_max(event_type, ts) AS event_type FROM events GROUP BY user_id""")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    return triage.upsert_latest(e.filter(F.col("event_id") % 2 == 0).transform(lambda d: resolve.first_per(d, ["user_id"], [F.desc("ts")])), e, "user_id", "ts").select("user_id", "event_id", "event_type")


@query("""
SELECT min(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') GROUP BY o_custkey""")
def unknown_only(spark, sf_dir):
    d = table(spark, sf_dir, "orders")
    return triage.unknown_only(d, d.filter("o_orderstatus = 'F'").select("o_custkey").distinct(), "o_custkey", "o_orderkey").select("o_orderkey")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_state(spark, sf_dir):
    return triage.last_state(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


@query(f"""
WITH a AS (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'adopt' WHEN 1 THEN 'edit' WHEN 2 THEN 'exclude' WHEN 3 THEN 'restore' ELSE 'delete' END AS act FROM {ENTRY_SQL})
SELECT p_partkey, CASE act WHEN 'adopt' THEN 'confirmed' WHEN 'edit' THEN 'unverified' WHEN 'exclude' THEN 'excluded' ELSE CASE WHEN title <> '' THEN 'needsReview' ELSE 'unverified' END END AS status,
  CASE act WHEN 'adopt' THEN true WHEN 'edit' THEN false ELSE pinned END AS pinned, CASE act WHEN 'adopt' THEN p_type WHEN 'edit' THEN NULL ELSE title END AS resolved_title, CASE WHEN act IN ('adopt', 'edit') THEN 0 ELSE 2 END AS conflicts FROM a WHERE act <> 'delete'""")
def manual_actions(spark, sf_dir):
    act = F.element_at(F.array(*[F.lit(x) for x in ("adopt", "edit", "exclude", "restore", "delete")]), (F.col("p_partkey") % 5).cast("int") + 1)
    e = _entries(spark, sf_dir).select("p_partkey", "status", "pinned", F.col("title").alias("resolved_title"), F.col("publisher").alias("candidate_title"), F.lit(2).alias("conflicts"), act.alias("action"))
    return triage.apply_action(e).select("p_partkey", "status", "pinned", "resolved_title", "conflicts")


@query()
def tracker_fold(spark, sf_dir):
    return observe.track(table(spark, sf_dir, "conversations").filter("conv_id is not null"), "conv_id", "turn", "text")


@query("""
SELECT event_id, CASE WHEN user_id % 11 = 0 THEN 'idle' WHEN user_id % 7 = 0 THEN 'idle' WHEN event_id % 13 = 0 THEN 'idle' WHEN event_id % 5 = 0 THEN 'idle' WHEN event_type = 'click' THEN 'success' WHEN event_id % 3 = 0 THEN 'idle'
  WHEN event_id % 4 = 1 THEN 'searching' WHEN event_id % 4 = 2 THEN 'searching' WHEN user_id % 2 = 1 AND event_type = 'view' THEN 'duplicate' ELSE 'searching' END AS kind,
  CASE WHEN user_id % 11 = 0 THEN 'starting' WHEN user_id % 7 = 0 THEN 'preparing' WHEN event_id % 13 = 0 THEN 'behind' WHEN event_id % 5 = 0 THEN 'advice' WHEN event_type = 'click' THEN 'captured' WHEN event_id % 3 = 0 THEN 'moving'
  WHEN event_id % 4 = 1 THEN 'reading' WHEN event_id % 4 = 2 THEN 'looking_up' WHEN user_id % 2 = 1 AND event_type = 'view' THEN 'shelf_done' WHEN user_id % 2 = 1 THEN 'next_shelf' ELSE 'shelf' END AS reason FROM events""")
def scan_status(spark, sf_dir):
    e, u, t = F.col("event_id"), F.col("user_id"), F.col("event_type")
    s = {
        "ready": u % 11 != 0, "preparing": u % 7 == 0, "busy": e % 13 == 0, "advice": F.when(e % 5 == 0, "dark"), "outcome": F.when(t == "click", "queued").when(t == "view", "duplicate"), "moving": e % 3 == 0,
        "reading": (e % 4 == 1).cast("int"), "looking_up": (e % 4 == 2).cast("int"), "captured": u % 2, "shelf_read": F.lit(False),
    }
    d = table(spark, sf_dir, "events").select("event_id", views.scan_status(s).alias("s"))
    return d.select("event_id", "s.kind", "s.reason")


@query("""
SELECT event_id, user_id, CAST(row_number() OVER w AS INTEGER) AS rank, greatest(0, count(*) OVER (PARTITION BY user_id) - 6) AS rest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id DESC) QUALIFY row_number() OVER w <= 6""")
def recent_feed(spark, sf_dir):
    return views.recent_feed(table(spark, sf_dir, "events"), "user_id", "event_id", 6).select("event_id", "user_id", "rank", "rest")


@query("""
WITH p AS (SELECT *, CAST(event_id % 3 AS INTEGER) AS pending, event_type = 'view' AS scanning FROM events), l AS (SELECT *, lag(pending) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM p)
SELECT event_id, coalesce(b > 0 AND pending = 0 AND NOT scanning, false) AS finished FROM l""")
def finished_edges(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("pending", (F.col("event_id") % 3).cast("int")).withColumn("scanning", F.col("event_type") == "view")
    return views.finished_edges(e, "user_id", "event_id", "pending", "scanning").select("event_id", "finished")


@query("""
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 403 WHEN page_id % 4 = 1 THEN 405 WHEN page_id % 3 = 0 THEN 400 WHEN url LIKE 'https://%' AND url LIKE 'https://www.%' AND regexp_extract(url, '://([^/?#]*)', 1) = 'www.ththea.example.com' THEN 200 ELSE 403 END AS status FROM pages""")
def relay_requests(spark, sf_dir):
    k = F.col("page_id")
    v = recognition.relay_verdict(F.when(k % 4 == 0, "https://evil.example").otherwise("https://app.example"), F.when(k % 4 == 1, "POST").otherwise("GET"), F.when(k % 3 == 0, "").otherwise(F.col("url")), ["https://app.example"], "www.ththea.example.com")
    return table(spark, sf_dir, "pages").select("page_id", v.alias("status"))


@query("""
SELECT o_custkey, max(o_orderpriority) AS text FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY length(o_orderpriority) DESC, o_totalprice DESC) AS r FROM orders WHERE o_orderstatus <> 'P') WHERE r = 1 GROUP BY o_custkey""")
def better_read(spark, sf_dir):
    return views.better_read(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_totalprice", "o_orderstatus <> 'P'").select("o_custkey", F.col("o_orderpriority").alias("text"))


@query(f"""
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'scan' ELSE isbn13 END AS isbn13, CASE WHEN p_partkey % 4 = 0 THEN 'unverified' ELSE status END AS status, pinned AND p_partkey % 4 <> 0 AS pinned, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE 3 END AS conflicts FROM {ENTRY_SQL}""")
def bind_isbn(spark, sf_dir):
    e = _entries(spark, sf_dir).withColumn("conflicts", F.lit(3))
    scanned = e.filter("p_partkey % 4 = 0").select("p_partkey", F.lit("scan").alias("isbn13"))
    return views.bind_isbn(e, scanned, "p_partkey").select("p_partkey", "isbn13", "status", "pinned", "conflicts")


@query("""
SELECT p_partkey, CASE WHEN 20 * p_size * 3 * 30 * p_partkey * 3 <= 2400000 AND ceil(160.0 / (20 * p_size)) >= 3 THEN 3 WHEN 20 * p_size * 2 * 30 * p_partkey * 2 <= 2400000 AND ceil(160.0 / (20 * p_size)) >= 2 THEN 2 ELSE 1 END AS scale FROM part""")
def strip_scale(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", segment.strip_scale(F.col("p_size") * 20, F.col("p_partkey") * 30).alias("scale"))


@query(f"""
SELECT o_custkey || '-' || CAST(i - 1 AS VARCHAR) AS id, codes[i] AS isbn13 FROM (SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, list(CAST(o_orderkey AS VARCHAR) ORDER BY o_orderkey) AS codes FROM orders GROUP BY ALL), unnest(range(1, len(codes) + 1)) AS u(i)""")
def entries_from_isbns(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("session"), "o_orderkey", F.col("o_orderkey").cast("string").alias("code"))
    return recognition.entries_from_isbns(d, "code", "session", "o_orderkey").select("id", "isbn13")


@query(f"""
SELECT vec_id, CASE WHEN b < 0.15 THEN 'dark' WHEN b > 0.95 THEN 'bright' WHEN w > 0.45 THEN 'glare' WHEN label % 2 = 0 THEN 'blur' END AS advice FROM (SELECT vec_id, label, list_sum(list_transform(g, lambda v: CASE WHEN vec_id % 5 = 0 THEN v // 8 ELSE v END)) / 64.0 / 255 AS b,
  len(list_filter(g, lambda v: CASE WHEN vec_id % 5 = 0 THEN v // 8 ELSE v END >= 254)) / 64.0 AS w FROM {GRID_SQL})""")
def frame_advice(spark, sf_dir):
    g = _grids(spark, sf_dir).withColumn("g", F.transform("grid", lambda v: F.when(F.col("vec_id") % 5 == 0, F.floor(v / 8).cast("int")).otherwise(v)))
    sharp = F.when(F.col("label") % 2 == 0, 0.0).otherwise(1.0)
    return g.select("vec_id", views.frame_advice(images.brightness(F.col("g")), images.blowout(F.col("g")), sharp).alias("advice"))


@query("""
SELECT o_orderkey, '{"steps":[' || CASE WHEN o_orderkey % 2 = 0 THEN 'skip' ELSE 'none' END || ']}' AS kind, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS text FROM orders""")
def output_text(spark, sf_dir):
    even = F.col("o_orderkey") % 2 == 0
    content = lambda kind, t: F.struct(F.lit(kind).alias("type"), t.alias("text"))
    step = lambda kind, *c: F.struct(F.lit(kind).alias("type"), F.array(*c).alias("content"))
    d = table(spark, sf_dir, "orders").withColumn("s", F.when(even, F.array(step("thought", content("text", F.lit("no"))), step("model_output", content("image", F.lit("x")), content("text", F.col("o_orderpriority"))))).otherwise(F.array(step("thought", content("text", F.lit("no"))))))
    kind = F.concat(F.lit('{"steps":['), F.when(even, "skip").otherwise("none"), F.lit("]}"))
    return d.select("o_orderkey", kind.alias("kind"), recognition.output_text(F.to_json(F.struct(F.col("s").alias("steps")))).alias("text"))


@query()
def segment_bands(spark, sf_dir):
    """Bands of images made of eight embeddings' grids side by side."""
    g = _grids(spark, sf_dir).withColumn("frame", F.floor(F.col("vec_id") / 8)).withColumn("x", F.col("vec_id") % 8)
    rows = g.select("frame", "x", F.posexplode("grid").alias("i", "v")).select("frame", F.struct(F.floor(F.col("i") / 8), "x", F.col("i") % 8, "v").alias("p"))
    image = rows.groupBy("frame").agg(F.sort_array(F.collect_list("p")).alias("p"), F.count("*").alias("n"))
    data = F.unhex(F.array_join(F.transform("p", lambda p: F.lpad(F.hex(p["v"].cast("bigint")), 2, "0")), ""))
    d = image.select("frame", data.alias("data"), F.floor(F.col("n") / 8).cast("int").alias("width"))
    return d.select("frame", F.posexplode(segment.segment(F.col("data"), F.col("width"))).alias("pos", "b")).select("frame", "pos", "b.start", "b.end")
