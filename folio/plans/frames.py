"""Queries of lookups, payloads, images' parts and a scan's diagnostics, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import diagnostics, images, mentions, views
from ..sources import lookup, records
from . import oracle as o
from .catalogue import GRID_SQL, _grids, book_isbn, query, table

PART_ISBN = o.isbn13("lpad(CAST(p_partkey AS VARCHAR), 9, '0')")


class Stumbling:
    """A catalogue that turns every request away once, then knows all keys whose last digit isn't 7."""

    def __init__(self):
        self.seen = set()

    def __call__(self, keys: list[str]) -> dict[str, str]:
        if (own := tuple(keys)) not in self.seen:
            self.seen.add(own)
            raise lookup.RateLimited("slow down")
        return {k: f"book {k}" for k in keys if k[-1] != "7"}


@query(f"""
SELECT DISTINCT isbn AS key, CASE WHEN right(isbn, 1) <> '7' THEN 'book ' || isbn END AS payload, CAST(NULL AS VARCHAR) AS error, 2 AS attempts FROM (SELECT {PART_ISBN} AS isbn FROM part)""")
def looked_up(spark, sf_dir):
    """All keys, in either form and twice, in chunks that fail once."""
    p = table(spark, sf_dir, "part")
    code = book_isbn(F.col("p_partkey"))
    spaced = F.concat(F.substring(code, 1, 3), F.lit("-"), F.substring(code, 4, 10))
    keys = p.select(F.explode(F.array(code, spaced, F.lit("9780000000000"), F.lit(None))).alias("isbn13"))
    return lookup.looked_up(keys, Stumbling(), pause_s=0.0)


@query(f"""
SELECT p_partkey AS entry_id, left(p_name || ' ' || p_brand || ' ' || p_type || ' and more of the text', 40) AS entry_text, isbn AS query, CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 0 END AS hits, CASE WHEN p_partkey % 3 = 1 THEN left(repeat('e', 250), 200) END AS error
FROM (SELECT *, {PART_ISBN} AS isbn FROM part)""")
def lookup_log(spark, sf_dir):
    """Recorded answers: a record, an error, nothing at all."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    p = p.withColumn("isbn13", book_isbn(k))
    answers = p.filter(k % 3 != 2).select(F.col("isbn13").alias("key"), F.when(k % 3 == 0, F.col("p_name")).alias("payload"), F.when(k % 3 == 1, F.repeat(F.lit("e"), F.lit(250))).alias("error"))
    entries = p.select(k.alias("entry_id"), "isbn13", F.concat_ws(" \n ", "p_name", "p_brand", "p_type", F.lit("and more of the text")).alias("raw_text"))
    return lookup.lookup_log(entries, lookup.recorded(answers, entries)).withColumn("hits", F.col("hits").cast("int"))


@query(f"""
SELECT p_partkey, 0 AS ordinal, p_name AS title, [p_brand, p_type] AS authors, CASE WHEN p_size % 2 = 0 THEN p_type END AS publisher, CAST(1990 + p_size AS VARCHAR) AS published, CASE WHEN p_partkey % 5 <> 4 THEN {PART_ISBN} END AS isbn13, 's' AS series, 'http://x/' || CAST(p_partkey AS VARCHAR) AS link FROM part
UNION ALL SELECT p_partkey, 1, NULL, [], NULL, NULL, NULL, NULL, NULL FROM part""")
def ndl_items(spark, sf_dir):
    """Feeds of two items, with prefixes of their own, codes by type or by shape, blank elements, and an item of nothing."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    code, text_of = book_isbn(k), lambda name, c: F.concat(F.lit(f"<{name}>"), c, F.lit(f"</{name.split()[0]}>"))
    identifier = F.when(k % 5 == 4, "<dc:identifier>12345</dc:identifier>").when(k % 5 == 3, text_of("dc:identifier", code)).otherwise(F.concat(text_of("dc:identifier", F.lit("9784101010014x")), text_of('dc:identifier xsi:type="dcndl:ISBN"', code)))
    publisher = F.when(F.col("p_size") % 2 == 0, text_of("dc:publisher", F.concat(F.lit(" "), "p_type", F.lit("\n")))).otherwise("<dc:publisher> </dc:publisher>")
    item = F.concat(
        F.lit("<item>"), text_of("title", F.concat(F.lit("  "), "p_name", F.lit("  "))), text_of("link", F.concat(F.lit("http://x/"), k.cast("string"))), text_of("dc:creator", F.col("p_brand")), F.lit("<dc:creator/>"), text_of("dc:creator", F.col("p_type")),
        publisher, text_of("dcterms:issued", (F.col("p_size") + 1990).cast("string")), text_of("dcndl:seriesTitle", F.lit("s")), identifier, F.lit("</item>"),
    )
    feed = F.concat(F.lit('<rss xmlns:dc="d" xmlns:dcterms="t" xmlns:dcndl="n" xmlns:xsi="x"><channel>'), item, F.lit("<item><category>none</category></item></channel></rss>"))
    d = records.xml_items(p.select("p_partkey", feed.alias("xml")), "p_partkey", "xml")
    return d.select("p_partkey", "ordinal", "title", "authors", "publisher", "published", "isbn13", "series", F.col("sourceUrl").alias("link"))


@query(f"""
SELECT p_partkey, CASE WHEN p_partkey % 6 <> 5 THEN p_name END AS title, CASE WHEN p_partkey % 6 = 5 THEN NULL WHEN p_partkey % 6 = 0 THEN {PART_ISBN} WHEN p_partkey % 6 = 1 THEN {PART_ISBN} WHEN p_partkey % 6 = 2 THEN {PART_ISBN} END AS isbn13,
  CASE WHEN p_partkey % 6 < 5 THEN 'https://c/' || CAST(p_size AS VARCHAR) END AS cover FROM part""")
def volume_records(spark, sf_dir):
    """Volumes with a code of 13 digits, of 10, an invalid one before a valid one, none, and without a title."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 6
    code = book_isbn(F.col("p_partkey"))
    nine = F.lpad(F.col("p_partkey").cast("string"), 9, "0")
    from ..functions.ids import check_digit_10

    short = F.concat(nine, check_digit_10(nine))
    one = lambda kind, c: F.struct(F.lit(kind).alias("type"), c.alias("identifier"))
    wrong = F.concat(F.substring(code, 1, 12), F.pmod(F.substring(code, 13, 1).cast("int") + 1, F.lit(10)).cast("string"))
    codes = F.when(k == 0, F.array(one("ISBN_10", short), one("ISBN_13", code))).when(k == 1, F.array(one("OTHER", code), one("ISBN_10", short))).when(k == 2, F.array(one("ISBN_13", wrong), one("ISBN_13", code))).otherwise(F.array(one("ISBN_13", wrong)))
    volume = F.struct(F.when(k != 5, F.concat(F.lit(" "), "p_name")).alias("title"), F.array("p_brand").alias("authors"), codes.alias("industryIdentifiers"), F.struct(F.concat(F.lit("http://c/"), F.col("p_size").cast("string")).alias("thumbnail")).alias("imageLinks"))
    r = records.volume_record(F.to_json(F.struct(volume.alias("volumeInfo"))))
    return p.select("p_partkey", r.alias("r")).select("p_partkey", "r.title", "r.isbn13", F.col("r.coverUrl").alias("cover"))


@query("""
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'The ' || seg || ' Book' WHEN 1 THEN seg || ' of the Long Winter' WHEN 2 THEN seg || ' Press' ELSE '' END AS title, CASE WHEN c_custkey % 4 < 2 THEN [seg || ' Smith'] ELSE [] END AS authors,
  CASE c_custkey % 4 WHEN 0 THEN seg || ' Press' WHEN 2 THEN seg || ' Press' END AS publisher, CASE c_custkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END AS kept
FROM (SELECT *, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS seg FROM customer)""")
def fragment_roles(spark, sf_dir):
    """Which line is the title, an author, the publisher; stray signs, a line of one sign, a publisher alone, nothing."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey") % 4
    seg = F.initcap("c_mktsegment")
    f = lambda t, conf=0.9: F.struct(t.alias("text"), F.lit(conf).alias("confidence"))
    lines = (
        F.when(k == 0, F.array(f(F.concat(F.lit("|| The "), seg, F.lit("  Book ▒"))), f(F.concat(seg, F.lit(" Smith"))), f(F.concat(F.lit("* "), seg, F.lit(" Press"))), f(F.lit("x"))))
        .when(k == 1, F.array(f(F.concat(seg, F.lit(" Smith")), 0.5), f(F.concat(seg, F.lit(" of the Long Winter")), 1.0))).when(k == 2, F.array(f(F.concat(seg, F.lit(" Press"))))).otherwise(F.array(f(F.lit("--")), f(F.lit("▒"))))
    )
    d = c.select("c_custkey", mentions.roles(lines).alias("r"), F.size(mentions.clean_fragments(lines)).alias("kept"))
    return d.select("c_custkey", "r.title", "r.authors", "r.publisher", "kept")


@query("""
SELECT doc_id, i - 1 AS pos, trim(regexp_replace(regexp_replace(regexp_replace(l[i], '[^A-Za-z0-9~:.,&''!?/+#()\\- ]', ' ', 'g'), ' +', ' ', 'g'), '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE regexp_matches(text, '^[\\x20-\\x7e\\n]*$')), unnest(range(1, len(l) + 1)) AS u(i)""")
def clean_lines(spark, sf_dir):
    """Every line of the documents that are plain ASCII."""
    d = table(spark, sf_dir, "documents").filter(F.col("text").rlike("^[\\x20-\\x7e\\n]*$"))
    return d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), text.clean_line(F.col("line"), folded=True).alias("line"))


@query(f"""
SELECT vec_id, list_transform(range(CAST(w * h AS BIGINT)), lambda i: g[CAST(least(7, floor(floor(i / w) * 8 / h)) * 8 + least(7, floor(i % w * 8 / w)) AS BIGINT) + 1]) AS small
FROM (SELECT vec_id, g, CAST(1 + vec_id % 11 AS DOUBLE) AS w, CAST(greatest(1, floor(vec_id % 7 / 2.0 + 0.5)) AS DOUBLE) AS h FROM {GRID_SQL})""")
def downscale(spark, sf_dir):
    """Images of 8 by 8 pixels to 1 to 11 by 1 to 3."""
    g = _grids(spark, sf_dir)
    return g.select("vec_id", images.downscale(F.col("grid"), F.lit(8), F.lit(8), 1 + F.col("vec_id") % 11, F.col("vec_id") % 7 / 2.0).alias("small"))


@query(f"""
WITH b AS (SELECT vec_id, g, k, CAST((vec_id + k) % 8 AS DOUBLE) / 8 AS bx, CAST((vec_id + 3 * k) % 8 AS DOUBLE) / 8 AS "by", CAST(1 + k AS DOUBLE) / 16 AS bw, CAST((vec_id + k) % 4 AS DOUBLE) / 8 AS bh FROM {GRID_SQL}, unnest([0, 1, 2]) AS u(k)),
r AS (SELECT *, greatest(0, CAST(floor(bx * 8 - bw * 8 * CAST(0.35 AS DOUBLE) + 0.5) AS INTEGER)) AS x, greatest(0, CAST(floor("by" * 8 - bh * 8 * CAST(0.35 AS DOUBLE) * CAST(0.06 AS DOUBLE) + 0.5) AS INTEGER)) AS y,
  least(8, CAST(floor((bx + bw) * 8 + bw * 8 * CAST(0.35 AS DOUBLE) + 0.5) AS INTEGER)) AS x2, least(8, CAST(floor(("by" + bh) * 8 + bh * 8 * CAST(0.35 AS DOUBLE) * CAST(0.06 AS DOUBLE) + 0.5) AS INTEGER)) AS y2 FROM b WHERE bh > 0),
s AS (SELECT *, greatest(1, x2 - x) AS w, greatest(1, y2 - y) AS h FROM r)
SELECT vec_id, k, w AS crop_width, h AS crop_height, list_transform(range(w * h), lambda i: g[(y + i // w) * 8 + x + i % w + 1]) AS crop FROM s""")
def strip_crops(spark, sf_dir):
    """Three boxes per image, one of a few of them without a height."""
    g = _grids(spark, sf_dir).withColumn("width", F.lit(8)).withColumn("height", F.lit(8))
    v, k = F.col("vec_id"), F.col("k")
    boxes = g.select("vec_id", F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("k"))
    box = F.struct(((v + k) % 8 / 8).alias("x"), ((v + 3 * k) % 8 / 8).alias("y"), ((k + 1) / 16).alias("width"), ((v + k) % 4 / 8).alias("height"))
    return images.crops(g, boxes.withColumn("box", box), "vec_id", "grid", "width", "height", "box").select("vec_id", "k", "crop_width", "crop_height", "crop")


@query(f"""
WITH p AS (SELECT vec_id, CAST(i % 8 AS INTEGER) AS x, g[i + 1] AS v, CASE WHEN i % 8 BETWEEN 2 AND 5 THEN CASE WHEN g[i + 1] + 10 <= g[i - 1] AND g[i + 1] + 10 <= g[i + 3] THEN 1.0 ELSE 0.0 END ELSE 0.0 END AS dark FROM {GRID_SQL}, unnest(range(64)) AS u(i))
SELECT vec_id, x, round(avg(v), 6) AS mean, round(avg(dark), 6) AS groove FROM p GROUP BY ALL""")
def column_profiles(spark, sf_dir):
    g = _grids(spark, sf_dir)
    d = images.column_mean(g, "vec_id", "grid", 8).join(images.groove_density(g, "vec_id", "grid", 8, 1.5), ["vec_id", "x"])
    return d.select("vec_id", "x", F.round("mean", 6).alias("mean"), F.round("density", 6).alias("groove"))


@query("SELECT user_id, arg_max(event_id, (value, -event_id)) AS event_id FROM events GROUP BY user_id")
def sharpest(spark, sf_dir):
    return images.sharpest(table(spark, sf_dir, "events"), "user_id", "value", "event_id").select("user_id", "event_id")


def _scan(spark, sf_dir) -> DataFrame:
    e = F.col("event_id")
    outcome = F.when(F.col("event_type") == "click", "queued").when(F.col("event_type") == "view", "duplicate").otherwise("rejected")
    return table(spark, sf_dir, "events").filter("user_id is not null").select(F.col("user_id").alias("session"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), e.alias("seq"), outcome.alias("outcome"), (e % 4).cast("int").alias("recognised"), (e % 3).cast("int").alias("produced"))


@query("""
SELECT user_id AS session, count_if(event_type = 'click') AS captured, count_if(event_type = 'click' AND event_id % 4 = 0) AS unreadable, CAST(sum(event_id % 4) AS BIGINT) AS recognised, CAST(sum(event_id % 3) AS BIGINT) AS produced FROM events WHERE user_id IS NOT NULL GROUP BY ALL""")
def scan_counters(spark, sf_dir):
    return diagnostics.counters(_scan(spark, sf_dir))


@query("""
WITH r AS (SELECT *, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS n, row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY epoch_us(ts) // 1000 DESC, event_id DESC) AS c FROM events WHERE user_id IS NOT NULL)
SELECT user_id AS session, string_agg(CAST(event_id AS VARCHAR) || ':' || CAST(CASE WHEN event_id % 2 = 0 THEN event_id % 3 ELSE event_id % 2 END AS VARCHAR), ',' ORDER BY ms, event_id) FILTER (WHERE n <= 8) AS frames,
  least(20, count_if(event_type = 'click')) AS lookups, least(60, count(*)) AS resolutions, max(strftime(make_timestamp(ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z') AS last FROM r GROUP BY user_id""")
def scan_report(spark, sf_dir):
    """Read back from the JSON: the frames that are left with their strips that gave a book, and how much of the rest."""
    s, even = _scan(spark, sf_dir), F.col("seq") % 2 == 0
    strip = lambda i: F.struct(F.lit(i).alias("index"), F.lit("t").alias("text"), F.when(F.lit(i) < F.col("seq") % 2, 1).otherwise(0).alias("spines"))
    frames = s.select("session", "at", "seq", F.col("seq").cast("string").alias("id"), F.when(even, "gemini").otherwise("strips").alias("mode"), F.col("produced").alias("spines"), F.lit(5).alias("ms"), F.array(strip(0), strip(1)).alias("strips"))
    lookups = s.filter("outcome = 'queued'").select("session", "at", "seq", F.lit("ndl").alias("source"), F.lit("q").alias("query"), F.lit(0).alias("hits"), F.lit(None).cast("string").alias("error"))
    resolutions = s.select("session", "at", "seq", F.lit("t").alias("entry_text"), F.lit("notFound").alias("status"), F.lit(None).cast("string").alias("top_title"), F.lit(None).cast("double").alias("top_score"))
    d = diagnostics.report(frames, lookups, resolutions, sizes=(8, 20, 60))
    kept = F.from_json("report", "frames array<struct<id:string,at:string,read:int>>, lookups array<struct<source:string>>, resolutions array<struct<at:string,status:string>>")
    d = d.select("session", kept.alias("r"))
    return d.select("session", F.array_join(F.transform("r.frames", lambda f: F.concat_ws(":", f["id"], f["read"].cast("string"))), ",").alias("frames"), F.size("r.lookups").cast("bigint").alias("lookups"), F.size("r.resolutions").cast("bigint").alias("resolutions"), F.array_max(F.transform("r.resolutions", lambda x: x["at"])).alias("last"))


@query("""
SELECT p_partkey AS id, coalesce(nullif(CASE WHEN p_partkey % 3 = 0 THEN p_name END, ''), nullif(CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '' END, '')) AS title, CASE p_partkey % 5 WHEN 0 THEN 'found' WHEN 1 THEN 'missing' WHEN 2 THEN 'looking' ELSE 'review' END AS state,
  (SELECT min(s_name) FROM supplier WHERE s_suppkey = p_partkey) AS photo FROM part WHERE p_size % 2 = 0 AND p_partkey % 7 <> 0""")
def spine_results(spark, sf_dir):
    """A session's entries with their state, each with its photo where there is one."""
    k = F.col("p_partkey")
    status = F.when(k % 5 == 0, "confirmed").when(k % 5 == 1, "notFound").when(k % 5 == 2, "unverified").when(k % 5 == 3, "conflict").otherwise("needsReview")
    e = table(spark, sf_dir, "part").select(k.alias("id"), k.alias("photo_id"), status.alias("status"), F.when(k % 7 == 0, "barcode").otherwise("spine").alias("input_kind"), (F.col("p_size") % 2).alias("session"), F.when(k % 3 == 0, F.col("p_name")).alias("resolved_title"), F.when(k % 2 == 0, F.col("p_brand")).otherwise("").alias("extracted_title"))
    photos = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("photo_id"), F.col("s_name").alias("photo"))
    return views.with_photo(views.spine_results(e, F.lit(0)), photos).select("id", "title", "state", "photo")
