"""Payloads of catalogues and recognisers, standardised to records and mentions with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import tidy

OPENBD = "summary struct<isbn:string,title:string,volume:string,series:string,publisher:string,pubdate:string,cover:string,author:string>, onix struct<CollateralDetail:struct<TextContent:array<struct<Text:string>>>>"
VOLUME = "volumeInfo struct<title:string,subtitle:string,authors:array<string>,publisher:string,publishedDate:string,description:string,industryIdentifiers:array<struct<type:string,identifier:string>>,imageLinks:struct<thumbnail:string>,infoLink:string>"
VISION = "spines array<struct<box_2d:array<double>,raw_visible_text:string,title:string,authors:array<string>,publisher:string,confidence:double>>"
# Words that tell a role, and the range of a box.
ROLE_TAIL = f"[／/][{ids.SPACE}]*(?:著|編|訳|監修|画|作|絵|原作|校訂).*$"
BOX_RANGE = 1000.0


def blank_to_null(c: Column) -> Column:
    t = tidy(c)
    return F.when(t != "", t)


def normalize_pubdate(c: Column) -> Column:
    """YYYY-MM with six digits or more, YYYY with four, else null."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.when(F.length(d) >= 6, F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2))).when(F.length(d) >= 4, F.substring(d, 1, 4))


def parse_authors(c: Column) -> Column:
    """Names of one text: cut at commas and semicolons, then each without its role."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), "[,，、;；]"), lambda a: tidy(F.regexp_replace(a, ROLE_TAIL, "")))
    return F.filter(parts, lambda a: a != "")


def openbd_record(payload: Column) -> Column:
    """struct of a record from one item, null without a title."""
    p = F.from_json(payload, OPENBD)
    s = p["summary"]
    texts = F.filter(F.transform(F.coalesce(p["onix"]["CollateralDetail"]["TextContent"], F.array().cast("array<struct<Text:string>>")), lambda t: blank_to_null(t["Text"])), lambda t: t.isNotNull())
    return F.when(
        blank_to_null(s["title"]).isNotNull(),
        F.struct(
            blank_to_null(s["title"]).alias("title"), parse_authors(s["author"]).alias("authors"), blank_to_null(s["publisher"]).alias("publisher"), normalize_pubdate(s["pubdate"]).alias("published"),
            ids.to_isbn13(s["isbn"]).alias("isbn13"), s["isbn"].alias("isbnRaw"), blank_to_null(s["series"]).alias("series"), blank_to_null(s["cover"]).alias("coverUrl"),
            F.get(texts, F.lit(0)).alias("description"), F.lit("openbd").alias("source"),
        ),
    )


def volume_record(payload: Column) -> Column:
    """struct of a record from one volume, null without a title; a valid 13-digit code comes before a 10-digit one."""
    v = F.from_json(payload, VOLUME)["volumeInfo"]
    codes = F.coalesce(v["industryIdentifiers"], F.array().cast("array<struct<type:string,identifier:string>>"))
    of = lambda kind: F.get(F.filter(F.transform(F.filter(codes, lambda i: i["type"] == kind), lambda i: F.struct(ids.to_isbn13(i["identifier"]).alias("isbn"), i["identifier"].alias("raw"))), lambda i: i["isbn"].isNotNull()), F.lit(0))
    found = F.coalesce(of("ISBN_13"), of("ISBN_10"))
    return F.when(
        blank_to_null(v["title"]).isNotNull(),
        F.struct(
            blank_to_null(v["title"]).alias("title"), blank_to_null(v["subtitle"]).alias("subtitle"), F.coalesce(v["authors"], F.array().cast("array<string>")).alias("authors"),
            v["publisher"].alias("publisher"), v["publishedDate"].alias("published"), found["isbn"].alias("isbn13"), found["raw"].alias("isbnRaw"),
            F.regexp_replace(v["imageLinks"]["thumbnail"], "^http://", "https://").alias("coverUrl"), v["description"].alias("description"), F.lit("googleBooks").alias("source"), v["infoLink"].alias("sourceUrl"),
        ),
    )


#: One <item> without prefixes; repeated children are arrays.
ITEM = "title array<string>, link array<string>, creator array<string>, publisher array<string>, issued array<string>, seriesTitle array<string>, identifier array<struct<_VALUE:string,_type:string>>"


def xml_items(df: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """One record per <item>, whatever its prefixes; malformed XML raises. Absent fields are null."""
    x = F.col(xml_col)
    checked = df.filter(F.size(F.xpath(x, F.lit("/*"))) > 0)  # raises on what isn't well-formed
    items = F.regexp_extract_all(x, F.lit(r"(?s)<(?:[\w.-]+:)?item[\s>].*?</(?:[\w.-]+:)?item>"), 0)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace("item", r"(</?)[\w.-]+:", "$1"), r"\sxmlns(?::[\w.-]+)?=(?:\"[^\"]*\"|'[^']*')", ""), r"\s[\w.-]+:(\w+=)", " $1")
    d = checked.select(id_col, F.posexplode(items).alias("ordinal", "item"))
    d = d.select(id_col, "ordinal", F.from_xml(plain, ITEM, {"mode": "FAILFAST"}).alias("r"))
    texts = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda t: tidy(F.coalesce(t, F.lit("")))), lambda t: t != "")
    one = lambda c: F.get(texts(F.col(f"r.{c}")), F.lit(0))
    codes = F.coalesce("r.identifier", F.array().cast("array<struct<_VALUE:string,_type:string>>"))
    valid = lambda a: F.get(F.filter(F.transform(a, lambda i: ids.extract_isbn13(i["_VALUE"])), lambda i: i.isNotNull()), F.lit(0))
    typed = F.filter(codes, lambda i: F.coalesce(F.upper(i["_type"]).contains("ISBN"), F.lit(False)))
    return d.select(
        id_col, "ordinal", one("title").alias("title"), texts(F.col("r.creator")).alias("authors"), one("publisher").alias("publisher"), one("issued").alias("published"),
        F.coalesce(valid(typed), valid(codes)).alias("isbn13"), one("seriesTitle").alias("series"), one("link").alias("sourceUrl"), F.lit("ndl").alias("source"),
    )


def vision_box(b: Column) -> Column:
    """[top, left, bottom, right] of 0..1000 as a box of 0..1, clamped; null for an empty or malformed one."""
    at = lambda i: F.least(F.lit(BOX_RANGE), F.greatest(F.lit(0.0), F.get(b, F.lit(i)))) / BOX_RANGE
    ok = (F.size(b) == 4) & ~F.exists(b, lambda x: x.isNull() | F.isnan(x)) & (at(3) > at(1)) & (at(2) > at(0))
    return F.when(ok, F.struct(at(1).alias("x"), at(0).alias("y"), (at(3) - at(1)).alias("width"), (at(2) - at(0)).alias("height")))


def vision_mentions(df: DataFrame, id_col: str, payload: str) -> DataFrame:
    """id_col, pos, title, authors, publisher, confidence, box: valid spines of a payload, pos from left to right."""
    d = df.select(id_col, F.posexplode(F.from_json(payload, VISION)["spines"]).alias("__p", "s")).withColumn("box", vision_box(F.col("s.box_2d")))
    line = F.get(F.filter(F.transform(F.split("s.raw_visible_text", "\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    title = F.coalesce(F.when(F.trim("s.title") != "", F.trim("s.title")), line)
    names = F.filter(F.transform(F.coalesce("s.authors", F.array().cast("array<string>")), lambda a: F.trim(F.coalesce(a, F.lit("")))), lambda a: a != "")
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("s.confidence", F.lit(0.0))))
    d = d.select(id_col, "__p", title.alias("title"), names.alias("authors"), F.when(F.trim("s.publisher") != "", F.trim("s.publisher")).alias("publisher"), confidence.alias("confidence"), "box")
    d = d.filter("box is not null and title is not null")
    order = F.array_sort(F.collect_list(F.struct(F.col("box.x").alias("x"), "__p", "title", "authors", "publisher", "confidence", "box")))
    return d.groupBy(id_col).agg(order.alias("m")).select(id_col, F.posexplode("m").alias("pos", "m")).select(id_col, "pos", "m.title", "m.authors", "m.publisher", "m.confidence", "m.box")


def proxied_url(proxy: Column, target: Column) -> Column:
    """Null without a proxy; a proxy that ends in = gets the target encoded, any other one gets it as a path."""
    p = F.trim(proxy)
    encoded = F.url_encode(target)
    for java, plain in (("\\+", "%20"), ("%28", "("), ("%29", ")"), ("%7E", "~"), ("%21", "!"), ("%27", "'")):
        encoded = F.regexp_replace(encoded, java, plain)
    return F.when(p == "", None).when(F.endswith(p, F.lit("=")), F.concat(p, encoded)).otherwise(F.concat(F.regexp_replace(p, "/+$", ""), F.lit("/"), target))


def is_gzip(content: Column) -> Column:
    return F.substring(content, 1, 2) == F.unhex(F.lit("1F8B"))
