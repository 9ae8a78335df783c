"""From recogniser output and scans to rows: flattening of pages, choice of passes, entries, the relay's request rules."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What counts as a word and as a column.
LEAST_WORD_CONFIDENCE, LEAST_COLUMN_CHARS, ENOUGH_COLUMNS = 0.3, 3, 2
BBOX = "struct<x0:double,y0:double,x1:double,y1:double>"
PAGE = f"blocks array<struct<paragraphs:array<struct<lines:array<struct<confidence:double,bbox:{BBOX},words:array<struct<text:string,confidence:double,bbox:{BBOX}>>>>>>>>"


class Recognizer(Protocol):
    """Turns batches of images into batches of recognitions; used with mapInPandas."""

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]: ...


def recognise(frames: DataFrame, recognizer: Recognizer, schema: str) -> DataFrame:
    return frames.mapInPandas(recognizer, schema)


def to_box(b: Column, width: Column, height: Column) -> Column:
    w, h, zero = F.greatest(F.lit(1), width), F.greatest(F.lit(1), height), F.lit(0.0)
    return F.struct((b["x0"] / w).alias("x"), (b["y0"] / h).alias("y"), (F.greatest(zero, b["x1"] - b["x0"]) / w).alias("width"), (F.greatest(zero, b["y1"] - b["y0"]) / h).alias("height"))


def unrotate(b: Column, quarter_turns: Column) -> Column:
    """A box read on a page turned by 0, 1 or 3 quarters, back in the page's own frame."""
    as_box = lambda x, y, w, h: F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    return (
        F.when(quarter_turns == 3, as_box(b["y"], 1 - b["x"] - b["width"], b["height"], b["width"]))
        .when(quarter_turns == 1, as_box(1 - b["y"] - b["height"], b["x"], b["height"], b["width"])).otherwise(as_box(b["x"], b["y"], b["width"], b["height"]))
    )


def page_columns(df: DataFrame, keys: list[str], page: str, width: str, height: str, turns: str) -> DataFrame:
    """keys, column, text, confidence, box, words: lines of a page with enough sure characters, in reading order."""
    d = df.select(*keys, width, height, turns, F.from_json(page, PAGE)["blocks"].alias("b"))
    d = d.select(*keys, width, height, turns, F.posexplode("b").alias("bi", "b")).select(*keys, width, height, turns, "bi", F.posexplode("b.paragraphs").alias("pi", "p"))
    d = d.select(*keys, width, height, turns, "bi", "pi", F.posexplode("p.lines").alias("li", "l"))
    share = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(0.0)) / 100))
    box = lambda b: unrotate(to_box(b, F.col(width), F.col(height)), F.col(turns))
    words = F.transform("l.words", lambda w: F.struct(F.regexp_replace(F.coalesce(w["text"], F.lit("")), r"\s+", "").alias("text"), share(w["confidence"]).alias("confidence"), box(w["bbox"]).alias("box")))
    words = F.filter(words, lambda w: (w["text"] != "") & (w["confidence"] >= LEAST_WORD_CONFIDENCE))
    d = d.select(*keys, "bi", "pi", "li", words.alias("words"), share(F.col("l.confidence")).alias("confidence"), box(F.col("l.bbox")).alias("box"))
    d = d.withColumn("text", F.array_join(F.transform("words", lambda w: w["text"]), "")).filter(F.length("text") >= LEAST_COLUMN_CHARS)
    w = Window.partitionBy(*keys).orderBy("bi", "pi", "li")
    return d.withColumn("column", F.row_number().over(w) - 1).select(*keys, "column", "text", "confidence", "box", "words")


def best_pass(passes: DataFrame, key: str, order: str, columns: str) -> DataFrame:
    """Per frame the first pass with enough columns, else the one with most, the earliest of equals."""
    enough = F.col(columns) >= ENOUGH_COLUMNS
    w = Window.partitionBy(key).orderBy(F.desc(enough), F.when(enough, F.col(order)), F.desc(columns), F.col(order))
    return passes.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def entries_from_isbns(df: DataFrame, isbn: str, prefix: str, order: str) -> DataFrame:
    """One unverified entry per scanned ISBN (a row each), named prefix-0, prefix-1, ... in order."""
    w = Window.partitionBy(prefix).orderBy(order)
    d = df.select(prefix, F.col(isbn).alias("isbn13"), (F.row_number().over(w) - 1).alias("i"))
    return d.select(
        F.concat(F.col(prefix), F.lit("-"), F.col("i").cast("string")).alias("id"), F.col(prefix).alias("photo_id"), F.col("isbn13").alias("raw_text"), "isbn13", F.lit("barcode").alias("isbn_provenance"),
        F.lit("unverified").alias("status"), F.lit(False).alias("pinned"), F.lit("barcode").alias("input_kind"),
    )


def entries_from_mentions(df: DataFrame, photo: str, prefix: str, pos: str) -> DataFrame:
    """One unverified entry per mention (title, authors, publisher, confidence, fragments as text lines)."""
    raw = F.coalesce(F.when(F.size("lines") > 0, F.array_join("lines", "\n")), F.concat_ws(" ", "title", F.array_join("authors", " "), "publisher"))
    return df.select(
        F.concat(F.col(prefix), F.lit("-"), F.col(pos).cast("string")).alias("id"), F.col(photo).alias("photo_id"), raw.alias("raw_text"), "title", "authors", "publisher", "confidence",
        F.lit("unverified").alias("status"), F.lit(False).alias("pinned"), F.lit("spine").alias("input_kind"),
    )


def output_text(payload: Column) -> Column:
    """The first text of the first model output among a response's steps."""
    schema = "steps array<struct<type:string,content:array<struct<type:string,text:string>>>>"
    step = F.get(F.filter(F.from_json(payload, schema)["steps"], lambda s: s["type"] == "model_output"), F.lit(0))
    return F.get(F.filter(step["content"], lambda c: (c["type"] == "text") & c["text"].isNotNull()), F.lit(0))["text"]


def relay_verdict(origin: Column, method: Column, target: Column, origins: list[str], host: str) -> Column:
    """The relay's answer to a request as an HTTP status: 200 if it is passed on."""
    there = F.try_parse_url(target, F.lit("HOST"))
    return (
        F.when(~F.coalesce(origin.isin(*origins), F.lit(False)), 403).when(method == "OPTIONS", 204).when(method != "GET", 405).when(F.coalesce(target, F.lit("")) == "", 400)
        .when(there.isNull(), 400).when((there != host) | (F.try_parse_url(target, F.lit("PROTOCOL")) != "https"), 403).otherwise(200)
    )
