"""Export formats: one text column per row, and writers that add what stands around the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import format_isbn13
from ..operators.ranking import numbered
from ..operators.triage import exportable
from ..schema import CSV_HEADER, MARKDOWN_HEADER

BOM, CRLF = "﻿", "\r\n"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def csv_field(c: Column) -> Column:
    v = _text(c)
    return F.when(v.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_row(r: dict[str, Column], status: Column) -> Column:
    """One line without its end. r: title, subtitle, authors (array), publisher, published, isbn13, series, source."""
    values = [r["title"], r["subtitle"], F.array_join(r["authors"], "; "), r["publisher"], r["published"], format_isbn13(_text(r["isbn13"])), r["series"], r["source"], status]
    return F.concat_ws(",", *[csv_field(v) for v in values])


def csv_header() -> str:
    return BOM + ",".join(CSV_HEADER)


def markdown_row(r: dict[str, Column]) -> Column:
    pipes = lambda c: F.replace(_text(c), F.lit("|"), F.lit("\\|"))
    values = [pipes(r["title"]), pipes(F.array_join(r["authors"], ", ")), pipes(r["publisher"]), _text(r["published"]), format_isbn13(_text(r["isbn13"]))]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *values), F.lit(" |"))


def markdown_header() -> list[str]:
    return ["| " + " | ".join(MARKDOWN_HEADER) + " |", "|" + " --- |" * len(MARKDOWN_HEADER)]


def bibtex_entry(r: dict[str, Column], index: Column) -> Column:
    """A whole entry; fields that are empty are left out, braces in values go."""
    plain = lambda c: F.regexp_replace(c, "[{}]", "")
    field = lambda name, c: F.when(_text(c) != "", F.concat(F.lit(f"  {name} = {{"), c, F.lit("}")))
    author = F.regexp_replace(F.coalesce(F.get(r["authors"], F.lit(0)), F.lit("unknown")), "[^A-Za-z0-9]", "")
    year = F.substring(_text(r["published"]), 1, 4)
    key = F.concat(F.when(author == "", "book").otherwise(author), year, F.lit("_"), index.cast("string"))
    fields = F.concat_ws(
        ",\n", F.concat(F.lit("  title = {"), plain(_text(r["title"])), F.lit("}")), field("author", plain(F.array_join(r["authors"], " and "))), field("publisher", plain(r["publisher"])),
        field("year", F.when(_text(r["published"]) != "", year)), field("isbn", format_isbn13(_text(r["isbn13"]))),
    )
    return F.concat(F.lit("@book{"), key, F.lit(",\n"), fields, F.lit("\n}"))


def isbn_list(entries: DataFrame, order: str) -> DataFrame:
    """isbn13, first: distinct ISBNs of exportable entries with where each is first seen."""
    return entries.filter(F.col("isbn13") != "").groupBy("isbn13").agg(F.min(order).alias("first"))


def report_json(entries: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON text per entry, nulls left out: a backup keeps entries of every state."""
    return entries.select(F.to_json(F.struct(*columns)).alias("json"))


def write_lines(df: DataFrame, line: str, path: str, order: str, head: list[str] = (), end: str = "\n") -> None:
    """Write a text column in order, in as many files as there are ranges; the header is a small file that sorts first."""
    spark = df.sparkSession
    lines = numbered(df, order, "__i").sort("__i").select(line)
    if head:
        spark.createDataFrame([(h,) for h in head], "line string").coalesce(1).write.mode("overwrite").option("lineSep", end).text(f"{path}/0_head")
    lines.write.mode("overwrite").option("lineSep", end).text(f"{path}/1_rows")


WRITERS = {"csv": (csv_header, CRLF), "markdown": (markdown_header, "\n"), "bibtex": (None, "\n\n"), "isbn": (None, "\n"), "json": (None, "\n")}

__all__ = ["WRITERS", "bibtex_entry", "csv_header", "csv_row", "exportable", "isbn_list", "markdown_header", "markdown_row", "report_json", "write_lines"]
