"""Line deduplication across documents, in DataFrame functions only.

1. Every text is split into lines; keys (trimmed, A-Z lower-cased) of some length are exploded with their position, as
   128 bits of hash, without their text.
2. Distinct documents are counted per hash, after a partial count in every task.
3. The hashes of too many documents are written as a table and joined back: only hashes and positions move, and as both
   sides are dealt for the join alone, adaptive execution splits a hash that a third of all documents hold. What a
   document loses is gathered as positions.
4. Each text, which moves once, drops those positions and is put together again in order.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: `[\x20\x09-\x0D]`
SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case and every other character as it is."""
    trimmed = F.btrim(line, F.lit(SPACE))
    ascii_only = F.octet_length(trimmed) == F.char_length(trimmed)
    return F.when(ascii_only, F.lower(trimmed)).otherwise(F.translate(trimmed, ascii_uppercase, ascii_lowercase))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, positions): positions, from 0, of the lines that each document loses; only documents that lose some.

    A document is known by its id and a hash of its text: rows equal in both lose the same lines.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.transform(_lines(text), line_key).alias("keys"))
    hashed = keyed.select("id", "text_hash", F.posexplode("keys").alias("position", "key")).filter(F.char_length("key") >= least_chars).select(
        "id", "text_hash", "position", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2")
    )
    # Ids are counted once each; null ids count as one document more, which never is the largest.
    common = (
        hashed.groupBy("h1", "h2")
        .agg(F.countDistinct("id").alias("ids"), F.max(F.col("id").isNull().cast("int")).alias("null_id"), F.max("id").alias("keeper"))
        .filter(F.col("ids") + F.col("null_id") >= least_docs)
        .select("h1", "h2", "keeper")
    )
    lost = hashed.join(materialize(common), ["h1", "h2"]).filter(F.col("id").isNull() | (F.col("id") != F.col("keeper")))
    return lost.groupBy("id", "text_hash").agg(F.collect_set("position").alias("positions"))


def dedup_lines(docs: DataFrame, least_chars: int = 20, least_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_lines, n_dropped, kept_text: one row per input row.

    Texts are split at `\\n`; a null or empty text is one empty line. A key of at least least_chars code points that at
    least least_docs documents hold is dropped from all of them but the one with the largest id, which keeps all its
    lines with that key. What is left is joined by `\\n`; nothing left gives an empty text. Rows that repeat an id count
    as one document per key and are each put together from their own text; null ids together count as one document,
    smaller than any. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("text_hash", F.xxhash64("text"))
    lost = repeated_lines(docs, least_chars, least_docs, id_col, text_col).withColumnsRenamed({"id": "lost_id", "text_hash": "lost_hash"})
    joined = whole.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("text_hash") == F.col("lost_hash")), "left")
    cut = joined.select("id", "positions", _lines(F.col("text")).alias("lines"))
    gone = F.coalesce(F.size("positions"), F.lit(0))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("positions"))  # in order, each once
    kept = F.array_join(F.when(F.col("positions").isNull(), F.col("lines")).otherwise(F.transform(stay, lambda i: F.col("lines")[i])), "\n")
    return cut.select(F.col("id").alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.when(gone < 0, 0).otherwise(gone).cast("long").alias("n_dropped"), kept.alias("kept_text"))
