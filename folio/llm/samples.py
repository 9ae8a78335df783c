"""Bounded samples of labelled rows, for fitting only: what is counted or scored covers all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col) -> F.Column:
    """Rows kept from all fitting: crc32 of the id as text is a multiple of 5. A null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, most: dict[int, int]) -> DataFrame:
    """(id, y): of the rows not held out, at most most[y] ids per label y, lowest hash of the id first.

    Null ids and labels are left out; an id with several labels takes the largest.
    """
    known = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
        .select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
        .groupBy("id").agg(F.max("y").alias("y"))
    )
    parts = [known.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in most.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def texts_of(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """The sample's rows with their documents; an id that repeats counts once, with its least text."""
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)
    rest = [c for c in d.columns if c not in ("id", "text")]
    one = d.join(F.broadcast(sample), "id").groupBy("id").agg(F.min(F.struct("text", *rest)).alias("r"), F.max("y").alias("y"))
    return one.select("id", "y", "r.*")
