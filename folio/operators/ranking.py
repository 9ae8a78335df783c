"""A running number over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: str, name: str = "index", parts: int = 64) -> DataFrame:
    """df with name: 1, 2, ... in the order of a numeric column (nulls last, ties by a hash of the row, so that runs agree).

    Rows are dealt into ranges cut at approximate quantiles; each range is numbered on its own and starts where the
    counts of the ranges before it end. What the driver gets is one cut and one count per range.
    """
    cuts = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 10_000).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    below = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c < F.col(order))) if cuts else F.lit(0)
    d = df.withColumn("__b", F.when(F.col(order).isNull(), len(cuts) + 1).otherwise(below))
    counts = {r["__b"]: r.n for r in d.groupBy("__b").agg(F.count("*").alias("n")).collect()}
    starts, total = [], 0
    for b in sorted(counts):
        starts += [F.lit(b), F.lit(total)]
        total += counts[b]
    if not counts:
        return d.withColumn(name, F.lit(0).cast("bigint")).drop("__b")
    plain = [c for c, t in df.dtypes if "map<" not in t]
    number = F.row_number().over(Window.partitionBy("__b").orderBy(F.asc_nulls_last(order), F.xxhash64(*plain)))
    return d.withColumn(name, (number + F.create_map(*starts)[F.col("__b")]).cast("bigint")).drop("__b")
