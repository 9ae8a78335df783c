"""What a scan did: counters per session, and a report of a fixed size that a person can read and send."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Records of a session that a report keeps.
FRAMES, LOOKUPS, RESOLUTIONS = 8, 120, 60


def strips_with_books(mode: Column, spines: Column, strips: Column) -> Column:
    """How many strips gave a book: a frame that was read whole counts its spines, else strips with any."""
    return F.when(mode == "gemini", spines).when(strips.isNull(), 0).otherwise(F.size(F.filter(strips, lambda s: s["spines"] > 0)))


def mean_confidence(confidences: Column) -> Column:
    """0 without any."""
    c = F.filter(F.coalesce(confidences, F.array().cast("array<double>")), lambda x: x.isNotNull())
    return F.when(F.size(c) > 0, F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)).otherwise(0.0)


def counter_columns() -> list[Column]:
    """Aggregates over frames (outcome, recognised, produced); take them in a groupBy, or in observe() on a running query."""
    return [
        F.count_if(F.col("outcome") == "queued").alias("captured"), F.count_if((F.col("outcome") == "queued") & (F.coalesce("recognised", F.lit(0)) == 0)).alias("unreadable"),
        F.coalesce(F.sum("recognised"), F.lit(0)).cast("bigint").alias("recognised"), F.coalesce(F.sum("produced"), F.lit(0)).cast("bigint").alias("produced"),
    ]


def counters(frames: DataFrame, session: str = "session") -> DataFrame:
    return frames.groupBy(session).agg(*counter_columns())


def _last(df: DataFrame, n: int, columns: list[str], name: str) -> DataFrame:
    """session, name: the last n rows by time as an array, oldest first; rows are cut per task before they move."""
    w = Window.partitionBy("session").orderBy(F.desc("at"), F.desc("seq"))
    kept = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    item = F.struct("at", "seq", F.struct(F.date_format(F.timestamp_millis("at"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("at"), *columns).alias("row"))
    return kept.groupBy("session").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["row"]).alias(name))


def report(frames: DataFrame, lookups: DataFrame, resolutions: DataFrame, sizes=(FRAMES, LOOKUPS, RESOLUTIONS)) -> DataFrame:
    """session, report: JSON of the last frames, lookups and resolutions of each session.

    All three have session, at (milliseconds) and seq (which breaks ties); frames have id, mode, spines, ms and strips
    (array<struct<index, text, spines>>); lookups source, query, hits, error; resolutions entry_text, status, top_title,
    top_score. A session that only one of them knows has empty lists for the others. Times are told in UTC.
    """
    f = frames.select("session", "at", "seq", "id", "mode", "spines", "ms", "strips", F.size("strips").alias("bandCount"), strips_with_books(F.col("mode"), F.col("spines"), F.col("strips")).alias("read"))
    parts = [_last(f, sizes[0], ["id", "mode", "spines", "ms", "bandCount", "read", "strips"], "frames"), _last(lookups, sizes[1], ["source", "query", "hits", "error"], "lookups"), _last(resolutions, sizes[2], ["entry_text", "status", "top_title", "top_score"], "resolutions")]
    d = parts[0].join(parts[1], "session", "full").join(parts[2], "session", "full")
    lists = [F.coalesce(F.col(c), F.array().cast(d.schema[c].dataType)).alias(c) for c in ("frames", "lookups", "resolutions")]
    return d.select("session", F.to_json(F.struct(*lists)).alias("report"))
