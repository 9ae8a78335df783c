"""Queries of the order-dependent folds and of keyed tables, over `events` and images, with recursive SQL beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import capture
from . import oracle as o
from .catalogue import query, table, whole_units

#: An hour of the table counts as a second; a value is a gray level and a number of bits.
FRAMES_SQL = """(SELECT CAST(user_id AS VARCHAR) AS session, event_id AS frame, epoch_ms(ts) // 3600000 * 1000 AS t, event_type <> 'view' AS usable, value % 1 AS sharp, event_id % 10 = 0 AS busy,
    CAST(floor(value) AS INTEGER) % 256 AS v, CAST(floor(value) AS INTEGER) % 65 AS k, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) // 3600000, event_id) AS n FROM events WHERE user_id IS NOT NULL)"""


def _frames(spark, sf_dir) -> DataFrame:
    level = F.floor("value").cast("int")
    nibble = lambda j: F.substring(F.lit("08cef"), F.least(F.lit(4), F.greatest(F.lit(0), level % 65 - 4 * j)) + 1, F.lit(1))
    return table(spark, sf_dir, "events").select(
        "user_id", F.col("event_id").alias("frame"), (whole_units(F.col("ts"), 3_600_000) * 1000).alias("at"), (F.col("event_type") != "view").alias("usable"),
        (F.col("value") % 1).alias("sharp"), (F.col("event_id") % 10 == 0).alias("busy"), F.unhex(F.lpad(F.hex((level % 256).cast("bigint")), 2, "0")).alias("gray"), F.concat(*[nibble(j) for j in range(16)]).alias("hash"),
    )


@query(f"""
WITH RECURSIVE f AS {FRAMES_SQL},
g AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS frame, CAST(0 AS BIGINT) AS t, CAST('' AS VARCHAR) AS decision, 0 AS stable, CAST(NULL AS BIGINT) AS since, CAST(0 AS DOUBLE) AS best, CAST(NULL AS INTEGER) AS prev, CAST(NULL AS INTEGER) AS shot, CAST(NULL AS BIGINT) AS shot_at FROM f
  UNION ALL
  SELECT session, n, frame, t, d, CASE WHEN d = 'wait' AND moved <= 0.06 THEN stable + 1 WHEN d IN ('held', 'busy') THEN stable ELSE 0 END, CASE WHEN d = 'capture' THEN t ELSE since END, CASE WHEN d = 'capture' THEN 0 ELSE best END,
    CASE WHEN d = 'capture' THEN NULL ELSE v END, CASE WHEN d = 'capture' THEN v ELSE shot END, CASE WHEN d = 'capture' THEN t ELSE shot_at END
  FROM (SELECT *, CASE WHEN NOT usable THEN 'reject'
      WHEN NOT (moved <= 0.06 AND stable + 1 >= 3 OR t - since >= 8000 OR t - since >= 4000 AND sharp >= best * CAST(0.85 AS DOUBLE)) THEN 'wait'
      WHEN shot IS NOT NULL AND abs(v - shot) / 255.0 < 0.1 AND t - shot_at < 10000 THEN 'held' WHEN busy THEN 'busy' ELSE 'capture' END AS d
    FROM (SELECT g.session, f.n, f.frame, f.t, f.usable, f.sharp, f.busy, f.v, g.stable, coalesce(g.since, f.t) AS since, greatest(g.best, f.sharp) AS best, g.shot, g.shot_at, coalesce(abs(f.v - g.prev) / 255.0, 1) AS moved
          FROM g JOIN f ON f.session = g.session AND f.n = g.n + 1)))
SELECT session, t AS "at", frame, decision FROM g WHERE n > 0""")
def capture_gate(spark, sf_dir):
    """Every event as a frame of one gray level."""
    return capture.capture_gate(_frames(spark, sf_dir), "user_id", "at", "frame", "usable", "sharp", "gray", "busy")


@query(f"""
WITH RECURSIVE f AS (SELECT *, array_to_string(list_transform(range(16), lambda j: substr('08cef', CAST(least(4, greatest(0, k - 4 * j)) AS INTEGER) + 1, 1)), '') AS h FROM {FRAMES_SQL}),
g AS (
  SELECT DISTINCT session, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS frame, CAST(0 AS BIGINT) AS t, false AS captured, CAST([] AS STRUCT(h VARCHAR, a BIGINT)[]) AS c FROM f
  UNION ALL
  SELECT session, n, frame, t, coalesce(p, 0) = 0, CASE WHEN coalesce(p, 0) = 0 THEN list_append(live, struct_pack(h := h, a := t)) ELSE list_transform(live, lambda x, i: struct_pack(h := x.h, a := CASE WHEN i = p THEN t ELSE x.a END)) END
  FROM (SELECT *, list_position(list_transform(live, lambda x: {o.hamming('x.h', 'h')} <= 6), true) AS p
    FROM (SELECT g.session, f.n, f.frame, f.t, f.h, list_filter(g.c, lambda x: x.a >= f.t - 8000) AS live FROM g JOIN f ON f.session = g.session AND f.n = g.n + 1)))
SELECT session, t AS "at", frame, captured FROM g WHERE n > 0""")
def near_captures(spark, sf_dir):
    """Every event as a view whose hash has as many bits as its value says."""
    return capture.near_captures(_frames(spark, sf_dir), "user_id", "at", "frame", "hash")
