"""Signal operators over small grey images: an image is an array of bytes in rows, with its width and height."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BLOWOUT_LEVEL, BRIGHTNESS, FORCE_MS, LEAST_SHARPNESS, MOST_BLOWOUT, NEW_SHELF, RESCUE_MS, RESCUE_RATIO, RETRY_MS, STABLE_TICKS, STILL

SHARPNESS_SCALE = 2000.0
HASH_SIDE = 8
OTSU_DEFAULT = 128
# How far a box is widened, how much less so in height, and how much darker a groove is.
PAD, PAD_HEIGHT = 0.35, 0.06
GROOVE_DEPTH = 10
PEAK_EDGE, PEAK_GROOVE, EDGE_WEIGHT, GROOVE_WEIGHT = 0.45, 0.5, 0.6, 0.4


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, x: t + x)


def brightness(pixels: Column) -> Column:
    return F.when(F.size(pixels) > 0, _sum(pixels) / F.size(pixels) / 255.0).otherwise(0.0)


def blowout(pixels: Column) -> Column:
    return F.when(F.size(pixels) > 0, F.size(F.filter(pixels, lambda v: v >= BLOWOUT_LEVEL)) / F.size(pixels)).otherwise(0.0)


def sharpness(pixels: Column, width: Column, height: Column) -> Column:
    """Variance of the four-neighbour Laplacian over the inner pixels, scaled and clamped to 1."""
    at = lambda i: F.get(pixels, i)

    def measured(w):
        inner = F.filter(F.sequence(F.lit(0), F.size(pixels) - 1), lambda i: (i >= w) & (i < w * (height - 1)) & (i % w > 0) & (i % w < w - 1))
        lap = F.transform(inner, lambda i: (at(i - 1) + at(i + 1) + at(i - w) + at(i + w) - 4 * at(i)).cast("double"))
        return F.transform(F.array(lap), lambda a: _sum(F.transform(a, lambda x: x * x)) / F.size(a) - (_sum(a) / F.size(a)) ** 2)[0]

    value = F.transform(F.array(width), measured)[0]
    return F.when((width < 3) | (height < 3), 0.0).otherwise(F.least(F.lit(1.0), value / SHARPNESS_SCALE))


def is_usable(bright: Column, blown: Column, sharp: Column) -> Column:
    return bright.between(*BRIGHTNESS) & (blown <= MOST_BLOWOUT) & (sharp >= LEAST_SHARPNESS)


def decide_capture(usable: Column, moved: Column, stable: Column, waited_ms: Column, sharp: Column, best: Column) -> Column:
    return (
        F.when(~usable, "reject").when((moved <= STILL) & (stable + 1 >= STABLE_TICKS), "capture").when(waited_ms >= FORCE_MS, "capture")
        .when((waited_ms >= RESCUE_MS) & (sharp >= RESCUE_RATIO * best), "capture").otherwise("wait")
    )


def should_rearm(difference: Column, elapsed_ms: Column) -> Column:
    return (difference >= NEW_SHELF) | (elapsed_ms >= RETRY_MS)


def frame_difference(a: Column, b: Column) -> Column:
    """Mean absolute difference as a share of full range; images of different size differ fully."""
    mean = _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double"))) / F.size(a) / 255.0
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0), 1.0).otherwise(mean)


def visual_hash(grid: Column) -> Column:
    """16 hex digits of an 8 by 8 grid: a bit is set where the value reaches the mean."""

    def hashed(m):
        nibble = lambda k: F.lower(F.hex(sum(F.when(F.get(grid, 4 * k + j) >= m, 8 >> j).otherwise(0) for j in range(4)).cast("bigint")))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(HASH_SIDE * HASH_SIDE // 4 - 1)), nibble), "")

    return F.transform(F.array(_sum(grid) / F.size(grid)), hashed)[0]


def histogram(df: DataFrame, key: str, pixels: str) -> DataFrame:
    """key, v, n: how often each byte occurs in each image."""
    return df.select(key, F.explode(pixels).alias("v")).groupBy(key, "v").agg(F.count("*").alias("n"))


def otsu(hist: DataFrame, key: str) -> DataFrame:
    """key, threshold: the largest between-class variance, the first of equal ones; 128 for an image of one value."""
    up = Window.partitionBy(key).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy(key)
    d = hist.withColumn("w0", F.sum("n").over(up).cast("double")).withColumn("s0", F.sum(F.col("n") * F.col("v")).over(up).cast("double"))
    d = d.withColumn("w", F.sum("n").over(everything)).withColumn("s", F.sum(F.col("n") * F.col("v")).over(everything)).filter("w0 < w")
    between = F.col("w0") * (F.col("w") - F.col("w0")) * (F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / (F.col("w") - F.col("w0"))) ** 2
    best = d.withColumn("b", F.round(between, 6)).groupBy(key).agg(F.max_by("v", F.struct("b", -F.col("v"))).alias("t"))
    return hist.select(key).distinct().join(best, key, "left").select(key, F.coalesce("t", F.lit(OTSU_DEFAULT)).alias("threshold"))


def to_gray(r: Column, g: Column, b: Column) -> Column:
    """Weighted brightness of a colour, halves rounded to even."""
    return F.bround((299 * r + 587 * g + 114 * b) / 1000.0).cast("int")


def smooth_profile(df: DataFrame, key: str, x: str, value: str, radius: int) -> DataFrame:
    """df with smooth: the mean over the neighbours within the radius, fewer at the ends."""
    return df.withColumn("smooth", F.avg(value).over(Window.partitionBy(key).orderBy(x).rowsBetween(-radius, radius)))


def normalize_profile(df: DataFrame, key: str, value: str) -> DataFrame:
    """df with level: the value between its key's least (0) and largest (1); 0 everywhere if those are equal."""
    w = Window.partitionBy(key)
    span = F.max(value).over(w) - F.min(value).over(w)
    return df.withColumn("level", F.when(span <= 1e-9, 0.0).otherwise((F.col(value) - F.min(value).over(w)) / span))


def local_peaks(df: DataFrame, key: str, x: str, value: str, radius: int) -> DataFrame:
    """Rows that no neighbour within the radius exceeds; of equal neighbours the left one is the peak."""
    w = Window.partitionBy(key).orderBy(x)
    left, right = F.max(value).over(w.rowsBetween(-radius, -1)), F.max(value).over(w.rowsBetween(1, radius))
    d = df.withColumn("__l", left).withColumn("__r", right)
    return d.filter((F.col("__l").isNull() | (F.col(value) > F.col("__l"))) & (F.col("__r").isNull() | (F.col(value) >= F.col("__r")))).drop("__l", "__r")


def edge_density(df: DataFrame, key: str, pixels: str, width: int, level: int = 18) -> DataFrame:
    """key, x, density: the share of rows in which a column differs from its right neighbour by the level or more."""
    p = df.select(key, F.posexplode(pixels).alias("i", "v")).select(key, (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).alias("y"), "v")
    step = p.withColumn("d", F.abs(F.lead("v").over(Window.partitionBy(key, "y").orderBy("x")) - F.col("v")))
    return step.filter("d is not null").groupBy(key, "x").agg(F.avg((F.col("d") >= level).cast("double")).alias("density"))


def merge_columns(columns: Column, least_width: float = 0.15, same: float = 0.5) -> Column:
    """Strip columns by place: narrow ones go, overlapping ones (against the group's own extent) become one.

    columns: array<struct<x, width, text>>; returns array<struct<x, width, text>> from left to right.
    """
    wide = F.array_sort(F.filter(columns, lambda c: c["width"] >= least_width))
    kind = "array<struct<x:double,width:double,text:string>>"

    def add(groups, c):
        last = F.get(groups, F.size(groups) - 1)
        end = F.least(last["x"] + last["width"], c["x"] + c["width"])
        overlap = F.greatest(F.lit(0.0), end - F.greatest(last["x"], c["x"])) / F.least(last["width"], c["width"])
        joined = F.struct(F.least(last["x"], c["x"]).alias("x"), (F.greatest(last["x"] + last["width"], c["x"] + c["width"]) - F.least(last["x"], c["x"])).alias("width"), F.concat_ws(" ", last["text"], c["text"]).alias("text"))
        alone = F.struct(c["x"].alias("x"), c["width"].alias("width"), c["text"].alias("text"))
        return F.when((F.size(groups) > 0) & (overlap >= same), F.concat(F.slice(groups, F.lit(1), F.size(groups) - 1), F.array(joined))).otherwise(F.concat(groups, F.array(alone))).cast(kind)

    return F.aggregate(wide, F.array().cast(kind), add)


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5).cast("int")


def downscale(pixels: Column, width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """The nearest pixel of each cell of a smaller (or larger) image, in rows; sizes are rounded and at least 1.

    An image without pixels stays without.
    """
    w, h = F.greatest(F.lit(1), round_half_up(to_width)), F.greatest(F.lit(1), round_half_up(to_height))

    def picked(size):
        row = lambda i: F.least(height - 1, F.floor(F.floor(i / size["w"]) * height / size["h"]).cast("int"))
        column = lambda i: F.least(width - 1, F.floor(i % size["w"] * width / size["w"]).cast("int"))
        return F.transform(F.sequence(F.lit(0), size["w"] * size["h"] - 1), lambda i: F.get(pixels, row(i) * width + column(i)))

    small = F.transform(F.array(F.struct(w.alias("w"), h.alias("h"))), picked)[0]
    return F.when(F.size(pixels) > 0, small).otherwise(F.slice(pixels, 1, 0))


def box_to_rect(box: Column, width: Column, height: Column, pad: float = PAD) -> Column:
    """struct(x, y, width, height) in whole pixels of a box of shares, widened by a share of itself (less so in height, where
    letters follow each other), cut at the image's edges and at least one pixel wide and high."""
    px, py = box["width"] * width * pad, box["height"] * height * pad * PAD_HEIGHT
    x, y = F.greatest(F.lit(0), round_half_up(box["x"] * width - px)), F.greatest(F.lit(0), round_half_up(box["y"] * height - py))
    right, bottom = F.least(width, round_half_up((box["x"] + box["width"]) * width + px)), F.least(height, round_half_up((box["y"] + box["height"]) * height + py))
    return F.struct(x.alias("x"), y.alias("y"), F.greatest(F.lit(1), right - x).alias("width"), F.greatest(F.lit(1), bottom - y).alias("height"))


def crop(pixels: Column, width: Column, rect: Column) -> Column:
    """The pixels of a rectangle (see box_to_rect), in rows."""
    rows = F.transform(F.sequence(F.lit(0), rect["height"] - 1), lambda i: F.slice(pixels, (rect["y"] + i) * width + rect["x"] + 1, rect["width"]))
    return F.flatten(rows)


def crops(frames: DataFrame, boxes: DataFrame, frame: str, pixels: str, width: str, height: str, box: str) -> DataFrame:
    """boxes with crop_width, crop_height and crop: one row per box whose frame is there, cut by a join on the frame.

    The frames' pixels move once per box of theirs; a null or empty box gives none.
    """
    d = boxes.filter(F.col(box).isNotNull() & (F.col(f"{box}.width") > 0) & (F.col(f"{box}.height") > 0)).join(frames.select(frame, pixels, width, height), frame)
    d = d.withColumn("__rect", box_to_rect(F.col(box), F.col(width), F.col(height))).withColumn("crop", crop(F.col(pixels), F.col(width), F.col("__rect")))
    return d.select(*boxes.columns, F.col("__rect.width").alias("crop_width"), F.col("__rect.height").alias("crop_height"), "crop")


def column_mean(df: DataFrame, key: str, pixels: str, width: int) -> DataFrame:
    """key, x, mean of each column."""
    p = df.select(key, F.posexplode(pixels).alias("i", "v"))
    return p.groupBy(key, (F.col("i") % width).alias("x")).agg(F.avg("v").alias("mean"))


def groove_density(df: DataFrame, key: str, pixels: str, width: int, reach: float, depth: int = GROOVE_DEPTH) -> DataFrame:
    """key, x, density: the share of rows in which a pixel is darker, by the depth or more, than both of those `reach` to
    its left and right; 0 for columns that lack either neighbour."""
    p = df.select(key, F.posexplode(pixels).alias("i", "v")).select(key, (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).alias("y"), "v")
    w, n = Window.partitionBy(key, "y").orderBy("x"), max(1, math.floor(reach + 0.5))
    left, right = F.lag("v", n).over(w), F.lead("v", n).over(w)
    dark = F.coalesce((left - F.col("v") >= depth) & (right - F.col("v") >= depth), F.lit(False))
    return p.withColumn("__d", dark.cast("double")).groupBy(key, "x").agg(F.avg("__d").alias("density"))


def sharpest(df: DataFrame, key: str, sharp: str, order: str) -> DataFrame:
    """The sharpest frame of each burst, the first of equal ones; a null sharpness is below any other."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(sharp), order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
