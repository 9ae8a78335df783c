"""Observation streams in batch form: capture windows, shelves, steady ticks, overlap and Hamming joins, the tracker."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import ngrams
from ..functions.text import match_key
from ..schema import CAPTURE_WINDOW_MS, NEW_SHELF_BITS, RECENT_OBSERVATIONS, SAME_BAND, SAME_HASH_BITS, SAME_TEXT, STILL


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 16-digit hex hashes, half by half (a half fits into a long)."""
    half = lambda c, at: F.conv(F.substring(c, at, 8), 16, 10).cast("bigint")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def capture_sessions(df: DataFrame, keys: list[str], at: str, window: float, order: str) -> DataFrame:
    """df with session (from 1) and captured: the first sighting of a key, or one later than `window` after the last.

    Every sighting refreshes the window; a gap of exactly the window is still the same capture.
    """
    w = Window.partitionBy(*keys).orderBy(at, order)
    fresh = F.coalesce(F.col(at) - F.lag(at).over(w) > window, F.lit(True))
    d = df.withColumn("captured", fresh)
    return d.withColumn("session", F.sum(F.col("captured").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def shelf_generation(df: DataFrame, key: str, order: str, hash_col: str) -> DataFrame:
    """df with shelf (from 0): a new one where a hash lies far from the one before it."""
    w = Window.partitionBy(key).orderBy(order)
    far = F.coalesce(hamming(F.col(hash_col), F.lag(hash_col).over(w)) > NEW_SHELF_BITS, F.lit(False)).cast("int")
    return df.withColumn("__far", far).withColumn("shelf", F.sum("__far").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__far")


def still_ticks(df: DataFrame, key: str, order: str, moved: str, limit: float = STILL) -> DataFrame:
    """df with stable: how many frames in a row moved no more than the limit; and island, numbered by resets."""
    w = Window.partitionBy(key).orderBy(order)
    moving = F.coalesce(F.col(moved) > limit, F.lit(True))
    d = df.withColumn("island", F.sum(moving.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(key, "island").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("stable", F.sum(F.when(F.col(moved) <= limit, 1).otherwise(0)).over(inside))


def running_best(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("best", F.max(value).over(w))


def band_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two intervals as a share of the narrower one."""
    both = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    narrow = F.least(a1 - a0, b1 - b0)
    return F.when(narrow > 0, both / narrow).otherwise(0.0)


def overlap_join(df: DataFrame, shelf: str, frame: str, id_col: str, start: str, end: str) -> DataFrame:
    """(left, right, overlap): pairs of one shelf and different frames whose bands overlap by half the narrower.

    Bands are dealt into cells; two bands that overlap share a cell, so the join is on shelf and cell, not all pairs of a
    shelf. The cell is as wide as the widest band, and a pair is kept in the first cell it shares only.
    """
    widest = df.agg(F.max(F.col(end) - F.col(start)).alias("w")).first().w or 1.0
    cell = lambda c: F.floor(F.col(c) / widest)
    d = df.select(shelf, frame, id_col, F.col(start).alias("s"), F.col(end).alias("e"), F.explode(F.sequence(cell(start), cell(end))).alias("cell"))
    a, b = d.toDF(shelf, "fa", "left", "sa", "ea", "cell"), d.toDF(shelf, "fb", "right", "sb", "eb", "cell")
    overlap = band_overlap(F.col("sa"), F.col("ea"), F.col("sb"), F.col("eb"))
    pairs = a.join(b, [shelf, "cell"]).filter("left < right and fa != fb").filter(F.col("cell") == F.floor(F.greatest("sa", "sb") / widest))
    return pairs.select("left", "right", overlap.alias("overlap")).filter(F.col("overlap") >= SAME_BAND)


def hamming_join(df: DataFrame, id_col: str, hash_col: str, limit: int = SAME_HASH_BITS) -> DataFrame:
    """(left, right, bits): pairs whose 64-bit hashes differ in at most `limit` bits.

    Cut into limit + 1 runs of bits, at least one run is equal, so the join is on a run's place and value. Equal hashes
    are compared once and expanded at the end.
    """
    hashes = df.select(hash_col).filter(F.col(hash_col).isNotNull()).distinct()
    bits = F.array_join(F.transform(F.split(F.lower(hash_col), ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), "")
    cuts = [64 * i // (limit + 1) for i in range(limit + 2)]
    runs = F.array(*[F.struct(F.lit(i).alias("place"), F.substring("bits", a + 1, b - a).alias("run")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    d = hashes.withColumn("bits", bits).select(hash_col, F.explode(runs).alias("r")).select(F.col(hash_col).alias("h"), "r.*")
    near = d.toDF("ha", "place", "run").join(d.toDF("hb", "place", "run"), ["place", "run"]).filter("ha <= hb").select("ha", "hb").distinct()
    near = near.withColumn("bits", hamming(F.col("ha"), F.col("hb"))).filter(F.col("bits") <= limit)
    one, two = df.select(F.col(id_col).alias("x"), F.col(hash_col).alias("ha")), df.select(F.col(id_col).alias("y"), F.col(hash_col).alias("hb"))
    return near.join(one, "ha").join(two, "hb").filter((F.col("x") < F.col("y")) | ((F.col("ha") != F.col("hb")) & (F.col("x") > F.col("y")))).select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), "bits").distinct()


def dice(a: str, b: str) -> float:
    """Dice coefficient of two keys' bigrams, for the folds below."""
    ga, gb = ([s[i : i + 2] for i in range(len(s) - 1)] or ([s] if s else []) for s in (a, b))
    if not ga or not gb:
        return float(not ga and not gb)
    return 2.0 * sum((Counter(ga) & Counter(gb)).values()) / (len(ga) + len(gb))


class Tracker:
    """Which observations are the same book: by place on the shelf first, by text second; the last 80 are remembered."""

    def __init__(self, recent: int = RECENT_OBSERVATIONS, known=()):
        self.recent, self.seen = recent, [dict(x) for x in known]

    def same(self, key: str, site: tuple | None) -> dict | None:
        if site:
            shelf, frame, start, end = site
            for o in self.seen:
                if o["site"] and o["site"][0] == shelf and o["site"][1] != frame:
                    _, _, s, e = o["site"]
                    narrow = min(end - start, e - s)
                    if narrow > 0 and max(0.0, min(end, e) - max(start, s)) / narrow >= SAME_BAND:
                        return o
        best, found = 0.0, None
        if key:
            for o in self.seen:
                score = 1.0 if o["key"] == key else dice(o["key"], key)
                if score >= SAME_TEXT and score > best:
                    best, found = score, o
        return found

    def note(self, entry_id: str, key: str, site: tuple | None) -> dict:
        o = self.same(key, site)
        if o is None:
            o = {"entry_id": entry_id, "key": key, "count": 1, "site": site}
            self.seen = [*self.seen, o][-self.recent :]
            return o
        self.seen.remove(o)
        self.seen.append(o)
        o["count"] += 1
        o["site"] = site or o["site"]
        if len(key) > len(o["key"]):
            o["key"] = key
        return o


TRACKED = "session string, ordinal bigint, entry_id string, count bigint"


def by_session(df: DataFrame, order: list[str], start, step, schema: str) -> DataFrame:
    """Fold each session's rows in order: step(state, row) gives an output tuple, start() a session's first state.

    Sorted partitions are streamed batch by batch and only the state is carried on, however long a session is.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        session, state = None, None
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False, name="Row"):
                own = None if pd.isna(r.session) else r.session
                if state is None or own != session:
                    session, state = own, start()
                out.append(step(state, r))
            yield pd.DataFrame(out, columns=names)

    return df.repartition("session").sortWithinPartitions("session", *order).mapInPandas(run, schema)


def track(df: DataFrame, session: str, ordinal: str, text_col: str, shelf: str | None = None, frame: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """session, ordinal, entry_id, count: each observation's entry, named after the observation that opened it.

    The fold depends on order and on at most 80 remembered observations, so a session is one sequence, which is streamed.
    """
    site = [F.col(c) for c in (shelf, frame, start, end)] if shelf else [F.lit(None).cast("double")] * 4
    d = df.select(F.col(session).cast("string").alias("session"), F.col(ordinal).cast("bigint").alias("ordinal"), match_key(F.col(text_col), True).alias("key"), *[c.cast("double").alias(n) for c, n in zip(site, ("shelf", "frame", "s", "e"))])

    def step(tracker: Tracker, r) -> tuple:
        o = tracker.note(f"{r.session}-{r.ordinal}", r.key, None if pd.isna(r.shelf) else (r.shelf, r.frame, r.s, r.e))
        return r.session, r.ordinal, o["entry_id"], o["count"]

    return by_session(d, ["ordinal", "key"], Tracker, step, TRACKED)


def text_join(observations: DataFrame, known: DataFrame, o_id: str, o_key: str, k_id: str, k_key: str) -> DataFrame:
    """(o_id, k_id, score): the best known key by dice, 0.72 at least, the earliest of equals; blocked by bigrams.

    A dice of t needs bigram counts within t / (2 - t) of each other, which prunes before anything is compared.
    """
    from ..functions.similarity import dice as native_dice

    o = observations.select(o_id, o_key).withColumn("__no", F.size(ngrams(F.col(o_key)))).withColumn("__g", F.explode(F.array_distinct(ngrams(F.col(o_key)))))
    k = known.select(k_id, k_key).withColumn("__nk", F.size(ngrams(F.col(k_key)))).withColumn("__g", F.explode(F.array_distinct(ngrams(F.col(k_key)))))
    ratio = SAME_TEXT / (2 - SAME_TEXT)
    pairs = o.join(k, "__g").filter((F.least("__no", "__nk") >= ratio * F.greatest("__no", "__nk"))).select(o_id, o_key, k_id, k_key).distinct()
    scored = pairs.withColumn("score", F.when(F.col(o_key) == F.col(k_key), 1.0).otherwise(native_dice(F.col(o_key), F.col(k_key)))).filter(F.col("score") >= SAME_TEXT)
    w = Window.partitionBy(o_id).orderBy(F.desc("score"), F.col(k_id))
    return scored.withColumn("__r", F.row_number().over(w)).filter("__r = 1").select(o_id, k_id, "score")


__all__ = [
    "CAPTURE_WINDOW_MS", "Tracker", "band_overlap", "capture_sessions", "dice", "hamming", "hamming_join", "overlap_join", "running_best", "shelf_generation", "still_ticks", "text_join", "track",
]
