"""What a person is told: ordered decisions over state columns. Kinds and reasons are codes; wording is the caller's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BRIGHTNESS, LEAST_SHARPNESS, MOST_BLOWOUT


def frame_advice(bright: Column, blown: Column, sharp: Column) -> Column:
    """Why a frame can't be read, or null: too dark, too bright, glare, blur, in this order."""
    return F.when(bright < BRIGHTNESS[0], "dark").when(bright > BRIGHTNESS[1], "bright").when(blown > MOST_BLOWOUT, "glare").when(sharp < LEAST_SHARPNESS, "blur")


def scan_status(s: dict[str, Column]) -> Column:
    """struct(kind, reason, settled) of a shelf scan; the first condition that holds decides.

    s: ready, preparing, busy, moving, shelf_read (boolean), reading, looking_up, captured (counts), advice, outcome (text).
    """
    say = lambda kind, reason, settled=False: F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"), F.lit(settled).alias("settled"))
    return (
        F.when(~s["ready"], say("idle", "starting")).when(s["preparing"], say("idle", "preparing")).when(s["busy"], say("idle", "behind"))
        .when(F.coalesce(s["advice"], F.lit("")) != "", say("idle", "advice")).when(s["outcome"] == "queued", say("success", "captured")).when(F.coalesce(s["moving"], F.lit(False)), say("idle", "moving"))
        .when(s["reading"] > 0, say("searching", "reading")).when(s["looking_up"] > 0, say("searching", "looking_up"))
        .when((s["captured"] > 0) & (F.coalesce(s["shelf_read"], F.lit(False)) | F.coalesce(s["outcome"] == "duplicate", F.lit(False))), say("duplicate", "shelf_done", True))
        .when((s["captured"] > 0) & (s["reading"] + s["looking_up"] == 0), say("searching", "next_shelf", True)).otherwise(say("searching", "shelf"))
    )


def close_hint(reading: Column, looking_up: Column, captured: Column) -> Column:
    return F.when(reading + looking_up > 0, "continues").when(captured > 0, "done")


def barcode_status(ready: Column, last_isbn: Column, duplicate: Column, age_ms: Column, hold_ms: int = 2500) -> Column:
    shown = last_isbn.isNotNull() & (age_ms < hold_ms)
    return F.when(~ready, "idle").when(shown & duplicate, "duplicate").when(shown, "success").otherwise("searching")


def state_text(status: Column, input_kind: Column) -> Column:
    """A code for the row's note, null for confirmed rows; not found differs by how the book was read."""
    return F.when(status == "confirmed", None).when(status == "notFound", F.when(input_kind == "spine", "notFound_spine").otherwise("notFound_barcode")).otherwise(status)


def state_is_problem(status: Column) -> Column:
    return status.isin("notFound", "unverified")


def shown_title(resolved: Column, extracted: Column, placeholder: str = "-") -> Column:
    """The resolved title, else the extracted one (an empty resolved title is one); a placeholder for an empty result."""
    t = F.coalesce(resolved, extracted, F.lit(""))
    return F.when(t == "", placeholder).otherwise(t)


def cover_chain(cover: Column, isbn: Column, thumbnails: str) -> Column:
    """Addresses to try for a cover, in order."""
    own = F.when(F.coalesce(cover, F.lit("")) != "", cover)
    return F.array_compact(F.array(own, F.when(F.coalesce(isbn, F.lit("")) != "", F.concat(F.lit(thumbnails), F.url_encode(isbn), F.lit(".jpg")))))


def is_debug(query_string: Column) -> Column:
    return F.coalesce(F.regexp_extract(query_string, r"(?:^\??|&)debug=([^&]*)", 1) == "1", F.lit(False))


def better_read(df: DataFrame, key: str, text_col: str, confidence: str, eligible: str) -> DataFrame:
    """Per key the longest eligible read, the surer one of equals."""
    return df.filter(eligible).groupBy(key).agg(F.max_by(F.struct(text_col, confidence), F.struct(F.length(text_col), confidence)).alias("r")).select(key, "r.*")


def recent_feed(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The last n rows of each key, newest first, with rest: how many older ones there are."""
    w = Window.partitionBy(key)
    d = df.withColumn("rank", F.row_number().over(w.orderBy(F.desc(order)))).withColumn("rest", F.greatest(F.lit(0), F.count("*").over(w) - n))
    return d.filter(F.col("rank") <= n)


def feed_states(scanned: DataFrame, states: DataFrame, key: str, state: str, default: str = "looking") -> DataFrame:
    return scanned.join(states, key, "left").withColumn(state, F.coalesce(F.col(state), F.lit(default)))


def finished_edges(df: DataFrame, key: str, order: str, pending: str, scanning: str) -> DataFrame:
    """df with finished: work was pending just before, none is now, and nothing is being scanned."""
    before = F.lag(pending).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("finished", F.coalesce((before > 0) & (F.col(pending) == 0) & ~F.col(scanning), F.lit(False)))


def still_there(changes: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Changes to rows that haven't been deleted meanwhile."""
    return changes.join(live.select(key).distinct(), key, "left_semi")


def bind_isbn(df: DataFrame, scanned: DataFrame, key: str) -> DataFrame:
    """df with a scanned ISBN put on its rows: candidates, conflicts and the pin go, the row is unverified again."""
    d = df.join(scanned.select(key, F.col("isbn13").alias("__isbn")), key, "left")
    hit = F.col("__isbn").isNotNull()
    return (
        d.withColumn("isbn13", F.coalesce("__isbn", "isbn13")).withColumn("status", F.when(hit, "unverified").otherwise(F.col("status")))
        .withColumn("pinned", ~hit & F.col("pinned")).withColumn("conflicts", F.when(hit, 0).otherwise(F.col("conflicts"))).drop("__isbn")
    )


def candidate_line(title: Column, authors: Column) -> Column:
    return F.concat_ws("／", title, F.when(F.size(authors) > 0, F.array_join(authors, "、")))


def percent(score: Column) -> Column:
    return F.floor(score * 100 + 0.5).cast("int")


def error_text(c: Column, most: int = 200) -> Column:
    return F.substring(c, 1, most)


def spine_results(entries: DataFrame, session: Column) -> DataFrame:
    """The entries that a session read from spines, with title (null while there is none) and state for its feed.

    Needs id, status, input_kind, session, resolved_title and extracted_title.
    """
    own = entries.filter((F.col("input_kind") == "spine") & (F.col("session") == session))
    some = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit(""))
    state = F.when(F.col("status") == "confirmed", "found").when(F.col("status") == "notFound", "missing").when(F.col("status") == "unverified", "looking").otherwise("review")
    return own.withColumn("title", F.coalesce(some("resolved_title"), some("extracted_title"))).withColumn("state", state)


def with_photo(entries: DataFrame, photos: DataFrame, key: str = "photo_id") -> DataFrame:
    """entries with the photo's columns, null without one: a missing photo is nobody's concern. Photos have unique keys."""
    return entries.join(photos, key, "left")
