"""The observation tracker as a stream: the same fold as in batch, with its memory as keyed state."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import match_key
from ..operators.observe import TRACKED, Tracker
from ..schema import CAPTURE_WINDOW_MS


def track_stream(df: DataFrame, session: str, ordinal: str, text_col: str) -> DataFrame:
    """session, ordinal, entry_id, count of a stream; a session's rows are folded in the order of `ordinal` per batch."""
    d = df.select(F.col(session).cast("string").alias("session"), F.col(ordinal).cast("bigint").alias("ordinal"), match_key(F.col(text_col), True).alias("key"))

    def fold(key, batches, state: GroupState):
        tracker = Tracker(known=json.loads(state.get[0]) if state.exists else ())
        pdf = pd.concat(list(batches)).sort_values("ordinal")
        out = []
        for r in pdf.itertuples():
            o = tracker.note(f"{r.session}-{r.ordinal}", r.key, None)
            out.append((r.session, r.ordinal, o["entry_id"], o["count"]))
        state.update((json.dumps(tracker.seen),))
        yield pd.DataFrame(out, columns=["session", "ordinal", "entry_id", "count"])

    return d.groupBy("session").applyInPandasWithState(fold, TRACKED, "seen string", "append", GroupStateTimeout.NoTimeout)


def capture_stream(df: DataFrame, keys: list[str], at: str, late: str = "1 minute") -> DataFrame:
    """keys, first, last, sightings of each capture: sightings no further apart than the capture window."""
    window = F.session_window(at, f"{CAPTURE_WINDOW_MS} milliseconds")
    return df.withWatermark(at, late).groupBy(*keys, window).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("sightings"))
