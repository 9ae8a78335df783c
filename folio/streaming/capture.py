"""What is captured from a sequence of frames: the gate (steady long enough, or waited so long that the best so far must
do) and the guard against capturing the same view twice. Both run over tables and, with keyed state and timers, over
streams; a stream's state goes when a session falls silent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.observe import by_session
from ..schema import CAPTURE_WINDOW_MS, FORCE_MS, NEW_SHELF, RESCUE_MS, RESCUE_RATIO, RETRY_MS, SAME_HASH_BITS, STABLE_TICKS, STILL

DECIDED = "session string, at bigint, frame bigint, decision string"
CAPTURED = "session string, at bigint, frame bigint, captured boolean"
#: A session without a frame for so long is over: no limit of the gate reaches further.
SILENT_MS = FORCE_MS + RETRY_MS
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def difference(a: bytes, b: bytes) -> float:
    """Mean difference of two gray images of one size, 0 to 1; of different sizes they have nothing in common."""
    if len(a) != len(b):
        return 1.0
    x, y = (np.frombuffer(g, np.uint8).astype(np.int16) for g in (a, b))
    return float(np.abs(x - y).mean()) / 255 if len(x) else 0.0


class Gate:
    """Per session: frames in a row that were still, since when it waits, the best sharpness meanwhile, the frame before
    and the captured one."""

    FIELDS = ("stable", "since", "best", "previous", "captured", "captured_at")
    STATE = "stable int, since bigint, best double, previous binary, captured binary, captured_at bigint, last bigint, told boolean"

    def __init__(self, stable=0, since=None, best=0.0, previous=None, captured=None, captured_at=None):
        self.stable, self.since, self.best, self.previous, self.captured, self.captured_at = stable, since, best, previous, captured, captured_at

    def decide(self, usable: bool, moved: float, waited: int, sharp: float) -> str:
        if not usable:
            return "reject"
        steady = moved <= STILL and self.stable + 1 >= STABLE_TICKS
        return "capture" if steady or waited >= FORCE_MS or waited >= RESCUE_MS and sharp >= RESCUE_RATIO * self.best else "wait"

    def frame(self, at: int, usable: bool, sharp: float, gray: bytes, busy: bool = False) -> str:
        """First the frame itself is judged; only one worth taking is held back, where the captured shelf is still in view
        or reading is behind. A held frame leaves everything as it is."""
        moved = 1.0 if self.previous is None else difference(self.previous, gray)
        self.since = at if self.since is None else self.since
        self.previous, self.best = gray, max(self.best, sharp)
        decision = self.decide(usable, moved, at - self.since, sharp)
        if decision == "reject":
            self.stable = 0
        elif decision == "wait":
            self.stable = self.stable + 1 if moved <= STILL else 0
        elif self.captured is not None and difference(self.captured, gray) < NEW_SHELF and at - self.captured_at < RETRY_MS:
            return "held"
        elif busy:
            return "busy"
        else:
            self.captured, self.captured_at = gray, at
            self.stable, self.since, self.best, self.previous = 0, at, 0.0, None
        return decision


class Captures:
    """Views captured of late: one as near as a few bits is the same, and seeing it again keeps it fresh."""

    def __init__(self, seen=(), window: int = CAPTURE_WINDOW_MS, bits: int = SAME_HASH_BITS):
        self.seen, self.window, self.bits = [list(x) for x in seen], window, bits

    def captured(self, hash_hex: str | None, at: int) -> bool:
        """Whether the view is new. A frame without a hash is, and isn't remembered."""
        self.seen = [x for x in self.seen if x[1] >= at - self.window]
        if hash_hex is None:
            return True
        own = int(hash_hex, 16)
        for x in self.seen:
            if (int(x[0], 16) ^ own).bit_count() <= self.bits:
                x[1] = at
                return False
        self.seen.append([hash_hex, at])
        return True


def _frames(df: DataFrame, session: str, at: str, frame: str, **columns) -> DataFrame:
    return df.filter(F.col(session).isNotNull()).select(F.col(session).cast("string").alias("session"), F.col(at).cast("bigint").alias("at"), F.col(frame).cast("bigint").alias("frame"), *[c.alias(n) for n, c in columns.items()])


def _gate_frames(df, session, at, frame, usable, sharp, gray, busy, *more):
    flag = F.coalesce(F.col(busy), F.lit(False)) if busy else F.lit(False)
    return _frames(df, session, at, frame, usable=F.coalesce(F.col(usable), F.lit(False)), sharp=F.coalesce(F.col(sharp).cast("double"), F.lit(0.0)), gray=F.coalesce(F.col(gray), F.lit(b"")), busy=flag, **{c: F.col(c) for c in more})


def capture_gate(df: DataFrame, session: str, at: str, frame: str, usable: str, sharp: str, gray: str, busy: str | None = None) -> DataFrame:
    """session, at, frame, decision of each frame: capture, wait, reject, held or busy.

    Frames of a session follow each other by time (milliseconds), then by `frame`; gray is a small image as bytes. Frames
    without a session are left out. A session is one sequence by nature and is streamed; null marks count as not usable.
    """
    d = _gate_frames(df, session, at, frame, usable, sharp, gray, busy)
    return by_session(d, ["at", "frame"], Gate, lambda g, r: (r.session, r.at, r.frame, g.frame(r.at, r.usable, r.sharp, r.gray, r.busy)), DECIDED)


def near_captures(df: DataFrame, session: str, at: str, frame: str, hash_col: str) -> DataFrame:
    """session, at, frame, captured: whether each view is new, or as near as a few bits to one seen within the window."""
    d = _frames(df, session, at, frame, hash=F.col(hash_col))
    return by_session(d, ["at", "frame"], Captures, lambda c, r: (r.session, r.at, r.frame, c.captured(None if pd.isna(r.hash) else r.hash, r.at)), CAPTURED)


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A session's frames of one micro-batch (as many as the trigger lets in), by time and number."""
    return pd.concat(list(rows)).sort_values(["at", "frame"])


def _reset_timer(handle, at: int) -> None:
    for t in list(handle.listTimers()):
        handle.deleteTimer(t)
    handle.registerTimer(at)


class GateProcessor(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("gate", Gate.STATE)

    def _save(self, gate: Gate, last: int, told: bool) -> None:
        self.state.update(tuple(getattr(gate, f) for f in Gate.FIELDS) + (last, told))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        gate = Gate(*old[:6]) if old else Gate()
        pdf = _in_order(rows)
        decisions = [gate.frame(r.at, r.usable, r.sharp, r.gray, r.busy) for r in pdf.itertuples()]
        last = int(pdf["at"].iloc[-1])
        self._save(gate, last, False)
        due = gate.since + FORCE_MS
        _reset_timer(self.handle, due if due > last else last + SILENT_MS)
        yield pd.DataFrame({"session": key[0], "at": pdf["at"], "frame": pdf["frame"], "decision": decisions})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The limit of waiting passed without a frame: said once. Later the silent session's state goes."""
        *fields, last, told = self.state.get()
        gate = Gate(*fields)
        if told or gate.since + FORCE_MS <= last:
            self.state.clear()
            return
        self._save(gate, last, True)
        self.handle.registerTimer(last + SILENT_MS)
        yield pd.DataFrame({"session": [key[0]], "at": [gate.since + FORCE_MS], "frame": pd.array([None], "Int64"), "decision": ["overdue"]})

    def close(self) -> None:
        pass


class CapturesProcessor(StatefulProcessor):
    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("captures", "hashes array<string>, at array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        captures = Captures(zip(*old) if old else ())
        pdf = _in_order(rows)
        new = [captures.captured(None if pd.isna(r.hash) else r.hash, r.at) for r in pdf.itertuples()]
        self.state.update(([h for h, _ in captures.seen], [int(t) for _, t in captures.seen]))
        _reset_timer(self.handle, int(pdf["at"].iloc[-1]) + CAPTURE_WINDOW_MS + 1)
        yield pd.DataFrame({"session": key[0], "at": pdf["at"], "frame": pdf["frame"], "captured": new})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _keyed(frames: DataFrame, late: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    keep_state_in_rocksdb(frames.sparkSession)
    timed = frames.withColumn("event_time", F.timestamp_millis("at")).withWatermark("event_time", late)
    return timed.groupBy("session").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs that provider; a session that has chosen one keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(key, "") or ""):
        spark.conf.set(key, ROCKSDB)


def gate_stream(df: DataFrame, session: str, at: str, frame: str, usable: str, sharp: str, gray: str, busy: str | None = None, late: str = "2 seconds") -> DataFrame:
    """capture_gate over a stream; and, where a session waits beyond the last limit and no frame comes, a row `overdue`
    without a frame, said once per wait. The watermark lags `late` behind the latest frame."""
    return _keyed(_gate_frames(df, session, at, frame, usable, sharp, gray, busy), late, GateProcessor(), DECIDED)


def near_capture_stream(df: DataFrame, session: str, at: str, frame: str, hash_col: str, late: str = "2 seconds") -> DataFrame:
    """near_captures over a stream. Each sighting moves the window on, which no session window can do for near hashes:
    nearness isn't transitive."""
    return _keyed(_frames(df, session, at, frame, hash=F.col(hash_col)), late, CapturesProcessor(), CAPTURED)
