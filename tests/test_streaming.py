"""The capture gate and near-hash captures: tables and streams against a plain loop, timers, expiry of state."""

import random

import pytest

from folio.streaming import capture

FRAMES = "session string, at long, frame long, usable boolean, sharp double, gray binary, busy boolean, hash string"


def plain_gate(frames):
    """One session's frames in order, said as the rule says it."""
    stable, since, best, previous, shot, shot_at, out = 0, None, 0.0, None, None, None, []
    diff = lambda a, b: sum(abs(x - y) for x, y in zip(a, b)) / len(a) / 255
    for at, usable, sharp, gray, busy in frames:
        moved = diff(previous, gray) if previous is not None else 1
        if since is None:
            since = at
        previous = gray
        best = max(best, sharp)
        if not usable:
            stable = 0
            out.append("reject")
            continue
        take = (moved <= 0.06 and stable + 1 >= 3) or at - since >= 8000 or (at - since >= 4000 and sharp >= best * 0.85)
        if not take:
            stable = stable + 1 if moved <= 0.06 else 0
            out.append("wait")
        elif shot is not None and not (diff(shot, gray) >= 0.1 or at - shot_at >= 10_000):
            out.append("held")
        elif busy:
            out.append("busy")
        else:
            shot, shot_at, stable, since, best, previous = gray, at, 0, at, 0.0, None
            out.append("capture")
    return out


def frames_of(seed, sessions=5, n=120):
    rng = random.Random(seed)
    rows = []
    for s in range(sessions):
        at, level = 1_000_000 + s, 100
        for i in range(n):
            at += rng.choice([100, 300, 300, 1500, 6000])
            level = max(0, min(235, level + rng.choice([0, 0, 0, 3, -3, 30, -30, 90, -90])))
            gray = bytes(level + rng.randrange(8) for _ in range(16))
            k = rng.randrange(65) if rng.random() < 0.3 else rows[-1][8] if i else 0
            k = max(0, min(64, k + rng.choice([0, 0, 2, -2, 5])))
            hash_hex = None if rng.random() < 0.05 else f"{((1 << k) - 1):016x}"
            rows.append((f"s{s}", at, i, rng.random() < 0.9, round(rng.random(), 3), gray, rng.random() < 0.1, hash_hex, k))
    return [r[:8] for r in rows]


def plain_captures(frames):
    seen, out = [], []
    for at, h in frames:
        seen = [x for x in seen if x[1] >= at - 8000]
        same = next((x for x in seen if h is not None and bin(int(x[0], 16) ^ int(h, 16)).count("1") <= 6), None)
        if same:
            same[1] = at
        elif h is not None:
            seen.append([h, at])
        out.append(same is None)
    return out


def per_session(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.fixture(scope="module")
def frames():
    return frames_of(3)


def expected(frames, column):
    want = {}
    for s, rows in per_session(frames).items():
        marks = plain_gate([(r[1], r[3], r[4], r[5], r[6]) for r in rows]) if column == "decision" else plain_captures([(r[1], r[7]) for r in rows])
        want |= {(s, r[2]): m for r, m in zip(rows, marks)}
    return want


def test_gate_and_captures_over_a_table(spark, frames):
    df = spark.createDataFrame(random.Random(1).sample(frames, len(frames)) + [(None, 1, 1, True, 0.5, b"x", False, None)], FRAMES)
    got = capture.capture_gate(df, "session", "at", "frame", "usable", "sharp", "gray", "busy").collect()
    assert {(r.session, r.frame): r.decision for r in got} == expected(frames, "decision")
    assert {r.decision for r in got} == {"capture", "wait", "reject", "held", "busy"}
    got = capture.near_captures(df, "session", "at", "frame", "hash").collect()
    assert {(r.session, r.frame): r.captured for r in got} == expected(frames, "captured")
    assert len({r.captured for r in got}) == 2


def streamed(spark, tmp_path, batches, start):
    """Rows after each micro-batch of one file; the query stops and starts again from its checkpoint in between."""
    source, out, got = tmp_path / "in", [], []
    source.mkdir()
    for k, batch in enumerate(batches):
        pd_batch = spark.createDataFrame(batch, FRAMES).coalesce(1)
        pd_batch.write.mode("overwrite").parquet(str(tmp_path / "one"))
        part = next((tmp_path / "one").glob("part-*.parquet"))
        part.rename(source / f"{k:03d}.parquet")
        df = spark.readStream.schema(FRAMES).option("maxFilesPerTrigger", 1).parquet(str(source))
        q = start(df).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got.append(spark.read.parquet(str(tmp_path / "out")).collect())
        out.append(q.lastProgress)
    return got, out


def test_gate_stream_equals_the_loop_and_tells_what_is_overdue(spark, tmp_path):
    frames = [r for r in frames_of(8, sessions=2, n=40)]
    cut = sorted(frames, key=lambda r: r[1])
    end = max(r[1] for r in frames)
    far = [("late", end + 60_000 * k, 0, True, 0.5, b"\0" * 16, False, None) for k in (1, 2)]  # moves the watermark on
    batches = [cut[:30], cut[30:], far[:1], far[1:]]
    got, progress = streamed(spark, tmp_path, batches, lambda df: capture.gate_stream(df, "session", "at", "frame", "usable", "sharp", "gray", "busy"))
    decided = {(r.session, r.frame): r.decision for r in got[-1] if r.session != "late" and r.frame is not None}
    assert decided == expected(frames, "decision")
    overdue = [(r.session, r.at) for r in got[-1] if r.decision == "overdue" and r.session != "late"]
    assert len(overdue) == len(set(overdue)) and {s for s, _ in overdue} <= {"s0", "s1"}
    for s, rows in per_session(frames).items():
        marks = expected(frames, "decision")
        since = max([r[1] for r in rows if marks[s, r[2]] == "capture"], default=rows[0][1])
        assert ((s, since + 8000) in overdue) == (since + 8000 > rows[-1][1])
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] < progress[1]["stateOperators"][0]["numRowsTotal"]  # silent sessions are gone


def test_near_capture_stream_equals_the_loop_over_restarts(spark, tmp_path):
    frames = frames_of(5, sessions=2, n=40)
    cut = sorted(frames, key=lambda r: r[1])
    got, _ = streamed(spark, tmp_path, [cut[:25], cut[25:50], cut[50:]], lambda df: capture.near_capture_stream(df, "session", "at", "frame", "hash", "1 hour"))
    assert {(r.session, r.frame): r.captured for r in got[-1]} == expected(frames, "captured")


def test_difference_of_frames():
    assert capture.difference(b"\0\xff", b"\xff\0") == 1.0 and capture.difference(b"", b"") == 0.0 and capture.difference(b"a", b"ab") == 1.0
    assert capture.Gate(captured=b"\0", captured_at=0).frame(9_999, True, 1.0, b"\0") == "wait"


@pytest.mark.parametrize("name", ["capture_gate", "near_captures", "gap_chunks"])
def test_events_before_1970_and_repeated_ones_agree_with_the_sql(spark, tmp_path, name):
    """Events on both sides of 1970, each of them twice under one number."""
    import duckdb

    import __spark_entry__

    c = duckdb.connect()
    c.execute(
        f"""COPY (SELECT i AS event_id, TIMESTAMP '1969-12-31 20:00:00' + i * INTERVAL 17 MINUTE + i * INTERVAL 7 SECOND AS ts, i % 3 AS user_id, CASE WHEN i % 5 = 0 THEN 'view' ELSE 'click' END AS event_type, (i * 37 % 400) / 8.0 AS value
        FROM range(200) r(i), range(2) ORDER BY i) TO '{tmp_path}/events.parquet' (FORMAT parquet)"""
    )
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = c.execute(__spark_entry__.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, __spark_entry__.queries()[name](spark, str(tmp_path)).collect())) == sorted(want)
