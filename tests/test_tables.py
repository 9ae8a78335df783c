"""Keyed tables by batch, re-resolution over a stream, restarts, and what a person's edits reset."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folio.operators import resolution, triage
from folio.streaming.retry import RESULT, Progress, retry_batches, retry_summary, settled
from folio.streaming.tables import KeyedTable, upsert_batches

ROW = "k long, v string, at long"
ENTRY = f"entry_id long, status string, pinned boolean, title string, resolved {resolution.RECORD}, provenance map<string, string>, conflicts array<string>"


def rows(t):
    return sorted((r.k, r.v, r["at"]) for r in t.read().collect())


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ROW, "k", buckets=16)
    assert rows(t) == []
    base = [(k, f"v{k}" * 50, 0) for k in range(3000)]
    assert t.upsert(0, spark.createDataFrame(base, ROW), "at") == 16
    whole = size(tmp_path / "t")
    assert t.upsert(1, spark.createDataFrame([(7, "new", 2), (7, "older", 1), (5000, "added", 0), (None, "no key", 9)], ROW), "at") <= 2
    assert size(tmp_path / "t/rows/version=1") < whole / 4
    want = {k: (k, v, a) for k, v, a in base} | {7: (7, "new", 2), 5000: (5000, "added", 0)}
    assert rows(t) == sorted(want.values())
    t.upsert(2, spark.createDataFrame([(7, "late", 1)], ROW), "at")  # an older change comes late
    assert rows(t) == sorted(want.values())
    t.update(3, spark.createDataFrame([(8, "changed", 5), (99_999, "gone", 5)], ROW), ["v"])
    t.delete(4, spark.createDataFrame([(9,), (77_777,)], "k long"))
    want[8] = (8, "changed", 0)
    del want[9]
    assert rows(t) == sorted(want.values())
    assert len(list((tmp_path / "t/manifests").glob("version=*"))) == 2
    live = {(b, v) for m in t._versions() for b, v in t._manifest(m).items()}
    kept = {(int(p.name.split("=")[1]), int(p.parent.name.split("=")[1])) for p in (tmp_path / "t/rows").glob("version=*/__bucket=*")}
    assert kept == live  # old generations go
    t.clear(5)
    assert rows(t) == []


def test_a_repeated_batch_changes_nothing_and_a_half_written_one_is_not_seen(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ROW, "k", buckets=4)
    t.upsert(0, spark.createDataFrame([(1, "a", 1), (2, "b", 1)], ROW), "at")
    change = spark.createDataFrame([(1, "c", 2)], ROW)
    t.upsert(1, change, "at")
    before = rows(t)
    t.upsert(1, change, "at")
    assert rows(t) == before == [(1, "c", 2), (2, "b", 1)]
    (tmp_path / "t/manifests/version=1/_SUCCESS").unlink()  # as if the driver had died before the manifest was there
    assert rows(t) == [(1, "a", 1), (2, "b", 1)]
    t.upsert(1, change, "at")
    assert rows(t) == before


def test_deleting_every_row_of_a_bucket_leaves_it_empty(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ROW, "k", buckets=2)
    t.upsert(0, spark.createDataFrame([(k, "a", 1) for k in range(4)], ROW), "at")
    t.delete(1, spark.range(4).toDF("k"))
    assert rows(t) == [] and t.current() == {}
    t.upsert(2, spark.createDataFrame([(3, "b", 1)], ROW), "at")
    assert rows(t) == [(3, "b", 1)]


def test_upserts_of_a_stream_go_on_after_a_restart(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ROW, "k", buckets=4)
    for n, batch in enumerate([[(1, "a", 1), (2, "a", 1)], [(1, "b", 3)], [(1, "late", 2), (3, "c", 1)]]):
        spark.createDataFrame(batch, ROW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        upsert_batches(spark.readStream.schema(ROW).parquet(str(tmp_path / "in")), t, "at", str(tmp_path / "check")).awaitTermination(60)
        assert t._versions()[0] == n
    assert rows(t) == [(1, "b", 3), (2, "a", 1), (3, "c", 1)]


def found_if_even(asked):
    """A stand-in for the composed resolution."""
    even = F.col("entry_id") % 2 == 0
    record = F.when(even, F.struct(F.lit("found").alias("title"), F.array().cast("array<string>"), *[F.lit(None).cast("string")] * 5, F.lit("ndl")).cast(resolution.RECORD))
    return asked.select("entry_id", F.when(even, "confirmed").otherwise("unverified").alias("status"), record.alias("resolved"), F.create_map(F.lit("title"), F.lit("ndl")).alias("provenance"), F.lit(None).cast("array<string>").alias("conflicts"))


def test_retries_settle_live_rows_only_and_survive_restarts(spark, tmp_path):
    none = (None, None, None)
    entries = [(1, "unverified", False, "t", *none), (2, "notFound", False, "t", *none), (3, "notFound", False, "", *none), (4, "notFound", True, "t", *none), (5, "needsReview", False, "t", *none), (6, "notFound", False, "t", *none), (8, "excluded", False, "t", *none), (10, "notFound", None, "t", *none)]
    t = KeyedTable(spark, str(tmp_path / "t"), ENTRY, "entry_id", buckets=4)
    t.rewrite(0, spark.createDataFrame(entries, ENTRY), lambda _: spark.createDataFrame(entries, ENTRY))
    progress = Progress()
    spark.streams.addListener(progress)
    deleted = []

    def resolve(asked):
        done = found_if_even(asked)
        if not deleted:  # an entry goes while it is looked up
            done = spark.createDataFrame(done.collect(), done.schema)
            t.delete(1, spark.createDataFrame([(6,)], "entry_id long"))
            deleted.append(6)
        return done

    try:
        for batch in ([(1,), (2,), (3,), (4,), (6,)], [(5,), (8,), (10,), (6,), (None,), (99,), (10,)]):
            spark.createDataFrame(batch, "entry_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("entry_id long").parquet(str(tmp_path / "in"))
            q = retry_batches(stream.select("entry_id"), Shifted(t), resolve, str(tmp_path / "check"))
            assert q.awaitTermination(120)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    finally:
        spark.streams.removeListener(progress)
    got = {r.entry_id: r for r in t.read().collect()}
    assert {i: r.status for i, r in got.items()} == {1: "unverified", 2: "confirmed", 3: "notFound", 4: "notFound", 5: "needsReview", 8: "excluded", 10: "confirmed"}
    assert got[2].resolved.title == "found" and got[4].resolved is None
    assert progress.totals["retry"] == {"requests": 12, "without_id": 1} and progress.batches["retry"] == 2 and len(progress.ended) == 2


class Shifted:
    """The table with versions after those that the test wrote itself."""

    def __init__(self, table):
        self.table = table

    def read(self):
        return self.table.read()

    def update(self, version, changes, columns):
        return self.table.update(version + 2, changes, columns)


def test_a_disabled_listener_notes_nothing_and_the_summary_counts(spark):
    p = Progress(enabled=False)
    p.onQueryProgress(None), p.onQueryTerminated(None)
    assert (p.batches, p.totals, p.ended) == ({}, {}, [])
    e = spark.createDataFrame([(1, "unverified", False, "t", None, None, None), (2, "notFound", False, "t", None, None, None)], ENTRY)
    after = settled(e, found_if_even)
    assert after.columns == ["entry_id", *RESULT]
    assert retry_summary(e, after).first().asDict() == {"done": 2, "still": 1}


@pytest.mark.parametrize("text, title, authors, publisher", [("罪と罰 中\nドストエフスキー\n新潮社", "罪と罰中", ["ドストエフスキー"], "新潮社"), ("Alpha Press\nBeta Press Book of Days", "Beta Press Book of Days", [], "Alpha Press"), ("\n \n", "", [], None)])
def test_edits_parse_again_and_reset(spark, text, title, authors, publisher):
    e = spark.createDataFrame([(1, "confirmed", True, "raw", "old", ["x"], "y", {"a": 1})], "entry_id long, status string, pinned boolean, raw_text string, title string, authors array<string>, publisher string, candidates map<string, int>")
    r = triage.edit_texts(e, spark.createDataFrame([(1, text), (1, None), (None, "z"), (2, "other")], "entry_id long, text string")).first()
    assert (r.status, r.pinned, r.title, r.authors, r.publisher, r.candidates) == ("unverified", True, title, authors, publisher, None)
    assert json.dumps(r.asDict(), default=str)
