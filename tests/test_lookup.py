"""Batched lookups with errors as a column, diagnostics, search in steps, image parts."""

import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folio.functions.ids import check_digit_13
from folio.operators import diagnostics, images, resolve
from folio.sources import lookup, records


def isbns(spark, n):
    body = F.concat(F.lit("978"), F.lpad(F.col("id").cast("string"), 9, "0"))
    return spark.range(n).select(F.concat(body, check_digit_13(body)).alias("isbn13"))


class Client:
    """Notes each request in a folder; fails as told."""

    def __init__(self, folder, fails=0, error=lookup.RateLimited("later")):
        self.folder, self.fails, self.error, self.seen = str(folder), fails, error, Counter()

    def __call__(self, keys):
        self.seen[tuple(keys)] += 1
        with (Path(self.folder) / f"{random.random()}").open("w") as f:
            f.write(" ".join(keys))
        if self.seen[tuple(keys)] <= self.fails:
            raise self.error
        return {k: f"p{k}" for k in keys if not k.startswith("97800000001")}


def asked(folder):
    return [p.read_text().split() for p in Path(folder).iterdir()]


def test_each_distinct_key_is_asked_for_once_in_chunks(spark, tmp_path):
    keys = isbns(spark, 230)
    twice = keys.unionByName(keys.select(F.concat(F.substring("isbn13", 1, 3), F.lit("-"), F.substring("isbn13", 4, 10)).alias("isbn13"))).unionByName(spark.createDataFrame([(None,), ("junk",)], "isbn13 string"))
    got = lookup.looked_up(twice.repartition(2), Client(tmp_path), pause_s=0).collect()
    want = {r.isbn13 for r in keys.collect()}
    assert sorted(r.key for r in got) == sorted(want)
    assert {(r.payload is None, r.error, r.attempts) for r in got} == {(True, None, 1), (False, None, 1)}  # a miss has no error
    requests = asked(tmp_path)
    assert Counter(k for r in requests for k in r) == Counter(want) and max(map(len, requests)) <= 50
    assert lookup.looked_up(keys.limit(0), Client(tmp_path)).count() == 0


@pytest.mark.parametrize("error, attempts", [(lookup.RateLimited("x" * 500), 3), (lookup.BadStatus(503), 3), (lookup.BadStatus(404), 1), (lookup.NotConfigured("no proxy"), 1), (ValueError("odd"), 3)])
def test_a_chunk_that_fails_gives_its_keys_the_error(spark, tmp_path, error, attempts):
    got = lookup.looked_up(isbns(spark, 60), Client(tmp_path, fails=9, error=error), pause_s=0).collect()
    assert len(got) == 60 and {(r.payload, r.attempts) for r in got} == {(None, attempts)}
    assert {r.error for r in got} == {lookup.describe(error)} and len(got[0].error) <= 200


def test_a_retry_that_works_leaves_no_error(spark, tmp_path):
    got = lookup.looked_up(isbns(spark, 60), Client(tmp_path, fails=2), pause_s=0).collect()
    assert {(r.error, r.attempts) for r in got} == {(None, 3)}


def test_recorded_answers_and_the_log(spark):
    keys = isbns(spark, 3)
    a, b, c = (r.isbn13 for r in keys.orderBy("isbn13").collect())
    answers = spark.createDataFrame([(a, "x", None), (a, None, "old error"), (b, None, "e" * 300), ("junk", "y", None)], "key string, payload string, error string")
    got = {r.key: r for r in lookup.recorded(answers, keys).collect()}
    assert (got[a].payload, got[a].error, got[b].payload, len(got[b].error), got[c].payload, got[c].error) == ("x", None, None, 200, None, None)
    e = spark.createDataFrame([(1, a, "a \n long " + "t" * 50), (2, c, None), (3, "junk", "z")], "entry_id int, isbn13 string, raw_text string")
    log = {r.entry_id: r for r in lookup.lookup_log(e, lookup.recorded(answers, keys)).collect()}
    assert set(log) == {1, 2} and log[1].hits == 1 and len(log[1].entry_text) == 40 and (log[2].hits, log[2].error, log[2].entry_text) == (0, None, "")


def test_a_report_has_a_fixed_size_and_equal_counters(spark):
    rows = [(s, 1000 * (i // 2), i, f"f{i}", "gemini" if i % 2 else "strips", i % 5, 7, None if i % 3 == 0 else [(0, "t", i % 2), (1, "u", 1)], "queued" if i % 4 else "busy", i % 3, i % 2) for s in ("a", "b") for i in range(300)]
    f = spark.createDataFrame(rows, "session string, at long, seq long, id string, mode string, spines int, ms int, strips array<struct<index:int,text:string,spines:int>>, outcome string, recognised int, produced int")
    lookups = spark.createDataFrame([("c", 5, 1, "ndl", "q", 0, None)], "session string, at long, seq long, source string, query string, hits int, error string")
    resolutions = spark.createDataFrame([], "session string, at long, seq long, entry_text string, status string, top_title string, top_score double")
    got = {r.session: r.report for r in diagnostics.report(f, lookups, resolutions).collect()}
    import json

    a = json.loads(got["a"])
    assert [x["id"] for x in a["frames"]] == [f"f{i}" for i in range(292, 300)] and (a["lookups"], a["resolutions"]) == ([], [])
    assert [x["read"] for x in a["frames"]] == [i % 5 if i % 2 else 0 if i % 3 == 0 else i % 2 + 1 for i in range(292, 300)]
    assert a["frames"][0]["at"] == "1970-01-01T00:02:26.000Z" and json.loads(got["c"])["lookups"][0]["query"] == "q"
    own = [r for r in rows if r[0] == "a"]
    want = (sum(r[8] == "queued" for r in own), sum(r[8] == "queued" and r[9] == 0 for r in own), sum(r[9] for r in own), sum(r[10] for r in own))
    assert {tuple(r)[1:] for r in diagnostics.counters(f).collect()} == {want}
    c = spark.createDataFrame([([0.5, None, 1.0],), ([],), (None,)], "c array<double>")
    assert [r[0] for r in c.select(diagnostics.mean_confidence(F.col("c"))).collect()] == [0.75, 0.0, 0.0]


@pytest.mark.parametrize("common", [0, 2, 10_000])
def test_search_in_steps_equals_a_scan_of_everything(spark, common):
    rng = random.Random(common + 1)
    vocabulary = ["a", "b", "c", "d", "rare"]
    some = lambda: rng.choices(vocabulary, [9, 8, 6, 4, 1], k=rng.randrange(0, 4))
    recs = [(i, some(), rng.choice(["x", "y", ""])) for i in range(60)]
    qs = [(i, some() + (["absent"] if i % 3 == 0 else []), rng.choice(["x", "z", ""])) for i in range(30)]
    schema = "array<string>, author_key string"
    got = resolve.relaxed_search(spark.createDataFrame(qs, f"query_id long, words {schema}"), spark.createDataFrame(recs, f"record_id long, words {schema}"), limit=4, common=common)
    want = set()
    for q, w, author in qs:
        step = lambda rw, ra: 0 if not set(w) & set(rw) else 1 if set(w) <= set(rw) and author and author == ra else 2 if set(w) <= set(rw) else 3  # noqa: B023, E731
        hits = [(step(rw, ra), r) for r, rw, ra in recs if step(rw, ra)]
        least = min((s for s, _ in hits), default=0)
        want |= {(q, r, s, n + 1) for n, (s, r) in enumerate(sorted(h for h in hits if h[0] == least)[:4])}
    assert {(r.query_id, r.record_id, r.step, r["rank"]) for r in got.collect()} == want


def test_image_parts_at_the_edges(spark):
    d = spark.createDataFrame([([1, 2, 3, 4, 5, 6], 3, 2)], "p array<int>, w int, h int")
    small = lambda a, b: images.downscale(F.col("p"), F.col("w"), F.col("h"), F.lit(a), F.lit(b))
    r = d.select(small(0.2, 0.0).alias("one"), small(6, 2).alias("wide"), images.downscale(F.slice("p", 1, 0), F.lit(0), F.lit(0), F.lit(2), F.lit(2)).alias("none")).first()
    assert (r.one, r.wide, r.none) == ([1], [1, 1, 2, 2, 3, 3, 4, 4, 5, 5, 6, 6], [])
    box = F.struct(F.lit(0.9).alias("x"), F.lit(0.0).alias("y"), F.lit(0.5).alias("width"), F.lit(1.0).alias("height"))
    assert tuple(d.select(images.box_to_rect(box, F.col("w"), F.col("h")).alias("r")).first().r) == (2, 0, 1, 2)


def test_roles_after_a_wide_space_go(spark):
    d = spark.createDataFrame([("夏目漱石／　著",), ("A／編, B",)], "a string")
    assert [r[0] for r in d.select(records.parse_authors(F.col("a"))).collect()] == [["夏目漱石"], ["A", "B"]]
