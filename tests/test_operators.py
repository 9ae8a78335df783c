import random

import pytest
from pyspark.sql import functions as F

from folio.operators import images, mentions, observe, resolve, triage
from folio.operators.ranking import numbered
from folio.sources import export, records
from folio.streaming import tracking


@pytest.mark.parametrize(
    "flags, length, status",
    [
        (("agreement",), 10, "confirmed"), (("exact", "author"), 10, "confirmed"), (("exact",), 10, "needsReview"), (("disagreement", "exact"), 10, "conflict"),
        (("exact", "author"), 2, "needsReview"), (("exact", "repeated"), 10, "confirmed"), (("repeated",), 10, "needsReview"), ((), 10, "needsReview"),
    ],
)
def test_evidence_table(spark, flags, length, status):
    x = [F.lit(f in flags) for f in ("agreement", "disagreement", "exact", "author", "repeated")]
    assert spark.range(1).select(resolve.status_from_evidence(F.lit(length), *x).alias("s")).first().s == status


def test_export_filter(spark):
    rows = [("confirmed", False, "t", True), ("needsReview", False, "t", False), ("needsReview", True, "t", True), ("excluded", True, "t", False), ("confirmed", False, "", False), ("notFound", False, None, False)]
    d = spark.createDataFrame(rows, "s string, p boolean, t string, ok boolean")
    assert all(r.ok == r.x for r in d.withColumn("x", triage.exportable(F.col("s"), F.col("p"), F.col("t"))).collect())
    d = spark.createDataFrame([("needsReview", False, "t"), ("excluded", False, "t")], "s string, p boolean, t string")
    assert [r.x for r in d.select(triage.exportable(F.col("s"), F.col("p"), F.col("t"), True).alias("x")).collect()] == [True, False]


def test_query_expansion(spark):
    d = spark.createDataFrame([("文化政策の現在", ["小林真理"], ["文化政策の現在", "小林真理", "東京大学出版会"])], "t string, a array<string>, l array<string>")
    q = d.select(mentions.build_queries(F.col("t"), F.col("a"), F.col("l")).alias("q")).first().q
    assert (q[0].title, q[0].authors, q[0].mode) == ("文化政策の現在", ["小林真理"], "title")
    titles = [x.title for x in q]
    assert "文化政策の現" in titles and "文化政策の現在 小林真理" in titles
    assert (q[-1].title, q[-1].mode) == ("文化政策", "any")
    assert d.select(F.size(mentions.attempts(mentions.build_queries(F.col("t"), F.col("a"), F.col("l")))).alias("n")).first().n == 3


def test_roles_from_fragments(spark):
    d = spark.createDataFrame([([("文化政策の現在", 0.9), ("小林真理", 0.8), ("東京大学出版会", 0.7)],)], "f array<struct<text: string, confidence: double>>")
    r = d.select(mentions.roles(F.col("f")).alias("r")).first().r
    assert (r.title, r.authors, r.publisher) == ("文化政策の現在", ["小林真理"], "東京大学出版会")


def test_gap_chunks_split_segments(spark):
    h, words, y = 0.03, [], 0.1
    for segment in (["日本", "文化", "の", "歴史"], ["尾藤", "正英"], ["岩波", "新書"]):
        for w in segment:
            words.append(("k", len(words), w, y, h))
            y += h * 1.05
        y += 2 * h
    d = spark.createDataFrame(words, "k string, i int, w string, head double, size double")
    got = mentions.gap_chunks(d, "k", "i", "head", "size").orderBy("i").collect()
    assert [r.chunk for r in got] == [0, 0, 0, 0, 1, 1, 2, 2]


def test_gap_chunks_keep_words_alike_together(spark):
    """Rows equal in head and order follow each other as they did when gaps were taken; words without a head end it."""
    rows = [(k, i, None if i == 9 else 100 * i, 30) for k in range(40) for i in range(10) for _ in range(5)]
    d = spark.createDataFrame(rows, "k int, i int, head long, size long").repartition(7)
    d = d.withColumn("head", F.when((F.col("i") == 5) | (F.col("i") == 8), F.col("head") + 400 + 300 * F.col("i")).when(F.col("i") > 5, F.col("head") + 1900).otherwise(F.col("head")))
    got = mentions.gap_chunks(d, "k", "i", "head", "size").select("k", "i", "chunk").distinct().collect()
    assert sorted(map(tuple, got)) == [(k, i, (i >= 5) + (i >= 8)) for k in range(40) for i in range(10)]


def test_large_groups_are_streamed_and_counted(spark):
    """No operator takes a whole group at once, and the folds carry their state over batches of two rows."""
    from folio.sources import recognition
    from folio.streaming.capture import Gate, capture_gate

    rng = random.Random(8)
    rows = [(s, i, 400 * i, rng.choice(["red widget", "blue bolts", "green gear"]), rng.random() < 0.8, rng.random() / 20, rng.random(), bytes([rng.randrange(40)] * 4)) for s in ("a", "b", "c") for i in range(60)]
    d = spark.createDataFrame(rows, "s string, i long, at long, t string, u boolean, m double, h double, g binary").repartition(3)
    want_tracked, want_decided = set(), set()
    for s in ("a", "b", "c"):
        tracker, gate = observe.Tracker(), Gate()
        for _, i, at, t, u, _, h, g in (r for r in rows if r[0] == s):
            o = tracker.note(f"{s}-{i}", t.replace(" ", ""), None)
            want_tracked.add((s, i, o["entry_id"], o["count"]))
            want_decided.add((s, at, i, gate.frame(at, u, h, g)))
    tracked, decided = observe.track(d, "s", "i", "t"), capture_gate(d, "s", "at", "i", "u", "h", "g")
    chunks, entries = mentions.gap_chunks(d, "s", "i", "at", "m"), recognition.entries_from_isbns(d, "t", "s", "i")
    plan = lambda x: x._jdf.queryExecution().toString()
    for x in (tracked, decided, chunks, entries):
        assert "FlatMapGroupsInPandas" not in plan(x) and "collect_list" not in plan(x)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert set(map(tuple, tracked.collect())) == want_tracked and set(map(tuple, decided.collect())) == want_decided
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {(r.id, r.isbn13) for r in entries.collect()} == {(f"{s}-{i}", t) for s, i, _, t, *_ in rows}
    values = spark.createDataFrame([("k", v) for v in (1.0, 4.0, 4.0, 9.0, None, 2.0, 9.0)] + [("n", None)], "k string, v double")
    assert [tuple(r) for r in mentions.upper_median(values, "k", F.col("v"), "m").collect()] == [("k", 4.0)]


def test_blocking_loses_no_candidate(spark):
    from folio.functions import similarity as sim

    rng = random.Random(3)
    keys = sorted({"".join(rng.choices("abcd", k=rng.randrange(1, 9))) for _ in range(60)})
    k = spark.createDataFrame([(x,) for x in keys], "k string")
    every = k.toDF("a").crossJoin(k.toDF("b")).withColumn("s", sim.title_similarity(F.col("a"), F.col("b"))).filter("s >= 0.3").select("a", "b")
    assert every.exceptAll(resolve.title_matches(k.toDF("a"), "a", k.toDF("b"), "b").select("a", "b")).count() == 0


def test_merges_are_idempotent_and_keep_what_is_there(spark):
    d = spark.createDataFrame([("a", None), ("", "x"), (None, "y")], "cur string, inc string")
    fields, p = resolve.fill_missing({"publisher": F.col("cur")}, {"publisher": F.col("inc")}, F.lit("ndl"), F.create_map(F.lit("title"), F.lit("googleBooks")))
    once = d.select(fields["publisher"].alias("cur"), "inc", p.alias("p")).collect()
    assert [r.cur for r in once] == ["a", "x", "y"] and once[0].p == {"title": "googleBooks"} and once[1].p["publisher"] == "ndl"


def test_capture_window_refreshes(spark):
    d = spark.createDataFrame([("k", i, t) for i, t in enumerate([1000, 1800, 2600, 3400, 4401])], "k string, i int, at int")
    got = observe.capture_sessions(d, ["k"], "at", 1000, "i").orderBy("i").collect()
    assert [r.captured for r in got] == [True, False, False, False, True]


def test_shelves(spark):
    d = spark.createDataFrame([("s", i, h) for i, h in enumerate(["0" * 16, "0" * 15 + "3", "f" * 16, "f" * 16])], "s string, i int, h string")
    assert [r.shelf for r in observe.shelf_generation(d, "s", "i", "h").orderBy("i").collect()] == [0, 0, 1, 1]


def test_hamming_join_is_complete(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    rows = [(i, f"{b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(9))):016x}") for i, b in enumerate(base * 6)]
    want = {(i, j) for i, a in rows for j, b in rows if i < j and (int(a, 16) ^ int(b, 16)).bit_count() <= 6}
    got = observe.hamming_join(spark.createDataFrame(rows, "i int, h string"), "i", "h").collect()
    assert {(r.left, r.right) for r in got} == want and len(got) == len(want)


def test_whole_catalogue_and_whole_hashes(spark, tmp_path):
    from folio.plans import catalogue

    parts = [(k, f"word{k} same", f"Brand#{k}", "t") for k in range(1, 10)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    got = catalogue.QUERIES["relaxed_search_all"](spark, str(tmp_path)).collect()
    assert {r.record_id for r in got if r.step < 3} == {1, 3, 4, 6, 7, 9} and {r.record_id for r in got if r.step == 3} == set(range(1, 10))
    low, high = [-0.5] * 16, [0.5] * 8 + [-0.5] * 8
    rows = [(1, 0, low + high + low * 2), (2, 0, low + high * 2 + low), (3, 0, low + high + low * 2)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [tuple(r) for r in catalogue.QUERIES["hash_pairs_64"](spark, str(tmp_path)).collect()] == [(1, 3, 0)]


def test_tracker_by_place_text_and_memory():
    t = observe.Tracker(recent=2)
    assert t.note("a", "吾輩は猫である", (0, 1, 0.1, 0.2))["count"] == 1
    assert t.note("b", "別の字", (0, 2, 0.12, 0.2))["entry_id"] == "a"
    assert t.note("c", "吾輩は猫である", (1, 3, 0.1, 0.2))["entry_id"] == "a"
    for k in ("いろは歌", "徒然草抄"):
        t.note(k, k, None)
    assert t.note("d", "吾輩は猫である", None)["entry_id"] == "d"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"s{i % 2}", i, t) for i, t in enumerate(["red widget", "red widgets", "blue bolt", "blue bolts", "green gear", "red widget", "blue bolt"])]
    d = spark.createDataFrame(rows, "s string, o long, t string")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = tracking.track_stream(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), "s", "o", "t")
    stream.writeStream.format("memory").queryName("tracked").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.table("tracked").collect())) == sorted(map(tuple, observe.track(d, "s", "o", "t").collect()))


def test_xml_items(spark):
    item = '<item><title>T{0}</title><dc:title>other</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dcterms:issued>2018-03</dcterms:issued><dc:identifier>4003101014</dc:identifier><dc:identifier xsi:type="dcndl:ISBN">{1}</dc:identifier></item>'
    ns = 'xmlns:dc="d" xmlns:dcterms="t" xmlns:dcndl="n" xmlns:xsi="x"'
    xml = f"<rss {ns}><channel>{item.format(1, '9784130342230')}{item.format(2, 'none')}</channel></rss>"
    got = records.xml_items(spark.createDataFrame([(1, xml), (2, f"<rss {ns}><channel/></rss>")], "i int, x string"), "i", "x").orderBy("ordinal").collect()
    assert [(r.title, r.authors, r.published, r.isbn13) for r in got] == [("T1", ["A", "B"], "2018-03", "9784130342230"), ("T2", ["A", "B"], "2018-03", "9784003101018")]
    with pytest.raises(Exception):
        records.xml_items(spark.createDataFrame([(1, "<rss><item>")], "i int, x string"), "i", "x").collect()


def test_vision_payload(spark):
    payload = '{"spines": [{"box_2d": [0, 500, 1000, 900], "title": "B", "authors": ["x", " "], "confidence": 3}, {"box_2d": [-5, 0, 1200, 100], "raw_visible_text": "\\n A \\nz"}, {"box_2d": [5, 5, 5, 9], "title": "flat"}, {"title": "none"}]}'
    got = records.vision_mentions(spark.createDataFrame([(1, payload)], "i int, p string"), "i", "p").orderBy("pos").collect()
    assert [(r.title, r.authors, r.confidence) for r in got] == [("A", [], 0.0), ("B", ["x"], 1.0)]


def test_connector_records(spark):
    volume = '{"volumeInfo": {"title": " T ", "authors": ["a"], "industryIdentifiers": [{"type": "ISBN_10", "identifier": "4003101014"}, {"type": "ISBN_13", "identifier": "bad"}], "imageLinks": {"thumbnail": "http://x/y"}}}'
    r = spark.createDataFrame([(volume,)], "v string").select(records.volume_record(F.col("v")).alias("r")).first().r
    assert (r.title, r.isbn13, r.coverUrl) == ("T", "9784003101018", "https://x/y")
    assert spark.createDataFrame([('{"volumeInfo": {"title": " "}}',)], "v string").select(records.volume_record(F.col("v")).alias("r")).first().r is None


def test_csv_quotes_only_when_needed(spark):
    d = spark.createDataFrame([('a "b", c', ["x", "y"], None)], "title string, authors array<string>, publisher string")
    none = F.lit(None).cast("string")
    r = {"title": F.col("title"), "authors": F.col("authors"), "publisher": F.col("publisher"), "subtitle": none, "published": none, "isbn13": none, "series": none, "source": F.lit("ndl")}
    assert d.select(export.csv_row(r, F.lit("confirmed")).alias("x")).first().x == '"a ""b"", c",,x; y,,,,,ndl,confirmed'
    assert export.csv_header().startswith("﻿タイトル,副題")


def test_numbers_run_without_gaps(spark):
    d = spark.range(1000).withColumn("k", F.col("id") % 7)
    got = numbered(d, "id").orderBy("id").collect()
    assert [r["index"] for r in got] == list(range(1, 1001))
    assert sorted(r["index"] for r in numbered(d, "k").collect()) == list(range(1, 1001))
    assert numbered(d.limit(0), "id").count() == 0


def test_image_measures(spark):
    checker = [255 if (x + y) % 2 else 0 for y in range(8) for x in range(8)]
    d = spark.createDataFrame([(1, [128] * 64), (2, checker)], "i int, g array<int>")
    got = d.orderBy("i").select(images.brightness(F.col("g")).alias("b"), images.sharpness(F.col("g"), F.lit(8), F.lit(8)).alias("s"), images.visual_hash(F.col("g")).alias("h")).collect()
    assert got[0].b == pytest.approx(128 / 255) and got[0].s == 0.0 and got[0].h == "f" * 16
    assert got[1].s == 1.0 and got[1].h == "55aa" * 4
    assert {r.i: r.threshold for r in images.otsu(images.histogram(d, "i", "g"), "i").collect()} == {1: 128, 2: 0}


def test_merge_columns(spark):
    d = spark.createDataFrame([([(0.5, 0.2, "c"), (0.1, 0.2, "a"), (0.15, 0.2, "b"), (0.0, 0.05, "thin")],)], "c array<struct<x: double, width: double, text: string>>")
    assert [m.text for m in d.select(images.merge_columns(F.col("c")).alias("m")).first().m] == ["a b", "c"]
