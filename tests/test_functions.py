import random

import pytest
from pyspark.sql import functions as F

from folio.functions import ids, similarity as sim, text


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_isbn_pairs(spark):
    rows = [("4003101014", True), ("4003101015", False), ("400310101", False), ("043942089X", True), ("4-00-310101-4", True), (None, False)]
    d = spark.createDataFrame(rows, "c string, ok boolean")
    assert all(r.ok == r.got for r in d.withColumn("got", ids.is_isbn10(F.col("c"))).collect())
    rows = [("9784003101018", True), ("9784003101019", False), ("978-4-00-310101-8", True), ("", False)]
    d = spark.createDataFrame(rows, "c string, ok boolean")
    assert all(r.ok == r.got for r in d.withColumn("got", ids.is_isbn13(F.col("c"))).collect())
    assert one(spark, ids.to_isbn13(F.col("c")), c="4003101014") == "9784003101018"


@pytest.mark.parametrize("line", ["ISBN978-4-00-310101-8", "ISBN4-00-310101-4"])
def test_isbn_in_text(spark, line):
    assert one(spark, ids.extract_isbn13(F.col("c")), c=line) == "9784003101018"


def test_isbn_in_text_strips_once_and_agrees_with_a_plain_loop(spark):
    """The first valid code of 13 digits wins over any of 10; the text is stripped at one place of the expression."""
    import re

    def digit13(b):
        return str(-sum(int(x) * (1, 3)[i % 2] for i, x in enumerate(b)) % 10)

    def plain(line):
        s = re.sub("[-\\s]", "", line).upper()
        long = [c for c in re.findall("97[89][0-9]{10}", s) if c[12] == digit13(c[:12])]
        short = [c for c in re.findall("[0-9]{9}[0-9X]", s) if sum((10 - i) * (10 if x == "X" else int(x)) for i, x in enumerate(c)) % 11 == 0]
        bodies = ["978" + c[:9] for c in short]
        return long[0] if long else bodies[0] + digit13(bodies[0]) if bodies else None

    rng = random.Random(5)
    some = lambda: rng.choice(["4-00-310101-4", "978-4-00-310101-8", "978-4-00-310101-9", "4 00 310101 5", "080442957x", "9791034304844", "12345", "C0193", "a b", str(rng.randrange(10**13))])
    lines = ["", "-", *(" t ".join(some() for _ in range(rng.randint(1, 4))) for _ in range(300))]
    d = spark.createDataFrame([(x,) for x in [*lines, None]], "c string").select("c", ids.extract_isbn13(F.col("c")).alias("x"))
    assert [(r.c, r.x) for r in d.collect()] == [(x, plain(x)) for x in lines] + [(None, None)]
    assert d._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1


def test_barcodes(spark):
    for codes in (["1923000012004", "9784873115658"], ["9784873115658", "1923000012004"]):
        assert spark.createDataFrame([(codes,)], "c array<string>").select(ids.pick_isbn13(F.col("c")).alias("x")).first().x == "9784873115658"
    assert spark.createDataFrame([(["1920079003001"],)], "c array<string>").select(ids.pick_isbn13(F.col("c")).alias("x")).first().x is None


@pytest.mark.parametrize(
    "raw, key", [("ＡＢＣ１２３", "abc123"), ("サーバー", "さば"), ("サーバ", "さば"), ("ﾉﾙｳｪｲ", "のるうぇい"), ("佐々木", "佐木"), ("コンピュータ・サイエンス", "こんぴゅたさいえんす"), (None, "")]
)
def test_match_key(spark, raw, key):
    assert one(spark, text.match_key(F.col("c")), c=raw) == key


@pytest.mark.parametrize(
    "title, main, sub, volume",
    [("吾輩は猫である 上", "吾輩は猫である", None, "上"), ("鋼の錬金術師 第3巻", "鋼の錬金術師", None, "3"), ("A:B", "A:B", None, None), ("Foo-Bar", "Foo", "Bar", None), ("casino 3", "casi", None, "3")],
)
def test_split_title(spark, title, main, sub, volume):
    got = one(spark, text.split_title(F.col("c")), c=title)
    assert (got.main, got["sub"], got.volume) == (main, sub, volume)


@pytest.mark.parametrize("raw, clean", [("文化 政 策の現在", "文化政策の現在"), ("|_ 小林真理 ~", "小林真理"), ("C++ プログラミング", "C++プログラミング")])
def test_clean_line(spark, raw, clean):
    assert one(spark, text.clean_line(F.col("c")), c=raw) == clean


def test_roles(spark):
    d = spark.createDataFrame([("岩波書店", True, True), ("O'Reilly books", True, False), ("小林真理", False, True), ("Robert Martin", False, True), ("山田太郎 著", False, True), ("", False, False)], "c string, p boolean, a boolean")
    for r in d.select("*", text.looks_like_publisher(F.col("c")).alias("gp"), text.looks_like_author(F.col("c")).alias("ga")).collect():
        assert (r.gp, r.ga) == (r.p, r.a), r


@pytest.mark.parametrize(
    "q, t, score", [("吾輩は猫である", "吾輩は描である", 0.733333), ("ノルウェイ", "ノルウェイの森", 0.77), ("red widget", "red widgets", 0.926765), ("blue bolt", "blue gear", 0.453571), ("", "x", 0.0)]
)
def test_title_similarity(spark, q, t, score):
    x = sim.title_similarity(sim.title_key(F.col("q"), True), sim.title_key(F.col("t"), True))
    assert one(spark, x, q=q, t=t) == pytest.approx(score, abs=1e-6)


def test_author_similarity_is_one_sided(spark):
    d = spark.createDataFrame([(["夏目, 漱石"], ["夏目漱石"], 1.0), ([], ["x"], 0.5), (["a"], ["a", "zz"], 1.0)], "q array<string>, t array<string>, s double")
    for r in d.withColumn("x", sim.author_similarity(sim.author_keys(F.col("q")), sim.author_keys(F.col("t")))).collect():
        assert r.x == pytest.approx(r.s)


def test_dice_matches_a_plain_count(spark):
    from folio.operators.observe import dice

    rng = random.Random(1)
    rows = [("".join(rng.choices("abc", k=rng.randrange(7))), "".join(rng.choices("abc", k=rng.randrange(7)))) for _ in range(200)]
    for r in spark.createDataFrame(rows, "a string, b string").select("a", "b", sim.dice(F.col("a"), F.col("b")).alias("x")).collect():
        assert r.x == pytest.approx(dice(r.a, r.b)), (r.a, r.b)
