"""Fill-in-middle, line dedup and importance resampling against plain Python on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.llm import fill_in_middle as fim
from folio.llm.importance_resampling import Crc32, Trie, Vocabulary, bucket_gains, resample, words_of
from folio.llm.line_dedup import dedup_lines
from tests.llm.fixtures import DOCS, clashing, documents


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Fill-in-middle


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (len(units), "plain", None, None, text)
    if h4 % 100 < 20:
        return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


ODD = ["<P>", "a <M> b", "<P<S", "<P", "x<", "<S", "S>a<", "<<P>>", "< P>", "<p>", "é<P", "日本語テキスト です。", "aé" * 40, "aÿb\u0080c", "😀😀a😀", "\n\n\n", "A" * 70000 + "<S>", "ab 1" * 9000]


def test_fill_in_middle_equals_plain_python_and_restores(spark):
    rows = documents(n=40) + [(2000 + i, t, None, None, None) for i, t in enumerate(ODD * 4)] + [(None, "null id here", None, None, None)] * 2 + [(7, "again", None, None, None)] * 2
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(3))
    out = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect())
    assert got == Counter((i, *plain_fim(i, t)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.back) for r in out.collect()) == Counter((i, t or "") for i, t, *_ in rows)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_lanes_agree_with_one_byte_after_the_other(monkeypatch):
    rng = random.Random(3)
    data = np.frombuffer(bytes(rng.choices(b"<<PSM>ab \xc3\xa9\xff", k=5003)), np.uint8)
    state, want = 0, []
    for byte in data.tolist():
        out = int(fim._TABLE[state * 256 + byte])
        state = out & fim._STATE
        want.append(out)
    for lanes in (1, 7, 64, 2048, 9000):
        monkeypatch.setattr(fim, "_LANES", lanes)
        assert fim.scan(data).tolist() == want


# Line dedup


def plain_lines(rows, least_chars=20, least_docs=3):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = [(i, [(line, line.strip(" \t\n\x0b\x0c\r").translate(fold)) for line in (t or "").split("\n")]) for i, t, *_ in rows]
    holders = defaultdict(set)
    for i, lines in keyed:
        for _, k in lines:
            holders[k].add(-1 if i is None else i)
    out = []
    for i, lines in keyed:
        lost = [len(k) >= least_chars and len(holders[k]) >= least_docs and max(holders[k]) != (-1 if i is None else i) for _, k in lines]
        out.append((i, len(lines), sum(lost), "\n".join(line for (line, _), gone in zip(lines, lost) if not gone)))
    return Counter(out)


def test_line_dedup_equals_plain_python(spark):
    rng = random.Random(5)
    common = [f"a line that many documents share number {k} é" for k in range(6)] + ["short", "x" * 20, "x" * 19, "É" * 20, "é" * 20, "İstanbul is a long enough line"]
    texts = []
    for _ in range(60):
        lines = [rng.choice(["", "  ", "\t\x0b"]) + (c.upper() if rng.random() < 0.2 and c.isascii() else c) + rng.choice(["", "\r", " \x0c"]) for c in rng.choices(common, k=rng.randrange(1, 6))]
        texts.append("\n".join(lines + [f"own line {rng.random()} of this text"] * rng.randrange(3)))
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    rows += [(500 + i, t, None, None, None) for i, t in enumerate([None, "", "\n", "\n\n", common[0], common[0] + "\n" + common[0], "y" * 5000 + "\n" + "z\n" * 3000])]
    rows += [(None, common[0], None, None, None), (None, common[1] + "\n", None, None, None)]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(5))
    got = Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(docs).collect())
    assert got == plain_lines(rows)
    assert sum(n for (_, _, n, _) in got) > 50
    assert dedup_lines(docs.limit(0)).count() == 0


def test_a_repeated_row_or_id_counts_as_one_document(spark):
    line = "this line stands in several documents"
    rows = [(1, line, "", "", 0)] * 3 + [(1, "other\n" + line, "", "", 0), (2, line.upper(), "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {r.n_dropped for r in dedup_lines(docs).collect()} == {0}
    rows += [(3, f"  {line}\t\n{line}", "", "", 0)]
    got = dedup_lines(spark.createDataFrame(rows, DOCS)).collect()
    assert Counter((r.doc_id, r.n_dropped, r.kept_text) for r in got) == Counter([(1, 1, "")] * 3 + [(1, 1, "other"), (2, 1, ""), (3, 0, rows[-1][1])])


# Importance resampling


def plain_features(text):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(fold))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resample(rows, target, percent, least_words=20, buckets=10_000):
    crc = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text, *_ in rows:
        s.update(map(crc, plain_features(text)[1]))
    for text in target:
        t.update(map(crc, plain_features(text)[1]))
    all_s, all_t = s.total() + buckets, t.total() + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)}
    out = []
    for i, text, *_ in rows:
        w, f = plain_features(text)
        weight = sum(gain[crc(x)] for x in f)
        h = int(sha(f"42:{'' if i is None else i}")[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(w) >= least_words])
    out.sort(key=lambda r: (not r[4], -r[3], r[0] is None, r[0] or 0, r[2]))
    drawn = percent * sum(r[4] for r in out) // 100
    return Counter((*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(out))


@pytest.mark.parametrize("percent", [5, 60, 100])
def test_resampling_equals_plain_python(spark, percent):
    rows = documents(seed=9, n=60)
    rows += [(3000, "x" * 70_000 + " " + "ab " * 20_000, None, None, None), (3001, "日本語 と Ünicode 2024 " * 9, None, None, None), (None, "null id " * 20, None, None, None)]
    rows += [(5, rows[5][1], None, None, None)] * 2
    target = [rows[4][1], "ka lo mi ter", None, ""]
    docs = clashing(spark.createDataFrame(rows, DOCS).repartition(4))
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    out = resample(docs, items, percent=percent)
    assert [t for _, t in out.dtypes] == ["bigint"] * 5
    assert Counter(map(tuple, out.collect())) == plain_resample(rows, target, percent)


def test_resampling_of_empty_tables(spark):
    docs, items = spark.createDataFrame(documents(n=12), DOCS), spark.createDataFrame([], "item_id long, text string")
    assert resample(docs.limit(0), items).count() == 0
    assert Counter(map(tuple, resample(docs, items, percent=50).collect())) == plain_resample([tuple(r) for r in docs.collect()], [], 50)
    assert not bucket_gains(docs.limit(0), items).any()


def test_trie_nodes_hold_counts_and_crc_states():
    texts = [b"one two three one two three one two", b"", b"one", b"\xc3\xa9t\xc3\xa9 one two " + b"w" * 300 + b" one two"]
    words = [words_of(t) for t in texts]
    vocabulary = Vocabulary()
    trie = Trie(vocabulary.numbers([w for own in words for w in own]), np.array([len(w) for w in words]), vocabulary, Crc32())
    want = [Counter(b" ".join(own[i : i + k]) for own in words for i in range(len(own) - k + 1)) for k in (1, 2, 3)]
    for (_, node, state), runs in zip(trie.levels, want):
        assert len(state) == len(runs)
        assert Counter(dict(zip(state.tolist(), np.bincount(node).tolist()))) == Counter({zlib.crc32(r): n for r, n in runs.items()})


def test_vocabulary_starts_anew_beyond_its_limit():
    v = Vocabulary(limit=2)
    assert v.numbers([b"a", b"b", b"c", b"a"]).tolist() == [0, 1, 2, 0]
    assert v.numbers([b"c", b"a"]).tolist() == [0, 1] and len(v.own) == 2
