import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from folio.llm import decontamination, fingerprints, ngram_jaccard, packing, pii, quality, sharding, toxicity
from folio.llm.common import WordHashes, connected_components, shingle_set, shingle_sets
from tests.llm.fixtures import DOCS, clashing, documents, words

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def texts():
    return {i: t or "" for i, t, *_ in documents()}


# --- n-gram Jaccard join


def components(sets: dict[int, frozenset]) -> dict[int, int]:
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in sets}


def plain_sets(t: dict[int, str]) -> dict[int, frozenset]:
    out = {}
    for i, x in t.items():
        w = x.encode().lower().split()
        out[i] = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    return out


def test_join_matches_brute_force(spark, docs):
    want = plain_sets(texts())
    got = {r.doc_id: r for r in ngram_jaccard.ngram_jaccard_join(clashing(docs)).collect()}
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in want.items()}
    assert {i: r.component_id for i, r in got.items()} == components(want)


def test_join_on_chains_of_near_copies_of_one_text(spark):
    """A large group whose members are linked in part only: no link between components may be lost."""
    rng = random.Random(4)
    base = words(rng, 120)
    rows = {}
    for i in range(90):
        w = list(base)
        for k in rng.sample(range(120), rng.randrange(0, 5)):
            w[k] = f"w{rng.randrange(10**6)}"
        rows[i] = " ".join(w)
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.ngram_jaccard_join(d).collect()}
    assert got == components(plain_sets(rows))


def test_every_pair_above_the_threshold_shares_a_signature():
    rng, cache = random.Random(9), WordHashes()
    for n in (5, 6, 8, 11, 17, 30, 64, 130, 400):
        for _ in range(30):
            a = [f"w{rng.randrange(10**7)}" for _ in range(n + 4)]
            x = shingle_set(" ".join(a).encode(), cache)
            extra = np.unique(np.array([rng.getrandbits(64) for _ in range(n)], np.uint64))
            drop = rng.randrange(0, n // 4 + 2)
            y = np.unique(np.concatenate([rng.sample(list(x), len(x) - drop), extra[: rng.randrange(0, max(1, n // 5 - drop + 2))]]).astype(np.uint64))
            common = len(set(x.tolist()) & set(y.tolist()))
            if len(y) and 5 * common >= 4 * (len(x) + len(y) - common):
                f = [np.array([rng.choice([0.0, 0.0, 0.3]) for _ in s]) for s in (x, y)]
                cost = dict(zip(x.tolist(), f[0])) | dict(zip(y.tolist(), f[1]))
                sig, own = ngram_jaccard.signatures([x, y], [np.array([cost[v] for v in s.tolist()]) for s in (x, y)])
                shared = set(sig[own == 0].tolist()) & set(sig[own == 1].tolist())
                assert shared, (n, len(x), len(y), common)


def test_shingle_sets_of_many_texts_tell_apart_what_plain_sets_do():
    rng = random.Random(12)
    rows = ["", " ", "A", "a b\tC  d", "a b c d", "\x00 \x1c b c d e", "\x00\x00 \x1c b c d e", "x" * 70 + " b c d e", "x" * 71 + " b c d e", "12345678 b c d e", "123456789 b c d e"]
    rows += [" ".join(rng.choice(["a", "bb", "x" * 17, "y" * 90, "\u00e4\u00df"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    want, got = plain_sets(dict(enumerate(rows))), shingle_sets([r.encode() for r in rows])
    assert [len(x) for x in got] == [len(want[i]) for i in range(len(rows))]
    hashes = {x: set() for x in set().union(*want.values())}
    for i, x in enumerate(got):
        for shingle in want[i]:
            hashes[shingle].add(frozenset(x.tolist())) if len(want[i]) == 1 else None
    assert all(len(x) <= 1 for x in hashes.values())
    of = {}
    assert all(of.setdefault(frozenset(want[i]), x.tobytes()) == x.tobytes() for i, x in enumerate(got)) and len(set(of.values())) == len(of)
    assert shingle_sets([]) == [] and len(shingle_sets([None])[0]) == 0


def test_the_star_of_a_large_group_stands_on_its_original_wherever_it_lies():
    """The original has the largest hash: a star on it links all copies, a star on any other text leaves pairs to be tried."""
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([np.delete(base, rng.choice(len(base), 24, False)), rng.integers(0, 1 << 63, 24).astype(np.uint64)])) for _ in range(40)] + [base]
    sig, own = ngram_jaccard.signatures(sets, [np.zeros(len(x)) for x in sets])
    row = {"sig": sig.astype(np.uint32).tobytes(), "local": own.astype(np.uint16).tobytes(), "ids": np.arange(41).tobytes(), "sizes": ngram_jaccard.size_code(np.array([len(x) for x in sets])).tobytes()}
    found = ngram_jaccard._collisions(pd.DataFrame([row]))
    pairs = found[found["members"].isna()]
    assert set(zip(pairs["a"], pairs["b"])) >= {(i, 40) for i in range(40)}
    assert len(found[found["members"].notna()]) > 1


def test_stars_of_all_buckets_stand_on_one_original(spark, monkeypatch):
    """Copies that the original links, not each other, in many buckets: a few pairs a copy are compared, not one a bucket."""
    rng, tried, links = random.Random(8), [], ngram_jaccard._links
    monkeypatch.setattr(ngram_jaccard, "_links", lambda near, sets: (tried.append(near.count()), links(near, sets))[1])
    base = words(rng, 300)
    rows = {200: " ".join(base)}
    for i in range(200):
        w = list(base)
        for k in rng.sample(range(60), 5):
            w[5 * k] = f"w{rng.randrange(10**6)}"
        rows[i] = " ".join(w)
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.ngram_jaccard_join(d, bucket_bytes=3000).collect()}
    assert got == components(plain_sets(rows)) and set(got.values()) == {0}
    assert sum(tried) <= 4 * len(rows), tried


def test_size_codes_of_sets_that_may_link_are_near():
    n = np.concatenate([np.arange(4, 3000), [10**6, 10**9]])
    most = n * 5 // 4
    code = [ngram_jaccard.size_code(x).astype(int) for x in (n, most)]
    assert (code[1] - code[0] <= ngram_jaccard.MOST_APART).all()


def test_a_set_of_four_links_with_one_of_five_that_holds_it(spark):
    rng = random.Random(6)
    rows, w = {}, [[f"w{rng.randrange(10**7)}" for _ in range(10)] for _ in range(6)]
    for i, x in enumerate(w):
        rows |= {10 * i: " ".join(x[:8]), 10 * i + 1: " ".join(x[:9]), 10 * i + 2: " ".join(["before", *x[:8]]), 10 * i + 3: " ".join(x[:7])}
    rows |= {100: "a b c d " * 6, 101: "a b c d " * 6 + "e"}
    want = components(plain_sets(rows))
    assert want[1] == want[2] == 0 and want[3] == 3 and want[101] == 100
    d = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.ngram_jaccard_join(d).collect()}
    assert got == want


def test_join_odd_tables(spark, empty):
    assert ngram_jaccard.ngram_jaccard_join(empty).count() == 0
    d = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (1, None), (None, None)], "doc_id long, text string")
    got = sorted(ngram_jaccard.ngram_jaccard_join(d).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_shingles))
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == [(1, 0, 1), (3, 2, 3), (3, 2, 3), (None, 0, None), (None, 2, None)]


def test_join_links_all_texts_of_an_id(spark):
    a, b, c = "a1 b c d e f g", "p q r s t u v", "k l m n o 1 2"
    rows = [(1, a), (5, a), (5, b), (9, b), (9, c), (12, c), (3, "other words here"), (3, ""), (20, "x"), (20, "y"), (21, "y")]
    got = ngram_jaccard.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (5, 1), (9, 1), (12, 1), (3, 3), (20, 20), (21, 20)} and len(got) == len(rows)


def test_keep_one_keeps_the_smallest(spark, docs):
    kept = {r.doc_id for r in ngram_jaccard.keep_one(docs).collect()}
    assert kept == {i for i, c in components(plain_sets(texts())).items() if i == c}


def test_keep_one_by_rows(spark):
    """Repeated rows, null ids, and an id with two texts of which one is a near copy of a smaller id."""
    a, b, c, e = ("a1 b c d e f g h", "p q r s t u v", "k l m n o 1 2", "w x y z 3 4 5")
    rows = [(1, a), (1, a), (2, a + " i"), (2, b), (3, c), (3, c), (None, c), (None, e), (None, e), (4, ""), (4, ""), (None, None), (None, None)]
    d = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = ngram_jaccard.keep_one(d)
    assert kept.columns == d.columns
    want = Counter([(1, a), (2, b), (3, c), (None, e), (4, ""), (4, ""), (None, None), (None, None)])
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 150: 100, 200: 100}


# --- toxicity and quality


def labelled(spark, n: int = 400):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        w, bad, junk = words(rng, rng.randrange(10, 80)), i % 5 == 0, i % 4 == 1
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["gromp", "gromping", "zarkel"]))
        if junk:
            w = [x + rng.choice(["***", "%%%"]) for x in w]
        rows.append((i, " ".join(w), "en", f"src{i % 5}", len(" ".join(w))))
        if i % 3:
            labels.append((i, int(not junk), int(bad)))
    rows += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (None, "ka lo mi", None, None, None)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_finds_held_out_documents(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.score_toxicity(clashing(docs), labels).collect()}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(i, r) for i, r in got.items() if i is not None and i < 400 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    assert np.mean([r.predicted == int(i % 5 == 0) for i, r in held]) > 0.95
    assert all(n.example not in {i for i, _ in held} for r in got.values() for n in r.neighbors)
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}


def test_index_gives_the_exact_nearest():
    rng = np.random.default_rng(1)
    terms, n = 40, 700
    model = toxicity.ToxicityModel(np.linspace(1, 4, terms), np.arange(n), rng.integers(0, 2, n), np.ones(n), 0.3, rng.random(terms), k=10)
    vectors = []
    for _ in range(n):
        t = np.sort(rng.choice(terms, rng.integers(0, 6), replace=False, p=np.r_[np.full(4, 0.15), np.full(36, 0.4 / 36)]))
        vectors.append((t, model.vectors(np.zeros(len(t), np.int64), t, rng.integers(1, 4, len(t)))[2]))
    flat = lambda at: (np.repeat(np.arange(len(at)), [len(vectors[i][0]) for i in at]), *(np.concatenate([vectors[i][k] for i in at]) for k in (0, 1)))
    own, t, w = flat(range(n))
    model.build(own.astype(np.int32), t, w)
    dense = np.zeros((n, terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    assert 0 < len(model.row_max) < terms
    at = list(range(0, n, 7))
    for i, (s, telling, o) in zip(at, model.nearest(len(at), *flat(at), at)):
        cos = (dense @ dense[i]).round(9)
        cos[i] = -1
        ranked = [j for j in np.lexsort((np.arange(n), -cos)) if cos[j] > 0]
        of = [[j for j in ranked if model.toxic[j] == y][:10] for y in (0, 1)]
        order = [j for j in ranked if j in of[0] or j in of[1]]
        assert list(o) == order and np.allclose(s, cos[order])
        assert np.allclose(telling, dense[order] @ (dense[i] * model.relevance))


def test_lookups_add_up_few_texts_at_a_time():
    """What 64 texts need beside the cells grows with two numbers a posting, and the neighbours stay those of plain products."""
    rng, terms, n, docs = np.random.default_rng(2), 1000, 2048, 64
    model = toxicity.ToxicityModel(np.ones(terms), np.arange(n), rng.integers(0, 2, n), np.ones(n), 0.3, rng.random(terms))
    drawn = lambda rows, most: (np.repeat(np.arange(rows), most), np.concatenate([np.sort(rng.choice(terms, most, replace=False)) for _ in range(rows)]))
    (own, t), (doc, q) = drawn(n, 45), drawn(docs, 300)
    w, x = rng.random(len(t)), rng.random(len(q))
    model.build(own.astype(np.int32), t, w)
    postings = int(np.bincount(t, minlength=terms)[q].sum())
    tracemalloc.start()
    found = model.nearest(docs, doc, q, x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    examples, texts = np.zeros((n, terms)), np.zeros((docs, terms))
    examples[own, t], texts[doc, q] = w, x
    for d, (s, telling, o) in enumerate(found):
        cos = (examples @ texts[d]).round(9)
        want = sorted(i for y in (0, 1) for i in sorted(np.flatnonzero(model.toxic == y), key=lambda i: (-cos[i], i))[:15])  # noqa: B023
        assert sorted(o) == want and np.allclose(s, cos[o]) and np.allclose(telling, examples[o] @ (texts[d] * model.relevance))
    assert len(model.row_max) < terms / 2 and most < 30 * postings, (most, postings, most / postings)


def test_toxicity_indexes_all_terms_of_the_examples(spark):
    """Documents without a telling word have neighbours too, and a toxic word in one example finds that example."""
    docs, labels = labelled(spark)
    more = spark.createDataFrame([(3001, "qqrare ka lo mi", "en", "s", 15), (3002, "some qqrare thing", "en", "s", 17)], DOCS)
    more_labels = spark.createDataFrame([(3001, 1, 1)], "doc_id long, quality int, toxic int")
    assert zlib.crc32(b"3001") % 5
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs.unionByName(more), labels.unionByName(more_labels)).collect()}
    assert all(r.neighbors for i, r in got.items() if i is not None and i < 400)
    assert got[3002].neighbors[0].example == 3001


def test_cosines_are_those_of_whole_texts(spark):
    """Plain TF-IDF over all words, those that no example has included, a very long text and repeated rows among them."""
    docs, labels = labelled(spark, 200)
    extra = [(500, " ".join(f"new{i % 900}" for i in range(5000)) + " gromp", "en", "s", 1), (501, "gromp new1 new1", "en", "s", 1), (501, "gromp new1 new1", "en", "s", 1), (502, "new2 unheard", "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, DOCS))
    rows = docs.collect()
    counts = [Counter(x for x in map(toxicity.word_of, (r.text or "").lower().split()) if x) for r in rows]
    df = Counter(w for c in counts for w in c)
    idf = {w: np.log((1 + len(rows)) / (1 + n)) + 1 for w, n in df.items()}
    vectors = [{w: (1 + np.log(n)) * idf[w] for w, n in c.items()} for c in counts]
    length = [np.sqrt(sum(x * x for x in v.values())) for v in vectors]
    cosine = lambda a, b: sum(x * vectors[b].get(w, 0.0) for w, x in vectors[a].items()) / (length[a] * length[b])
    y = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    place = {r.doc_id: i for i, r in enumerate(rows)}
    want = {}
    for i, r in enumerate(rows):
        near = sorted((-round(cosine(i, place[e]), 7), e) for e in y if length[i])
        want[r.doc_id, r.text] = [[-c for c, e in near if y[e] == t and c < 0][:15] for t in (0, 1)]
    got = toxicity.score_toxicity(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len({r.doc_id for r in got}) > 200
    for r in got:
        for t in (0, 1):
            assert np.allclose([n.similarity for n in r.neighbors if n.toxic == t], want[r.doc_id, r.text][t], atol=2e-7)
    one = {r.doc_id: r for r in got}
    assert 0 < max(n.similarity for n in one[500].neighbors) < 0.1 and not one[502].neighbors


def test_toxicity_without_labels(spark, empty):
    docs, labels = labelled(spark, 20)
    assert {r.score for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.0}
    assert toxicity.score_toxicity(empty, labels).count() == 0


def test_quality_tells_held_out_junk(spark, empty):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.score_quality(clashing(docs), labels).collect()}
    held = [(i, r) for i, r in got.items() if i is not None and i < 400 and r.held_out]
    assert len(got) == 403 and np.mean([r.predicted == int(i % 4 != 1) for i, r in held]) > 0.95
    assert {r.score for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score_quality(empty, labels).count() == 0


def test_one_class_of_labels_and_repeated_rows(spark):
    docs, labels = labelled(spark, 40)
    assert {r.score for r in quality.score_quality(docs, labels.filter("quality = 1")).collect()} == {1.0}
    twice = quality.score_quality(docs.union(docs), labels.union(labels)).groupBy("doc_id").count().collect()
    assert len(twice) == 43 and {r["count"] for r in twice} == {2}


def test_combined_views_are_calibrated_to_all_labels():
    # Good rows are sampled at a quarter of the others' rate; the scores must fit the rows before sampling.
    rng = np.random.default_rng(4)
    hidden = rng.normal(1.5, 2, 60_000)
    y = (rng.random(len(hidden)) < 1 / (1 + np.exp(-hidden))).astype(int)
    margins = [0.5 * hidden + rng.normal(0, 0.5, len(y)), 3 * hidden + rng.normal(0, 4, len(y)) + 2]
    taken = rng.random(len(y)) < np.where(y == 1, 0.25, 1.0)
    turn = rng.integers(0, 3, len(y))
    steps, mix = quality.combined(margins, y, np.where(y == 1, 1.0, 0.25), taken & (turn == 0), taken & (turn == 1))
    logit = [a * m + b for (a, b), m in zip(steps, margins)]
    for score in (*logit, mix[0] * logit[0] + mix[1] * logit[1] + mix[2]):
        p = 1 / (1 + np.exp(-score))
        for lo in np.arange(0, 1, 0.1):
            on = (turn == 2) & (p >= lo) & (p < lo + 0.1)
            if on.sum() > 300:
                assert abs(p[on].mean() - y[on].mean()) < 0.08


# --- personal data

KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base(t: str) -> str:
    out = []
    for k, (kind, p) in enumerate(KINDS.items()):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


PII_TEXTS = [
    None, "", "no data", "a@b.com", "x a.b+c%d@e-f.g.h. and a@b", "a@b.co_x@d.ef", "a@b.c..d a@@b.c .@x.y", "1.2.3.4 and 300.1.1.1 and 1.2.3.4.5.6.7.8 and 001.02.3.255",
    "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111 2", "4111  1111 1111 1111", "+1 (988) 555-2485 x +4912345 +12 345 678 90.", "+1 (578) 555-6437 4111111111111111", "é ü 🙂 a@b.com 🙂 9.9.9.9",
    "\ue000\ue001 a@b.com \ue002 4111 1111 1111 1111", "1 " * 3000, "a." * 4000 + "@b.c" + ".d" * 4000, "9" * 6000, "1.1.1.1 " * 1500,
]


def test_base_spans_match_the_patterns(spark):
    d = spark.createDataFrame(list(enumerate(PII_TEXTS)), "doc_id long, text string")
    for r in pii.find_pii(clashing(d)).collect():
        want = base(PII_TEXTS[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), PII_TEXTS[r.doc_id][:80]
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        kinds = Counter(s.split(":")[0] for s in r.spans.split(",") if s)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds[k] for k in KINDS]


def test_trees_add_what_a_base_rule_dropped(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        phone, card = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}", "4111111111111111"
        t = ["ka lo", phone, "mi", card, f"token = \"{rng.getrandbits(80):020x}{rng.randrange(10**15)}\"", f"v{rng.randrange(10)}.2.0 {rng.randrange(10**13, 10**14)}x"]
        rng.shuffle(t)
        rows.append((i, " ter ".join(t)))
    rows.append((1000, "ka +1 (578) 555-6437 4111111111111111 lo"))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_pii(d).collect()}
    assert base(rows[-1][1]) == "" and "card:21:37" in got[1000].spans and "phone:" in got[1000].spans
    assert all(set(r.spans.split(",")) - {""} == set(base(t).split(",")) - {""} for (i, t), r in ((x, got[x[0]]) for x in rows[:-1]))


def test_counts_are_the_base_rules(spark, monkeypatch):
    # A model that takes every proposal adds spans of each kind; the counts stay those of the base rules.
    monkeypatch.setattr(pii, "fit_proposals", lambda *_, **__: (lambda f: F.lit(1.0), dict.fromkeys(range(4), 0.0)))
    t = "a@b.com ka c (at) d.org ter +1 (578) 555-6437 4111111111111111 lo 988 555 2485 mi 4111 1111 1111 1112"
    r = pii.find_pii(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    want = Counter(s.split(":")[0] for s in base(t).split(","))
    assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want[k] for k in KINDS] == [1, 0, 0, 0] and r.spans.count(",") >= 3


def test_trees_learn_from_every_document(spark):
    # Cards lie only in texts of high hashes, behind more than 20,000 phone numbers in texts of low ones.
    rng, low, high = random.Random(5), [], []
    for i in range(1200):
        numbers = [f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}" for _ in range(60)]
        phones, card = " ter ".join(numbers), f"{i} ka 4111111111111111 mi {rng.randrange(10**13, 10**14)}x"
        h, g = (xxhash.xxh64_intdigest(t.encode(), seed=42) for t in (phones, card))  # as F.xxhash64
        low += [phones] if h >> 63 else []
        high += [] if g >> 63 else [card]
    rows = [*enumerate(low[:450]), *enumerate(high[:400], 1000), (9999, "ka +1 (578) 555-6437 4111111111111111 lo")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert d.filter("doc_id < 1000").select(F.max(F.xxhash64("text"))).first()[0] < 0 and len(low) >= 450
    got = {r.doc_id: r for r in pii.find_pii(d).collect()}
    assert "card:21:37" in got[9999].spans and "phone:" in got[9999].spans


def test_redaction(spark):
    d = spark.createDataFrame([(1, "write a@b.com or 1.2.3.4.", 99), (2, None, 7), (3, "plain", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.redact(d).collect()}
    assert got[1].text == "write <EMAIL> or <IP>." and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[2].n_chars, got[3].text) == (None, 7, "plain")
    assert pii.redact(d).columns == d.columns


# --- decontamination


def test_contamination_is_verified_and_complete(spark, docs, empty):
    rng = random.Random(6)
    items = [(i, " ".join(words(rng, rng.randrange(12, 60))) + ".\n" + " ".join(f"q{rng.randrange(10**6)}" for _ in range(6)) + ".") for i in range(150)]
    rows, want = [], set()
    for i in range(120):
        w = words(rng, rng.randrange(0, 400))
        if i % 4 == 0:
            item, text = rng.choice(items)
            at = rng.randrange(len(w) + 1)
            w[at:at] = text.upper().split()
            want.add((i, item))
        rows.append((i, " ".join(w)))
    # One word changed in an item's answer, and an item without its last words.
    for i, cut in ((600, lambda w: [*w[:-3], "other", *w[-2:]]), (601, lambda w: w[:-6])):
        item, text = max(items, key=lambda x: len(x[1]))
        rows.append((i, " ".join(["ka", *cut(text.split()), "lo"])))
        want.add((i, item))
    rows += [(500, None), (501, "")]
    table = spark.createDataFrame([*items, (None, "x y"), (900, None), (901, " ")], "item_id long, text string")
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({}, {"index_bytes": 9000}):
        got = {(r.doc_id, r.item_id) for r in decontamination.find_contamination(clashing(d), table, **how).collect()}
        assert got == want
    kept = {r.doc_id for r in decontamination.drop_contaminated(d, table).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in want}
    assert decontamination.find_contamination(empty, table).count() == 0 and decontamination.find_contamination(d, table.limit(0)).count() == 0


def test_retrieval_finds_all_above_the_threshold():
    import pandas as pd

    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(5, 25))) for _ in range(200)]
    rows = next(decontamination._item_rows([pd.DataFrame({"item_id": range(200), "text": texts})]))
    df = Counter(t for terms in rows["terms"] for t in terms)
    index = decontamination.build_index(rows, df, 200, rows["n"].mean(), 0.5)
    terms = decontamination.TermIds(index.vocabulary)
    ptr, term, impact = index.impacts
    impacts = [list(zip(term[a:b].tolist(), impact[a:b].tolist())) for a, b in zip(ptr, ptr[1:])]
    for _ in range(20):
        ids = terms.of(" ".join(rng.choices([*vocabulary, "zz"], k=300)).encode())
        want = set()
        for p in range(0, 300, index.window // 2):
            seen = set(ids[p : p + index.window].tolist())
            want |= {(i, p) for i, own in enumerate(impacts) if sum(w for t, w in own if t in seen) >= index.threshold[i] - 1e-9}
        assert {(i, p) for i, p, _ in index.retrieve(ids)} == want


# --- sharding


def test_shards_are_even_and_hold_every_row_once(spark, docs, empty):
    got = sharding.shard(clashing(docs), shards=7, block_rows=4).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts())
    sizes = Counter(r.shard for r in got)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
    for r in got:
        t = texts()[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(t) + 1, zlib.crc32(t), "rows", None)
    assert sharding.shard(empty).count() == 0
    assert sharding.shard(spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string"), shards=2).count() == 3


@pytest.mark.parametrize("built, run", [("1", "40"), ("40", "1")])
def test_shards_stay_exact_when_splits_change_between_build_and_action(spark, tmp_path, built, run):
    """Another number of cores, or a lost executor, changes how Spark splits the files of a written table."""
    spark.range(403).selectExpr("id AS doc_id", "repeat('x', cast(id AS int)) AS text").repartition(6).write.parquet(str(tmp_path / "d"))
    key = "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(key, built)
        shards = sharding.shard(spark.read.parquet(str(tmp_path / "d")), block_rows=20)
        spark.conf.set(key, run)
        got = shards.collect()
    finally:
        spark.conf.unset(key)
    assert sorted(r.doc_id for r in got) == list(range(403))
    sizes = Counter(r.shard for r in got)
    assert set(sizes.values()) == {50, 51}
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))


def test_matrix_has_its_sums_and_is_uniform():
    sent, taken = [10, 0, 25, 5], [13, 14, 13]
    total = np.zeros((4, 3))
    for seed in range(2000):
        m = sharding.communication_matrix(sent, taken, seed)
        assert m.sum(axis=1).tolist() == sent and m.sum(axis=0).tolist() == taken
        total += m
    assert np.allclose(total / 2000, np.outer(sent, taken) / 40, atol=0.15)


def test_rows_of_the_matrix_fit_together_beyond_small_urns():
    taken = np.full(9, 4 * 10**8)
    ends = np.linspace(0, taken.sum(), 6).astype(np.int64)
    rows = [sharding.matrix_row(p, ends, taken, 3) for p in range(5)]
    assert np.array_equal(sum(rows), taken) and [r.sum() for r in rows] == np.diff(ends).tolist()
    assert [n for _, _, n in sharding.block_sizes(10**11, 8, 500_000)][-1] <= 500_000


def test_large_urns_have_the_right_mean_and_spread():
    rng = np.random.default_rng(5)
    good, bad, draws = 3 * 10**9, 7 * 10**9, 10**6
    x = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(400)])
    sd = (draws * 0.3 * 0.7 * (1 - draws / 10**10)) ** 0.5
    assert abs(x.mean() - 0.3 * draws) < 5 * sd / 20 and 0.85 < x.std() / sd < 1.15
    assert sharding.hypergeometric(rng, 10**9, 10**9, 0) == 0


# --- packing


def test_marks_after_words_need_no_encoding_of_their_own():
    class Counting:
        def __init__(self, tok):
            self.tok, self.texts = tok, 0

        def encode(self, text, **how):
            self.texts += 1
            return self.tok.encode(text, **how)

        def encode_batch_fast(self, texts, **how):
            self.texts += len(texts)
            return self.tok.encode_batch_fast(texts, **how)

    cores = [*{w for w in words(random.Random(8), 400)}, "éß", "ñandú", "don", "ΟΔΟΣ", "ﬁn", "x1", "it's", "e\u0301"]
    marked = [w + m for w in cores for m in ("", ".", ",", "%%%", "!!", "'", "''s", ".***", "<|", "$\u0301", "…")]
    made = packing.WordIds(TOKENIZER)
    plain, made.tok = made.tok, Counting(made.tok)
    whole = plain.encode(" ".join(marked), add_special_tokens=False).ids
    assert np.frombuffer(next(made.all_ids([" ".join(marked)])), "<u4").tolist() == whole
    one = packing.WordIds(TOKENIZER)
    one.tok = Counting(plain)
    list(one.all_ids([" ".join(w + m for w in cores[:-5] for m in ("", "%%%", "!!", "'", ".***"))]))
    assert one.tok.texts < 20


def test_packing_is_a_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    for capacity in (2048, 64):
        got = packing.pack(clashing(docs), TOKENIZER, capacity=capacity).collect()
        for i, t in texts().items():
            ids = tok.encode(t, add_special_tokens=False).ids + [1]
            pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
            assert sum(r["length"] for r in pieces) == len(ids) == pieces[0].doc_tokens
            at = 0
            for r in pieces:
                assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
                at += r["length"]
        seqs: dict[int, list] = {}
        for r in got:
            seqs.setdefault(r.sequence_id, []).append(r)
        assert sorted(seqs) == list(range(len(seqs)))
        for rows in seqs.values():
            rows.sort(key=lambda r: r.offset)
            ends = np.cumsum([r["length"] for r in rows])
            assert ends[-1] <= capacity and [r.offset for r in rows] == [0, *ends[:-1].tolist()]
        assert len(seqs) <= 1.15 * -(-sum(r["length"] for r in got) // capacity) + 2
    assert packing.pack(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_patterns_cover_the_demand_exactly(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(1, 64), 20, replace=False))
    demand = rng.integers(1, 60, 20)
    plan = packing.cutting_patterns(sizes, demand, 64)
    assert (sum(p * n for p, n in plan) == demand).all() and all((p * sizes).sum() <= 64 for p, _ in plan)
    bins: list[int] = []
    for size in sorted(np.repeat(sizes, demand), reverse=True):
        at = next((k for k, room in enumerate(bins) if room >= size), None)
        bins.append(64) if at is None else None
        bins[-1 if at is None else at] -= size
    assert sum(n for _, n in plan) <= len(bins) + 1  # no worse than first fit, largest first


# --- fingerprints


def test_fingerprints_estimate_the_similarity(spark, docs, empty):
    t = texts()
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(clashing(docs)).collect()}
    order = sorted(t, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    errors = []
    for i, r in got.items():
        n = len(t[i])
        edited = t[i][: n - n // 3] + t[after[i]][: n // 3]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = (plain_sets({0: re.sub(r"[A-Z]+", lambda m: m[0].lower(), x)})[0] for x in (t[i], edited))
        errors.append(r.near_edited - len(a & b) / max(1, len(a | b)) if a or b else 0.0)
        assert len(r.fingerprint) in (0, 128)
    assert len(got) == len(t) and np.sqrt(np.mean(np.square(errors))) < 0.1
    same = {}
    for i, r in got.items():
        assert same.setdefault(t[i], r.fingerprint) == r.fingerprint
    assert fingerprints.fingerprint_edits(empty).count() == 0
    one = fingerprints.fingerprint_edits(spark.createDataFrame([(None, "a b c d e f g")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_next_document_crosses_ranges(spark):
    rows = [(i * 3, f"t{i}") for i in range(97)]
    d = spark.createDataFrame(rows, "id long, text string").repartition(5)
    got = {r.id: r.next_text for r in fingerprints.with_next(d, "id", ["text"]).collect()}
    order = sorted(dict(rows), reverse=True)
    assert got == {a: dict(rows)[b] for a, b in zip(order, order[1:] + order[:1])}


def test_inverse_without_blas_equals_numpy():
    rng = np.random.default_rng(4)
    for k in (0, 1, 2, 7, 60):
        m = rng.integers(0, 5, (k, k)).astype(float) + 3 * np.eye(k)
        assert np.allclose(packing.inverted(m) @ m, np.eye(k), atol=1e-8)
