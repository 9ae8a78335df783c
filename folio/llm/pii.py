"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base rules find e-mail addresses, ip addresses, card and phone numbers. Beside them, generators of high recall propose
overlapping spans: addresses with spelled-out or spaced signs, and groups of digits that look like a
number of one kind, wherever they begin in a longer run (where a base rule takes the run whole and drops it). Boosted trees look at
each proposed span's format and context; they are trained on a bounded sample of the documents themselves, where a
proposal counts as personal data if a base rule found it, and on features that leave out the very mark the base rule
asks for (the plus of a phone number, the @ of an address), so that they carry over to spans that lack it. Per kind, a
threshold on the trees' margin is chosen on held-back proposals so that it makes hardly any false redaction; proposals
above it are added. The trees become one column expression, so scoring stays inside Spark's own operators.

Long texts: every pattern below runs in time linear in the text (a run of characters is entered at its beginning
only, and repeated groups are turned into plain character classes beforehand).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
# Marks inside the working copy of a text, from the private use area; ones already there become OTHER.
DOT, GAP, EDGE, OTHER = "\ue000", "\ue001", "\ue002", "\ue003"
#: One entry per kind: the pattern over the working copy.
BASE = {
    EMAIL: rf"(?:(?<![A-Za-z0-9._%+\-{DOT}{GAP}])|\G)[A-Za-z0-9._%+\-{DOT}{GAP}]++@[A-Za-z0-9\-{GAP}]++{DOT}[A-Za-z0-9\-{DOT}{GAP}]*+",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: rf"[0-9{GAP}]{{14,}}+",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
PROPOSE_ADDRESS = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:@|\(at\)|\[at\]|&#64;) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{2,63}){1,8}"
PROPOSE_NUMBERS = (
    r"(?<![0-9])(?:[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![0-9])[0-9]{13,19}+(?![0-9])",
    r"(?<![0-9])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,7}+(?![0-9])",
    r"(?<![0-9.])[0-9]{1,3}+\.[0-9]{1,3}+\.[0-9]{1,3}+\.[0-9]{1,3}+(?![0-9])",
)
CONTEXT = 24
SPANS = "array<struct<start:int,kind:int,end:int>>"
#: Distinct formats that one task of a fit gets.
FORMATS = 200_000
PATIENCE = dict(trees=12, depth=3, precision=0.95)


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _clean(text: Column) -> Column:
    marks = DOT + GAP + EDGE + OTHER
    has = reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in marks])
    return F.when(has, F.translate(text, marks, OTHER * 4)).otherwise(text)


def _pieces(working: Column, pattern: str) -> Column:
    """The text cut at the matches: odd pieces are the matches, even ones what lies between."""
    return F.split(F.regexp_replace(working, f"({pattern})", f"{EDGE}$1{EDGE}"), EDGE)


def _located(pieces: Column) -> Column:
    """array<struct<start, end, text>> of the matches, in code points; sums of lengths are taken in two levels."""
    step = 256

    def spans(p):
        def place(lengths):
            def firsts(sums):
                chunk_start = F.transform(F.sequence(F.lit(0), F.size(sums)), lambda c: F.when(c > 0, F.aggregate(F.slice(sums, F.lit(1), c), F.lit(0), lambda a, x: a + x)).otherwise(0))

                def one(i):
                    c = F.floor(i / step).cast("int")
                    inside = i - c * step
                    before = F.get(chunk_start, c) + F.when(inside > 0, F.aggregate(F.slice(lengths, c * step + 1, inside), F.lit(0), lambda a, x: a + x)).otherwise(0)
                    return F.struct(before.alias("start"), (before + F.get(lengths, i)).alias("end"), F.get(p, i).alias("text"))

                return F.transform(F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: i % 2 == 1), one)

            sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / step).cast("int")), lambda c: F.aggregate(F.slice(lengths, c * step + 1, F.lit(step)), F.lit(0), lambda a, x: a + x))
            return _let(sums, firsts)

        return F.when(F.size(p) > 1, _let(F.transform(p, F.length), place)).otherwise(_none())

    return _let(pieces, spans)


def _none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,text:string>>")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def total(d):
        n = F.length(d)
        # From the right, every second digit is doubled; a product of two digits counts as their sum.
        each = F.transform(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
            lambda i: F.when((n - i) % 2 == 1, (lambda x: x * 2 - F.when(x > 4, 9).otherwise(0))(F.substring(d, i, F.lit(1)).cast("int"))).otherwise(F.substring(d, i, F.lit(1)).cast("int")),
        )
        return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0

    return _let(digits, total)


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _passes(kind: int, text: Column) -> Column:
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        return text.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    n = F.length(_digits(text))
    if kind == CARD:
        return F.when(n.between(14, 19), _luhn(_digits(text))).otherwise(False)
    return n.between(10, 15)


def _kept(at: Column, kind: int) -> Column:
    ok = F.filter(at, lambda s: _passes(kind, s["text"]))
    return F.transform(ok, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"))).cast(SPANS)


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("bigint")


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end>> of what the base rules find, ordered by start and kind."""
    has_digit = text.rlike("[0-9]")
    clean = _clean(text)
    working = {
        # A dot between two label characters, a single space or hyphen between two digits: one plain character each.
        EMAIL: F.regexp_replace(clean, r"\.(?<=[A-Za-z0-9-]\.)(?=[A-Za-z0-9-])", DOT),
        IP: clean,
        CARD: F.regexp_replace(clean, r"[\x20-](?<=[0-9][\x20-])(?=[0-9])", GAP),
        PHONE: clean,
    }
    might = {EMAIL: F.contains(text, F.lit("@")), IP: has_digit, CARD: has_digit, PHONE: F.contains(text, F.lit("+"))}
    found = []
    for kind in range(4):
        at = F.when(might[kind], _located(_pieces(working[kind], BASE[kind]))).otherwise(_none())
        found.append(_kept(at, kind))
    return F.array_sort(F.concat(*found))


FEATURES = ("length", "digits", "dots", "spaces", "hyphens", "brackets", "groups", "longest", "letter_before", "letter_after", "luhn", "octets", "label_end", "called")


def proposals(text: Column) -> Column:
    """array<struct<start, end, kind, f>> of proposed spans with their features f, in the order of FEATURES."""
    clean = _clean(text)

    def described(spans, address: bool):
        def one(s):
            t = F.rtrim(s["text"]) if address else F.regexp_replace(s["text"], r"[ ().-]+$", "")
            d = _digits(t)
            groups = F.filter(F.split(t, "[^0-9]+"), lambda g: g != "")
            octets = t.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
            before = F.substring(text, F.greatest(F.lit(1), s["start"] - CONTEXT + 1), F.least(s["start"], F.lit(CONTEXT)))
            end = s["start"] + F.length(t)
            after = F.substring(text, end + 1, F.lit(1))
            count = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("double")
            n = F.length(d)
            kind = F.lit(EMAIL) if address else F.when(octets, IP).when(n.between(14, 19) & (F.size(groups) <= 5) & ~F.contains(t, F.lit("(")), CARD).otherwise(PHONE)
            f = F.array(
                F.length(t).cast("double"), n.cast("double"), count("."), count(" "), count("-"), count("()"), F.size(groups).cast("double"),
                F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0)).cast("double"),
                before.rlike(r"[\p{L}_=\"']$").cast("double"), after.rlike(r"[\p{L}_\"'0-9]").cast("double"),
                F.when(n.between(14, 19), _luhn(d)).otherwise(False).cast("double"), octets.cast("double"),
                t.rlike(r"[A-Za-z]{2,}$").cast("double"), before.rlike(r"(?i)\b(?:tel|phone|call|fax|mobile|cell|e-?mail|mail|contact|card|visa|ip|host)\b").cast("double"),
            )
            return F.struct(s["start"].alias("start"), end.alias("end"), kind.alias("kind"), f.alias("f"))

        return F.transform(spans, one)

    addresses = F.when(F.contains(text, F.lit("@")) | text.rlike(r"(?i)[(\[]at[)\]]|&#64;"), described(_located(_pieces(clean, PROPOSE_ADDRESS)), True))
    numbers = [F.when(text.rlike("[0-9]{3}|[0-9][.][0-9]"), described(_located(_pieces(clean, p)), False)) for p in PROPOSE_NUMBERS]
    kind = "array<struct<start:int,end:int,kind:int,f:array<double>>>"
    return F.concat(*[F.coalesce(x, F.array().cast(kind)).cast(kind) for x in (addresses, *numbers)])


def _tree_column(node, f: Column) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    low, high = _tree_column(node.leftChild(), f), _tree_column(node.rightChild(), f)
    return F.when(f[split.featureIndex()] <= float(split.threshold()), low).otherwise(high)


def _telling(text: Column) -> Column:
    """Whether anything can be proposed in a text."""
    return text.rlike("[0-9@]") | text.rlike(r"(?i)[(\[]at[)\]]")


def fit_proposals(docs: DataFrame, text_col: str, trees: int, depth: int, precision: float):
    """(margin of a feature array as a function of columns, threshold by kind), or None where there is nothing to learn.

    Fitted on all proposals of all documents, which the base rules label; those of equal texts count once. Like ones
    become one row with their number as its weight, so what is fitted grows with the distinct formats only.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    text = F.col("text")
    some = docs.select(F.col(text_col).alias("text")).filter(_telling(text))
    spans = some.select(F.xxhash64("text").alias("h"), F.posexplode(proposals(text)).alias("at", "p"), base_spans(text).alias("base"))
    hit = F.exists("base", lambda b: (b["kind"] == F.col("p.kind")) & (b["start"] < F.col("p.end")) & (F.col("p.start") < b["end"]))
    once = spans.select("p.kind", "p.f", hit.cast("double").alias("label"), "h", "at").distinct()
    rows = materialize(once.groupBy("kind", "f", "label", (F.pmod("h", F.lit(3)) > 0).alias("t")).agg(F.count("*").cast("double").alias("n")))
    sizes = {(r.label, r.t): r.n for r in rows.groupBy("label", "t").agg(F.sum("n").alias("n")).collect()}
    if min(sizes.get((y, t), 0) for y in (0.0, 1.0) for t in (True, False)) < 5:
        return None
    formats = rows.filter("t").count()
    # In a fixed order, so that sums round alike in every run.
    train = rows.filter("t").coalesce(1 + formats // FORMATS).sortWithinPartitions("f", "kind", "label").select(array_to_vector(F.col("f")).alias("features"), "label", "n")
    # Where rows outnumber the square of the bins (and 10,000), the trees' split points would come from a sample.
    bins = max(32, math.isqrt(formats) + 1)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=7, maxBins=bins, weightCol="n").fit(train)
    parts = list(zip(model.treeWeights, model._java_obj.trees()))

    def margin(f: Column) -> Column:
        return reduce(lambda a, b: a + b, [_tree_column(tree.rootNode(), f) * float(w) for w, tree in parts])

    held = rows.filter("not t").select("kind", F.round(margin(F.col("f")), 6).alias("m"), "label", "n").groupBy("kind", "m").agg(F.sum(F.col("label") * F.col("n")).alias("hits"), F.sum("n").alias("n")).orderBy("kind", F.desc("m")).collect()
    thresholds: dict[int, float] = {}
    for kind in range(4):
        hits = n = 0
        for r in (r for r in held if r.kind == kind):
            hits, n = hits + r.hits, n + r.n
            # One false redaction is assumed besides those seen, so a few right ones don't suffice.
            if hits / (n + 1) >= precision and r.m > 0:
                thresholds[kind] = float(r.m)
    return margin, thresholds


def find_spans(text: Column, model=None) -> Column:
    """All spans, ordered by start and kind: the base rules' and, with a model, accepted proposals that overlap none."""
    base = base_spans(text)
    if model is None or not model[1]:
        return base
    margin, thresholds = model

    def one_each(more):
        # Of accepted proposals that overlap, the first by start and kind stays.
        return F.filter(more, lambda p, i: (i == 0) | ~F.exists(F.slice(more, F.lit(1), i), lambda q: (q["start"] < p["end"]) & (p["start"] < q["end"])))

    def with_more(b):
        enough = lambda p: reduce(lambda x, y: x | y, [(p["kind"] == k) & (F.round(margin(p["f"]), 6) >= t) for k, t in thresholds.items()])
        more = F.filter(proposals(text), lambda p: enough(p) & ~F.exists(b, lambda s: (s["start"] < p["end"]) & (p["start"] < s["end"])))
        spans = F.transform(more, lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end"))).cast(SPANS)
        return F.array_sort(F.concat(b, _let(F.array_sort(spans), one_each)))

    return _let(base, with_more)


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (overlapping ones as one) replaced by its kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])

    def cover(s):
        # Of overlapping spans, a later one begins where the earlier ones end, or goes if nothing is left of it.
        reach = F.transform(s, lambda x, i: F.when(i > 0, F.array_max(F.transform(F.slice(s, F.lit(1), i), lambda y: y["end"]))).otherwise(0))
        kept = F.filter(F.zip_with(s, reach, lambda x, r: F.struct(F.greatest(x["start"], r).alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), (x["start"] < r).alias("joined"))), lambda x: x["start"] < x["end"])

        def join(k):
            part = F.transform(k, lambda x, i: F.concat(
                F.substring(text, F.when(i > 0, F.get(k, i - 1)["end"]).otherwise(0) + 1, x["start"] - F.when(i > 0, F.get(k, i - 1)["end"]).otherwise(0)),
                F.when(x["joined"], F.lit("")).otherwise(F.get(names, x["kind"])),
            ))
            return F.concat(F.array_join(part, ""), F.substring(text, F.get(k, F.size(k) - 1)["end"] + 1, F.length(text)))

        return F.when(F.size(k := kept) > 0, _let(k, join)).otherwise(text)

    return F.when(F.size(spans) > 0, _let(spans, cover)).otherwise(text)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone (of the base rules' spans), base_sha256, spans (all): one row per input row.

    A null text counts as empty and has no spans; base_sha256 is then the hash of the empty string. Null and repeated
    ids are rows like any other, other columns are ignored. Where there is nothing to learn from, base spans stand alone.
    """
    model = fit_proposals(docs, text_col, **(PATIENCE | fit))
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("id", F.struct(base_spans(F.col("text")).alias("base"), find_spans(F.col("text"), model).alias("all")).alias("s"))
    counts = [_count(F.col("s.base"), k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return d.select(F.col("id").alias(id_col), *counts, F.sha2(spelled(F.col("s.base")).cast("binary"), 256).alias("base_sha256"), spelled(F.col("s.all")).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", **fit) -> DataFrame:
    """docs with the personal data in text_col replaced by its kind, and length_col (if it is there) set anew.

    Null texts stay null; all columns keep their names, types and order.
    """
    model = fit_proposals(docs, text_col, **(PATIENCE | fit))
    text = F.col(text_col)
    new = F.when(_telling(text), _let(find_spans(text, model), lambda s: redacted(text, s))).otherwise(text)
    out = docs.withColumn(text_col, new)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(text.isNull(), F.col(length_col)).otherwise(F.length(text)).cast(docs.schema[length_col].dataType))
    return out
