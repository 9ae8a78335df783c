"""Entity resolution: exact cascade, blocked fuzzy search, evidence, status and field-level merges.

Candidates are kept long (one row per entry and record) until the end; joins are on equal keys only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text
from ..schema import (
    AGREEMENT_DEPTH, AUTHOR_MATCH, AUTO_CONFIRM, CANDIDATE_FLOOR, DIFF_FIELDS, DISAGREEMENT_TITLE, MIN_QUERY_LENGTH, TITLE_EXACT,
)

#: In this order, and a later source is asked only where no earlier one knows the key.
CASCADE = ("openbd", "googleBooks", "ndl")
#: Ties of the score go to googleBooks.
SOURCE_RANK = {"googleBooks": 0, "ndl": 1, "openbd": 2}
EXACT_ISBN, OTHER_ISBN = 1.0, 0.9


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def top_per(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """df with rank: the first k rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def isbn_cascade(mentions: DataFrame, catalog: DataFrame, sources=CASCADE) -> DataFrame:
    """mentions (entry_id, isbn13) with the first source's record that knows the ISBN.

    catalog: source, ordinal, isbn13, title, authors, publisher. Adds source, title, authors, publisher and status:
    confirmed or notFound. One equi-join: the sources' order and the record's own order pick the row.
    """
    rank = F.coalesce(*[F.when(F.col("source") == s, k) for k, s in enumerate(sources)])
    known = first_per(catalog.filter(F.col("source").isin(*sources)).withColumn("__k", rank), ["isbn13"], [F.col("__k"), F.col("ordinal")]).drop("__k", "ordinal")
    out = mentions.join(known, "isbn13", "left")
    return out.withColumn("status", F.when(F.col("source").isNull(), "notFound").otherwise("confirmed"))


def score_isbn(isbn: Column, record_isbn: Column) -> Column:
    return F.when(record_isbn == isbn, EXACT_ISBN).otherwise(OTHER_ISBN)


def merge_isbn(isbn: Column, record_isbn: Column) -> tuple[Column, Column]:
    """(resolved isbn13, its provenance is the barcode): what was read fills in where the record has none."""
    missing = F.coalesce(record_isbn, F.lit("")) == ""
    return F.when(missing, isbn).otherwise(record_isbn), missing


def same_book() -> Column:
    """What records of one book share: the ISBN, else the address, else the key of title and authors."""
    return F.coalesce("isbn13", "sourceUrl", F.concat_ws("|", text.match_key(F.col("title"), True), text.match_key(F.array_join("authors", " "), True)))


def dedupe_records(records: DataFrame, group: list[str], order: list) -> DataFrame:
    """The first record per ISBN, else per address, else per title and authors key."""
    return first_per(records.withColumn("__key", same_book()), [*group, "__key"], order).drop("__key")


def blocked_pairs(queries: DataFrame, q_key: str, records: DataFrame, r_key: str) -> DataFrame:
    """Distinct (q_key, r_key) pairs of keys that share a bigram: every pair that can score CANDIDATE_FLOOR is there.

    Without a common bigram the title similarity is below 0.3 and the score below 0.15. Keys are made distinct first,
    so a name that many rows carry is compared once.
    """
    q = queries.select(q_key).distinct().withColumn("__g", F.explode(F.array_distinct(sim.ngrams(F.col(q_key)))))
    r = records.select(r_key).distinct().withColumn("__g", F.explode(F.array_distinct(sim.ngrams(F.col(r_key)))))
    return q.join(r, "__g").select(q_key, r_key).distinct()


def title_matches(queries: DataFrame, q_key: str, records: DataFrame, r_key: str) -> DataFrame:
    """(q_key, r_key, title_sim) of the distinct keys that may reach the floor."""
    pairs = blocked_pairs(queries, q_key, records, r_key)
    return pairs.withColumn("title_sim", sim.title_similarity(F.col(q_key), F.col(r_key))).filter(F.col("title_sim") >= sim.LOW_TITLE)


def fuzzy_candidates(mentions: DataFrame, records: DataFrame) -> DataFrame:
    """Candidates of score CANDIDATE_FLOOR or more: entry_id, record_id, source, ordinal, title_sim, score.

    mentions: entry_id, q_key (main title key; one row per query of an entry), q_authors (keys), q_publisher (key).
    records: record_id, source, ordinal, r_key, r_authors, r_publisher. An entry's best query counts.
    """
    scored = (
        mentions.join(title_matches(mentions, "q_key", records, "r_key"), "q_key").join(records, "r_key")
        .withColumn("score", F.round(sim.match_score(F.col("title_sim"), sim.author_similarity(F.col("q_authors"), F.col("r_authors")), sim.publisher_bonus(F.col("q_publisher"), F.col("r_publisher"))), 9))
    )
    best = scored.groupBy("entry_id", "record_id", "source", "ordinal").agg(F.max("score").alias("score"), F.max("title_sim").alias("title_sim"))
    return best.filter(F.col("score") >= CANDIDATE_FLOOR)


def by_score(*more) -> list:
    """Falling score; ties by source, then by the record's own order."""
    rank = F.coalesce(*[F.when(F.col("source") == s, k) for s, k in SOURCE_RANK.items()], F.lit(9))
    return [F.desc("score"), rank, F.col("ordinal"), *more]


def status_from_score(score: Column) -> Column:
    return F.when(score.isNull(), "notFound").when(score >= AUTO_CONFIRM, "confirmed").otherwise("needsReview")


def status_from_evidence(query_length: Column, agreement: Column, disagreement: Column, title_exact: Column, author_match: Column, repeated: Column) -> Column:
    """An ordered decision: each piece of evidence outweighs those after it."""
    return (
        F.when(query_length < MIN_QUERY_LENGTH, "needsReview").when(agreement, "confirmed").when(disagreement, "conflict")
        .when(title_exact & author_match, "confirmed").when(title_exact & repeated, "confirmed").otherwise("needsReview")
    )


def evidence(candidates: DataFrame, entries: DataFrame) -> DataFrame:
    """entries with top candidate, evidence and status.

    candidates: entry_id, source, ordinal, score, title_sim, author_sim (null where either side names no author), isbn13,
    r_key. entries: entry_id, query_length, observations, previous_isbn.
    """
    ranked = candidates.withColumn("__r", F.row_number().over(Window.partitionBy("entry_id").orderBy(*by_score())))
    within = Window.partitionBy("entry_id", "source").orderBy(*by_score())
    ranked = ranked.withColumn("__s", F.row_number().over(within))
    first = F.col("__r") == 1
    pick = lambda c, where: F.max(F.when(where, F.col(c)))
    gb, ndl = (F.col("source") == s for s in ("googleBooks", "ndl"))
    listed = lambda s: F.collect_set(F.when(s & (F.col("__s") <= AGREEMENT_DEPTH), F.col("isbn13")))
    tops = ranked.groupBy("entry_id").agg(
        pick("source", first).alias("top_source"), pick("ordinal", first).alias("top_ordinal"), pick("score", first).alias("top_score"), pick("isbn13", first).alias("top_isbn"),
        pick("author_sim", first).alias("top_author_sim"), pick("title_sim", first).alias("top_title_sim"),
        pick("isbn13", gb & (F.col("__s") == 1)).alias("g_isbn"), pick("isbn13", ndl & (F.col("__s") == 1)).alias("n_isbn"),
        pick("r_key", gb & (F.col("__s") == 1)).alias("g_key"), pick("r_key", ndl & (F.col("__s") == 1)).alias("n_key"),
        listed(gb).alias("g_list"), listed(ndl).alias("n_list"),
    )
    d = entries.join(tops, "entry_id", "left")
    no = F.lit(False)
    other = F.when(F.col("top_source") == "ndl", F.col("g_list")).otherwise(F.col("n_list"))
    agreement = F.coalesce(F.col("top_isbn").isNotNull() & F.array_contains(other, F.col("top_isbn")), no)
    apart = (F.col("g_isbn") != F.col("n_isbn")) & (sim.title_similarity(F.col("g_key"), F.col("n_key")) >= DISAGREEMENT_TITLE)
    d = (
        d.withColumn("isbn_agreement", agreement)
        .withColumn("disagreement", ~F.col("isbn_agreement") & F.coalesce(apart, no))
        .withColumn("title_exact", F.coalesce(F.col("top_title_sim") >= TITLE_EXACT, no))
        .withColumn("author_match", F.coalesce(F.col("top_author_sim") >= AUTHOR_MATCH, no))
        .withColumn("repeated", F.coalesce((F.coalesce("observations", F.lit(1)) >= 2) & (F.col("previous_isbn") == F.col("top_isbn")), no))
    )
    status = status_from_evidence(*[F.col(c) for c in ("query_length", "isbn_agreement", "disagreement", "title_exact", "author_match", "repeated")])
    return d.withColumn("status", F.when(F.col("top_source").isNull(), "notFound").otherwise(status)).drop("g_list", "n_list", "g_key", "n_key")


def field_text(c: Column, is_array: bool) -> Column:
    return F.coalesce(F.array_join(c, ", ") if is_array else c.cast("string"), F.lit(""))


def diff_records(a: Column, b: Column) -> Column:
    """array<struct<field, values: array<struct<source, value>>>> of fields that both have and that differ."""
    out = []
    for f in DIFF_FIELDS:
        x, y = field_text(a[f], f == "authors"), field_text(b[f], f == "authors")
        differ = x != y if f == "isbn13" else text.match_key(x, True) != text.match_key(y, True)
        values = F.array(F.struct(a["source"].alias("source"), x.alias("value")), F.struct(b["source"].alias("source"), y.alias("value")))
        out.append(F.when((x != "") & (y != "") & differ, F.struct(F.lit(f).alias("field"), values.alias("values"))))
    return F.array_compact(F.array(*out))


def empty(c: Column, is_array: bool = False) -> Column:
    return c.isNull() | (F.size(c) == 0 if is_array else c == "")


def fill_missing(current: dict[str, Column], incoming: dict[str, Column], source: Column, provenance: Column, arrays=("authors",)) -> tuple[dict[str, Column], Column]:
    """(fields, provenance): what the current record lacks and the incoming one has is taken over and noted."""
    fields, noted = {}, []
    for f, c in current.items():
        n = incoming[f]
        take = empty(c, f in arrays) & n.isNotNull() & (F.lit(True) if f in arrays else n != "")
        fields[f] = F.when(take, n).otherwise(c)
        noted.append(F.when(take, F.struct(F.lit(f).alias("key"), source.alias("value"))))
    extra = F.map_from_entries(F.array_compact(F.array(*noted)))
    return fields, join_maps(provenance, extra)


def join_maps(a: Column, b: Column) -> Column:
    """Union of two maps in which the right one wins."""
    return F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)


def adopt(record: dict[str, Column], source: Column) -> Column:
    """Provenance of a record taken whole: its source for every field that isn't null or empty text."""
    entries = [F.when(c.isNotNull() & (F.lit(True) if f == "authors" else c != ""), F.struct(F.lit(f).alias("key"), source.alias("value"))) for f, c in record.items()]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def enrich(entries: DataFrame, known: DataFrame, fields=("coverUrl", "publisher")) -> DataFrame:
    """Confirmed entries that lack a cover or publisher take what the record of the same ISBN has; adds enriched."""
    k = known.select("isbn13", *[F.col(f).alias(f"__{f}") for f in fields])
    d = entries.join(k, "isbn13", "left")
    lacks = reduce(lambda a, b: a | b, [empty(F.col(f)) for f in fields]) & (F.col("status") == "confirmed")
    gains = reduce(lambda a, b: a | b, [empty(F.col(f)) & ~empty(F.col(f"__{f}")) for f in fields])
    d = d.withColumn("enriched", lacks & gains)
    for f in fields:
        d = d.withColumn(f, F.when(F.col("enriched") & empty(F.col(f)) & ~empty(F.col(f"__{f}")), F.col(f"__{f}")).otherwise(F.col(f)))
    return d.drop(*[f"__{f}" for f in fields])


def relaxed_search(queries: DataFrame, records: DataFrame, limit: int = 10, common: int = 1000) -> DataFrame:
    """The tightest search that finds anything, per query: title and author, title, or any word.

    queries: query_id (unique), title_key, author_key, words (keys of the title's words). records: record_id, title_key,
    author_key, words. A title search wants all of the query's words in the record's title; at most `limit` records are
    returned, in the records' order. Adds step (1 tightest) and rank. Only queries without a hit go on to the broad step,
    which needs no more than the first records of each word, so no word pairs all rows.
    """
    from .search import AUTHOR_MARK, WordIndex

    words = F.array_distinct("words")
    author = F.when(F.col("author_key") != "", F.array(F.concat(F.lit(AUTHOR_MARK), F.col("author_key")))).otherwise(F.array().cast("array<string>"))
    r = records.select(F.lit("").alias("source"), "record_id", F.col("record_id").alias("ordinal"), F.lit("title").alias("field"), words.alias("title_words"), F.array_union(words, author).alias("words"))
    q = queries.withColumn("__w", words).filter(F.size("__w") > 0)
    step = lambda n, w: F.struct(F.lit(n).alias("step"), F.array_sort(w).alias("words"))
    steps = F.array_compact(F.array(F.when(F.size(author) > 0, step(1, F.array_union("__w", author))), step(2, F.col("__w"))))
    asked = q.select("query_id", F.explode(steps).alias("s")).select("query_id", "s.*", F.lit("").alias("source"), F.lit("title").alias("field"))
    tight = asked.join(WordIndex(r, common, limit).find(asked), ["source", "field", "words"])
    tight = tight.withColumn("__m", F.min("step").over(Window.partitionBy("query_id"))).filter("step = __m").select("query_id", "record_id", "step")
    left = q.join(tight.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.explode("__w").alias("word"))
    first = top_per(r.select("record_id", F.explode("title_words").alias("word")), ["word"], [F.col("record_id")], limit).drop("rank")
    broad = left.join(first, "word").select("query_id", "record_id").distinct().withColumn("step", F.lit(3))
    return top_per(tight.unionByName(broad), ["query_id"], [F.col("record_id")], limit)
