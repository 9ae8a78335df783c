"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Each 5-word shingle is hashed once. The hash's leading bits choose one of 128 bins, and a bin keeps its smallest hash.
An empty bin takes over a filled one that the bin's own random order puts first (optimal densification: the choice
depends on the bin and on which bins are filled, not on the neighbours). The fingerprint holds 4 low-order bits of
every bin (hashed with its number), one hex digit each; the likeness of two fingerprints is the share of equal digits, less what chance gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SHINGLE_WORDS, shuffle_partitions

BIN_BITS = 7
BINS = 1 << BIN_BITS
LOW_BITS = 4


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS)  # signed: the bins are -64 .. 63, in the order of the sorted hashes


def shingle_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def shingles(h):
        n = F.size(h)
        whole = F.array(F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")))
        rolled = F.transform(F.sequence(F.lit(0), n - SHINGLE_WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE_WORDS)]))
        return F.when(n >= SHINGLE_WORDS, rolled).when(n > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), shingles)


def digits_of(text: Column) -> Column:
    """array<int> of one digit per bin; empty for a text without words."""
    low = (1 << LOW_BITS) - 1

    def firsts(s):
        return F.filter(s, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(s, i - 1))))

    def dense(filled):
        def digits(bins):
            def one(j):
                # An empty bin takes the filled one that comes first in j's own random order.
                borrowed = F.array_min(F.transform(filled, lambda x: F.struct(F.xxhash64(_bin(x), j).alias("order"), x.alias("hash"))))["hash"]
                at = F.array_position(bins, j).cast("int")
                value = F.when(at > 0, F.get(filled, at - 1)).otherwise(borrowed)
                # Hashed with the bin's number, so that one value in many bins isn't equal by chance in all of them at once.
                return F.xxhash64(value, j).bitwiseAND(F.lit(low)).cast("int")

            return F.transform(F.sequence(F.lit(-BINS // 2).cast("bigint"), F.lit(BINS // 2 - 1).cast("bigint")), one)

        return F.when(F.size(filled) > 0, _let(F.transform(filled, _bin), digits)).otherwise(F.array().cast("array<int>"))

    return _let(_let(F.sort_array(shingle_hashes(text)), firsts), dense)


def packed(digits: Column) -> Column:
    """The digits as hex text."""
    return F.array_join(F.transform(digits, lambda d: F.lower(F.hex(d.cast("bigint")))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity from two digit arrays, corrected for digits equal by chance; 0 to 1.

    Two texts without words are alike (1), one without words and one with words aren't (0).
    """
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda t, x: t + F.coalesce(x, F.lit(0)))
    chance = 1.0 / (1 << LOW_BITS)
    fair = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (same / float(BINS) - chance) / (1 - chance)))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(fair)


def with_next(docs: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """docs (id_col and columns) with next_<column>: the row of the next smaller id, the largest id's after the last.

    Rows are dealt into ranges of ids; each range also gets the first row of the range below, so one shuffle suffices
    and no task sees more than a range. Ties of ids follow the columns, null ids come last.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    cuts = docs.agg(F.percentile_approx(id_col, [i / n for i in range(1, n)] or [0.5], 10_000).alias("c")).first().c or []
    cuts = sorted({int(c) for c in cuts})
    i = F.col(id_col)
    above = F.size(F.filter(F.array(*[F.lit(c).cast("bigint") for c in cuts]), lambda c: c >= i)) if cuts else F.lit(0)
    bucket = F.when(i.isNull(), len(cuts)).otherwise(above)
    tops = {r.b: r.top for r in docs.groupBy(bucket.alias("b")).agg(F.max(id_col).alias("top")).collect()}
    order = sorted(tops)
    # The first row of a range is also the row after the last of the range before it; the first of all closes the circle.
    guests = None
    for b, before in zip(order, [order[-1:], *([x] for x in order)]):
        hit = i.eqNullSafe(F.lit(tops[b]).cast("bigint"))
        guests = F.when(hit, before[0]) if guests is None else guests.when(hit, before[0])
    guest = guests if guests is not None else F.lit(None).cast("int")
    places = F.array(F.struct(bucket.cast("int").alias("range"), F.lit(0).alias("guest")), F.struct(guest.cast("int").alias("range"), F.lit(1).alias("guest")))
    dealt = docs.select("*", F.explode(F.filter(places, lambda p: p["range"].isNotNull())).alias("p")).select(id_col, *columns, "p.*")
    w = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last(id_col), *columns)
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).filter("guest = 0").drop("range", "guest")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fingerprint (128 hex digits, empty for a text without words), one row per input row."""
    return docs.select(id_col, packed(digits_of(F.coalesce(F.col(text_col), F.lit("")))).alias("fingerprint"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of an edited text and of the next document in falling order of ids.

    Columns: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text
    has its last third replaced by as many characters of the next document's beginning, or all it has. Null texts count
    as empty. Rows that repeat an id are ordered by their text; null ids come last. A single row is its own next. Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = with_next(d.withColumn("digits", digits_of(F.col("text")).cast("array<tinyint>")), "id", ["text", "digits"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    d = d.select("id", n.cast("bigint").alias("n_chars"), edited.alias("edited"), "digits", "next_digits")
    d = d.withColumn("edited_digits", digits_of(F.col("edited")).cast("array<tinyint>"))
    return d.select(
        F.col("id").alias(id_col), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        packed(F.col("digits")).alias("fingerprint"), packed(F.col("edited_digits")).alias("edited_fingerprint"),
        likeness(F.col("digits"), F.col("edited_digits")).alias("near_edited"), likeness(F.col("digits"), F.col("next_digits")).alias("near_next"),
    )
