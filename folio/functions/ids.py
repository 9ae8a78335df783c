"""ISBN functions: Column -> Column, all built from Spark's own functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the identifier and text rules see it.
SPACE = "\\t\\n\\x0B\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def once(c: Column, f) -> Column:
    """f(c) where c is evaluated once however often f uses it: a lambda's variable is bound, an expression is repeated."""
    return F.transform(F.array(c), f)[0]


def strip_isbn(c: Column) -> Column:
    """Without white space and dashes, upper case."""
    return F.upper(F.regexp_replace(c, rf"[{SPACE}\-‐−―ー]", ""))


def _weighted(c: Column, weights) -> Column:
    return reduce(lambda a, b: a + b, [F.substring(c, i + 1, 1).try_cast("int") * w for i, w in enumerate(weights)])


def check_digit_13(first12: Column) -> Column:
    """The 13th digit for twelve digits, as text."""
    return F.pmod(10 - F.pmod(_weighted(first12, [1, 3] * 6), F.lit(10)), F.lit(10)).cast("string")


def check_digit_10(first9: Column) -> Column:
    """The 10th character for nine digits: 0-9 or X."""
    d = F.pmod(11 - F.pmod(_weighted(first9, range(10, 1, -1)), F.lit(11)), F.lit(11))
    return F.when(d == 10, "X").otherwise(d.cast("string"))


def is_isbn13(c: Column) -> Column:
    right = once(strip_isbn(c), lambda s: F.when(s.rlike("^[0-9]{13}$"), F.substring(s, 13, 1) == check_digit_13(s)).otherwise(False))
    return F.coalesce(right, F.lit(False))


def is_isbn10(c: Column) -> Column:
    right = once(strip_isbn(c), lambda s: F.when(s.rlike("^[0-9]{9}[0-9X]$"), F.substring(s, 10, 1) == check_digit_10(s)).otherwise(False))
    return F.coalesce(right, F.lit(False))


def isbn10_to_13(c: Column) -> Column:
    """The 13-digit form of a valid ten-character code, else null."""
    body = F.concat(F.lit("978"), F.substring(strip_isbn(c), 1, 9))
    return F.when(is_isbn10(c), F.concat(body, check_digit_13(body)))


def to_isbn13(c: Column) -> Column:
    """A valid code's 13-digit form, else null."""
    return F.when(is_isbn13(c), strip_isbn(c)).otherwise(isbn10_to_13(c))


def extract_isbn13(text: Column) -> Column:
    """The first valid ISBN in a text once white space and dashes are gone: 13 digits before 10.

    The stripped text and each code found are bound once (a lambda's variable), then only digits are added up.
    """

    def first(s):
        codes = lambda pattern: F.regexp_extract_all(s, F.lit(pattern), 1)
        long = F.filter(codes("(97[89][0-9]{10})"), lambda c: F.substring(c, 13, 1) == check_digit_13(c))
        short = F.filter(codes("([0-9]{9}[0-9X])"), lambda c: F.substring(c, 10, 1) == check_digit_10(c))
        bodies = F.transform(F.slice(short, 1, 1), lambda c: F.concat(F.lit("978"), F.substring(c, 1, 9)))
        return F.coalesce(F.get(long, F.lit(0)), F.get(F.transform(bodies, lambda b: F.concat(b, check_digit_13(b))), F.lit(0)))

    return once(strip_isbn(text), first)


def is_isbn_barcode(c: Column) -> Column:
    """A 13-digit code of the book range with a right check digit; price codes and other goods are not."""
    return is_isbn13(c) & F.coalesce(strip_isbn(c).rlike("^97[89]"), F.lit(False))


def pick_isbn13(codes: Column) -> Column:
    """Of several read codes, the first that is a book's."""
    return strip_isbn(F.get(F.filter(codes, is_isbn_barcode), F.lit(0)))


def format_isbn13(c: Column) -> Column:
    """Thirteen plain digits (where hyphens go depends on a range table); what isn't 13 digits stays as it is."""
    s = strip_isbn(c)
    return F.when(s.rlike("^[0-9]{13}$"), s).otherwise(c)
