"""Text functions for titles, people and publishers: Column -> Column.

Only Unicode compatibility folding (NFKC) has no counterpart in Spark; `fold` does it with a vectorized UDF that gets
nulls for rows that are plain ASCII. Where a column is known to be stable under NFKC, pass folded=True and the whole
expression stays in Spark.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .ids import SPACE, once

# Characters that count as dashes, as punctuation, as kana, as worth keeping; words that tell roles.
DASHES = "\\-~\u2010-\u2015\u2212\u30fc\u30a0\uff0d\uff5e\u301c"
PUNCTUATION = SPACE + "!-/:-@\\[-`{-~\u3001-\u303f\u30fb\u30a0\uff01-\uff20\uff3b-\uff40\uff5b-\uff65\u2018\u2019\u201c\u201d"
KANA_SHIFT, KATAKANA, HIRAGANA = 0x60, (0x30A1, 0x30F6), (0x3041, 0x3096)
JAPANESE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff"
KEPT = (
    JAPANESE + "\uff21-\uff3a\uff41-\uff5a\uff10-\uff19A-Za-z0-9\u30fc\uff0d\u30fb\u3001\u3002\u300c\u300d\u300e\u300f\uff08\uff09()"
    "\u3008\u3009\u300a\u300b\u3010\u3011\u301c~:\uff1a.,&\uff06'\u2019!?\uff01\uff1f/+#\\-" + SPACE
)
PUBLISHER_WORDS = "出版|書店|書房|新聞社|刊行会|大学出版|文庫|新書|選書|叢書|株式会社|[社舎堂閣]$|press|publish|books?$"
ROLE_TAIL = f"[／/]?[{SPACE}]*(?:著|編著|編|訳|監修|共著)[{SPACE}]*$"
PARTICLES = "[はがをにへとでもやのかなるれたい]{2}"
JAPANESE_NAME = f"^[\u3400-\u4dbf\u4e00-\u9fff\u30a0-\u30ff・{SPACE}]+$"
LATIN_NAME = f"^(?:[A-Z][a-z.'-]+[{SPACE}]+){{1,2}}[A-Z][a-z.'-]+$"
MOST_PUBLISHER_CHARS, NAME_CHARS = 16, (2, 12)
VOLUME_TAILS = (
    f"[{SPACE}]*[（(]?(?:第)?[{SPACE}]*([0-9０-９一二三四五六七八九十百]+)[{SPACE}]*(?:巻|集|部|冊)[)）]?$",
    f"[{SPACE}]+([上中下前後続新旧])$",
    f"(?i)[{SPACE}]*(?:vol\\.?|no\\.?)[{SPACE}]*([0-9０-９]+)$",
)
SUBTITLE = f"^(.+?)[{SPACE}]*[:：\\-—―~〜][{SPACE}]*(.+)$"


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def _beyond_ascii(c: Column) -> Column:
    return c.rlike("[^\\x00-\\x7f]")


def fold(c: Column) -> Column:
    return F.coalesce(_nfkc(F.when(_beyond_ascii(c), c)), c)


def katakana_to_hiragana(c: Column) -> Column:
    lo, hi = KATAKANA
    return F.translate(c, "".join(map(chr, range(lo, hi + 1))), "".join(chr(x - KANA_SHIFT) for x in range(lo, hi + 1)))


def hiragana_to_katakana(c: Column) -> Column:
    lo, hi = HIRAGANA
    return F.translate(c, "".join(map(chr, range(lo, hi + 1))), "".join(chr(x + KANA_SHIFT) for x in range(lo, hi + 1)))


def match_key(c: Column, folded: bool = False) -> Column:
    """What two spellings of a name or title share: for comparing, not for display. Null counts as empty."""
    c = F.coalesce(c, F.lit(""))
    s = F.lower(c if folded else fold(c))
    if folded:  # in ASCII all dashes are punctuation, and there is no kana
        return once(s, lambda x: F.regexp_replace(F.when(_beyond_ascii(x), katakana_to_hiragana(F.regexp_replace(x, f"[{DASHES}]", ""))).otherwise(x), f"[{PUNCTUATION}]", ""))
    s = F.regexp_replace(s, f"[{DASHES}]", "")
    s = katakana_to_hiragana(s)
    s = F.regexp_replace(s, f"[{PUNCTUATION}]", "")
    return F.coalesce(_nfc(F.when(_beyond_ascii(s), s)), s)


def tidy(c: Column) -> Column:
    """White space collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{SPACE}]+", " "))


def split_title(c: Column) -> Column:
    """struct(main, sub, volume): a volume mark at the end is cut first, then a subtitle of two characters or more."""
    t = tidy(c)
    main, volume = t, F.lit(None).cast("string")
    for p in reversed(VOLUME_TAILS):
        hit = t.rlike(p)
        main = F.when(hit, F.trim(F.regexp_replace(t, p, ""))).otherwise(main)
        volume = F.when(hit, F.regexp_extract(t, p, 1)).otherwise(volume)
    head, tail = F.regexp_extract(main, SUBTITLE, 1), F.regexp_extract(main, SUBTITLE, 2)
    cut = (F.length(head) >= 2) & (F.length(tail) >= 2)
    return F.struct(
        F.when(cut, F.trim(head)).otherwise(main).alias("main"), F.when(cut, F.trim(tail)).alias("sub"), volume.alias("volume")
    )


def author_key(c: Column, folded: bool = False) -> Column:
    return match_key(F.regexp_replace(c, "[,，、]", ""), folded)


def has_japanese(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[{JAPANESE}]"), F.lit(False))


def clean_line(c: Column, folded: bool = False) -> Column:
    """A recognised line without stray signs; Japanese lines lose white space next to anything beyond ASCII."""
    s = tidy(F.regexp_replace(c if folded else fold(c), f"[^{KEPT}]", " "))
    s = F.regexp_replace(s, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", "")
    joined = F.regexp_replace(s, f"[{SPACE}]+(?=[^\\x20-\\x7e])|(?<=[^\\x20-\\x7e])[{SPACE}]+", "")
    return F.when(has_japanese(s), joined).otherwise(s)


def looks_like_publisher(c: Column) -> Column:
    short = lambda t: (t != "") & (F.length(t) <= MOST_PUBLISHER_CHARS) & t.rlike(f"(?i)(?:{PUBLISHER_WORDS})")
    return F.coalesce(once(tidy(c), short), F.lit(False))


def looks_like_author(c: Column) -> Column:
    t = tidy(c)
    japanese = F.length(t).between(*NAME_CHARS) & ~t.rlike(PARTICLES) & t.rlike(JAPANESE_NAME)
    return F.coalesce(F.when(t == "", False).when(t.rlike(ROLE_TAIL), True).when(has_japanese(t), japanese).otherwise(t.rlike(LATIN_NAME)), F.lit(False))


def strip_author_role(c: Column) -> Column:
    return tidy(F.regexp_replace(c, ROLE_TAIL, ""))


def language_route(c: Column) -> Column:
    """Which catalogue is asked first."""
    return F.when(has_japanese(c), "ndl").otherwise("googleBooks")
