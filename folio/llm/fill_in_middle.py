"""Fill-in-middle transformation by a table-driven byte automaton.

A text is a row of units, `[A-Za-z]+|[^A-Za-z]` over code points. One scan of the UTF-8 bytes through a transition table
handles continuation bytes, unit boundaries and sentinel recognition together: each transition emits two counts, units
begun and code points begun, and whether a sentinel ended. A second pass over the counts locates the cuts. What a byte
does depends on the three bytes before it at most, so the bytes of many documents are scanned side by side in equal
lanes, each lane warmed up on the end of the one before. Only four numbers per document return from Python; texts are
cut and put together by Spark's own functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTINELS = ("<P>", "<S>", "<M>")
PREFIX, SUFFIX, MIDDLE = SENTINELS

#: Between documents; no UTF-8 text holds this byte.
_BREAK = 0xFF
#: Bytes scanned at once, and the lanes they are dealt to.
_BLOCK, _LANES = 4 << 20, 2048

# What a transition emits, beside the state it leads to.
_UNIT, _POINT, _FOUND = 8, 16, 32
_STATE = 7
# States: after a break or a byte outside letters, in a run of letters, after `<`, after `<` and a sentinel's letter.
_OUTSIDE, _LETTERS, _OPEN, _NAMED = range(4)
_WARM_UP = 3


def _transitions() -> np.ndarray:
    """table[state * 256 + byte]: next state and what is emitted."""
    names = {ord(s[1]) for s in SENTINELS}
    table = np.zeros((4, 256), np.uint8)
    for state in range(4):
        for byte in range(256):
            if byte == _BREAK:
                to = _OUTSIDE
            elif 0x80 <= byte <= 0xBF:  # goes on with a code point that has begun; no letter has one
                to = _OUTSIDE
            elif chr(byte).isascii() and chr(byte).isalpha():
                begins = 0 if state in (_LETTERS, _NAMED) else _UNIT
                to = (_NAMED if state == _OPEN and byte in names else _LETTERS) | begins | _POINT
            else:
                to = (_OPEN if byte == ord("<") else _OUTSIDE) | _UNIT | _POINT
                if state == _NAMED and byte == ord(">"):
                    to |= _FOUND
            table[state, byte] = to
    return table.reshape(-1)


_TABLE = _transitions()


def scan(data: np.ndarray) -> np.ndarray:
    """What each byte's transition emits, for bytes in which a break stands before each document."""
    length = max(1, -(-len(data) // _LANES))
    lanes = -(-len(data) // length)
    rows = np.full(lanes * length, _BREAK, np.uint8)
    rows[: len(data)] = data
    rows = np.ascontiguousarray(rows.reshape(lanes, length).T)  # one row per step of all lanes
    emitted = np.empty_like(rows)
    before = np.full((_WARM_UP, lanes), _BREAK, np.uint8)
    flat = np.concatenate([np.full(_WARM_UP, _BREAK, np.uint8), data])
    starts = np.arange(lanes) * length
    for k in range(_WARM_UP):
        before[k] = flat[starts + k]
    state = np.zeros(lanes, np.uint8)
    index = np.empty(lanes, np.int32)

    def step(byte: np.ndarray, out: np.ndarray) -> None:
        np.multiply(state, 256, out=index, dtype=np.int32)
        np.add(index, byte, out=index)
        np.take(_TABLE, index, out=out, mode="clip")
        np.bitwise_and(out, _STATE, out=state)

    scrap = np.empty(lanes, np.uint8)
    for k in range(_WARM_UP):
        step(before[k], scrap)
    for k in range(length):
        step(rows[k], emitted[k])
    return emitted.T.reshape(-1)[: len(data)]


def _cuts(data: np.ndarray, ends: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> dict[str, np.ndarray]:
    """For documents laid end to end (ends: bytes before each and all bytes): units, whether a sentinel occurs, and the
    code points before either cut."""
    n_docs = len(ends) - 1
    heads = ends[:-1] + np.arange(n_docs)  # of the breaks
    text = np.ones(len(data) + n_docs, bool)
    text[heads] = False
    broken = np.full(len(text), _BREAK, np.uint8)
    broken[text] = data
    emitted = scan(broken)
    found = np.concatenate([[0], np.cumsum(emitted & _FOUND > 0)])
    units = np.flatnonzero(emitted & _UNIT)  # places where units begin
    points = np.concatenate([[0], np.cumsum(emitted & _POINT > 0)])
    tails = np.append(heads[1:], len(broken))
    first = np.searchsorted(units, heads)
    n = np.searchsorted(units, tails) - first
    a, b = h1 % (n + 1), h2 % (n + 1)
    units = np.append(units, len(broken))
    out = {"n": n, "marked": found[tails] > found[heads]}
    for name, k in (("lower", np.minimum(a, b)), ("upper", np.maximum(a, b))):
        place = np.where(k < n, units[np.minimum(first + k, len(units) - 1)], tails)
        out[name] = points[place] - points[heads]
    return out


@F.arrow_udf(T.StructType([T.StructField("n", T.LongType()), T.StructField("marked", T.BooleanType()), T.StructField("lower", T.LongType()), T.StructField("upper", T.LongType())]))
def _locate(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """Documents in blocks of bounded bytes (one longer than that is a block of its own)."""
    text = text.cast(pa.large_string())
    _, places, content = text.buffers()
    offsets = np.frombuffer(places, np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(content, np.uint8) if content else np.empty(0, np.uint8)
    h1, h2 = (h.to_numpy(zero_copy_only=False).astype(np.int64) for h in (h1, h2))
    parts, at = [], 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _BLOCK, side="right")) - 1)
        parts.append(_cuts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], h1[at:to], h2[at:to]))
        at = to
    names = ("n", "marked", "lower", "upper")
    columns = [np.concatenate([p[c] for p in parts]) if parts else np.empty(0, bool if c == "marked" else np.int64) for c in names]
    return pa.StructArray.from_arrays([pa.array(c) for c in columns], names)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Each sentinel stands in it once: texts that hold one stay plain."""
    head = lambda s, mark: F.substring_index(s, mark, 1)
    tail = lambda s, mark: F.substring_index(s, mark, -1)
    first = lambda mark: F.substr(head(output, mark), F.lit(len(mark) + 1))  # noqa: E731  what stands after the leading sentinel
    psm = F.concat(first(SUFFIX), tail(output, MIDDLE), head(tail(output, SUFFIX), MIDDLE))
    spm = F.concat(head(tail(output, PREFIX), MIDDLE), tail(output, MIDDLE), first(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(
    docs: DataFrame, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id_col, n, form, prefix_chars, middle_chars, output: one row per input row.

    Draws are the first four 8-digit groups of the hex SHA-256 of `seed:id`. The prefix ends after the smaller, the
    middle after the larger of the first two groups modulo n + 1. The form is `plain` for an empty text, one that holds
    a sentinel, and in plain_percent of 100 cases by the third group; else `spm` in spm_percent of 100 by the fourth;
    else `psm`. A null text is empty; a null id is drawn as an empty one; rows that repeat get the same result each.
    An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    group = lambda k: F.conv(F.substring(F.col("__digest"), 8 * k + 1, 8), 16, 10).cast("long")
    drawn = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"), digest.alias("__digest"))
    cut = drawn.select("__id", "__text", group(2).alias("__h3"), group(3).alias("__h4"), _locate("__text", group(0), group(1)).alias("__c"))
    plain = (F.col("__text") == "") | F.col("__c.marked") | (F.col("__h3") % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(F.col("__h4") % 100 < spm_percent, "spm").otherwise("psm")
    lower, upper = F.col("__c.lower").cast("int"), F.col("__c.upper").cast("int")
    prefix = F.substr(F.col("__text"), F.lit(1), lower)
    middle = F.substr(F.col("__text"), lower + 1, upper - lower)
    suffix = F.substr(F.col("__text"), upper + 1)
    made = cut.withColumn("__form", form)
    is_plain = F.col("__form") == "plain"
    output = (
        F.when(is_plain, F.col("__text"))
        .when(F.col("__form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    return made.select(
        F.col("__id").alias(id_col), F.col("__c.n").alias("n"), F.col("__form").alias("form"),
        F.when(~is_plain, F.col("__c.lower")).alias("prefix_chars"),
        F.when(~is_plain, F.col("__c.upper") - F.col("__c.lower")).alias("middle_chars"),
        output.alias("output"),
    )
