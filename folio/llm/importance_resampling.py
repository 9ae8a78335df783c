"""Target-distribution importance resampling over hashed n-grams, counted and scored in partition-local word tries.

Features are runs of one to three words; a feature's bucket is the CRC-32 of its text modulo a number of buckets.
1. Every partition builds word tries. A node is a run of words; it holds how often the run occurs and the state of the
   CRC, which its children carry on by their word alone. Counts go to bucket totals, and totals are merged.
2. A bucket's gain compares its share of the target with its share of all documents. The gains, one number per bucket,
   travel with the task.
3. Documents are scored by walking their trie paths, where every node has its bucket's gain attached.
4. Documents with enough words are drawn by weight plus Gumbel noise, exactly the highest scores. The order is made by
   ranges, so no task sees all rows.

A partition's documents enter tries of bounded size, one after the other: a trie is emptied into the bucket totals when
its block of text ends, so memory doesn't grow with a partition, and sums over tries are exact.
"""

from __future__ import annotations

import math
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, shuffle_partitions

LONGEST = 3
#: Bytes of text that enter one trie (a longer document has one of its own).
_BLOCK = 4 << 20
_SEPARATORS = bytes(b for b in range(128) if not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or 0x41 <= b <= 0x5A))
#: A-Z to lower case, what separates words to a space.
_FOLD = bytes.maketrans(_SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(_SEPARATORS) + bytes(range(0x61, 0x7B)))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters a-z and bytes from 0x80 on, after A-Z became lower case."""
    return text.translate(_FOLD).split()


class Crc32:
    """Carries CRC states on over words: state of `a b` from that of `a`, the CRC of ` b` and its length."""

    def __init__(self):
        byte = np.arange(256, dtype=np.uint32)
        one = byte.copy()
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
        self.step = one
        # powers[j]: the linear map of 2^j zero bytes, as tables over the four bytes of a state
        self.powers = [np.stack([self._zero(byte << np.uint32(8 * k)) for k in range(4)])]

    def _zero(self, state: np.ndarray) -> np.ndarray:
        return (state >> np.uint32(8)) ^ self.step[state & np.uint32(255)]

    @staticmethod
    def _apply(table: np.ndarray, state: np.ndarray) -> np.ndarray:
        return table[0][state & 255] ^ table[1][state >> 8 & 255] ^ table[2][state >> 16 & 255] ^ table[3][state >> 24]

    def carried(self, state: np.ndarray, tail: np.ndarray, length: np.ndarray) -> np.ndarray:
        state = state.copy()
        for j in range(int(length.max(initial=0)).bit_length()):
            if j == len(self.powers):
                last = self.powers[-1]
                self.powers.append(np.stack([self._apply(last, t) for t in last]))
            at = np.flatnonzero(length >> j & 1)
            state[at] = self._apply(self.powers[j], state[at])
        return state ^ tail


class Vocabulary(dict):
    """word -> number, with the CRC of the word, that of a space and the word, and the length of the latter."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit, self.own, self.tail, self.length = limit, array("I"), array("I"), array("q")

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self.own)
        self.own.append(zlib.crc32(word))
        self.tail.append(zlib.crc32(b" " + word))
        self.length.append(len(word) + 1)
        return n

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """Of one block's words; emptied between blocks where it has grown beyond its limit."""
        if len(self.own) > self.limit:
            self.clear()
            self.own, self.tail, self.length = array("I"), array("I"), array("q")
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


class Trie:
    """The trie of one block: per level the CRC states of its nodes, and at each word the node of the run that starts there.

    word: number of each word of the block, document after document; sizes: words per document.
    """

    def __init__(self, word: np.ndarray, sizes: np.ndarray, vocabulary: Vocabulary, crc: Crc32):
        own, tail, length = (np.array(x) for x in (vocabulary.own, vocabulary.tail, vocabulary.length))
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))  # words from here to the document's end
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (places, node at each place, states of the nodes)
        node, at = pd.factorize(word)
        state = own[at]
        places = np.arange(len(word))
        self.levels.append((places, node, state))
        for depth in range(1, LONGEST):
            on = left[places] > depth
            places, parent = places[on], node[on]
            step = word[places + depth]
            node, path = pd.factorize(parent << 32 | step)  # a child is its parent and the next word
            parent, step = path >> 32, path & 0xFFFFFFFF
            state = crc.carried(state[parent], tail[step], length[step])
            self.levels.append((places, node, state))

    def bucket_counts(self, buckets: int) -> np.ndarray:
        total = np.zeros(buckets, np.int64)
        for _, node, state in self.levels:
            counts = np.bincount(node, minlength=len(state))
            total += np.bincount(state % np.uint32(buckets), weights=counts, minlength=buckets).astype(np.int64)
        return total

    def walk(self, gains: np.ndarray, words: int) -> np.ndarray:
        """Gains of the up to three nodes on the path from each word."""
        sums = np.zeros(words, np.int64)
        for places, node, state in self.levels:
            sums[places] += gains[state % np.uint32(len(gains))][node]
        return sums


def _blocks(text: pa.Array) -> Iterator[list[bytes]]:
    block, size = [], 0
    for s in text.cast(pa.large_binary()):
        t = s.as_py() or b""
        if block and size + len(t) > _BLOCK:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


def _tries(text: pa.Array, vocabulary: Vocabulary, crc: Crc32) -> Iterator[tuple[Trie, np.ndarray]]:
    for block in _blocks(text):
        words, sizes = [], []
        for t in block:
            own = words_of(t)
            words += own
            sizes.append(len(own))
        sizes = np.array(sizes, np.int64)
        yield Trie(vocabulary.numbers(words), sizes, vocabulary, crc), sizes


def bucket_totals(texts: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """(bucket, features): how many features of all texts fall into each bucket that has some."""

    def count(batches):
        total, vocabulary, crc = np.zeros(buckets, np.int64), Vocabulary(), Crc32()
        for batch in batches:
            for trie, _ in _tries(batch.column(0), vocabulary, crc):
                total += trie.bucket_counts(buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["bucket", "features"])

    local = texts.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket int, features long")
    return local.groupBy("bucket").agg(F.sum("features").alias("features"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, text_col: str = "text", target_col: str = "text") -> np.ndarray:
    """floor(1000 * log of the target's share of each bucket over the documents' share), both with one added per bucket.

    The driver receives at most `buckets` counts from either side.
    """
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for out, table, column in ((s, docs, text_col), (t, target, target_col)):
        for r in bucket_totals(table, column, buckets).collect():
            out[r.bucket] = r.features
    all_s, all_t = float(s.sum()) + buckets, float(t.sum()) + buckets
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s, t)], np.int64)


def _scorer(gains: np.ndarray):
    @F.arrow_udf("words long, features long, weight long")
    def score(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary, crc = Vocabulary(), Crc32()
        for batch in text:
            parts = [np.zeros((3, 0), np.int64)]
            for trie, sizes in _tries(batch, vocabulary, crc):
                ends = np.concatenate([[0], np.cumsum(sizes)])
                sums = np.concatenate([[0], np.cumsum(trie.walk(gains, ends[-1]))])
                features = sum(np.maximum(sizes - k, 0) for k in range(LONGEST))
                parts.append(np.stack([sizes, features, sums[ends[1:]] - sums[ends[:-1]]]))
            yield pa.StructArray.from_arrays([pa.array(x) for x in np.concatenate(parts, axis=1)], ["words", "features", "weight"])

    return score


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = 10_000,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """id_col, n_features, weight, score, rank: one row per input row; rank 1, 2, ... for those drawn, else null.

    weight is the sum of the gains of a text's features (0 without any), score adds Gumbel noise times 1000 by a hash of
    `seed:id`. Of the rows with at least least_words words, floor(percent * rows / 100) are drawn: highest scores first,
    ties to the smaller id, null ids last. A null text has no words; a null id is hashed as an empty one; rows that repeat
    are drawn as rows of their own. An empty table gives an empty result, an empty target gains from added counts
    alone. Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    gains = bucket_gains(docs, target, buckets, text_col, target_col)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = docs.select(F.col(id_col).alias("id"), _scorer(gains)(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("r")).select(
        "id", F.col("r.features").alias("n_features"), F.col("r.weight").alias("weight"), (F.col("r.weight") + noise).cast("long").alias("score"),
        (F.col("r.words") >= least_words).alias("enough"),
    )
    scored = materialize(scored)
    # Ranges of the order, each with its place written down, so that any later read has the same ranges and places.
    order = [F.desc("enough"), F.desc("score"), F.asc_nulls_last("id"), F.asc("weight"), F.asc("tie")]
    ordered = scored.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    serial = F.monotonically_increasing_id()  # partition number and place in it
    placed = materialize(ordered.select("id", "n_features", "weight", "score", "enough", F.shiftright(serial, 33).alias("range"), serial.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")))
    release(scored)
    counts = placed.groupBy("range").agg(F.count("*").alias("rows"), F.count_if("enough").alias("enough")).collect()
    drawn = percent * sum(r.enough for r in counts) // 100
    before, at = {}, 0
    for r in sorted(counts, key=lambda r: r.range):
        before[r.range] = at
        at += r.rows
    starts = spark.createDataFrame(list(before.items()), "range long, before long")  # one row per range
    rank = F.col("before") + F.col("place") + 1
    return placed.join(F.broadcast(starts), "range").select(F.col("id").alias(id_col), "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
