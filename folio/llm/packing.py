"""Packing into sequences of at most 2048 tokens as a cutting-stock problem, solved by column generation.

Each document's ids (and the end id) are cut into full sequences and one rest. The rests' lengths, rounded up to units
of 8 ids, make a histogram; a linear program over cutting patterns covers it with as few sequences as possible, where
a knapsack by dynamic programming prices new patterns until none improves. The solution is rounded down, what stays
uncovered is packed best fit on the histogram, and the patterns' places are handed out to the rests by their rank
within their length. The histogram has at most 256 bars, so the program is small however many documents there are.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import count
from string import punctuation

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, trim_memory

CAPACITY = 2048
UNIT = 8
END_ID = 1
#: Characters of texts whose parts are in memory at once (one longer text counts alone).
SPLIT_CHARS = 1_000_000


class WordIds:
    """word -> its ids as little-endian 32-bit bytes, remembered in two generations of at most `limit` words or so.

    Holds for tokenizers that lower-case, drop white space and have no token over a space or line feed (`splits`): a
    text's ids are then those of its parts between them, and each distinct part is encoded once. Words of letters are
    encoded many at a time, told apart by the tokens that end a word; ASCII marks after a word are tokens of
    their own. With any other tokenizer whole texts are encoded.
    """

    def __init__(self, path: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        self.limit, self.tok = limit, Tokenizer.from_file(path)
        self.splits = self._drops_spaces(json.loads(self.tok.to_str()))
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @staticmethod
    def _drops_spaces(made_of: dict) -> bool:
        def kinds(part):
            return [part["type"], *(k for x in part.get("normalizers", part.get("pretokenizers", [])) for k in kinds(x))] if part else []

        added = [t["content"] for t in made_of.get("added_tokens", [])]
        normal, cut = kinds(made_of.get("normalizer")), json.dumps(made_of.get("pre_tokenizer"))
        return (
            "Lowercase" in normal and set(normal) <= {"Sequence", "NFC", "Replace", "Lowercase"} and '"Removed"' in cut
            and made_of["model"].get("end_of_word_suffix") == "</w>" and not any(c.isspace() for t in added for c in t)
        )

    def _one(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, words: list[str], ids: np.ndarray) -> None:
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) != len(words) or cuts[-1] != len(ids):
            self.words.update((w, self._one(w)) for w in words)
            return
        data, at = ids.tobytes(), 0
        for w, end in zip(words, (4 * cuts).tolist()):
            self.words[w] = data[at:end]
            at = end

    def learn(self, words: set[str]) -> None:
        known = self.words
        if len(known) > self.limit:
            self.older, self.words = known, {}
            known = self.words
        new = words.difference(known)
        if self.older:
            kept = self.older.keys() & new
            known.update(zip(kept, map(self.older.__getitem__, kept)))
            new.difference_update(kept)
        plain, marked, rest = set(), {}, []
        for w in new:
            if w.isalpha():
                plain.add(w)
            elif (core := w.rstrip(punctuation)) is not w and core.isalpha():
                marked[w] = core
                if core not in known:
                    plain.add(core)
            else:
                rest.append(w)
        plain = list(plain)
        chunks = [plain[at : at + 2000] for at in range(0, len(plain), 2000)]
        for part, e in zip(chunks, self.tok.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)):
            self._letters(part, np.array(e.ids, "<u4"))
        for w, core in marked.items():
            if (marks := w[len(core) :]) not in known:
                known[marks] = self._one(marks)
            known[w] = known[core] + known[marks]
        for at in range(0, len(rest), 5000):
            part = rest[at : at + 5000]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                known[w] = np.array(e.ids, "<u4").tobytes()

    def all_ids(self, texts: list[str]):
        """The ids of each text, in turn; texts are split some at a time, so that their parts never lie in memory all at once."""
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= SPLIT_CHARS:
                size += len(texts[end])
                end += 1
            if self.splits:
                # Special strings are matched as they are written, and a final sigma is lower-cased by its neighbours.
                parts = [(t if "<|" in t or "\u03a3" in t else t.lower()).replace("\n", " ").split(" ") for t in texts[at:end]]
                self.learn(set().union(*parts))
                for words in parts:
                    yield b"".join(map(self.words.__getitem__, words))
            else:
                for e in self.tok.encode_batch_fast(texts[at:end], add_special_tokens=False):
                    yield np.array(e.ids, "<u4").tobytes()
            at = end


def _pieces(path: str, capacity: int):
    """text -> its pieces; the bounded cache of words lives as long as the task."""

    @F.pandas_udf("array<struct<start: bigint, length: bigint, ids_crc32: bigint, doc_tokens: bigint>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads only wait for each other
        words, end = WordIds(path), np.array([END_ID], "<u4").tobytes()
        for texts in batches:
            out = []
            for ids in words.all_ids(list(texts)):
                ids += end
                n = len(ids) // 4
                rows = []
                for at in range(0, n, capacity):
                    piece = ids[4 * at : 4 * (at + capacity)]
                    rows.append({"start": at, "length": len(piece) // 4, "ids_crc32": zlib.crc32(piece), "doc_tokens": n})
                out.append(rows)
            yield pd.Series(out)
        del words
        trim_memory()

    return cut


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value and how often each size is taken, repeats allowed."""
    best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = values > 1e-12
    v, s, at = values[useful], sizes[useful], np.flatnonzero(useful)
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        fit = s <= c
        if fit.any():
            total = v[fit] + best[c - s[fit]]
            j = int(total.argmax())
            if total[j] > best[c] + 1e-12:
                best[c], took[c] = total[j], at[fit][j]
    out, c = np.zeros(len(values), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            out[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[capacity]), out


def _greedy_basis(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> np.ndarray:
    """One pattern per size, as columns: each fills up by falling size with what is still wanted and is taken until a
    size runs out. A later pattern lacks the sizes that ran out before, so the matrix is triangular but for its order."""
    k, left = len(sizes), demand.astype(float)
    columns, open_sizes = np.zeros((k, k)), list(np.argsort(-sizes))
    for at in range(k):
        pattern, room = np.zeros(k), capacity
        for j in open_sizes:
            pattern[j] = take = min(int(np.ceil(left[j])), room // int(sizes[j]))
            room -= take * int(sizes[j])
        used = np.flatnonzero(pattern)
        out = used[(left[used] / pattern[used]).argmin()]
        left = np.maximum(left - pattern * left[out] / pattern[out], 0)
        left[open_sizes] = np.maximum(left[open_sizes], 1e-9)
        columns[:, at] = pattern
        open_sizes.remove(out)
    return columns


def _times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """The product without BLAS: its threads may stand still in a process that has forked, as every driver has."""
    return np.einsum("ij,j->i", matrix, vector)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with partial pivoting, one row operation for all columns at a time (no BLAS)."""
    k = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(k)])
    for j in range(k):
        p = j + int(np.abs(both[j:, j]).argmax())
        both[[j, p]] = both[[p, j]]
        both[j] /= both[j, j]
        factor = both[:, j].copy()
        factor[j] = 0.0
        rows = np.flatnonzero(factor)
        both[rows] -= factor[rows, None] * both[j]
    return both[:, k:]


def cutting_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 2e-4) -> list[tuple[np.ndarray, int]]:
    """(pattern, times): patterns of at most `capacity` that cover the demand of each size exactly.

    A revised simplex whose columns are priced by the knapsack, starting from one pattern per size, greedily chosen. The
    optimum is at least the total size over the capacity, and at least the present value divided by the worth of the
    best pattern under the present duals; the search ends when a bound proves it to be within `gap` of the optimum. Demands are told apart by less than the rounding
    looks at, so that no step is without progress and none returns to a former basis.
    """
    k = len(sizes)
    wanted = demand + 1e-7 * (1 + np.arange(k)) / max(k, 1)
    columns = _greedy_basis(sizes, wanted, capacity)
    inverse = inverted(columns)
    x = _times(inverse, wanted)
    least = float((sizes * wanted).sum()) / capacity
    for round_no in count() if k else ():
        duals = inverse.sum(axis=0)
        if x.sum() <= least * (1 + gap):
            break
        value, pattern = knapsack(duals, sizes, capacity)
        least = max(least, x.sum() / value)
        if value <= 1 + 1e-9:
            break
        step = _times(inverse, pattern.astype(float))
        up = step > 1e-9
        ratios = np.where(up, x / np.where(up, step, 1), np.inf)
        out = int(ratios.argmin())
        x = x - ratios[out] * step
        x[out] = ratios[out]
        x = np.maximum(x, 0)
        columns[:, out] = pattern
        inverse[out] /= step[out]
        others = np.arange(k) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        if round_no % 200 == 199:
            inverse = inverted(columns)
            x = np.maximum(_times(inverse, wanted), 0)
    plan = [(columns[:, j].astype(np.int64), int(x[j] + 1e-6)) for j in range(k) if x[j] + 1e-6 >= 1]
    left = demand - sum((p * n for p, n in plan), np.zeros(k, np.int64))
    # Rounding down can leave a few of each size over, or (patterns cover at least the demand) take a few too many.
    fixed = []
    for p, n in plan:
        while (left < 0).any() and n and (p * (left < 0)).any():
            left, n = left + p, n - 1
        fixed.append((p, n))
    plan = [(p, n) for p, n in fixed if n]
    while left.sum() > 0:
        pattern, room = np.zeros(k, np.int64), capacity
        for j in np.argsort(-sizes):
            take = min(int(left[j]), room // int(sizes[j]))
            pattern[j], room = take, room - take * int(sizes[j])
        times = max(1, int(min(left[j] // pattern[j] for j in np.flatnonzero(pattern))))
        plan.append((pattern, times))
        left = left - pattern * times
    return plan


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text counts as empty; an empty document is its end id alone. Rows with a null or repeated id are documents
    of their own. Sequence ids run from 0 without gaps, offsets are gapless in each sequence. `tokenizer` is the path of
    a tokenizer file that every executor has. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    unit = max(1, capacity // (CAPACITY // UNIT))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = materialize(texts.select("id", F.inline(_pieces(tokenizer, capacity)("text"))))
    # The written table's partitions are fixed, so ranks by partition are the same in every retry.
    placed = pieces.withColumn("size", F.ceil(F.col("length") / unit).cast("int")).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    counts = placed.groupBy("size", "part").agg(F.count("*").alias("n"))
    bars = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    full = capacity // unit
    sizes = np.array(sorted(s for s in bars if s < full), np.int64)
    plan = cutting_patterns(sizes, np.array([bars[s] for s in sizes], np.int64), full) if len(sizes) else []
    # Places: ranks [first, first + times * each) of a size go to sequences base, base + 1, ..., `each` to a sequence.
    places, used, base = [], {int(s): 0 for s in sizes}, 0
    for pattern, times in plan:
        for j in np.flatnonzero(pattern):
            s, each = int(sizes[j]), int(pattern[j])
            places.append((s, used[s], used[s] + times * each, each, base))
            used[s] += times * each
        base += times
    if full in bars:
        places.append((full, 0, int(bars[full]), 1, base))
    places = spark.createDataFrame(places or [], "size int, first long, last long, each long, base long")

    before = counts.select("size", "part", (F.sum("n").over(_by("size", "part")) - F.col("n")).alias("before"))
    ranked = placed.withColumn("r", F.row_number().over(_by(["size", "part"], "at")) - 1).join(before, ["size", "part"]).withColumn("rank", F.col("r") + F.col("before"))
    found = ranked.join(F.broadcast(places), "size").filter("rank >= first and rank < last").withColumn("sequence_id", F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("each")))
    offset = F.sum("length").over(_by("sequence_id", ["size", "rank"])) - F.col("length")
    return found.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def _by(keys, order):
    from pyspark.sql import Window

    keys, order = ([x] if isinstance(x, str) else x for x in (keys, order))
    return Window.partitionBy(*keys).orderBy(*[F.desc(c) if c == "size" else F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
