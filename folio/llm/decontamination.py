"""Benchmark decontamination: a BM25 inverted index of test items, queried with every training passage.

Passages are overlapping windows, wide enough that any run of words as long as the longest item lies in one. An item is
retrieved where its BM25 score for the passage reaches a share of what the item scores for itself, so the threshold
means the same for short and long items, and all items above it are retrieved, not the k best. Evaluation skips by
block-max WAND: items lie in blocks with each term's largest impact; a passage's terms are taken by falling bound up to
the pivot, and those beyond it open no block; blocks whose bound stays below the threshold are left out, and only what
passes is scored in full. Retrieved pairs are verified by the overlap of word 5-grams with the item's question and answer,
or with the whole item where that overlap is high.

The index is built on the driver from at most index_bytes of items at a time; more items are taken in several blocks,
each against all documents.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

K1, B = 1.2, 0.75
ITEMS_PER_BLOCK = 16
NGRAM = 5
#: An item is found too where this share of its 5-grams is there, whatever is missing (an answer of one changed word).
WHOLE = 0.8
#: A threshold, in shares of it, less what rounding may take.
REACHED = 1 - 1e-9
_HIT = "array<struct<item_id: bigint, score: double, question_overlap: double, answer_overlap: double>>"


#: A-Z to a-z, other ASCII signs to spaces; bytes beyond ASCII stay.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text: runs of letters and digits, A-Z lower-cased."""
    return text.translate(_PLAIN).split()


def parts_of(text: str) -> tuple[list[str], list[str]]:
    """(question, answer) words: the answer is the last line, or else the last sentence; a lone sentence is both."""
    words = lambda t: [w.decode("utf-8", "replace") for w in words_of(t.encode("utf-8", "replace"))]
    for mark in ("\n", ". ", "? ", "! "):
        head, found, tail = text.strip().rpartition(mark)
        if found and words(head) and words(tail):
            return words(head), words(tail)
    return words(text), words(text)


def _item_rows(batches):
    for pdf in batches:
        rows = []
        for i, text in zip(pdf["item_id"], pdf["text"]):
            q, a = parts_of(text)
            words = q if q == a else q + a
            if words:
                rows.append((i, q, a, len(words), sorted(set(words))))
        yield pd.DataFrame(rows, columns=["item_id", "question", "answer", "n", "terms"])


class TermIds:
    """The ids of a text's words in the vocabulary, -1 for other words."""

    def __init__(self, vocabulary: dict[str, int]):
        self.find = {t.encode("utf-8"): k for t, k in vocabulary.items()}.get

    def of(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.find, words, repeat(-1)), np.int64, len(words))


@dataclass
class Bm25Index:
    vocabulary: dict[str, int]
    item_ids: np.ndarray
    window: int
    threshold: np.ndarray  # by item
    term_blocks: tuple  # ptr by term, block, largest share
    cells: tuple  # ptr by (term, block) entry, item, share
    largest: np.ndarray  # by term: the largest share in any item
    impacts: tuple  # ptr by item, term, impact: all terms of each item
    parts: list  # by item: (question ngrams, answer ngrams), each of (n, set)
    n_blocks: int

    def retrieve(self, ids: np.ndarray) -> list[tuple[int, int, float]]:
        """(item, first word of the passage, score) of all passages and items that reach the item's threshold.

        Only an item's essential terms are listed, those without which it can't reach its threshold; impacts are shares
        of what the other terms leave of the threshold at least. In each passage the terms are taken in the order of their largest
        share; from the pivot on, where what is left can't add up to a threshold any more, terms open no block. The blocks
        that the terms before it open are bounded by all terms of the passage, and only items in blocks whose bound
        reaches the threshold are added up.
        """
        ptr, blocks, most = self.term_blocks
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            return []
        stride, n_blocks, n_terms = self.window // 2, self.n_blocks, len(self.largest)
        # Each word lies in the passage that begins at its stride and in the one before.
        passage, words = at // stride, ids[at]
        later = passage > 0
        pairs = np.unique(np.concatenate([passage * n_terms + words, (passage[later] - 1) * n_terms + words[later]]))
        passage, term = pairs // n_terms, pairs % n_terms
        share = self.largest[term]
        enough = np.bincount(passage, share) >= REACHED
        keep = enough[passage]
        if not keep.any():
            return []
        passage, term, share = passage[keep], term[keep], share[keep]
        order = np.lexsort((-share, passage))
        passage, term, share = passage[order], term[order], share[order]
        # What the terms from here on add up to in their passage.
        left = np.cumsum(share[::-1])[::-1]
        ends = np.append(np.flatnonzero(np.diff(passage)) + 1, len(passage))
        beyond = np.append(left, 0.0)[ends]
        left = left - np.repeat(beyond, np.diff(np.concatenate([[0], ends])))
        n_passages = int(passage[-1]) + 1
        count = ptr[term + 1] - ptr[term]
        entry = _ranges(ptr[term], count)
        where = np.repeat(passage, count) * n_blocks + blocks[entry]
        opened = np.zeros(n_passages * n_blocks, bool)
        opened[where[np.repeat(left >= REACHED, count)]] = True
        live = opened & (np.bincount(where, most[entry], n_passages * n_blocks) >= REACHED)
        if not live.any():
            return []
        on = live[where]
        entry, where = entry[on], where[on]
        cell, item, impact = self.cells
        count = cell[entry + 1] - cell[entry]
        post = _ranges(cell[entry], count)
        number = np.cumsum(live) - 1
        key = np.repeat(number[where], count) * ITEMS_PER_BLOCK + item[post] % ITEMS_PER_BLOCK
        bound = np.bincount(key, impact[post])
        found = np.flatnonzero(bound >= REACHED)
        if not len(found):
            return []
        # Their scores in full: which of an item's terms the passage has.
        passage, block = np.divmod(np.flatnonzero(live)[found // ITEMS_PER_BLOCK], n_blocks)
        item = block * ITEMS_PER_BLOCK + found % ITEMS_PER_BLOCK
        ptr, term, impact = self.impacts
        count = ptr[item + 1] - ptr[item]
        own = _ranges(ptr[item], count)
        key = np.repeat(passage, count) * n_terms + term[own]
        there = pairs[np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)] == key
        score = np.bincount(np.repeat(np.arange(len(item)), count), impact[own] * there)
        ok = score >= self.threshold[item] - 1e-9
        return list(zip(item[ok].tolist(), (passage[ok] * stride).tolist(), score[ok].tolist()))

    def verified(self, ids: np.ndarray, overlap: float) -> list[dict]:
        best: dict[int, tuple] = {}
        for i, start, score in self.retrieve(ids):
            passage = ids[start : start + self.window].tolist()
            shares, there_all, size = [], 0, 0
            for n, grams in self.parts[i]:
                there = len(grams & {tuple(passage[k : k + n]) for k in range(len(passage) - n + 1)})
                shares.append(there / len(grams))
                there_all, size = there_all + there, size + len(grams)
            if min(shares) >= overlap or there_all >= WHOLE * size:
                best[i] = max(best.get(i, (0.0,)), (score, *shares))
        return [{"item_id": int(self.item_ids[i]), "score": round(s, 6), "question_overlap": q, "answer_overlap": a} for i, (s, q, a) in sorted(best.items())]


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (n of them), one range after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


def build_index(rows: pd.DataFrame, df: dict[str, int], n_items: int, mean_length: float, share: float) -> Bm25Index:
    """rows: item_id, question, answer, n, terms of the items of this index; df, n_items and mean_length of all items."""
    vocabulary = {t: k for k, t in enumerate(sorted({t for terms in rows["terms"] for t in terms}))}
    impacts, rest, threshold, essential, parts = [], [], [], [], []
    for q, a, n in zip(rows["question"], rows["answer"], rows["n"]):
        words = list(q) if list(q) == list(a) else [*q, *a]
        tf = pd.Series(words).value_counts()
        norm = K1 * (1 - B + B * n / mean_length)
        own = {vocabulary[t]: float(np.log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm)) for t, f in tf.items()}
        least, total, small = share * sum(own.values()), 0.0, set()
        for t, w in sorted(own.items(), key=lambda x: (x[1], x[0])):
            if total + w >= least:
                break
            total += w
            small.add(t)
        impacts.append(own), rest.append(total), threshold.append(least), essential.append({t: w for t, w in own.items() if t not in small})
        grams = []
        for part in (q, a):
            ids = [vocabulary[t] for t in part]
            m = min(NGRAM, len(ids))
            grams.append((m, {tuple(ids[k : k + m]) for k in range(len(ids) - m + 1)}))
        parts.append(grams)
    threshold, rest = np.array(threshold), np.array(rest)
    # Essential terms must reach what the others leave of the threshold, so shares are of that.
    needed = threshold - rest
    blocks = (len(rows) + ITEMS_PER_BLOCK - 1) // ITEMS_PER_BLOCK
    posts = sorted((t, i // ITEMS_PER_BLOCK, i, w / needed[i]) for i, own in enumerate(essential) for t, w in own.items())
    term, block = np.array([p[0] for p in posts], np.int64), np.array([p[1] for p in posts], np.int64)
    item, impact = np.array([p[2] for p in posts], np.int64), np.array([p[3] for p in posts])
    cell_key, first = np.unique(term * blocks + block, return_index=True)
    most = np.maximum.reduceat(impact, first) if len(first) else np.empty(0)
    ptr = np.searchsorted(cell_key // blocks, np.arange(len(vocabulary) + 1))
    largest = np.zeros(len(vocabulary))
    np.maximum.at(largest, term, impact)
    longest = int(rows["n"].max())
    flat = [x for own in impacts for x in own.items()]
    every = (np.cumsum([0, *map(len, impacts)]), np.array([t for t, _ in flat], np.int64), np.array([w for _, w in flat]))
    return Bm25Index(vocabulary, rows["item_id"].to_numpy(np.int64), 2 * max(64, longest), threshold, (ptr, cell_key % blocks, most), (np.append(first, len(posts)), item, impact), largest, every, parts, blocks)


def _search(index: Bm25Index, overlap: float):
    terms = TermIds(index.vocabulary)

    @F.pandas_udf(_HIT)
    def hits(texts: pd.Series) -> pd.Series:
        return pd.Series([index.verified(terms.of(t), overlap) if t else [] for t in texts])

    return hits


def _indexes(items: DataFrame, item_id: str, item_text: str, share: float, index_bytes: int):
    """The indexes of the items, one after the other, each of about index_bytes of text."""
    known = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    rows = known.mapInPandas(_item_rows, "item_id long, question array<string>, answer array<string>, n long, terms array<string>")
    size = known.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    stats = rows.agg(F.count("*").alias("n"), F.avg("n").alias("mean")).first()
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    parts = max(1, -(-size // index_bytes))
    for b in range(parts if stats.n else 0):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "n"), F.lit(parts)) == b)
        own = part.toPandas().sort_values(["n", "item_id"]).reset_index(drop=True)
        if len(own):
            terms = part.select(F.explode("terms").alias("term")).distinct().join(df, "term").collect()
            yield parts, build_index(own, {r.term: r.df for r in terms}, stats.n, stats.mean, share)


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.5, overlap: float = 0.5, index_bytes: int = 32 << 20
) -> DataFrame:
    """One row per document and test item found in it: id_col, item_id, score, question_overlap, answer_overlap.

    score is the best BM25 score of any passage. Null and empty texts hold nothing; items with a null id or text, or
    without words, are left out. Repeated documents each give their rows; repeated items are found once per row, and a
    null document id stays null. Other columns are ignored; an empty table gives an empty result. A benchmark of more
    than one index is searched one index at a time, so that no job holds more than one.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = [docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, item_id long, score double, question_overlap double, answer_overlap double")]
    for parts, index in _indexes(items, item_id, item_text, share, index_bytes):
        hits = docs.select(F.col(id_col), F.inline(_search(index, overlap)(F.col(text_col).cast("binary"))))
        found.append(materialize(hits) if parts > 1 else hits)
    return reduce(DataFrame.union, found[1:] or found)


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.5, overlap: float = 0.5, index_bytes: int = 32 << 20) -> DataFrame:
    """docs without the rows in which a test item is found; all columns stay. Null texts hold nothing and stay."""
    for parts, index in _indexes(items, item_id, item_text, share, index_bytes):
        docs = docs.filter(F.size(_search(index, overlap)(F.col(text_col).cast("binary"))) == 0)
        docs = materialize(docs) if parts > 1 else docs
    return docs
