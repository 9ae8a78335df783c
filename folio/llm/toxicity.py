"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, calibrated votes.

Fitting takes a bounded sample of labelled rows (`most_toxic`, `most_clean`): they fill the index with all their words.
Document frequencies of all words are counted over all documents, and every word of a document counts in its norm. What
no example has is known by 63-bit hashes: it can't be shared, so it changes no order of examples; its part of the norm
is joined in afterwards from the table of counts, which stays distributed.

Examples are laid out in blocks of 128 of the same kind and label; for each term and block the index keeps the largest
weight. Documents are looked up some at a time: for each label the two blocks of highest bound give a k-th best
similarity, and of the others only those whose bound reaches it are looked at, so the k nearest of each label are exact.
Terms that many examples hold have their postings stored as rows of a matrix, the others as lists.

A neighbour votes with its cosine, each shared term's part of it weighted by the term's relevance (its squared
correlation with the label among the examples, and a floor), and by how thinly its class was sampled. Votes are drawn
towards the base rate and calibrated by isotonic regression on leave-one-out votes of the examples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, shuffle_partitions, trim_memory
from .samples import held_out, labelled_sample, texts_of

BLOCK = 128
#: A term that this share of the examples holds has its postings stored as a row.
COMMON = 0.05
#: More than single precision can be wrong in a cosine.
SLACK = 1e-4
#: Documents that are looked up together.
TOGETHER = 64
#: Of these, texts whose postings are added up together.
FEW = 8
#: Relevance of a term that tells nothing about the label; a perfect one has 1 more.
LEAST_RELEVANCE = 0.005
_FOUND = "toxic_votes double, votes double, inner double, example array<bigint>, similarity array<double>, toxic array<int>, word array<bigint>, tf array<int>"


def word_of(token: str) -> str:
    """A lower-cased token without the marks at its ends."""
    start, end = 0, len(token)
    while start < end and not token[start].isalnum():
        start += 1
    while end > start and not token[end - 1].isalnum():
        end -= 1
    return token[start:end]


def _counted(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, how often it occurs there), by text and term."""
    order = np.lexsort((term, doc))
    doc, term = doc[order], term[order]
    first = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | np.append(True, term[1:] != term[:-1])[: len(term)])
    return doc[first], term[first], np.diff(np.append(first, len(doc)))


class Terms(dict):
    """token -> its word's 64-bit hash, or that word's number in the sorted hashes of a vocabulary (below -1 for others:
    63 bits of the hash); remembered up to a bound. Tokens without a letter or digit are no words (0, or -1)."""

    def __init__(self, vocabulary: np.ndarray | None = None, limit: int = 300_000):
        super().__init__()
        self.vocabulary, self.limit = vocabulary, limit

    def _learn(self, tokens: list[str]) -> None:
        bare = [t.rstrip(".,!?;:") for t in tokens]
        words = [b if b.isalnum() else word_of(t) for b, t in zip(bare, tokens)]
        hashes = pd.util.hash_array(np.array(words, object), categorize=False)
        hashes[[i for i, x in enumerate(words) if not x]] = 0
        if self.vocabulary is not None:
            at = self.vocabulary.searchsorted(hashes)
            there = (at < len(self.vocabulary)) & (hashes != 0)
            there[there] = self.vocabulary[at[there]] == hashes[there]
            others = np.minimum(np.invert((hashes >> np.uint64(1)).view(np.int64)), -2)
            hashes = np.where(there, at, np.where(hashes == 0, -1, others))
        self.update(zip(tokens, hashes.tolist()))

    def _tokens(self, texts) -> tuple[np.ndarray, np.ndarray]:
        tokens = [(t or "").lower().split() for t in texts]
        doc = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        flat = list(chain.from_iterable(tokens))
        unknown, kind = (1, np.uint64) if self.vocabulary is None else (-(1 << 63), np.int64)
        term = np.fromiter(map(self.get, flat, repeat(unknown)), kind, len(flat))
        if len(gaps := np.flatnonzero(term == kind(unknown))):
            missing = [flat[i] for i in gaps.tolist()]
            new = set(missing)
            if len(self) + len(new) > self.limit:
                self.clear()
            self._learn(list(new))
            term[gaps] = np.fromiter(map(self.__getitem__, missing), kind, len(missing))
        return doc, term

    def split(self, texts) -> tuple[tuple, tuple]:
        """(position of the text, word's number, how often it occurs), and the same of the words outside the vocabulary."""
        doc, term = self._tokens(texts)
        known, other = term >= 0, term < -1
        both, n = np.unique(doc[known] << 32 | term[known], return_counts=True)
        return (both >> 32, both & 0xFFFFFFFF, n), _counted(doc[other], term[other])

    def of(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the text, word's number or hash, how often it occurs), by text and word; other tokens left out."""
        if self.vocabulary is not None:
            return self.split(texts)[0]
        doc, term = self._tokens(texts)
        return _counted(doc[term != 0], term[term != 0])


def _groups(texts):
    return (texts[at : at + TOGETHER] for at in range(0, len(texts), TOGETHER))


def _selection(batches):
    """(word's hash, toxic examples with it, clean examples with it), summed over the batch."""
    cache = Terms()
    for pdf in batches:
        words, labels = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for part, y in zip(_groups(list(pdf["text"])), _groups(pdf["y"].to_numpy(np.int64))):
            doc, word, _ = cache.of(part)
            words.append(word), labels.append(y[doc])
        found, at = np.unique(np.concatenate(words), return_inverse=True)
        toxic, total = np.bincount(at, np.concatenate(labels), len(found)).astype(np.int64), np.bincount(at, minlength=len(found))
        yield pd.DataFrame({"word": found.view(np.int64), "toxic": toxic, "clean": total - toxic})
    del cache
    trim_memory()


def _frequencies(vocabulary):
    """(term, documents with it): -1 counts the documents; words outside the vocabulary come batch by batch."""

    def run(batches):
        cache, n, total = Terms(vocabulary.value), 0, np.zeros(len(vocabulary.value), np.int64)
        for pdf in batches:
            n += len(pdf)
            others = [np.empty(0, np.int64)]
            for part in _groups(list(pdf["text"])):
                known, other = cache.split(part)
                np.add.at(total, known[1], 1)
                others.append(other[1])
            words, count = np.unique(np.concatenate(others), return_counts=True)
            yield pd.DataFrame({"term": words, "n": count})
        del cache
        trim_memory()
        some = np.flatnonzero(total)
        yield pd.DataFrame({"term": np.concatenate([[-1], some]), "n": np.concatenate([[n], total[some]])})

    return run


def _vectors(vocabulary):
    def run(batches):
        cache = Terms(vocabulary.value)
        for pdf in batches:
            terms, tf = [], []
            for part in _groups(list(pdf["text"])):
                doc, term, n = cache.of(part)
                cuts = np.searchsorted(doc, np.arange(1, len(part)))
                terms += np.split(term, cuts)
                tf += np.split(n, cuts)
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "terms": terms, "tf": tf})
        del cache
        trim_memory()

    return run


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the weighted non-decreasing least-squares fit, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x[order], y[order], w[order]):
        if blocks and blocks[-1][3] == xi:
            b = blocks[-1]
            b[0], b[1] = (b[0] * b[1] + yi * wi) / (b[1] + wi), b[1] + wi
        else:
            blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, n, lo, hi = blocks.pop()
            b = blocks[-1]
            blocks[-1] = [(b[0] * b[1] + m * n) / (b[1] + n), b[1] + n, b[2], hi]
    knots = [(v, b[0]) for b in blocks for v in ((b[2], b[3]) if b[2] != b[3] else (b[2],))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, ... (n of them), one range after the other."""
    out = np.repeat(start - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out


@dataclass
class ToxicityModel:
    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray
    base: float
    relevance: np.ndarray
    k: int = 15
    shrink: float = 0.01
    documents: int = 0
    slot: np.ndarray = field(default=None, repr=False)  # by example: its place in the blocks
    example: np.ndarray = field(default=None, repr=False)  # by place: its example, or -1
    clean_blocks: int = 0
    column: np.ndarray = field(default=None, repr=False)  # by term: its row of `rows`, or -1
    row_relevance: np.ndarray = field(default=None, repr=False)
    rows: np.ndarray = field(default=None, repr=False)
    row_max: np.ndarray = field(default=None, repr=False)
    ords: np.ndarray = field(default=None, repr=False)
    vals: np.ndarray = field(default=None, repr=False)
    cell_ptr: np.ndarray = field(default=None, repr=False)
    cell_block: np.ndarray = field(default=None, repr=False)
    cell_max: np.ndarray = field(default=None, repr=False)
    cell_at: np.ndarray = field(default=None, repr=False)
    knots: tuple = ((0.0, 1.0), (0.0, 1.0))

    def weighed(self, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        return (1 + np.log(tf)) * self.idf[term]

    def vectors(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, weight): the texts' vectors over the terms of the examples, each of length 1."""
        w = self.weighed(term, tf)
        norm = np.sqrt(np.bincount(doc, w * w))
        return doc, term, w / np.maximum(norm, 1e-300)[doc] if len(doc) else w

    def build(self, own: np.ndarray, term: np.ndarray, val: np.ndarray) -> None:
        """Postings by term, then by place; a cell is what a term has in one block, cell_ptr[t] its first one. No block
        holds examples of both labels."""
        clean, toxic = np.flatnonzero(self.toxic == 0), np.flatnonzero(self.toxic != 0)
        self.clean_blocks = -(-len(clean) // BLOCK)
        blocks, n_terms = self.clean_blocks - (-len(toxic) // BLOCK), len(self.idf)
        self.slot = np.zeros(len(self.ids), np.int32)
        self.slot[clean] = np.arange(len(clean))
        self.slot[toxic] = self.clean_blocks * BLOCK + np.arange(len(toxic))
        self.example = np.full(blocks * BLOCK, -1, np.int32)
        self.example[self.slot] = np.arange(len(self.ids))
        own = self.slot[own]
        many = np.flatnonzero(np.bincount(term, minlength=n_terms) > max(COMMON * len(self.ids), BLOCK // 8))
        self.column = np.full(n_terms, -1, np.int32)
        self.column[many] = np.arange(len(many))
        self.row_relevance = self.relevance[many]
        row = self.column[term]
        self.rows = np.zeros((blocks * BLOCK, len(many)), np.float32)
        self.rows[own[row >= 0], row[row >= 0]] = val[row >= 0]
        self.row_max = np.ascontiguousarray(self.rows.reshape(blocks, BLOCK, len(many)).max(axis=1).T)
        term, val, own = term[row < 0], val[row < 0], own[row < 0]
        order = np.lexsort((own, term))
        term, self.ords, self.vals = term[order], own[order], val[order]
        cell = term * max(blocks, 1) + self.ords // BLOCK
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        self.cell_ptr = np.searchsorted(term[first], np.arange(n_terms + 1)).astype(np.int32)
        self.cell_block = (cell[first] % max(blocks, 1)).astype(np.int32)
        self.cell_max = np.maximum.reduceat(self.vals, first) if len(first) else np.empty(0)
        self.cell_at = np.append(first, len(term)).astype(np.int32)

    def nearest(self, docs: int, doc: np.ndarray, term: np.ndarray, w: np.ndarray, skip: list[int] | None = None) -> list[tuple]:
        """For each of some texts, given as their vectors, the k examples of each label of largest positive cosine, largest
        first, ties by position; exact. (cosines, their parts weighted by relevance, positions)."""
        blocks = self.row_max.shape[1]
        if not blocks:
            return [(np.empty(0), np.empty(0), np.empty(0, np.int64))] * docs
        width = blocks * BLOCK
        labels = [(a, b) for a, b in ((0, self.clean_blocks), (self.clean_blocks, blocks)) if a < b]
        col = self.column[term]
        dense = np.zeros((docs, len(self.row_max)), np.float32)
        dense[doc[col >= 0], col[col >= 0]] = w[col >= 0]
        doc, term, w = doc[col < 0], term[col < 0], w[col < 0]
        n = self.cell_ptr[term + 1] - self.cell_ptr[term]
        cells, of = _ranges(self.cell_ptr[term], n), np.repeat(np.arange(len(doc)), n)
        at = doc[of] * blocks + self.cell_block[cells]
        bound = dense @ self.row_max + np.bincount(at, self.cell_max[cells] * w[of], docs * blocks).reshape(docs, blocks)
        s, rest, done = np.zeros((docs, width), np.float32), np.zeros((docs, width)), np.zeros(blocks, bool)
        parts = []

        def look(live: np.ndarray) -> None:
            """Add up the cosines of the examples in the live blocks: of the common terms in s (for all texts), of the
            others in rest. Live cells of a term that lie side by side are one run of postings; a few texts at a time, so
            that what is being added up stays in the processor's cache."""
            for b in np.flatnonzero(live.any(axis=0) & ~done):
                s[:, b * BLOCK : (b + 1) * BLOCK] = dense @ self.rows[b * BLOCK : (b + 1) * BLOCK].T
                done[b] = True
            on = np.flatnonzero(live.reshape(-1)[at])
            c, o = cells[on], of[on]
            head = np.flatnonzero((np.diff(c, prepend=-2) != 1) | (np.diff(o, prepend=-1) != 0))
            start, end, o = self.cell_at[c[head]], self.cell_at[c[np.append(head, len(c))[1:] - 1] + 1], o[head]
            n = (end - start).astype(np.int64)
            cuts = np.searchsorted(doc[o], np.arange(0, docs + FEW, FEW))
            for d, lo, hi in zip(range(0, docs, FEW), cuts, cuts[1:]):
                post = _ranges(start[lo:hi], n[lo:hi])
                to = np.repeat((doc[o[lo:hi]] - d) * width, n[lo:hi])
                to += self.ords.take(post, mode="clip")  # all are in range; this leaves out the test
                val = self.vals.take(post, mode="clip")
                val *= np.repeat(w[o[lo:hi]], n[lo:hi])
                some = rest[d : d + FEW].reshape(-1)
                some += np.bincount(to, val, len(some))
                parts.append((d, to, val, o[lo:hi], np.cumsum(n[lo:hi])))

        first, least = np.zeros((docs, blocks), bool), np.zeros((docs, blocks))
        best = [a + np.argsort(-bound[:, a:b], axis=1, kind="stable")[:, :2] for a, b in labels]
        for top in best:
            np.put_along_axis(first, top, True, axis=1)
        look(first)
        own = np.arange(docs)
        for (a, b), top in zip(labels, best):
            seen = s.reshape(docs, blocks, BLOCK)[own[:, None], top] + rest.reshape(docs, blocks, BLOCK)[own[:, None], top]
            if skip is not None:
                place = self.slot[skip]
                hit, col = np.nonzero(top == (place // BLOCK)[:, None])
                seen[hit, col, place[hit] % BLOCK] = 0
            seen = seen.reshape(docs, -1)
            k = min(self.k, seen.shape[1])
            least[:, a:b] = np.partition(seen, seen.shape[1] - k, axis=1)[:, -k, None] - SLACK
        look((bound > 0) & (bound >= least) & ~first)
        total = s + rest.astype(np.float32)
        if skip is not None:
            total[own, self.slot[skip]] = 0
        near = []
        for d in range(docs):
            for a, b in labels:
                x = total[d, a * BLOCK : b * BLOCK]
                o = np.flatnonzero(x > max(least[d, a], 0.0))
                if len(o) > self.k:
                    o = o[x[o] >= np.partition(x[o], -self.k)[-self.k] - SLACK]
                near.append(a * BLOCK + o)
        # What may be among the nearest is added up anew in double precision; only there are the shared terms' parts
        # weighted by relevance.
        ends = np.cumsum([0, *map(len, near)])[:: len(labels)]
        near = np.concatenate(near)
        key = np.repeat(own, np.diff(ends)) * width + near
        number, told = np.full(docs * width, -1, np.int32), np.zeros(len(key))
        number[key] = np.arange(len(key))
        for d, to, val, o, end in parts:
            i = number[d * width : (d + FEW) * width].take(to, mode="clip")
            hit = np.flatnonzero(i >= 0)
            told += np.bincount(i[hit], val[hit] * self.relevance[term[o]].take(np.searchsorted(end, hit, "right")), len(key))
        rest, out = rest.reshape(-1)[key], []
        for d in range(docs):
            of = slice(ends[d], ends[d + 1])
            o, q = near[of], dense[d].astype(float)
            p, common = self.example[o], self.rows[o].astype(float) @ np.stack([q, q * self.row_relevance], axis=1)
            exact = (common[:, 0] + rest[of]).round(9)
            by = np.lexsort((p, -exact))
            by = by[exact[by] > 0]
            toxic = self.toxic[p[by]] != 0
            by = by[np.where(toxic, np.cumsum(toxic), np.cumsum(~toxic)) <= self.k]
            out.append((exact[by], common[by, 1] + told[of][by], p[by]))
        return out

    def votes(self, telling: np.ndarray, o: np.ndarray) -> tuple[float, float]:
        """Sums of the votes: of the toxic neighbours, of all."""
        v = telling * self.weight[o]
        return float((v * self.toxic[o]).sum()), float(v.sum())

    def calibrate(self, toxic_votes: np.ndarray, votes: np.ndarray) -> None:
        """From the leave-one-out votes of the examples."""
        if len(votes) and 0 < self.toxic.sum() < len(votes):
            raw = (toxic_votes + self.shrink * self.base) / (votes + self.shrink)
            self.knots = isotonic(raw, self.toxic.astype(float), self.weight)
        else:
            self.knots = (np.array([0.0, 1.0]), np.array([self.base, self.base]))

    def score(self, toxic_votes, votes, share):
        """Calibrated score of votes; share: what of the text's length lies in the terms of the examples."""
        raw = (share * toxic_votes + self.shrink * self.base) / (share * votes + self.shrink)
        return np.clip(np.interp(raw, *self.knots), 0.0, 1.0)

    def found(self, texts: list[str], cache: Terms) -> list[tuple]:
        """For each text: sums of votes, its squared length over the terms of the examples, the neighbours, and, where
        it has any, its words that no example holds with their counts."""
        out = []
        for part in _groups(texts):
            (doc, term, tf), (at, word, n) = cache.split(part)
            inner = np.bincount(doc, self.weighed(term, tf) ** 2, len(part))
            cuts = np.searchsorted(at, np.arange(len(part) + 1))
            for i, (s, telling, o) in enumerate(self.nearest(len(part), *self.vectors(doc, term, tf))):
                end = cuts[i + 1] if len(o) else cuts[i]
                out.append((*self.votes(telling, o), inner[i], self.ids[o], s, self.toxic[o], word[cuts[i] : end], n[cuts[i] : end]))
        return out


def _layout(own: np.ndarray, term: np.ndarray, w: np.ndarray, toxic: np.ndarray, n_terms: int, rounds: int = 4) -> np.ndarray:
    """An order of the examples in which like ones lie together, which keeps block bounds tight: by label, then by the
    nearest of some centres over the commonest terms."""
    if not len(toxic):
        return np.empty(0, np.int64)
    common = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:256]
    place = np.full(n_terms, -1)
    place[common] = np.arange(len(common))
    x = np.zeros((len(toxic), len(common)))
    x[own[place[term] >= 0], place[term[place[term] >= 0]]] = w[place[term] >= 0]
    centre = x[:: max(1, len(x) // max(1, len(x) // (2 * BLOCK)))]
    for _ in range(rounds):
        of = (x @ centre.T).round(9).argmax(axis=1)
        sums = np.zeros_like(centre)
        np.add.at(sums, of, x)
        centre = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return np.lexsort((np.arange(len(x)), of, toxic))


def _finder(spark, model: ToxicityModel, vocabulary):
    """text -> what `found` tells; equal texts of a batch are looked up once."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(_FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache = Terms(vocabulary.value)
        for texts in batches:
            of: dict = {}
            at = [of.setdefault(t or "", len(of)) for t in texts]
            found = shared.value.found(list(of), cache)
            yield pd.DataFrame([found[i] for i in at], columns=[c.split()[0] for c in _FOUND.split(", ")])
        del cache
        trim_memory()

    return find


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, columns: list, **fit) -> DataFrame:
    """columns, score and neighbors of each document. The neighbours are found where the texts lie and written; the words
    that no example holds are joined to their counts, and their part of the norm comes back by row number."""
    model, vocabulary, others = fit_toxicity(docs, labels, id_col, text_col, **fit)
    find = _finder(docs.sparkSession, model, vocabulary)
    looked = materialize(docs.select(*columns, find(F.col(text_col)).alias("r")).select("*", F.monotonically_increasing_id().alias("row")))
    documents = float(model.documents)
    idf = F.log((1 + documents) / (1 + F.coalesce("n", F.lit(1)))) + 1
    outside = (
        looked.select("row", F.explode(F.arrays_zip("r.word", "r.tf")).alias("x")).select("row", F.col("x.word").alias("term"), F.col("x.tf").alias("tf"))
        .join(others, "term", "left").groupBy("row").agg(F.sum(((1 + F.log("tf")) * idf) ** 2).alias("outer"))
    )
    total = F.col("r.inner") + F.coalesce("outer", F.lit(0.0))
    share = F.when(F.col("outer").isNull(), 1.0).otherwise(F.sqrt(F.col("r.inner") / total))

    @F.pandas_udf("double")
    def score(toxic_votes: pd.Series, votes: pd.Series, share: pd.Series) -> pd.Series:
        return pd.Series(calibration.score(toxic_votes.to_numpy(), votes.to_numpy(), share.to_numpy()))

    calibration = ToxicityModel(*[np.empty(0)] * 4, model.base, np.empty(0), shrink=model.shrink, knots=model.knots)
    neighbors = F.transform(
        F.arrays_zip("r.example", "r.similarity", "r.toxic"),
        lambda x: F.struct(x["example"].alias("example"), (x["similarity"] * F.col("share")).alias("similarity"), x["toxic"].alias("toxic")),
    )
    whole = looked.join(outside, "row", "left").withColumn("share", share)
    names = [c for c in looked.columns if c not in ("r", "row")]
    return whole.select(*names, score("r.toxic_votes", "r.votes", "share").alias("score"), neighbors.alias("neighbors"))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    most_toxic: int = 3000, most_clean: int = 6000,
):
    """(model, vocabulary as a broadcast, counts of the other words that several documents hold) from at most most_toxic + most_clean labelled
    documents and the word counts of all documents. What is broadcast is bounded by the words of the examples.

    Without labelled rows, or with one class only, every document scores the base rate (0 without labels).
    """
    spark = docs.sparkSession
    sample = materialize(labelled_sample(labels, id_col, label_col, {1: most_toxic, 0: most_clean}))
    examples = materialize(texts_of(docs, sample, id_col, text_col).repartition(shuffle_partitions(spark)))
    sizes = {r.y: r.n for r in examples.groupBy("y").agg(F.count("*").alias("n")).collect()}
    known = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(label_col).cast("int").alias("y")).agg(F.count("*").alias("n"))
    all_sizes = {r.y: r.n for r in known.collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    a, b, c, d = F.col("toxic"), F.col("clean"), F.lit(float(n1)) - F.col("toxic"), F.lit(float(n0)) - F.col("clean")
    chi2 = (a * d - b * c) ** 2 * (n1 + n0) / (float(max(n1 * n0, 1)) * (a + b) * F.greatest(c + d, F.lit(1.0)))
    terms = (
        examples.mapInPandas(_selection, "word long, toxic long, clean long")
        .groupBy("word").agg(F.sum("toxic").cast("double").alias("toxic"), F.sum("clean").cast("double").alias("clean"))
        .select("word", chi2.alias("chi2")).toArrow()
    )
    words = terms["word"].to_numpy().view(np.uint64)
    order = np.argsort(words)
    vocabulary = spark.sparkContext.broadcast(words[order])
    relevance = LEAST_RELEVANCE + terms["chi2"].to_numpy()[order] / max(n1 + n0, 1)
    del terms, words, order
    counts = materialize(docs.select(F.col(text_col).alias("text")).mapInPandas(_frequencies(vocabulary), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).filter("term >= -1 or n > 1"))
    counted = counts.filter("term >= -1").toArrow()
    df = np.zeros(len(relevance) + 1)
    df[counted["term"].to_numpy()] = counted["n"].to_numpy()
    del counted
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1
    rows = examples.mapInPandas(_vectors(vocabulary), "id long, y int, terms array<int>, tf array<int>").toArrow().sort_by("id")
    y, ids = rows["y"].to_numpy().astype(np.int64), rows["id"].to_numpy()
    share = {k: all_sizes.get(k, 0) / max(sizes.get(k, 0), 1) for k in (0, 1)}
    labelled = all_sizes.get(0, 0) + all_sizes.get(1, 0)
    model = ToxicityModel(idf, ids, y, np.ones(len(ids)), all_sizes.get(1, 0) / labelled if labelled else 0.0, relevance, documents=int(df[-1]))
    lists = [rows[c].combine_chunks() for c in ("terms", "tf")]
    own = np.repeat(np.arange(len(ids)), np.diff(lists[0].offsets.to_numpy()))
    own, term, w = model.vectors(own, *(x.values.to_numpy() for x in lists))
    del rows, lists
    order = _layout(own, term, w, y, len(idf))
    model.ids, model.toxic = ids[order], y[order]
    model.weight = np.where(model.toxic == 1, share[1], share[0]) / max(share[0], share[1], 1e-9)
    model.build(np.argsort(order)[own].astype(np.int32), term.astype(np.int64), w)
    del own, term, w
    shared = spark.sparkContext.broadcast(model)

    def votes(batches):
        m, cache = shared.value, Terms(vocabulary.value)
        place = {d: i for i, d in enumerate(m.ids.tolist())}
        for pdf in batches:
            at, raw = [place[d] for d in pdf["id"]], []
            for k in range(0, len(at), TOGETHER):
                part = list(pdf["text"].iloc[k : k + TOGETHER])
                found = m.nearest(len(part), *m.vectors(*cache.of(part)), at[k : k + TOGETHER])
                raw += [m.votes(telling, o) for _, telling, o in found]
            yield pd.DataFrame({"i": at, "toxic": [x for x, _ in raw], "n": [x for _, x in raw]})

    raw = examples.mapInPandas(votes, "i long, toxic double, n double").toArrow().sort_by("i")
    model.calibrate(raw["toxic"].to_numpy(), raw["n"].to_numpy())
    shared.destroy()
    release(sample, examples)
    return model, vocabulary, counts.filter("term < -1")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """One row per document: id_col, held_out, score (0 to 1), predicted (score >= 0.5), neighbors (all that vote).

    Null and empty texts have no words: they get the calibrated score of a document without neighbours. Rows with
    a null id or a repeated id are scored like any other. Other columns are ignored, whatever their names.
    """
    scored = _scored(docs, labels, id_col, text_col, [F.col(id_col).alias("id"), held_out(id_col).alias("held_out")], **fit)
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "neighbors")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, **fit) -> DataFrame:
    """docs without the rows that score threshold or more; all columns stay. Equal texts score alike, so the rejected
    ones are known by 128 bits of hash of their text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keys = [F.xxhash64(text), F.xxhash64(F.lit(1), text)]
    scored = _scored(docs, labels, id_col, text_col, [k.alias(f"key{i}") for i, k in enumerate(keys)], **fit)
    rejected = scored.filter(F.col("score") >= threshold).select("key0", "key1").distinct()
    own = F.coalesce(docs[text_col], F.lit(""))
    return docs.join(rejected, (F.xxhash64(own) == rejected["key0"]) & (F.xxhash64(F.lit(1), own) == rejected["key1"]), "left_anti")
