"""Quality by co-training: two classifiers, one on a document's text and one on its metadata, teach each other.

Both views start from a bounded sample of labelled rows. In each round, each classifier scores a bounded pool of
unlabelled documents and hands those it is most sure of, as pseudo-labels, to the other one; both are fitted anew. Then
each view's margin is calibrated (Platt) on labelled rows that neither was fitted on, the calibrated views are combined
by a logistic regression on yet other rows, and every document is scored. In both steps a row weighs as many labelled
rows as it stands for, so scores are calibrated to the labels' own share of good documents, not to the sample's.

Text view: shares of character classes, shape of words and lines, repetition. Metadata view: language, source and the
recorded length, hashed into a fixed number of columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .samples import held_out, labelled_sample, texts_of

META_COLUMNS = 96
_CLASS = np.zeros(256, np.int64)
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = (
        0 if _c >= 128 else 1 if "a" <= _ch <= "z" else 2 if "A" <= _ch <= "Z" else 3 if "0" <= _ch <= "9" else 4 if _ch == " " else 5 if _ch == "\n"
        else 6 if _ch in ".!?" else 7 if _ch in ",;:'\"-" else 8 if _ch in "()[]{}<>/\\" else 9 if _ch in "*#%&$@^~|+=_" else 10
    )
CLASSES = 11


def text_features(text: str | None) -> np.ndarray:
    """Numbers that describe the whole text's form; an empty text has zeros but for the last, which says so."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    if not words:
        return np.append(np.zeros(CLASSES + 17), 1.0)
    codes = _CLASS[np.frombuffer(data, np.uint8)]
    share = np.bincount(codes, minlength=CLASSES) / len(codes)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    distinct = len(set(words)) / len(words)
    marked = float(np.mean([not 97 <= w[-1] <= 122 and w[-1] < 128 for w in words]))
    run = float((np.diff(codes) == 0).mean()) if len(codes) > 1 else 0.0
    _, counts = np.unique(lengths, return_counts=True)
    p = counts / counts.sum()
    pairs = list(zip(words, words[1:]))
    more = [
        np.log1p(len(words)), lengths.mean() / 10, lengths.std() / 10, float((lengths > 15).mean()), float((lengths <= 2).mean()), float((lengths == 1).mean()),
        distinct, distinct * np.log1p(len(words)) / 10, len(set(pairs)) / max(len(pairs), 1), len(set(lines)) / len(lines), np.log1p(len(lines)), np.log1p(len(words) / len(lines)),
        marked, run, float(-(p * np.log(p)).sum()), float(np.mean([65 <= w[0] <= 90 for w in words])), float(np.mean([any(48 <= c <= 57 for c in w) for w in words[:1] + words[-1:]])),
    ]
    return np.concatenate([share, more, [0.0]])


def meta_features(lang, source, n_chars) -> np.ndarray:
    out = np.zeros(META_COLUMNS + 4)
    for k, v in (("lang", lang), ("source", source), ("both", f"{lang}|{source}")):
        out[xxhash.xxh64_intdigest(f"{k}={v}") % META_COLUMNS] += 1.0
    n = float(n_chars) if n_chars is not None and n_chars == n_chars else 0.0
    size = np.log1p(max(n, 0.0))
    out[META_COLUMNS:] = size / 10, (size / 10) ** 2, float(n < 100), float(n_chars is None)
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, ridge: float = 1.0, rounds: int = 25, alike: bool = True) -> Logistic:
        """Newton's method with a ridge penalty; the classes weigh alike, or as much as their rows do."""
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((len(x), 1))])
        w = np.ones(len(y)) if w is None else w
        if alike:
            pos, neg = w[y == 1].sum(), w[y == 0].sum()
            w = w * np.where(y == 1, (pos + neg) / (2 * pos), (pos + neg) / (2 * neg))
        beta = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
            h = (z * (w * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + ridge * np.eye(z.shape[1])
            step = np.linalg.solve(h, z.T @ (w * (y - p)) - ridge * beta)
            beta += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, beta)

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return z @ self.weights[:-1] + self.weights[-1]


def platt(margin: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a m + b))), with the usual smoothed targets; w: the rows' weights."""
    pos, neg = (y == 1).sum(), (y == 0).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    beta, z = np.zeros(2), np.stack([margin, np.ones(len(y))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (w * (t - p)) - 1e-3 * beta)
        beta += np.clip(step, -2, 2)
    return max(float(beta[0]), 1e-6), float(beta[1])


def combined(margins: list[np.ndarray], y: np.ndarray, w: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[list[tuple[float, float]], np.ndarray]:
    """(Platt step of each view, weights of their logits and a constant): the rows in `first` calibrate the views, those in
    `second` combine them."""
    steps = [platt(m[first], y[first], w[first]) for m in margins]
    logit = np.stack([a * m[second] + b for m, (a, b) in zip(margins, steps)], axis=1)
    both = Logistic.fit(logit, y[second].astype(float), w[second], alike=False)
    own = both.weights[:2] / both.scale
    # Margins beyond eight standard deviations are clipped in the fit, which no logit of the views reaches in practice.
    return steps, np.array([*own, both.weights[2] - (own * both.mean).sum()])


@dataclass
class QualityModel:
    views: list
    calibration: list
    combine: np.ndarray | None
    base: float

    def scores(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        """[score, text view, metadata view] per row."""
        if not self.views:
            return np.full((len(text), 3), self.base)
        logit = [np.clip(a * v.margin(x) + b, -30, 30) for v, (a, b), x in zip(self.views, self.calibration, (text, meta))]
        total = np.clip(self.combine[0] * logit[0] + self.combine[1] * logit[1] + self.combine[2], -30, 30)
        return 1 / (1 + np.exp(-np.stack([total, *logit], axis=1)))

    def udf(self):
        model = self

        @F.pandas_udf("struct<score: double, text_score: double, metadata_score: double>")
        def score(text: pd.Series, lang: pd.Series, source: pd.Series, n: pd.Series) -> pd.DataFrame:
            x = np.stack([text_features(t) for t in text])
            m = np.stack([meta_features(*v) for v in zip(lang, source, n)])
            return pd.DataFrame(model.scores(x, m), columns=["score", "text_score", "metadata_score"])

        return score


def _features(batches):
    for pdf in batches:
        yield pd.DataFrame({
            "y": pdf["y"], "h": pdf["h"], "x": [text_features(t) for t in pdf["text"]],
            "m": [meta_features(*v) for v in zip(pdf["lang"], pdf["source"], pdf["n"])],
        })


def _meta(docs: DataFrame, lang: str, source: str, length: str) -> list[Column]:
    """The metadata columns; those the table lacks are null."""
    get = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind)
    return [get(lang, "string").alias("lang"), get(source, "string").alias("source"), get(length, "double").alias("n")]


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", lang_col: str = "lang", source_col: str = "source", length_col: str = "n_chars",
    most_per_class: int = 4000, pool: int = 6000, rounds: int = 3, handed_over: float = 0.05,
) -> QualityModel:
    """A model from at most most_per_class labelled documents of each class and `pool` unlabelled ones."""
    meta = _meta(docs, lang_col, source_col, length_col)
    sample = materialize(labelled_sample(labels, id_col, label_col, {0: most_per_class, 1: most_per_class}))
    known = texts_of(docs, sample, id_col, text_col, *meta)
    with_label = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("id")).distinct()
    free = docs.select(F.col(id_col).cast("long").alias("id")).filter("id is not null").join(with_label, "id", "left_anti").groupBy("id").agg(F.lit(-1).alias("y"))
    free = materialize(free.orderBy(F.xxhash64("id"), "id").limit(pool))
    labelled = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(label_col).cast("int").alias("y")).agg(F.count("*").alias("n"))
    labelled = {r.y: r.n for r in labelled.collect()}
    rows = known.union(texts_of(docs, free, id_col, text_col, *meta)).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(8)))
    rows = rows.mapInPandas(_features, "y int, h long, x array<double>, m array<double>").toPandas()
    y = rows["y"].to_numpy()
    base = labelled.get(1, 0) / sum(labelled.values()) if labelled else 0.5
    part = np.minimum(rows["h"].to_numpy(), 2)
    calibrate_on, combine_on, fit_on = ((y >= 0) & (part == k) for k in range(3))
    if any(min(np.bincount(y[on], minlength=2)[:2]) < 2 for on in (calibrate_on, combine_on, fit_on)):
        return QualityModel([], [], None, base)
    stands_for = np.array([labelled.get(k, 0) / max((y == k).sum(), 1) for k in (0, 1)])
    weight = np.where(y == 1, stands_for[1], stands_for[0]) / stands_for.max()
    data = [np.stack(rows["x"].to_list()), np.stack(rows["m"].to_list())]
    own = [list(np.flatnonzero(fit_on)) for _ in data]
    said = [dict(zip(o, y[o])) for o in own]
    free_rows = np.flatnonzero(y == -1)
    views = [Logistic.fit(x[o], y[o]) for x, o in zip(data, own)]
    for _ in range(rounds):
        n = int(handed_over * len(free_rows))
        for giver, taker in ((0, 1), (1, 0)):
            new = np.array([i for i in free_rows if i not in said[taker]], np.int64)
            if not len(new) or not n:
                continue
            m = views[giver].margin(data[giver][new])
            order = np.argsort(m, kind="stable")
            for part, label in ((order[: max(1, int(n * (1 - base)))], 0), (order[::-1][: max(1, int(n * base))], 1)):
                said[taker].update({int(new[i]): label for i in part if (m[i] > 1) == (label == 1) and abs(m[i]) > 1})
        views = [Logistic.fit(x[list(s)], np.array(list(s.values())), np.where(np.isin(list(s), free_rows), 0.3, 1.0)) for x, s in zip(data, said)]
    calibration, combine = combined([v.margin(x) for v, x in zip(views, data)], y, weight, calibrate_on, combine_on)
    return QualityModel(views, calibration, combine, base)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", length_col: str = "n_chars", threshold: float = 0.5, **fit) -> DataFrame:
    """One row per document: id_col, held_out, score (0 to 1, higher: better), predicted, text_score, metadata_score.

    Null and empty texts are scored as such; missing metadata is a value of its own, as are metadata columns the table
    lacks. Rows with a null or repeated id are scored like any other. With labels of one class only, or none, every
    document scores the share of good labels (0.5 without labels). Other columns are ignored, whatever their names.
    """
    udf = fit_quality(docs, labels, id_col, text_col, lang_col=lang_col, source_col=source_col, length_col=length_col, **fit).udf()
    scored = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), udf(F.col(text_col), *_meta(docs, lang_col, source_col, length_col)).alias("r"))
    return scored.select(id_col, "held_out", "r.score", (F.col("r.score") >= threshold).cast("int").alias("predicted"), "r.text_score", "r.metadata_score")
