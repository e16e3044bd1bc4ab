"""Toxicity by a convolutional text classifier.

A word (lower-cased run of letters, digits and characters beyond ASCII) has the sum
of three hashed embeddings: of itself and of its first four and five bytes, so that
inflected forms share what they are learnt from. Filters of widths 1 to 3 run over the
words of the whole text, each keeps its maximum, and a logistic layer reads the
maxima. The model is trained in numpy on the driver, on labelled documents in the order of a hash of doc_id: of each class
at most MAX_DOCS, and together of at most MAX_BYTES (the bounds of the sample; a text that does not fit is passed over). One labelled document in ASIDE, by
another hash, is never fitted: a like sample of these gives Platt scaling at the true class shares.
Neither language, source, id nor label is an input of a score. Afterwards a threshold
per language is calibrated on the scores of all the documents set aside: the one of the best F1 (of ties the
highest) where the language has labels of both classes, else DEFAULT_THRESHOLD.

Nulls: a null text is empty and scored by the bias alone; a null language has thresholds of
its own; rows with a null doc_id are scored but never learnt from; a repeated label
counts once, as toxic if any says so; of texts of one id the least is learnt from. Without labels of both classes every score is 0. Texts are
scored whole, whatever their length. Only doc_id, text and lang are read, so other columns may have any names. No documents: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seams.llm import textcore as tc
from seams.llm.store import materialize

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 8, 8, (1, 2, 3)
PREFIXES = (4, 5)
MAX_DOCS = 3000
MAX_BYTES = 64 << 20
ASIDE = 5
DEFAULT_THRESHOLD = 0.7
_PAD = max(WIDTHS) - 1


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % folds == fold, F.lit(False))


def features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets (words and padding x 3; -1: padding), first position of each row, and its row count of words."""
    data = tc.LOWER[raw]
    start, end, row = tc.words(data, off, tc.NOT_ALNUM)
    prefix = tc.sums(data)
    n, rows = len(start), len(off) - 1
    ids = np.empty((n, 1 + len(PREFIXES)), np.int64)
    for j, k in enumerate((None, *PREFIXES)):
        h = tc.span_hashes(prefix, start, end if k is None else np.minimum(end, start + k))
        ids[:, j] = (tc.mix(h + np.uint64(j)) & np.uint64(BUCKETS - 1)).astype(np.int64)
    first = tc.bounds(row, rows)
    out = np.full((n + _PAD * rows, ids.shape[1]), -1, np.int64)
    out[np.arange(n) + _PAD * row] = ids
    return out, first[:-1] + _PAD * np.arange(rows), np.diff(first)


class Model:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.E = np.zeros((BUCKETS + 1, DIM), np.float32)  # the last row is padding
        self.E[:-1] = rng.normal(0, 0.1, (BUCKETS, DIM))
        self.K = [rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.b = np.zeros(FILTERS * len(WIDTHS), np.float32)
        self.v = rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32)
        self.c = np.float32(0)
        self.scale, self.shift = 1.0, 0.0

    def pooled(self, ids: np.ndarray, first: np.ndarray, want: bool = False):
        """Maxima of the filters by row; with want also inputs and their positions."""
        X = self.E[ids].sum(1) if len(ids) else np.zeros((0, DIM), np.float32)
        n = len(X)
        P = np.zeros((len(first), FILTERS * len(WIDTHS)), np.float32)
        at = np.zeros(P.shape, np.int64)
        pad = ids[:, 0] < 0
        Xp = np.concatenate([X, np.zeros((_PAD, DIM), np.float32)])
        for k, w in enumerate(WIDTHS):
            Z = Xp[:n] @ self.K[k][0]
            for j in range(1, w):
                Z += Xp[j : n + j] @ self.K[k][j]
            Z += self.b[k * FILTERS : (k + 1) * FILTERS]
            Z[pad] = 0
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            P[:, cols] = np.maximum(np.maximum.reduceat(Z, first, axis=0), 0)
            if want:
                for i, (a, z) in enumerate(zip(first, [*first[1:], n])):
                    at[i, cols] = a + Z[a:z].argmax(0)
        return (P, Xp, at) if want else P

    def logits(self, ids, first) -> np.ndarray:
        return self.pooled(ids, first) @ self.v + self.c

    def scores(self, ids, first) -> np.ndarray:
        z = self.scale * self.logits(ids, first).astype(np.float64) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _join(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(parts), np.cumsum([0, *map(len, parts[:-1])])


def fit(texts: list[str], y: np.ndarray, apart: np.ndarray, share: float, epochs: int = 8, batch: int = 32, rate: float = 0.1, seed: int = 7) -> Model | None:
    """A model for the texts, fitted to those that are not apart and scaled by those that are; share: of class 1 among all labelled documents. None without both classes."""
    train, aside = np.flatnonzero(~apart), np.flatnonzero(apart)
    if not 0 < y[train].sum() < len(train):
        return None
    if not 0 < y[aside].sum() < len(aside):
        aside = train
    rng = np.random.default_rng(seed)
    parts = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        parts.append(features(raw, np.array([0, len(raw)]))[0])
    m = Model(seed)
    part = y[train].mean()
    weight = np.where(y == 1, 0.5 / part, 0.5 / (1 - part))
    past = {"E": np.full(m.E.shape, 1e-8, np.float32), "K": [np.full(k.shape, 1e-8, np.float32) for k in m.K], "b": np.full(m.b.shape, 1e-8), "v": np.full(m.v.shape, 1e-8), "c": 1e-8}

    def step(value, grad, g2, r):
        g2 += grad * grad
        return value - r * grad / np.sqrt(g2)

    for _ in range(epochs):
        rng.shuffle(train)
        for lo in range(0, len(train), batch):
            own = train[lo : lo + batch]
            ids, first = _join([parts[i] for i in own])
            P, X, at = m.pooled(ids, first, want=True)
            p = 1 / (1 + np.exp(-np.clip(P @ m.v + m.c, -30, 30)))
            d = (weight[own] * (p - y[own]) / len(own)).astype(np.float32)
            dP = d[:, None] * m.v * (P > 0)
            rows, grads = [], []
            dK = []
            for k, w in enumerate(WIDTHS):
                cols = slice(k * FILTERS, (k + 1) * FILTERS)
                G, where = dP[:, cols], at[:, cols]
                g = np.empty_like(m.K[k])
                for j in range(w):
                    g[j] = np.einsum("rfd,rf->df", X[where + j], G)
                    rows.append(np.minimum(where + j, len(ids) - 1).ravel())
                    grads.append((G[:, :, None] * m.K[k][j].T[None]).reshape(-1, DIM))
                dK.append(g)
            used, inverse = np.unique(ids[np.concatenate(rows)].ravel(), return_inverse=True)
            dE = np.zeros((len(used), DIM), np.float32)
            np.add.at(dE, inverse, np.repeat(np.concatenate(grads), ids.shape[1], axis=0))
            dE, used = dE[used >= 0], used[used >= 0]
            g2 = past["E"][used] + dE * dE
            past["E"][used] = g2
            m.E[used] -= rate * dE / np.sqrt(g2)
            for k, g in enumerate(dK):
                m.K[k] = step(m.K[k], g, past["K"][k], rate / 4)
            m.v = step(m.v, P.T @ d, past["v"], rate / 4).astype(np.float32)
            m.b = step(m.b, dP.sum(0), past["b"], rate / 4).astype(np.float32)
            past["c"] += d.sum() ** 2
            m.c = np.float32(m.c - rate / 4 * d.sum() / np.sqrt(past["c"]))
    z = np.array([m.logits(*_join([parts[i]]))[0] for i in aside], np.float64)
    m.scale, m.shift = platt(z, y[aside], share)
    return m


def platt(z: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of the logistic fit of y on z, with classes weighted to `share` and targets smoothed."""
    n1, n0 = max(int(y.sum()), 1), max(int(len(y) - y.sum()), 1)
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.where(y == 1, share / n1, (1 - share) / n0) * len(y)
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        s = w * p * (1 - p) + 1e-9
        g = np.array([(w * (p - t) * z).sum() + 1e-3 * (a - 1), (w * (p - t)).sum()])
        H = np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]])
        move = np.linalg.solve(H, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -2, 2)
    return float(max(a, 1e-3)), float(b)


def _known(labels: DataFrame) -> DataFrame:
    """(doc_id, y, apart) of the labelled documents that may be learnt from."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    return known.withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit("apart")), F.lit(ASIDE)) == 0)


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES, **how) -> Model | None:
    """A model learnt from rows that are not held out."""
    known = _known(labels)
    totals = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("n1")).first()
    if not 0 < totals.n1 < totals.n:
        return None
    order = F.xxhash64("doc_id")
    kinds = [known.where((F.col("y") == y) & (F.col("apart") == apart)).orderBy(order, "doc_id").limit(max_docs // (ASIDE if apart else 1)) for y in (1, 0) for apart in (False, True)]
    sample = reduce(DataFrame.unionAll, kinds)
    own = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"), F.first("apart").alias("apart"))  # at most 2.4 x max_docs
    own = materialize(own.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))).withColumn("place", order), "toxicity-sample")
    room, chosen = {1: max_bytes // 2, 0: max_bytes // 2}, []
    for r in sorted(own.select("doc_id", "y", "size", "place").collect(), key=lambda r: (r.place, r.doc_id)):
        if r.size <= room[r.y]:
            room[r.y] -= r.size
            chosen.append((r.doc_id,))
    fits = docs.sparkSession.createDataFrame(chosen, docs.select("doc_id").schema)
    rows = own.join(F.broadcast(fits), "doc_id", "left_semi").collect()  # at most max_bytes
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text or "" for r in rows], np.array([r.y for r in rows]), np.array([r.apart for r in rows], bool), totals.n1 / totals.n, **how)


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id", "lang")) -> DataFrame:
    """`keep` of docs and the score of each whole text."""
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.drop("__text").schema), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if m is not None:
                data, off = tc.utf8(batch.column(len(keep)))
                for lo, raw, at in tc.blocks(data, off):
                    ids, first, _ = features(raw, at)
                    out[lo : lo + len(at) - 1] = m.scores(ids, first)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], [*keep, "score"])

    return source.mapInArrow(run, fields)


def thresholds(scores: DataFrame, labels: DataFrame, bins: int = 100) -> DataFrame:
    """lang, threshold: of the best F1 on labelled rows that are neither held out nor fitted."""
    known = _known(labels).where("apart")
    cell = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    table = scores.join(known, "doc_id").groupBy(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), cell.alias("bin")).agg(F.sum("y").alias("n1"), F.count("*").alias("n"))

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("bin", ascending=False)
        tp, n = pdf.n1.cumsum().to_numpy(float), pdf.n.cumsum().to_numpy(float)
        f1 = 2 * tp / (n + pdf.n1.sum())
        both = 0 < pdf.n1.sum() < pdf.n.sum()
        return pd.DataFrame({"lang": [key[0]], "threshold": [max(pdf.bin.to_numpy()[int(f1.argmax())] / bins, 1 / bins) if both else DEFAULT_THRESHOLD]})

    return table.groupBy("lang").applyInPandas(run, "lang string, threshold double")


def classify(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7), the language's threshold and flagged (score >= it)."""
    scores = materialize(score(docs, train(docs, labels, **how)), "toxicity-scores")
    cuts = thresholds(scores, labels).withColumnRenamed("lang", "__lang")
    out = scores.join(cuts, F.coalesce(F.col("lang").cast("string"), F.lit("")) == F.col("__lang"), "left")
    cut = F.coalesce("threshold", F.lit(DEFAULT_THRESHOLD))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= DEFAULT_THRESHOLD).cast("int").alias("predicted"), cut.alias("threshold"), (F.col("score") >= cut).alias("flagged"))
