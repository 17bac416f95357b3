"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another; a later model sees the earlier categories'
probabilities beside the text features. While it is trained it sees out-of-fold predictions (each
row's from models that saw neither the row nor a copy of its text, as folds are dealt by a hash of
the features), so it learns how far to trust them on unseen documents.

Features are the lower-cased words and their 4 to 6 letter beginnings (stems carry over to unseen
endings), hashed to 32 bits; a model keeps the FEATURES with the strongest association and weighs
them by logistic regression. Training takes a bounded sample: ``SAMPLE`` labelled rows, half of
them positive in the last category where there are as many, chosen by hash of doc_id; the
probability is corrected for that by the rates over all labels, but passed on as it was trained. Only the sample's hashed features
come to the driver. Scoring reads every whole document where it lies, without a shuffle.

Defined cases: a null text has no feature and scores its category's base rate; documents with a
null ``doc_id`` are scored and never train; null labels don't train; a document labelled twice
trains twice; without labels or with one class only the probability is that class's rate; other
columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow

SAMPLE, FEATURES, FOLDS, ROUNDS = 8000, 1024, 3, 200
L2 = 2e-4
THRESHOLD = 0.5
STEMS = (4, 5, 6)
WORD = regex.compile(r"[\p{L}\p{M}]+")
REMEMBER = 300_000


def word_features(word: str) -> list[int]:
    """Hashes of a lower-cased word and of its beginnings."""
    return [zlib.crc32(word.encode())] + [zlib.crc32(f"{word[:n]}*".encode()) for n in STEMS if len(word) > n]


def text_features(text: str | None) -> np.ndarray:
    """Distinct features of a whole text, sorted."""
    words = set(WORD.findall((text or "").lower()))
    return np.unique(np.array([f for w in words for f in word_features(w)], np.int64))


class Model:
    """Feature weights by hash, of earlier categories' probabilities, and the intercept; ``shift`` corrects the final log-odds."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, earlier: np.ndarray, bias: float):
        self.ids, self.weights, self.earlier, self.bias, self.shift = ids, weights, earlier, bias, 0.0

    def logit(self, rows: Sequence[np.ndarray], earlier: np.ndarray) -> np.ndarray:
        row, col = entries(self.ids, rows)
        return np.bincount(row, self.weights[col], len(rows)) + (earlier * self.earlier).sum(1) + self.bias


def probability(logit):
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def entries(ids: np.ndarray, rows: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ones of the rows-by-``ids`` matrix."""
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows]) if len(rows) else np.zeros(0, np.int64)
    if not len(ids):
        return row[:0], flat[:0]
    col = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
    hit = ids[col] == flat
    return row[hit], col[hit]


def chosen(rows: Sequence[np.ndarray], y: np.ndarray, most: int) -> np.ndarray:
    """The features with the largest chi-squared against y, of those in two rows at least."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    ids, inverse = np.unique(flat, return_inverse=True)
    of = np.repeat(y, [len(r) for r in rows])
    n = np.bincount(inverse, minlength=len(ids)).astype(float)
    pos = np.bincount(inverse, weights=of, minlength=len(ids))
    rate = y.mean()
    chi = (pos - n * rate) ** 2 / np.maximum(n * rate * (1 - rate) * (1 - n / (len(y) + 1)), 1e-9)
    keep = np.flatnonzero(n >= 2)
    best = keep[np.lexsort((ids[keep], -chi[keep]))[:most]]
    return np.sort(ids[best])


def fit(rows: Sequence[np.ndarray], y: np.ndarray, earlier: np.ndarray, most: int = FEATURES) -> Model:
    """L2 logistic regression by accelerated gradient steps; deterministic."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), base)
    ids = chosen(rows, y, most)
    n, k = len(y), len(ids)
    row, col = entries(ids, rows)
    # Columns of earlier probabilities are scaled; sums over entries keep this off threaded algebra.
    scale = np.maximum(np.sqrt((earlier**2).mean(0)), 1e-3)
    dense = np.hstack([earlier / scale, np.ones((n, 1))])
    times = lambda v: np.bincount(row, v[:k][col], n) + (dense * v[k:]).sum(1)
    back = lambda r: np.append(np.bincount(col, r[row], k), (dense * r[:, None]).sum(0))
    v = np.ones(k + dense.shape[1])
    for _ in range(12):  # the largest eigenvalue bounds the step
        v = back(times(v))
        v /= np.sqrt((v * v).sum())
    u = back(times(v))
    step = 1 / (np.sqrt((u * u).sum()) / (4 * n) * 1.1 + L2)
    w = np.zeros(len(v))
    w[-1] = base
    z, t = w.copy(), 1.0
    for _ in range(ROUNDS):
        g = back(probability(times(z)) - y) / n + L2 * np.append(z[:-1], 0)
        new, t2 = z - step * g, (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return Model(ids, w[:k], w[k:-1] / scale, float(w[-1]))


def fit_chain(rows: Sequence[np.ndarray], labels: np.ndarray, folds: int = FOLDS) -> list[Model]:
    """One model per column of ``labels``; later ones are trained on out-of-fold probabilities of the earlier."""
    n, k = labels.shape
    oof, chain = np.zeros((n, 0)), []
    fold = np.array([zlib.crc32(r.tobytes()) for r in rows], np.int64) % folds
    for c in range(k):
        y = labels[:, c].astype(float)
        chain.append(fit(rows, y, oof))
        if c + 1 < k:
            out = np.zeros(n)
            for f in range(folds):
                a, b = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
                m = fit([rows[i] for i in a], y[a], oof[a])
                out[b] = probability(m.logit([rows[i] for i in b], oof[b]))
            oof = np.hstack([oof, out[:, None]])
    return chain


class Scorer:
    """Whole texts to the probabilities of all categories."""

    def __init__(self, chain: list[Model]):
        self.chain = chain
        self.ids = np.unique(np.concatenate([m.ids for m in chain])) if chain else np.zeros(0, np.int64)
        self.place = {int(f): i for i, f in enumerate(self.ids)}
        self.weights = np.zeros((len(chain), len(self.ids)))
        for c, m in enumerate(chain):
            self.weights[c, np.searchsorted(self.ids, m.ids)] = m.weights
        self.known: dict[str, tuple[int, ...]] = {}

    def probabilities(self, text: str | None) -> list[float]:
        on: set[int] = set()
        if len(self.known) > REMEMBER:
            self.known.clear()
        known = self.known
        for w in set(WORD.findall((text or "").lower())):
            got = known.get(w)
            if got is None:
                got = tuple(i for f in word_features(w) if (i := self.place.get(f)) is not None)
                if len(w) <= 64:
                    known[w] = got
            if got:
                on.update(got)
        z = self.weights[:, sorted(on)].sum(1)
        logits: list[float] = []
        for c, m in enumerate(self.chain):
            logits.append(float(z[c] + m.bias + (m.earlier * probability(np.array(logits))).sum()))
        return [float(probability(x + m.shift)) for x, m in zip(logits, self.chain, strict=True)]


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str], sample: int = SAMPLE) -> list[Model]:
    """``labels``: doc_id and a 0/1 column per category. The driver receives ``sample`` rows of features at most."""
    lab = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    rates = lab.agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in categories]).first()
    last = categories[-1]
    order = F.xxhash64("doc_id")
    half = lambda v, n: lab.filter(F.col(last) == v).orderBy(order, "doc_id", *categories).limit(n)
    ones = min(sample // 2, int(rates[last] or 0))
    picked = half(1, ones).unionByName(half(0, sample - ones))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                p = b.slice(lo, 500)
                f = pa.array([text_features(t.as_py()) for t in p.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([p.column(0), f, *p.columns[2:]], ["doc_id", "f", *categories])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    got = map_arrow(d.select("doc_id", "text", *categories), features, "doc_id long, f array<long>, " + ", ".join(f"{c} int" for c in categories)).toArrow().combine_chunks()
    order = np.lexsort([np.array([len(x) for x in got.column("f")], np.int64), got.column("doc_id").to_numpy()]) if got.num_rows else np.zeros(0, int)
    f = got.column("f").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int64()))
    flat, off = (f.flatten().to_numpy(), f.offsets.to_numpy() - f.offsets[0].as_py()) if got.num_rows else (np.zeros(0, np.int64), np.zeros(1, int))
    rows = [flat[off[i] : off[i + 1]] for i in order]
    y = np.array([got.column(c).to_numpy()[order] for c in categories], np.int64).reshape(len(categories), -1).T
    chain = fit_chain(rows, y)
    for c, m in zip(categories, chain, strict=True):  # the sample's rates against those of all labels
        if got.num_rows:
            all_rate = (float(rates[c] or 0) + 0.5) / (rates["n"] + 1)
            here = (float(y[:, list(categories).index(c)].sum()) + 0.5) / (len(y) + 1)
            m.shift = float(np.log(all_rate / (1 - all_rate)) - np.log(here / (1 - here)))
    return chain


def score(docs: DataFrame, chain: list[Model], categories: Sequence[str]) -> DataFrame:
    """doc_id and ``p_<category>`` for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # FEATURES weights per category at most
    names = ["doc_id", *[f"p_{c}" for c in categories]]
    d = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(shared.value)
        for b in batches:
            p = [s.probabilities(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[i] for x in p], pa.float64()) for i in range(len(categories))]], names)

    return map_arrow(d, run, f"doc_id {dict(d.dtypes)['doc_id']}, " + ", ".join(f"{n} double" for n in names[1:]))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Low quality first, as junk is mostly not toxic, then toxicity."""
    cats = ["low_quality", "toxic"]
    lab = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    out = score(docs, train(docs, lab, cats), cats)
    return out.withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
