import random

import numpy as np

from vectorloom.llm import toxicity

from .helpers import clashing, docs, rows


def made(n, seed=1):
    """Toxic texts hold a stem with a random ending; low quality ones repeat a mark."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    pairs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(r.choice([20, 60, 200]))]
        tox, low = i % 5 == 0, i % 7 == 0
        for _ in range(3 if tox else 0):
            w[r.randrange(len(w))] = "vrumok" + word()
        if low:
            w[r.randrange(len(w))] = "zzjunk"
        pairs.append((i, " ".join(w)))
        labels.append((i, int(not low), int(tox)))
    return pairs, labels


def test_unseen_documents(spark):
    pairs, labels = made(1200)
    lab = spark.createDataFrame(labels[:600], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.query(clashing(docs(spark, pairs)), lab).collect()}
    test = labels[600:]
    assert np.mean([got[i].toxic == bool(t) for i, _, t in test]) >= 0.98
    assert np.mean([(got[i].p_low_quality >= 0.5) == (q == 0) for i, q, _ in test]) >= 0.95


def test_odd_rows(spark):
    pairs, labels = made(60)
    odd = [(None, pairs[0][1]), (900, None), (901, ""), (902, "x " * 30000), (0, pairs[0][1])]
    lab = spark.createDataFrame([*labels, (900, 1, 0), (901, None, 1), (None, 1, 1), labels[3]], "doc_id long, quality int, toxic int")
    out = toxicity.query(docs(spark, pairs + odd), lab).collect()
    assert len(out) == 65 and all(0 <= r.p_toxic <= 1 for r in out)
    none = toxicity.query(docs(spark, pairs), lab.limit(0)).collect()
    assert len(none) == 60 and len({r.p_toxic for r in none}) == 1
    assert rows(toxicity.query(docs(spark, []), lab)) == []


def test_chain_uses_earlier_predictions():
    """The second category is the first one; its own features say nothing."""
    r = np.random.default_rng(0)
    y = r.integers(0, 2, 400)
    rows = [np.unique(np.r_[r.integers(1000, 2000, 5), [1] if t else [2]]) for t in y]
    first, second = toxicity.fit_chain(rows, np.stack([y, y], 1))
    assert second.earlier[0] > 0.2
    p = toxicity.probability(first.logit(rows, np.zeros((400, 0))))
    assert ((second.logit(rows, p[:, None]) > 0) == (y == 1)).mean() > 0.95


def test_copies_share_a_fold():
    """Each text twice, with labels of no pattern: were copies in two folds, the first category's predictions would give the second away."""
    r = np.random.default_rng(3)
    y = np.repeat(r.integers(0, 2, 200), 2)
    rows = [np.unique(x) for x in np.repeat(r.integers(1, 10**6, (200, 8)), 2, 0)]
    _, second = toxicity.fit_chain(rows, np.stack([y, y], 1))
    assert second.earlier[0] < 0.5


def test_scores_against_the_chain_by_hand(spark):
    pairs, labels = made(300)
    d = docs(spark, pairs)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    cats = ["quality", "toxic"]
    chain = toxicity.train(d, lab, cats)
    for r in toxicity.score(d, chain, cats).collect():
        words = set(toxicity.WORD.findall(dict(pairs)[r.doc_id].lower()))
        have = {f for w in words for f in toxicity.word_features(w)}
        fed, want = [], []
        for m in chain:
            z = m.bias + sum(w for f, w in zip(m.ids.tolist(), m.weights.tolist(), strict=True) if f in have) + sum(a * b for a, b in zip(m.earlier.tolist(), fed, strict=True))
            fed.append(1 / (1 + np.exp(-z)))
            want.append(1 / (1 + np.exp(-z - m.shift)))
        assert np.allclose([r.p_quality, r.p_toxic], want, atol=1e-9)


def test_held_out_labels(spark):
    """Half of the labels of the driver's tables train, the other half is judged."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    lab = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    half = [p.cache() for p in lab.randomSplit([0.5, 0.5], 7)]
    got = toxicity.query(d, half[0]).join(half[1].select("doc_id", "toxic").withColumnRenamed("toxic", "y"), "doc_id").collect()
    hit = sum(r.toxic and r.y == 1 for r in got)
    assert hit >= 0.8 * sum(r.y == 1 for r in got) and hit >= 0.97 * sum(r.toxic for r in got) and hit > 100
