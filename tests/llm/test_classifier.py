import random
import zlib

import numpy as np

from vigil.llm import classifier

from .cases import documents, texts, words


def test_statistics_are_finite():
    rows = np.array([classifier.statistics(t) for t in texts()])
    assert np.isfinite(rows).all() and len({len(classifier.statistics(t)) for t in texts()}) == 1


def test_random_features_approximate_the_kernel():
    r = np.random.default_rng(0)
    d, n = 5, 20_000
    model = classifier.Model(np.zeros(d), np.ones(d), r.normal(size=(d, n)) / 2, r.uniform(0, 2 * np.pi, n), np.zeros(0), np.zeros(1), np.ones(1))
    x = r.normal(size=(12, d))
    f = model.features(x)[:, :n]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 4 / 2)
    assert np.abs(f @ f.T - want).max() < 0.05


def test_isotonic_against_a_plain_fit():
    r = np.random.default_rng(1)
    for _ in range(20):
        w, m = r.integers(1, 9, 12).astype(float), r.random(12)
        got = classifier.isotonic(w, m)
        want = [max(min((w[a:b] * m[a:b]).sum() / w[a:b].sum() for b in range(i + 1, 13)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(got, want)


def test_sums_over_partitions(spark):
    r = np.random.default_rng(2)
    x, y = r.normal(size=(200, 3)), r.integers(0, 2, 200).astype(float)
    model = classifier.Model(np.zeros(3), np.ones(3), r.normal(size=(3, 10)), r.uniform(0, 6, 10), np.zeros(0), np.zeros(1), np.ones(1))
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "x array<double>, y double").repartition(7)
    a, b = classifier.summed(rows, model)
    f = model.features(x)
    assert np.allclose(a, f.T @ f) and np.allclose(b, f.T @ y)


def test_held_out_accuracy(spark):
    r = random.Random(0)
    rows = [words(r.randint(20, 200), i) for i in range(700)]
    bad = [i % 6 == 0 for i in range(700)]
    rows = [" ".join(w + r.choice(["***", "%%%"]) for w in t.split()) if b and r.random() < 0.5 else t.upper().replace(" ", "!! ") if b else t for t, b in zip(rows, bad, strict=True)]
    docs = documents(spark, rows + texts())
    ids = [(i * 7919) % 100003 for i in range(700)]
    labels = spark.createDataFrame([(d, int(not b), 0) for d, b in zip(ids, bad, strict=True)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    out = {x.doc_id: x for x in classifier.classify(docs, labels).collect()}
    assert len(out) == 700 + len(texts())
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 and x.predicted == (x.score >= 0.3) for x in out.values())
    held = [(out[d].predicted, int(not b)) for d, b in zip(ids, bad, strict=True) if out[d].held_out]
    assert np.mean([p == q for p, q in held]) > 0.97
    assert classifier.classify(docs.limit(0), labels).count() == 0
    assert {x.score for x in classifier.classify(docs, labels.limit(0)).collect()} == {1.0}
