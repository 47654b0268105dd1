from collections import defaultdict

from vigil.llm import mixing

from .cases import documents, words


def shares(sizes):
    """The rule as stated, over and over until no target is above three times its source's size."""
    total, fixed = sum(s for _, s in sizes), {}
    while True:
        left = total - sum(fixed.values())
        rest = [(i, w, s) for i, (w, s) in enumerate(sizes) if i not in fixed]
        weight = sum(w for _, w, _ in rest)
        new = {i: left * w / weight for i, w, _ in rest}
        over = {i: 3 * s for i, _, s in rest if new[i] > 3 * s}
        if not over:
            return [(fixed | new)[i] for i in range(len(sizes))]
        fixed |= over


def check(docs, rows):
    sizes = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    by = defaultdict(list)
    for r in rows:
        assert r.size == len((sizes[r.doc_id] or "").split())
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        by[r.source_size, r.target].append(r)
    return by


def test_targets_and_taken_words(spark):
    docs = documents(spark, [words(3 + (i * 37) % 90, i) for i in range(3000)])
    named = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    rows = mixing.mixed_words(docs).collect()
    check(docs, rows)
    source = defaultdict(int)
    for r in rows:
        source[named[r.doc_id]] += r.size
    order = sorted(source, key=lambda s: (s is None, s or ""))
    expected = dict(zip(order, shares([(i % 3 + 1, source[s]) for i, s in enumerate(order)]), strict=True))
    taken = defaultdict(int)
    for r in rows:
        s = named[r.doc_id]
        taken[s] += r.taken
        assert r.source_size == source[s] and abs(r.target - expected[s]) < 1e-6
    for s in order:
        assert abs(taken[s] - expected[s]) <= 0.01 * expected[s] + 100
    assert sorted(mixing.mixed_words(docs.repartition(7)).collect()) == sorted(rows)
    assert mixing.mixed_documents(docs).count() == sum(r.taken // r.size for r in rows)


def test_caps_are_shared_again(spark):
    sizes = [1, 2, 500, 4, 900]
    docs = spark.createDataFrame([(i, " ".join(["w"] * n), f"s{i}") for i, n in enumerate(sizes)], "doc_id long, text string, source string")
    got = {r.source: r.target for r in mixing.source_targets(docs.selectExpr("source", "size(split(text, ' ')) AS size")).collect()}
    want = shares([(i % 3 + 1, n) for i, n in enumerate(sizes)])
    assert all(abs(got[f"s{i}"] - x) < 1e-6 for i, x in enumerate(want))


def test_awkward_documents(spark):
    docs = documents(spark)
    assert len(mixing.mixed_words(docs).collect()) == docs.count()
    check(docs, mixing.mixed_words(docs).collect())
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mixed_words(docs.limit(0)).count() == 0
    empty = mixing.mixed_words(documents(spark, ["", None, " "])).collect()
    assert all(r.taken == 0 and r.target == 0 for r in empty)
    assert mixing.mixed_words(docs.union(docs)).count() == 2 * docs.count()
