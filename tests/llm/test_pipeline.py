"""Each stage against a brute-force version on its own input; the stages themselves are imported from the pipeline."""

import re

import corpus_pipeline

from . import test_quality_rules, test_simhash
from .cases import documents, texts, words


def test_stages(spark, tmp_path):
    rows = texts() + test_quality_rules.junk() + [f"{words(60, 70 + i)} mail me{i}@mail.example.org {words(9, i)}" for i in range(12)] + [words(80, 300 + i // 2) for i in range(10)]
    docs = documents(spark, rows)
    columns, names = docs.columns, [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, "unused")
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        rows = after.collect()
        if name != "packing":
            assert after.columns == columns
        if name == "quality rules":
            assert {r.doc_id for r in rows} == {d for d, r in before.items() if not test_quality_rules.plain(r.text)[5]}
        elif name == "near duplicates":
            held = sorted((d, test_simhash.plain(r.text)) for d, r in before.items())
            near = [(i, j) for i in range(len(held)) for j in range(i) if (held[i][1] ^ held[j][1]).bit_count() <= 2]
            assert sorted(r.doc_id for r in rows) == sorted({held[k][0] for k in test_simhash.roots(len(held), near)})
        elif name == "personal data":
            assert len(rows) == len(before) and not any(re.search(r"@mail", r.text) for r in rows)
            assert all(r.text == before[r.doc_id].text for r in rows if "@" not in before[r.doc_id].text and not re.search("[0-9]{4}", before[r.doc_id].text))
        elif name == "mixing":
            assert all(r == before[r.doc_id] for r in rows) and rows
        else:
            assert sorted({r.doc_id for r in rows}) == sorted(before)
        docs = after


def test_empty_table(spark):
    docs = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "unused")
    assert docs.count() == 0
