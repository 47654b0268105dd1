import re
from collections import defaultdict

from vigil.llm import quality_rules

from .cases import documents, texts, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def junk():
    return ["a b c d e f g h " * 3 + words(30, 3), "x y z w v " * 2 + words(60, 4), "x y z w v x y z w v x " + words(50, 5), "p q r s t u p q r s t " + words(200, 6), "### $$$ %%% | <b> & *" * 4, "l1 l2\nl1 l2\nl1 l2\n" + words(40, 7)]


def test_counts(spark):
    rows = texts() + junk()
    docs = documents(spark, rows)
    at = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    out = quality_rules.quality_verdicts(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        want = plain(at[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not r.base_failed and r.host_rate <= 0.5)


def test_bad_hosts_are_rejected_and_small_ones_shrunk(spark):
    good, bad = words(50, 1), "too short"
    rows = [(f"good{k}", good) for k in range(6) for _ in range(20)] + [("bad", bad)] * 19 + [("bad", good), ("small", bad), (None, good)]
    docs = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(rows)], "doc_id long, text string, source string")
    counted = quality_rules.rule_counts(docs)
    hosts = {r.host: r for r in quality_rules.host_verdicts(counted).collect()}
    assert hosts["bad"].host_rejected and not hosts["good0"].host_rejected and not hosts[None].host_rejected
    assert hosts["small"].host_rate < 1
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    verdicts = {r.doc_id for r in quality_rules.quality_verdicts(docs).collect() if r.kept}
    assert {r.doc_id for r in kept.collect()} == verdicts
    assert not any(r.source == "bad" for r in kept.collect())


def test_empty_table_and_repeated_rows(spark):
    docs = documents(spark)
    assert quality_rules.quality_verdicts(docs.limit(0)).count() == 0 and quality_rules.keep_good(docs.limit(0)).count() == 0
    assert quality_rules.quality_verdicts(docs.union(docs)).count() == 2 * docs.count()


def test_no_python_in_the_plan(spark):
    plan = quality_rules.quality_verdicts(documents(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
