"""State by key, and the chain kept up to date, against runs over everything."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import detection, features
from vigil.plans.chain import Chain
from vigil.plans.live import Live
from vigil.sources.keyed import KeyedTable
from vigil.sources.state import StateError

from .test_features import HOUR, T0, event, frame

DAY = 24 * HOUR
LOW = {"min_active_days": 3, "min_samples": 3, "min_peer_members": 2, "min_peer_active_days": 3, "min_peer_samples": 5}
RULE = {"rule_id": "fails", "version": 1, "name": "n", "scope": "event", "status": "active", "score": 65, "match": "all", "conditions": [{"field": "event.outcome", "operator": "eq", "value": "failure"}]}


def test_keyed_table_reads_and_writes_buckets_of_its_keys(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "k"), 1, {}, "k", buckets=8, most_parts=3)
    assert table.current() == (0, None) and table.lookup("a") is None and table.changed_since(0) is None
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v int")
    table.add(rows(*[(f"k{i}", i) for i in range(40)]))
    before = table.manifest()["parts"]
    assert len(before) == 8 and table.current()[1].count() == 40
    keys = rows(("k3", 0)).select("k")
    (bucket,) = table.buckets_of(keys)
    assert len(table.parts_of({bucket})) == 1
    rev = table.replace(rows(("k3", 33), ("k3", 34)), keys)
    after = table.manifest()["parts"]
    assert len(set(before) - set(after)) == 1 and len(set(after) - set(before)) == 1  # one bucket was written again
    assert sorted(r.v for r in table.lookup("k3").collect()) == [33, 34] and table.current()[1].count() == 41
    assert len(table.lookup("k3").inputFiles()) == 1 and [r.k for r in table.changed_since(rev - 1).collect()] == ["k3"]
    assert table.lookup("none").count() == 0 and table.of(rows(("none", 1))).count() == 0
    for i in range(5):
        table.add(rows(("k3", 50 + i)))
    assert len(table.parts_of({bucket})) <= 3 and sorted(r.v for r in table.lookup("k3").collect()) == [33, 34, 50, 51, 52, 53, 54]
    assert sorted(r.k for r in table.changed_since(rev).collect()) == ["k3"]
    assert table.replace(rows(("x", 1)).limit(0), keys) and table.lookup("k3").count() == 0 and table.current()[1].count() == 39
    held = len({p.partition("/")[0] for p in table.manifest()["parts"]})
    assert table.vacuum() > 0 and len([p for p in (tmp_path / "k").iterdir() if p.name.startswith("part-")]) == held and table.current()[1].count() == 39
    with pytest.raises(StateError):
        KeyedTable(spark, str(tmp_path / "k"), 1, {}, "k", buckets=4).current()


def rows_of(df, *drop):
    return sorted(map(str, df.select(*sorted(c for c in df.columns if c not in drop)).collect()))


VERSIONED = ("candidate_id", "revision", "supersedes")


def generated(n, seed):
    r = random.Random(seed)
    return [event(f"e{seed}-{i}", r.randrange(12) * DAY + r.randrange(24) * HOUR + r.randrange(HOUR), user=f"u{r.randrange(6)}", outcome=r.choice(["success", "failure", "success"]), action=r.choice(["repo_read", "repo_write"])) for i in range(n)]


def test_batches_equal_a_run_over_all(spark, tmp_path, monkeypatch):
    peers = spark.createDataFrame([(f"u{i}", f"g{i % 2}") for i in range(8)], "user_name string, group_id string")
    live = Live(spark, str(tmp_path / "live"), peers, [RULE], config=LOW, buckets=16)
    assert live.detect() is None and live.step(frame(spark, generated(3, 0)).withColumn("reason", F.lit("bad"))) is None
    first, second = generated(150, 1), [event("n1", 5 * DAY + 100, user="u1"), event("n2", 11 * DAY, user="u1", outcome="failure")]
    admitted = lambda rows: frame(spark, rows).withColumn("reason", F.lit(None).cast("string"))
    as_of = T0 + 12 * DAY

    def same(rows, rules):
        whole = Chain(frame(spark, rows), peers, rules=rules, as_of_ms=as_of, baseline_config=LOW)
        assert rows_of(live.windows.current()[1]) == rows_of(whole.windows)
        assert rows_of(live.personal.current()[1]) == rows_of(whole.personal) and rows_of(live.groups.current()[1]) == rows_of(whole.groups)
        assert rows_of(live.candidates.current()[1].where("status = 'active'"), *VERSIONED, "status") == rows_of(whole.candidates)

    live.step(admitted(first), as_of)
    same(first, [RULE])
    events, windows = set(live.events.manifest()["parts"]), set(live.windows.manifest()["parts"])
    looked = []
    of = KeyedTable.of
    monkeypatch.setattr(KeyedTable, "of", lambda self, keys: looked.append((self.folder.rpartition("/")[2], sorted(r[0] for r in keys.distinct().collect()))) or of(self, keys))
    users = live.take(admitted(second + first[:5]))
    assert [r.user_name for r in users.collect()] == ["u1"]
    assert ("events", ["u1"]) in looked and all(keys == ["u1"] for name, keys in looked if name != "ids")
    assert events < set(live.events.manifest()["parts"]) and len(windows - set(live.windows.manifest()["parts"])) == 1  # one user's bucket
    with pytest.raises(StateError, match="baselines"):
        live.detect()  # they are those of the windows before
    live.build(as_of)
    live.detect()
    same(first + second, [RULE])
    rev = live.candidates.manifest()["rev"]
    assert live.step(admitted(second)) is not None and live.candidates.manifest()["rev"] == rev  # nothing new
    harder = {**RULE, "version": 2, "conditions": [*RULE["conditions"], {"field": "event.action", "operator": "eq", "value": "repo_write"}]}
    live.rules = [harder]
    live.detect()
    same(first + second, [harder])
    old = live.candidates.current()[1].where("status = 'superseded' AND detector_id = 'fails'")
    assert old.count() >= frame(spark, first + second).where("outcome = 'failure'").count()


def test_a_crash_between_tables_is_made_good(spark, tmp_path, monkeypatch):
    peers = spark.createDataFrame([("u1", "g")], "user_name string, group_id string")
    live = Live(spark, str(tmp_path / "live"), peers, config=LOW, buckets=4)
    batch = frame(spark, generated(20, 3)).withColumn("reason", F.lit(None).cast("string"))

    def lost(*a, **k):
        raise KeyboardInterrupt

    for target in (live.ids, live.windows):
        with monkeypatch.context() as m:
            m.setattr(target, "add" if target is live.ids else "replace", lost)
            with pytest.raises(KeyboardInterrupt):
                live.take(batch)
        if target is live.windows:
            with pytest.raises(StateError):
                live.build(T0 + DAY)
    live.take(batch)
    assert rows_of(live.windows.current()[1]) == rows_of(features.user_windows(frame(spark, generated(20, 3)))) and live.events.current()[1].count() == 20


def test_report_order_and_limit(spark):
    rows = spark.createDataFrame([("b", 60, 5), ("a", 60, 5), ("c", 80, 1), ("d", 60, 9)], "candidate_key string, score int, window_start long")
    assert [r.candidate_key for r in detection.reported(rows).collect()] == ["c", "d", "a", "b"] and [r.candidate_key for r in detection.reported(rows, 2).collect()] == ["c", "d"]


def test_rows_that_stay_are_written_without_a_shuffle(spark, tmp_path, monkeypatch):
    """A change of a few keys shuffles their new rows alone; what stays is written from where it lies."""
    from vigil.sources.keyed import KeyedTable

    table = KeyedTable(spark, str(tmp_path / "k"), 1, {}, "k", buckets=4)
    table.add(spark.range(1000).selectExpr("id % 50 AS k", "id AS v"))
    plans, put = [], KeyedTable._put

    def seen(self, rows, part):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return put(self, rows, part)

    monkeypatch.setattr(KeyedTable, "_put", seen)
    monkeypatch.setattr("vigil.sources.keyed.SMALL_BYTES", 0)
    table.replace(spark.createDataFrame([(7, -1)], "k long, v long"), spark.createDataFrame([(7,), (8,)], "k long"))
    assert len(plans) == 2 and "Exchange hashpartitioning(_bucket" not in plans[0] and "Sort" not in plans[0]
    want = {(i % 50, i) for i in range(1000) if i % 50 not in (7, 8)} | {(7, -1)}
    assert {tuple(r) for r in table.current()[1].select("k", "v").collect()} == want
    assert {tuple(r) for r in table.lookup(7, 8).select("k", "v").collect()} == {(7, -1)}
