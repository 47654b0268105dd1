import json

import pytest

from vigil.operators import features, sessions
from vigil.sources import broker, files
from vigil.sources.state import StateError, StateTable
from vigil.streaming import engine

from .test_features import CANONICAL, HOUR, T0, canonical, event, frame
from .test_rules_and_parsing import GITLAB, SSO, SVN


def test_stream_equals_batch(spark, tmp_path):
    rows = [canonical(f"e{i}", time=f"2026-01-01T{(i * 5) % 24:02d}:{(i * 7) % 60:02d}:00Z", user=f"u{i % 3}") for i in range(40)] + [canonical("bad", user="")]
    parts = [rows[20:], rows[:25], rows[30:]]  # late, overlapping, and known events
    for i, p in enumerate(parts):
        spark.createDataFrame(p, CANONICAL).coalesce(1).write.json(str(tmp_path / f"in/{i}"))
    seen = []
    stream = spark.readStream.schema(CANONICAL).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
    start = lambda: engine.run(stream, str(tmp_path / "state"), str(tmp_path / "checkpoint"), lambda events, n: seen.append((n, sessions.sessions(events).select("session_id").collect())))
    start().awaitTermination()
    batch = features.accepted(features.admit(spark.createDataFrame(rows, CANONICAL)))
    want = sorted(sessions.sessions(batch).select("session_id").collect())
    assert len(seen) >= 2 and sorted(seen[-1][1]) == want
    table = StateTable(spark, str(tmp_path / "state"), engine.VERSION, {})
    assert sorted(features.user_windows(engine.accepted(table)).collect()) == sorted(features.user_windows(batch).collect())
    rev = table.current()[0]
    done = len(seen)
    start().awaitTermination()  # nothing new
    assert table.current()[0] == rev and len(seen) == done
    assert engine.absorb(table, features.admit(spark.createDataFrame(rows[:3], CANONICAL))) == rev  # a batch that comes again


KAFKA = "topic string, partition int, offset long, timestamp timestamp, value string"


def test_parse_stream_goes_on_where_it_stopped(spark, tmp_path):
    """Messages of a topic, some of which come in a second run."""

    def put(name, rows, first):
        data = [("t", 0, first + i, None, x) for i, x in enumerate(rows)]
        spark.createDataFrame(data, KAFKA).coalesce(1).write.json(str(tmp_path / "in" / name))

    def start(**options):
        messages = spark.readStream.schema(KAFKA).option("recursiveFileLookup", "true").json(str(tmp_path / "in"))
        records = files.kafka_records(messages, "k", "auto")
        engine.parse_stream(records, str(tmp_path / "out"), str(tmp_path / "checkpoint"), **options).awaitTermination()
        return StateTable(spark, str(tmp_path / "out/quality"), engine.VERSION, {"parsers": [], "config": {}, "folder": str(tmp_path / "out")})

    put("a", [SVN, SSO, "nothing"], 0)
    table = start()
    one = table.notes()
    assert one["records"] == 3
    put("b", [GITLAB, "nothing else"], 3)
    two = start().notes()
    assert two["records"] == 5 and two["batch"] == one["batch"] + 1 and two["chain"] != one["chain"]
    assert start().notes() == two
    good, unknown = engine.parsed(spark, str(tmp_path / "out"))
    assert good.count() == 3 and unknown.count() == 2
    counts = {(r.measure, r.key): r.n for r in table.current()[1].collect()}
    assert counts[("normalized", "")] == 3 and counts[("unknown", "")] == 2 and counts[("reason", "no_parser")] == 2
    with pytest.raises(StateError):
        start(config={"other": 1})


def test_broker_commits_come_last(spark, tmp_path):
    """Outputs, then the state, then the broker: a refused commit loses nothing and repeats nothing."""
    box = broker.Broker(str(tmp_path / "broker"))
    box.send("t", 0, [SVN, "nothing"], 1_700_000_000_000)
    box.send("t", 1, [SSO.encode(), b"\xff\xfe"])
    out = str(tmp_path / "out")

    def start(checkpoint="checkpoint"):
        engine.consume(spark, box.folder, ["t"], "g", ("k", "auto"), out, str(tmp_path / checkpoint)).awaitTermination()
        return engine.parse_state(spark, out).notes()

    def found():
        good, unknown = engine.parsed(spark, out)
        return sorted((r.raw.record_id, r.raw.storage_ref) for r in good.collect()), sorted(r.raw_text for r in unknown.collect())

    box.refuse()
    with pytest.raises(Exception, match="refuses"):
        start()
    first = engine.parse_state(spark, out).notes()
    assert (first["records"], first["commits"], first["offsets"]) == (4, 1, {"t": {"0": 2, "1": 2}}) and box.committed("g") == {}
    seen = found()
    assert [ref for _, ref in seen[0]] and {ref for _, ref in seen[0]} == {"kafka://t/0/0", "kafka://t/1/0"} and seen[1] == ["nothing", "\ufffd\ufffd"]
    box.refuse(False)
    assert start() == first and box.committed("g") == {"t": {"0": 2, "1": 2}} and found() == seen  # the batch comes again, and is known
    box.send("t", 0, [GITLAB])
    box.send("t", 2, ["more"])
    second = start()
    assert (second["records"], second["commits"]) == (6, 2) and second["chain"] != first["chain"] and box.committed("g") == {"t": {"0": 3, "1": 2, "2": 1}}
    box.send("t", 1, ["last"])
    third = start("another")  # Spark's own checkpoint is lost: the state says where to go on
    assert (third["records"], third["commits"]) == (7, 3) and len(found()[0]) == 3 and len(found()[1]) == 4
    (tmp_path / "out/unknown/batch=3").mkdir()
    found_rows = engine.parsed(spark, out)[1].count()
    assert found_rows == 4  # a folder without a commit is not read
    assert list(box.read("t", 0, 1, 3)) == [(1, 1_700_000_000_000, b"nothing"), (2, 0, GITLAB.encode())]


def test_produced_topics(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(broker, "SEGMENT", 3)
    rows = spark.createDataFrame([(i % 2, f"v{i:02d}") for i in range(17)], "partition int, value string")
    assert sorted(map(tuple, broker.produce(rows, str(tmp_path), "t").collect())) == [(0, 9), (1, 8)]
    box = broker.Broker(str(tmp_path))
    assert box.ends(["t", "none"]) == {"t": {"0": 9, "1": 8}, "none": {}}
    assert [v.decode() for _, _, v in box.read("t", 1, 2, 7)] == [f"v{i:02d}" for i in (5, 7, 9, 11, 13)]


def test_file_that_grows(spark, tmp_path):
    path, seen = tmp_path / "events.jsonl", []

    def line(i, minute, user="ana"):
        e = canonical(i, time=f"2026-01-01T{9 + minute // 60:02d}:{minute % 60:02d}:00Z", user=user)
        keys = [["id", "time", "action", "outcome"], ["name"], ["ip"], ["type", "id", "name"], ["bytes"], ["source_type", "source_id"]]
        names = ["event", "user", "source", "resource", "network", "raw"]
        return json.dumps({n: dict(zip(k, v, strict=True)) for n, k, v in zip(names, keys, e, strict=True)})

    def follow(**options):
        return engine.follow(spark, str(path), str(tmp_path / "state"), CANONICAL, lambda events, mark: seen.append((events.count(), mark)), **options)

    path.write_text(line("a", 0) + "\n" + line("b", 10) + "\n" + line("c", 200) + "\n" + '{"event": ')
    first = follow()
    assert (first["new"], first["closed"]) == (3, 1) and first["watermark"] == T0 + 9 * HOUR + 195 * 60_000
    assert first["offset"] == len(line("a", 0)) + len(line("b", 10)) + len(line("c", 200)) + 3
    assert follow()["new"] == 0  # the last line is not whole
    body = path.read_text().removesuffix('{"event": ')
    path.write_text(body + line("late", 5) + "\n" + line("a", 0) + "\n" + line("d", 400) + "\n")
    second = follow()
    assert second["new"] == 2 and second["closed"] == 2  # the late event's own session, and that of c
    closed = StateTable(spark, str(tmp_path / "state/sessions"), engine.VERSION, {"lag_s": 300, "schema": CANONICAL, "path": str(path)}).current()[1]
    assert sorted((r.start_time - T0 - 9 * HOUR, r.event_count) for r in closed.collect()) == [(0, 2), (300_000, 1), (200 * 60_000, 1)]
    assert [n for n, _ in seen] == [3, 3, 5]
    path.write_text(path.read_text().replace('"id": "b"', '"id": "B"'))
    with pytest.raises(StateError):
        follow()
    with pytest.raises(StateError):
        follow(lag_s=5)


def test_closed_sessions_stay(spark):
    ev = lambda *rows: frame(spark, [event(*r) for r in rows])
    done, pool, open_ = sessions.advance(sessions.none_closed(ev(("x", 0))), ev(("x", 0)).limit(0), ev(("a", 0), ("b", HOUR // 4), ("c", 10 * HOUR)), T0 + 5 * HOUR)
    assert [(r.event_count, r.close_reason) for r in done.collect()] == [(2, "watermark")] and [r.event_id for r in pool.collect()] == ["c"] and open_.count() == 1
    done, pool, _ = sessions.advance(done, pool, ev(("late", HOUR // 3)), T0 + 5 * HOUR)
    assert sorted(r.event_count for r in done.collect()) == [1, 2]
    assert sorted((r.event_count, r.close_reason) for r in sessions.flushed(done, pool).collect()) == [(1, "end_of_input"), (1, "watermark"), (2, "watermark")]


def test_modes(spark, tmp_path):
    mode = engine.Mode(StateTable(spark, str(tmp_path / "s"), 1, {}))
    mode.enter("replay")
    with pytest.raises(StateError):
        mode.enter("realtime")
    mode.finish()
    with pytest.raises(StateError):
        mode.enter("replay")
    mode.enter("realtime")
    with pytest.raises(StateError):
        mode.finish()
    with pytest.raises(StateError):
        mode.enter("replay")
    with pytest.raises(StateError):
        mode.enter("other")
