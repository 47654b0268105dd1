"""Registered queries of streams, resumed runs, brokers and state by key, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import oracle as o
from .functions import text as text_ops
from .operators import detection, evaluation, features, frequent
from .operators import sessions as session_ops
from .plans.live import Live
from .queries import ALL, EVENT_RULE, HINT, PRINTS, WINDOW_RULE, query
from .source_queries import ADMIT, NUMBERED, _canonical, forms, numbered
from .sources import broker, files
from .sources.keyed import KeyedTable
from .sources.state import StateTable, settle, shared_dir
from .sources.tables import canonical_events, peer_groups, read
from .streaming import engine, resume

c = F.col


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(o.sql(f"""SELECT event_id, event_time_ms FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY event_time_ms IS NULL, event_time_ms) AS r
  FROM (SELECT 'e' || CAST(substr(event_id, 2) AS BIGINT) // 3 AS event_id, reason, event_time_ms FROM ({ADMIT}))) WHERE r = 1 AND reason IS NULL""", NUMBERED))
def j14_repeated_ids(spark, sf_dir):
    """Three rows an id, some rejected: the earliest decides, in a batch as in a stream."""
    rows = _canonical(spark, sf_dir)
    number = F.floor(F.substring(c("event.id"), 2, 20).cast("long") / 3)
    return features.accepted(features.admit(rows.withColumn("event", c("event").withField("id", F.concat(F.lit("e"), number))))).select("event_id", "event_time_ms")


def _levels() -> str:
    out = ["h0 AS (SELECT k, i, sha256('evt-' || i || chr(0) || user_name) AS h, 1::BIGINT AS n FROM nv)"]
    for level in range(resume.LEVELS):
        out.append(f"h{level + 1} AS (SELECT k, i // {resume.FAN} AS i, sha256(string_agg(h, '' ORDER BY i)) AS h, CAST(sum(n) AS BIGINT) AS n FROM h{level} GROUP BY k, i // {resume.FAN})")
    return ", " + ", ".join(out)


@query(o.sql(f"SELECT k, n, h AS chain FROM h{resume.LEVELS}", NUMBERED, _levels()))
def t09_ordered_chain(spark, sf_dir):
    """A chain over the events of each resource in the order of their numbers."""
    rows = numbered(spark, sf_dir).select("k", "i", F.concat(F.lit("evt-"), "i").alias("record_id"), c("user_name").alias("checksum"))
    return resume.ordered_chain(rows, ["k"], "i")


@query(o.sql("SELECT 'normalized' AS kind, user_name, count(*) AS n FROM nv WHERE i % 3 < 2 GROUP BY ALL UNION ALL SELECT 'unknown', NULL, count(*) FROM nv WHERE i % 3 = 2", NUMBERED))
def t09_resumed_run(spark, sf_dir):
    """Files of three forms, parsed in a run that stops in the middle of one, and in a second that goes on."""
    f, at = forms(), _folder(spark, "logs")
    text = F.when(c("i") % 3 == 0, f["svn"]).when(c("i") % 3 == 1, f["sso"]).otherwise(F.concat(F.lit("no "), f["keys"]))
    lines = numbered(spark, sf_dir).select(text.alias("text"))
    lines.write.text(at)
    out, sources = _folder(spark, "resumed"), [{"source_id": "main", "source_type": "auto", "paths": [f"{at}/part-*"]}]
    resume.parse_files(spark, sources, out, most=lines.count() // 2 + 1)
    resume.parse_files(spark, sources, out, resume=True)
    shown = [spark.read.text(p).select(F.lit(kind).alias("kind"), F.get_json_object("value", "$.user.name").alias("user_name")) for kind in resume.SINKS for p in [f"{out}/{kind}/step-*"]]
    return shown[0].unionByName(shown[1]).groupBy("kind", "user_name").agg(F.count(F.lit(1)).alias("n"))


@query(o.sql("SELECT CAST(k % 3 AS INT) AS partition, count(*) AS records, count(*) FILTER (i % 2 = 0) AS unknown, count(*) AS committed FROM nv GROUP BY ALL", NUMBERED))
def t10_broker(spark, sf_dir):
    """Messages of three partitions, consumed and committed; the group's offsets beside what was parsed."""
    box = _folder(spark, "broker").removeprefix("file:")
    text = F.when(c("i") % 2 == 0, forms()["keys"]).otherwise(forms()["sso"])
    broker.produce(numbered(spark, sf_dir).select((c("k") % 3).cast("int").alias("partition"), text.alias("value")), box, "t").count()
    out = _folder(spark, "consumed")
    engine.consume(spark, box, ["t"], "g", ("main", "auto"), out, _folder(spark, "offsets")).awaitTermination()
    good, _ = engine.parsed(spark, out)
    place = lambda ref: F.regexp_extract(ref, "^kafka://t/([0-9]+)/", 1).cast("int").alias("partition")
    done = broker.Broker(box).committed("g").get("t", {})
    known = spark.createDataFrame([(int(p), n) for p, n in done.items()], "partition int, committed long")
    parsed = good.groupBy(place(c("raw.storage_ref"))).agg(F.count(F.lit(1)).alias("_good"))
    rows = known.join(parsed, "partition", "left").withColumn("records", c("committed"))
    return rows.select("partition", "records", (c("committed") - F.coalesce("_good", F.lit(0))).alias("unknown"), "committed")


@query(o.sql("SELECT candidate_key, user_name, window_start, detector_id, score FROM allc", *ALL, **PRINTS))
def t11_live_chain(spark, sf_dir):
    """Two batches through the chain that is kept up to date; the second has the later half of a few users' events."""
    events = settle(canonical_events(spark, sf_dir))
    low, high = events.agg(F.min("event_time_ms"), F.max("event_time_ms")).first()
    if low is None:
        low = high = 0
    later = (F.pmod(F.substring_index("user_name", "-", -1).cast("long"), F.lit(50)) == 7) & (c("event_time_ms") > (low + high) // 2) & (c("event_time_ms") < high)
    live = Live(spark, _folder(spark, "live"), settle(peer_groups(events)), [EVENT_RULE, WINDOW_RULE], buckets=16)
    admitted = events.withColumn("reason", F.lit(None).cast("string"))
    live.step(admitted.where(~later), high)
    found = live.step(admitted.where(later), high)
    if found is None:
        found = spark.createDataFrame([], "candidate_key string, user_name string, window_start long, detector_id string, score int, status string")
    return found.where("status = 'active'").select("candidate_key", "user_name", "window_start", "detector_id", "score")


CHANGED = {**EVENT_RULE, "version": 2, "conditions": [*EVENT_RULE["conditions"][:1], {"field": "resource.name", "operator": "ends_with", "value": "3"}]}


@query(o.sql("""SELECT event_id, 1 AS revision, 'superseded' AS status FROM ev WHERE source_type IN ('waf', 'svn') AND outcome = 'failure' AND shown LIKE '%7'
  UNION ALL SELECT event_id, 2, 'active' FROM ev WHERE source_type IN ('waf', 'svn') AND outcome = 'failure' AND shown LIKE '%3'"""))
def d08_rule_refresh(spark, sf_dir):
    """Candidates of a rule that was changed: what the old one had found is superseded throughout."""
    events = settle(canonical_events(spark, sf_dir))
    none = features.window_parts(events.limit(0))
    found = lambda rule: detection.rule_candidates(events, features.windows_in(none), features.values_in(none), [rule])
    first = settle(detection.first_versions(found(EVENT_RULE), 1))
    rows = detection.superseded(first, settle(found(CHANGED)), 2)
    return rows.select("event_id", c("revision").cast("int").alias("revision"), "status")


@query(o.sql("SELECT user_name, window_start, event_count, network_bytes_total FROM win WHERE window_size = 86400 AND user_name IN ('user-3', 'user-11', 'user-20')"))
def f17_lookup(spark, sf_dir):
    """The days of three users, from a table of all users' days: only the parts of their buckets are read."""
    events, day = canonical_events(spark, sf_dir), (86_400,)
    table = KeyedTable(spark, _folder(spark, "days"), 1, {}, "user_name", buckets=16)
    table.add(features.user_windows(events, day))
    return table.lookup("user-3", "user-11", "user-20").select("user_name", "window_start", "event_count", "network_bytes_total")


@query(o.sql("SELECT CAST(i AS VARCHAR) AS path, 1 AS record_index, 1 AS line_start, 11 AS line_end FROM nv UNION ALL SELECT CAST(i AS VARCHAR), 2, 12, 13 FROM nv", NUMBERED))
def s04_objects(spark, sf_dir):
    """Two objects of several lines in each file, and an unfinished one."""
    text = F.concat(forms()["hiklink"], F.lit(',\n{"a": '), c("i").cast("string"), F.lit("\n},\nrest {"))
    lines = numbered(spark, sf_dir).select(c("i").cast("string").alias("path"), F.posexplode(F.split(text, "\n")))
    rows = files.object_records(lines.select("path", (c("pos") + 1).alias("line"), c("col").alias("text")))
    return rows.select("path", "record_index", c("line_start").cast("int"), c("line_end").cast("int"))


@query(o.sql("SELECT user_name, start_time, last_event_time, 'closed' AS status, 'end_of_input' AS close_reason FROM sessions", o.SESSIONS))
def t05_flushed(spark, sf_dir):
    """All sessions when the input has ended."""
    events = canonical_events(spark, sf_dir)
    return session_ops.flushed(session_ops.none_closed(events), events).select("user_name", "start_time", "last_event_time", "status", "close_reason")


@query(o.sql("SELECT event_id, user_name, t AS event_time_ms FROM ev"))
def t08_absorbed(spark, sf_dir):
    """Events that come in two batches, some in both: each is known once."""
    events = settle(canonical_events(spark, sf_dir).withColumn("reason", F.lit(None).cast("string")))
    table = StateTable(spark, _folder(spark, "events"), engine.VERSION, {})
    number = F.substring("event_id", 5, 20).cast("long")
    for rest in (0, 1):
        engine.absorb(table, events.where(number % 3 != rest))
    return engine.accepted(table).select("event_id", "user_name", "event_time_ms")


@query(o.sql("SELECT user_name AS text, CAST(row_number() OVER (PARTITION BY k ORDER BY i) AS INT) AS line, 'k=' || k AS part FROM nv", NUMBERED))
def s06_packed_lines(spark, sf_dir):
    """Lines of gzip files, one for each resource, numbered."""
    at = _folder(spark, "packed")
    rows = numbered(spark, sf_dir).select("k", "i", "user_name").repartition("k").sortWithinPartitions("k", "i")
    rows.select("k", c("user_name").alias("value")).write.partitionBy("k").option("compression", "gzip").text(at)
    folders = [r.k for r in rows.select("k").distinct().collect()]
    lines = files.read_lines(spark, [f"{at}/k={k}" for k in folders])
    return lines.select("text", "line", F.regexp_extract("path", "(k=[0-9]+)/[^/]*$", 1).alias("part"))


@query(f"SELECT hint AS item, count(*) AS n, 0::BIGINT AS error FROM ({HINT}) WHERE hint <> '' GROUP BY ALL")
def a20_frequent_templates(spark, sf_dir):
    """Templates in a summary of bounded size, which is exact where there are no more than it holds."""
    return frequent.frequent_items(read(spark, sf_dir, "documents").select(text_ops.template_hint(F.col("text")).alias("hint")), "hint", limit=1_000_000)


DAY_MS = features.DAY_MS


@query(o.sql("""SELECT count(*) AS candidate_count, count(*) AS predicted_user_days, count(DISTINCT user_name) AS unique_predicted_users, count(*) FILTER (event_count >= 3) AS high_severity_candidates, true AS reused, true AS other FROM win WHERE window_size = 86400 AND event_count >= 2"""))
def e03_stored(spark, sf_dir):
    """An experiment that is run twice and stored once, and one of other inputs beside it."""
    days = settle(features.user_windows(canonical_events(spark, sf_dir), (86_400,)).where("event_count >= 2"))
    rows = days.select("user_name", c("window_start").alias("eval_day"), c("event_count").cast("int").alias("score"), F.when(c("event_count") >= 3, "high").otherwise("low").alias("severity"), F.lit("busy").alias("detector_id"))
    low, high = days.agg(F.min("window_start"), F.max("window_start")).first()
    store, inputs = evaluation.Experiments(spark, _folder(spark, "experiments")), {"windows": evaluation.contents(days)}
    run = lambda more: store.run("busy days", low or 0, (high or 0) + DAY_MS, {**inputs, **more}, lambda: rows)
    (first, _, _), (again, _, reused), (other, _, _) = run({}), run({}), run({"score": 3})
    metrics = store.query(again)["metrics"].select("candidate_count", "predicted_user_days", "unique_predicted_users", "high_severity_candidates")
    return metrics.withColumns({"reused": F.lit(reused and first == again), "other": F.lit(other != first)})
