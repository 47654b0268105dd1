import hashlib
import json

import pytest
from pyspark.sql import functions as F

from vigil.sources.state import StateError, StateTable
from vigil.streaming import resume

from .test_rules_and_parsing import GITLAB, SSO, SVN


def write(folder, name, lines):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def lines(n, first=0):
    return [(SVN, SSO, GITLAB, "nothing at all", "level=INFO user=ana")[(i * i + first) % 5].replace("ana", f"ana{first + i}") for i in range(n)]


def bytes_of(spark, folder, kind):
    return b"".join(open(p.removeprefix("file:"), "rb").read() for p, _ in resume.Sink(spark, f"{folder}/{kind}").parts())


@pytest.fixture
def sources(tmp_path):
    write(tmp_path / "in", "a.log", lines(9))
    write(tmp_path / "in", "b.log", [])
    write(tmp_path / "in", "c.log", ["", *lines(4, 30), ""])
    return [{"source_id": "one", "source_type": "auto", "paths": [str(tmp_path / "in/*.log")]}, {"source_type": "auto", "paths": [str(tmp_path / "in/a.log")]}]


def summary(spark, folder, notes):
    table = StateTable(spark, f"{folder}/state", resume.VERSION, {"sources": notes["sources"], "parsers": [], "folder": str(folder)})
    return sorted(map(tuple, table.current()[1].collect()))


def test_any_stop_gives_the_same_bytes(spark, sources, tmp_path, monkeypatch):
    whole = str(tmp_path / "whole")
    done = resume.parse_files(spark, sources, whole)
    assert (done["status"], done["records"], done["counts"]) == ("complete", 22, [9, 0, 4, 9])
    want = {k: bytes_of(spark, whole, k) for k in resume.SINKS}
    assert want["normalized"].count(b"\n") + want["unknown"].count(b"\n") == 22 and {k: len(v) for k, v in want.items()} == done["lengths"]
    refs = [json.loads(x)["raw"]["storage_ref"].rpartition("/")[2].split("#L") for x in want["normalized"].splitlines()]
    own = [(f, int(n.split("-")[0])) for f, n in refs]
    one = [x for x in own if x[0] == "a.log"]
    assert own == sorted(set(one)) + sorted(x for x in own if x[0] == "c.log") + sorted(set(one)) and len(one) == 2 * len(set(one))  # in the order of files
    folder = str(tmp_path / "stopped")
    part = resume.parse_files(spark, sources, folder, most=5, every=3)
    assert (part["records"], part["status"], part["cursor"]["unit"], part["cursor"]["number"]) == (5, "running", 0, 4)
    with pytest.raises(StateError):
        resume.parse_files(spark, sources, folder)
    with monkeypatch.context() as m:  # stops between outputs and commit
        m.setattr(StateTable, "commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            resume.parse_files(spark, sources, folder, resume=True)
    assert resume.Sink(spark, f"{folder}/normalized").length() > part["lengths"]["normalized"]
    for most in (1, 7, None):
        last = resume.parse_files(spark, sources, folder, resume=True, most=most)
    assert last["status"] == "complete" and {k: bytes_of(spark, folder, k) for k in resume.SINKS} == want
    assert last["cursor"] == done["cursor"]
    assert summary(spark, folder, {"sources": sources}) == summary(spark, whole, {"sources": sources})
    assert resume.parse_files(spark, sources, folder, resume=True) == last


def test_what_changed_is_refused(spark, sources, tmp_path):
    folder = str(tmp_path / "out")
    with pytest.raises(StateError):
        resume.parse_files(spark, sources, folder, resume=True)
    notes = resume.parse_files(spark, sources, folder, most=5)
    with pytest.raises(StateError):
        resume.parse_files(spark, sources, folder, resume=True, parsers=[{"parser_id": "x"}])
    at = tmp_path / "in/a.log"
    held, times = at.read_text(), at.stat()
    at.write_text(held.replace("ana", "eva", 1))
    with pytest.raises(StateError):
        resume.parse_files(spark, sources, folder, resume=True)
    import os

    os.utime(at, ns=(times.st_atime_ns, times.st_mtime_ns))  # same length and time, other bytes
    with pytest.raises(StateError, match="cursor"):
        resume.parse_files(spark, sources, folder, resume=True)
    at.write_text(held)
    os.utime(at, ns=(times.st_atime_ns, times.st_mtime_ns))
    part = next(p for p, n in resume.Sink(spark, f"{folder}/normalized").parts() if n).removeprefix("file:")
    body = open(part, "rb").read()
    open(part, "wb").write(body[:-5])
    for crc in (tmp_path / "out").rglob(".*.crc"):
        crc.unlink()
    with pytest.raises(StateError, match="committed"):
        resume.parse_files(spark, sources, folder, resume=True)
    open(part, "wb").write(body)
    assert resume.parse_files(spark, sources, folder, resume=True)["records"] == 22 > notes["records"]


def test_no_files(spark, tmp_path):
    notes = resume.parse_files(spark, [{"source_type": "auto", "paths": [str(tmp_path / "*.none")]}], str(tmp_path / "out"))
    assert (notes["status"], notes["records"], notes["lengths"]) == ("complete", 0, {"normalized": 0, "unknown": 0})


def test_chain_against_plain_hashes(spark, monkeypatch):
    monkeypatch.setattr(resume, "FAN", 4)
    rows = [(k, i, f"r{k}{i}", f"c{i}") for k in "ab" for i in range(37 if k == "a" else 3)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def plain(level):
        for _ in range(resume.LEVELS):
            level = [sha("".join(level[i : i + 4])) for i in range(0, len(level), 4)]
        return level[0]

    df = spark.createDataFrame(rows, "k string, i long, record_id string, checksum string")
    got = {r.k: (r.n, r.chain) for r in resume.ordered_chain(df.repartition(5), ["k"], "i").collect()}
    assert got == {k: (len(x), plain(x)) for k in "ab" for x in [[sha(f"{r[2]}\0{r[3]}") for r in rows if r[0] == k]]}
    swapped = df.withColumn("i", F.when((F.col("k") == "a") & F.col("i").isin(3, 4), 7 - F.col("i")).otherwise(F.col("i")))
    other = {r.k: r.chain for r in resume.ordered_chain(swapped, ["k"], "i").collect()}
    assert other["a"] != got["a"][1] and other["b"] == got["b"][1]
    assert resume.ordered_chain(df.limit(0), ["k"], "i").count() == 0


def test_records_are_kept_once_and_go_with_their_places(spark, sources, tmp_path, monkeypatch):
    """Nothing that was settled on the way stays, and a document is joined to no place."""
    shared, plans, append = tmp_path / "shared", [], resume.Sink.append
    monkeypatch.setattr("vigil.sources.state.shared_dir", lambda spark: str(shared))
    monkeypatch.setattr(resume.Sink, "append", lambda self, rows, step, parts: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or append(self, rows, step, parts))
    resume.parse_files(spark, sources, str(tmp_path / "out"), every=9)
    assert len(plans) == 6 and not any("Join" in p or "Exchange" in p for p in plans)
    left = [spark.read.parquet(str(p)).columns for p in shared.iterdir()]
    assert not any("raw_text" in c for c in left)
