import hashlib
import random

import pytest

from vigil.sources import tail
from vigil.sources.state import StateError


@pytest.fixture(autouse=True)
def small(monkeypatch):
    monkeypatch.setattr(tail, "BLOCK", 64)
    monkeypatch.setattr(tail, "SPAN", 50)
    monkeypatch.setattr(tail, "RECHECKED", 2)
    monkeypatch.setattr(tail, "LINES_A_BATCH", 3)


def test_only_what_was_added_is_read(spark, tmp_path):
    path, r, known, seen = tmp_path / "f", random.Random(1), {}, []
    path.write_bytes(b"")
    read = []
    for step in range(8):
        lines = [("é" * r.choice([0, 1, 5, 30, 90]) + f"{step}:{i}").encode() for i in range(r.choice([0, 1, 9]) if step else 60)]
        with path.open("ab") as f:
            f.write(b"".join(x + b"\n" for x in lines) + (b"not whole" if step == 3 else b""))
        if step == 4:
            body = path.read_bytes()
            path.write_bytes(body.replace(b"not whole", b""))
        rows, known = tail.appended(spark, str(path), known)
        seen += sorted(x.text for x in rows.collect())
        read.append((known.pop("bytes_read"), sum(map(len, lines)) + len(lines)))
    assert sorted(seen) == sorted(path.read_text().splitlines())
    body = path.read_bytes()
    assert known["offset"] == len(body) and known["blocks"] == [hashlib.sha256(body[i : i + 64]).hexdigest() for i in range(0, len(body) - 63, 64)]
    assert known["tail"] == (hashlib.sha256(body[len(body) - len(body) % 64 :]).hexdigest() if len(body) % 64 else "")
    assert all(n <= 3 * added + (2 + 4) * 64 for n, added in read) and len(body) > 20 * 64


def test_changes_are_found_in_turn(spark, tmp_path):
    path = tmp_path / "f"
    path.write_text("".join(f"line {i}\n" for i in range(60)))
    _, known = tail.appended(spark, str(path), {})
    body = path.read_text()
    path.write_text(body.replace("line 59", "LINE 59"))
    with pytest.raises(StateError):
        tail.appended(spark, str(path), known)
    path.write_text(body.replace("line 30", "LINE 30"))
    with pytest.raises(StateError):
        for _ in range(len(known["blocks"])):
            _, known = tail.appended(spark, str(path), known)
    path.write_text(body[:100])
    with pytest.raises(StateError):
        tail.appended(spark, str(path), known)
