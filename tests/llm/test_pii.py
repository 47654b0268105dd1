import hashlib
import math
import random
import re
from collections import Counter

import pytest

from vigil.llm import pii

from .cases import documents, texts, words

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and pii.luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


AWKWARD = [
    "a@b.com@c.org x@y a.b+c@d-e.f.g. @x.y é@x.org", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3.4.5", "4111-1111-1111-1111 4111 1111 1111 1112 1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1 2",
    "+1 (212) 555-0147. +44 20 7946 0958 +12 +1234567890123456 ++49 30 1234567", "🙂 mail x@y.zz at 10.0.0.1, card 378282246310005", "@@@.. a@b a@.b a@b. a@b.c", "1" * 3000 + "." + "2" * 30,
]


@pytest.mark.parametrize("text", [t for t in AWKWARD + texts() if t])
def test_base_spans_are_the_patterns(text):
    assert [f"{k}:{a}:{b}" for a, k, b in pii.base_spans(text)] == plain(text)


def test_luhn():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_long_runs_are_linear():
    pii.base_spans("x" * 2_000_000 + " @ " + "7" * 2_000_000 + "+")


def people(n=150):
    """Every mention of one address stands beside its owner's name; other words are common."""
    rows = []
    for k in range(3):
        for i in range(4):
            rows.append(f"{words(12, 50 * k + i)} please ask Zanthe{'abc'[k]} the manager owner{k}@mail.example.org about item {words(9, 500 * k + i)}")
    rows += [f"please ask the manager about it {words(30, 900 + i)}" for i in range(n)]
    return rows + [rows[0], "write to lone@mail.example.org with Rarename", "write to lone@mail.example.org with Rarename"]


def test_revealing_terms(spark):
    docs = documents(spark, people())
    found = pii.find_base(docs).cache()
    got = {r.term for r in pii.revealing_terms(docs, found).collect()}
    assert {"zanthea", "zantheb", "zanthec"} <= got
    assert not got & {"please", "manager", "the", "about", "rarename", "ask"}
    out = {r.doc_id: r for r in pii.sanitise(docs).collect()}
    for r in docs.collect():
        t = out[r.doc_id].text
        assert "@mail" not in t and "Zanthe" not in t and "manager" in t or "owner" not in r.text
    assert pii.sanitise(docs).columns == docs.columns and pii.sanitise(docs).schema == docs.schema


def test_digests(spark):
    rows = texts() + AWKWARD + people()
    docs = documents(spark, rows)
    at = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    out = pii.pii_digests(docs).collect()
    assert len(out) == len(rows)
    for r in out:
        base = plain(at[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("term")] == base
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in base) for k in PATTERNS]
        starts = [int(s.split(":")[1]) for s in r.spans.split(",") if s]
        assert starts == sorted(starts)
    assert pii.pii_digests(docs.limit(0)).count() == 0
    clean = documents(spark)
    kept = {r.doc_id: r.text for r in pii.sanitise(clean).collect()}
    assert all(kept[r.doc_id] == r.text for r in clean.collect() if not plain(r.text))
    assert pii.sanitise(clean.union(clean)).count() == 2 * clean.count()


def far(name, mail, seed):
    return f"{name} keeps the minutes. {words(60, seed)} {'x ' * 150}. Write to {mail} {words(20, seed + 1)} and {words(40, seed + 2)} {name} signs."


def test_terms_in_other_sentences(spark):
    """A name that never stands beside the address is counted over whole documents, and marked at every mention."""
    rows = [far("Quorvine", "far@mail.example.org", 3000 + 10 * i) for i in range(3)]
    docs = documents(spark, rows + [f"{words(50, 4000 + i)} keeps the minutes and signs" for i in range(120)])
    found = pii.find_base(docs).cache()
    assert "quorvine" in {r.term for r in pii.revealing_terms(docs, found).collect()}
    out = pii.sanitise(docs).where("text LIKE '%[EMAIL]%'").collect()
    assert len(out) == 3 and not any("Quorvine" in r.text for r in out) and all("minutes" in r.text and "signs" in r.text for r in out)
    marked = {r.doc_id: r for r in pii.pii_digests(docs).where("n_email > 0").collect()}
    for r in docs.collect():
        if r.doc_id in marked:
            spans = {s for s in marked[r.doc_id].spans.split(",") if s.startswith("term")}
            assert {f"term:{m.start()}:{m.end()}" for m in re.finditer("Quorvine", r.text)} <= spans


def test_free_terms():
    text = "ana bob@mail.example.org +1 212 555 0147 carol dave"
    held = pii.base_spans(text)
    assert [w for w, _, _ in pii.free_terms(text, held)] == ["ana", "carol", "dave"]
    assert all(text[a:b].lower() == w for w, a, b in pii.free_terms(text, held))


def test_contexts_are_counted_exactly(spark):
    """Two documents with the same least context, and one document with two contexts."""
    mail = "z@mail.example.org"
    beside = lambda w: pii.terms_beside(pii.free_terms(f"{mail} {w}", [(0, "email", len(mail))]), (0, "email", len(mail)))
    least, *others = sorted((words(5, 7000 + i) for i in range(3)), key=lambda w: pii.digest(["hesperix", *beside(w)]))
    gap = " 1" * 200 + " "
    line = lambda w, who, name: f"{gap}{name} {who}@mail.example.org {w}{gap}"
    rows = [line(least, "two", "Hesperix") + line(o, "two", "Hesperix") for o in others]
    rows += [line(least, "one", "Calvarun") + line(others[0], "one", "Calvarun"), f" {words(5, 7100)} Dorimund same@mail.example.org {least} " * 2]
    docs = documents(spark, rows + [words(30, 5000 + i) for i in range(120)])
    got = {r.term for r in pii.revealing_terms(docs, pii.find_base(docs).cache()).collect()}
    assert {"hesperix", "calvarun"} <= got and "dorimund" not in got


def staff(seed=5):
    """An awkward corpus: owners of addresses, a firm with a domain and many addresses, a host with a network, names that
    stand elsewhere too, copies, and words of every kind that reveal nothing. Gives texts and the terms that reveal."""
    r = random.Random(seed)
    noise = lambda n: words(n, r.randrange(10**9), 60)
    rows, planted = [], set()
    for k in range(8):
        name = f"{'Aurelbcd'[k]}{'ornithe'}{k}x"
        planted.add(name.lower())
        for _ in range(r.randint(2, 5)):
            rows.append(r.choice(["{w} {n} writes {w2} as owner{k}@mail.example.org says", "{n} {w} {w2} {w} mail owner{k}@mail.example.org {w2}", "owner{k}@mail.example.org\n{w}\n{w2} {n} {w}"]).format(w=noise(14), w2=noise(9), n=name, k=k))
    for i in range(9):
        rows.append(f"{noise(12)} Veltramix {noise(6)} staff{i}@veltramix-group.example.net {noise(5)}")
        rows.append(f"{noise(8)} 10.77.3.{i * 3} {noise(7)} rack Q7zeta {noise(6)}")
    planted |= {"veltramix", "q7zeta"}
    for i in range(12):  # a common name stands beside an address, but in many other documents too
        rows.append(f"{noise(10)} Marion solo{i % 3}@mail.example.org {noise(9)}")
    rows += [f"{noise(9)} Marion {noise(12)}" for _ in range(60)] + [f"{noise(20)} mail {noise(3)} says rack writes {noise(15)}" for _ in range(120)] + [noise(40) for _ in range(400)]
    once = f"{noise(5)} Singulara only@mail.example.org {noise(5)}"
    return [*rows, once, once, once], planted


def test_precision_and_recall_on_planted_terms(spark):
    rows, planted = staff()
    docs = documents(spark, rows)
    for both in (docs, docs.union(docs)):  # rows that all come twice change no verdict
        got = {x.term for x in pii.revealing_terms(both, pii.find_base(both).cache()).collect()}
        assert len(got & planted) / len(planted) >= 0.9 and len(got & planted) / len(got) >= 0.9
        assert not got & {"marion", "singulara", "owner", "says", "mail", "rack"}


def test_share_and_bits_against_a_plain_count(spark):
    rows, _ = staff(6)
    docs = documents(spark, rows)
    got = {(x.entity, x.term): (x.share, x.bits) for x in pii.revealing_terms(docs, pii.find_base(docs).cache()).collect()}
    term, who, both, contexts = Counter(), Counter(), Counter(), {}
    for t in rows:
        held = pii.base_spans(t)
        free = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]{2,}", t) if not m.group().isdigit()]
        term.update({w for w, _, _ in free})
        free = [w for w in free if not any(a < w[2] and w[1] < b for a, _, b in held)]
        assert len(held) <= 1
        for a, kind, b in held:
            near = [w for w, _, e in free if e <= a][-5:] + [w for w, s, _ in free if s >= b][:5]
            for e in pii.entities(t, (a, kind, b)):
                who[e] += 1
                for i, (w, _, _) in enumerate(free):
                    if w in [x for x, _, _ in free[:i]]:
                        continue
                    both[e, w] += 1
                    far = tuple(x for x, _, _ in free[max(0, i - 5) : i + 6])
                    contexts.setdefault((e, w), set()).add((tuple(near),) if w in near else (tuple(near), far))
    n, want = len(rows), {}
    for (e, w), k in both.items():
        share, bits = k / term[w], math.log2((k + 0.5) * (n + 0.5) / ((who[e] + 0.5) * (term[w] + 0.5)))
        if len(contexts[e, w]) > 1 and share >= 0.5 and bits >= 4:
            want[e, w] = share, bits
    assert got.keys() == want.keys() and len(got) >= 10
    assert all(abs(got[k][i] - want[k][i]) < 1e-9 for k in want for i in (0, 1))


def test_generalised():
    assert [pii.generalised(x) for x in ("Ana", "q7zeta", "rack", "été")] == ["[NAME]", "[CODE]", "[WORD]", "[WORD]"]


def test_terms_of_odd_letters(spark):
    """Letters whose lower case is longer, and names of two letters."""
    rows = [f"{words(12, 90 + i, 60)} İlker 李明 writes {words(9, 190 + i, 60)} ilk@mail.example.org {words(8, 290 + i, 60)}" for i in range(4)]
    docs = documents(spark, rows + [f"writes {words(30, 400 + i, 60)}" for i in range(150)])
    got = {x.term for x in pii.revealing_terms(docs, pii.find_base(docs).cache()).collect()}
    assert {"İlker".lower(), "李明"} <= got and "writes" not in got
