"""Personal data by patterns, and terms that reveal it by how often they share its documents in the corpus."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Matches begin where a run of digits does, so the look-behind changes none and keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TERM = re.compile(r"[^\W_]{2,}")
#: Words on either side of an entity that make a context.
NEAR = 5
#: A term reveals an entity that shares documents with it in so many different contexts, in such a share of all documents
#: with the term, and with such a gain over chance in bits; at REMOVE it is removed, below that generalised.
CONTEXTS, SHARE, BITS, REMOVE = 2, 0.5, 4.0, 0.9
#: Documents added to each count, so that terms seen a few times show no more than that.
SMOOTHING = 0.5
MAP_BITS = 1 << 22


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) in code points, by start and then kind."""
    found = [(a, "email", b) for a, b in emails(text)] if "@" in text else []
    if first := DIGIT.search(text):
        at = first.start()
        for m in IP.finditer(text, at):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), "ip", m.end()))
        for m in CARD.finditer(text, at):
            if 14 <= m.end() - m.start():
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), "card", m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= len(DIGIT.findall(m.group())) <= 15:
                    found.append((m.start(), "phone", m.end()))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[1])))


def entities(text: str, span: tuple[int, str, int]) -> list[int]:
    """Digests of what a span names, whatever its spacing or case: the value itself, and the group it is one of (the
    domain of an address, the network of an ip address, the issuer of a card, the exchange of a phone)."""
    raw, kind = text[span[0] : span[2]], span[1]
    value = raw.lower() if kind in ("email", "ip") else "".join(DIGIT.findall(raw))
    group = {"email": value.rpartition("@")[2], "ip": value.rpartition(".")[0], "card": value[:6], "phone": value[:-4]}[kind]
    return [xxhash.xxh64_intdigest(x) - (1 << 63) for x in (f"{kind}:{value}", f"{kind} of:{group}")]


def free_terms(text: str, taken: list[tuple[int, str, int]]) -> list[tuple[str, int, int]]:
    """(term, start, end) of every word of text, digits alone apart, that lies in no span; taken are the spans by start."""
    out, i, reach = [], 0, 0
    for m in TERM.finditer(text):
        a, b = m.span()
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][2])
            i += 1
        if reach <= a and not m.group().isdigit():
            out.append((m.group().lower(), a, b))
    return out


def terms_beside(words: list[tuple[str, int, int]], span: tuple[int, str, int]) -> list[str]:
    """Of the free terms of a text, up to NEAR on either side of a span, however far off they stand."""
    left = bisect_right(words, span[0], key=lambda w: w[2])
    right = bisect_left(words, span[2], key=lambda w: w[1])
    return [w for w, _, _ in words[max(0, left - NEAR) : left] + words[right : right + NEAR]]


FOUND = "spans array<struct<start:int,kind:string,end:int>>, entities array<long>, body string"
#: Rows gathered before they leave a task.
ROWS = 100_000


def find_base(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2 (name the row), doc_id, spans by the patterns, the entities they name, and the text where there are any."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, who, body = [], [], []
            for x in batch.column(3):
                t = x.as_py()
                held = base_spans(t)
                spans.append([dict(zip(("start", "kind", "end"), s, strict=True)) for s in held])
                who.append(sorted({e for s in held for e in entities(t, s)}))
                body.append(t if held else None)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
            yield pa.record_batch([*batch.columns[:3], pa.array(spans, kind), pa.array(who, pa.list_(pa.int64())), pa.array(body, pa.string())], ["k1", "k2", "doc_id", "spans", "entities", "body"])

    kind = docs.schema[id].dataType.simpleString()
    return keyed(docs, id, text).mapInArrow(rows, f"k1 long, k2 long, doc_id {kind}, {FOUND}")


def keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    raw = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.xxhash64(F.lit(1), F.col(id)).alias("k1"), F.xxhash64(raw).alias("k2"), F.col(id).alias("doc_id"), raw.alias("text"))


def bitmap(hashes: DataFrame) -> bytes:
    """A byte, 1 or 0, for each place of a map of fixed size: whether the column h has a value that falls there."""
    place = F.pmod("h", F.lit(MAP_BITS))
    words = hashes.select(place.alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("b", F.lit(64)).cast("int"))).alias("v"))
    held = np.zeros(MAP_BITS // 64, np.int64)
    for r in words.collect():  # MAP_BITS / 64 rows at most
        held[r.w] = r.v
    return np.unpackbits(held.view(np.uint8), bitorder="little").tobytes()


def document_counts(docs: DataFrame, terms: DataFrame | None = None, text: str = "text") -> DataFrame:
    """term, n_term: in how many of all documents each of terms (column term), or without terms each word, stands.

    Words pass a bitmap of the terms' hashes first, so that only theirs (and few others', which the join drops) are
    shuffled. The bitmap's size is fixed.
    """
    bits = None if terms is None else bitmap(terms.select(F.xxhash64("term").alias("h")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, mask = xxhash.xxh64_intdigest, MAP_BITS - 1
        for batch in batches:
            counts: dict[str, int] = {}
            for x in batch.column(0):
                if x.is_valid:
                    for w in {w.lower() for w in set(TERM.findall(x.as_py())) if not w.isdigit()}:
                        if bits is None or bits[place(w, 42) & mask]:
                            counts[w] = counts.get(w, 0) + 1
            yield pa.record_batch([pa.array([*counts], pa.string()), pa.array([*counts.values()], pa.int64())], ["term", "n"])

    counted = docs.select(F.col(text).alias("text")).mapInArrow(rows, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    return counted if terms is None else terms.select("term").distinct().join(counted, "term")


def spans_of(x: pa.ListScalar) -> list[tuple[int, str, int]]:
    return [(s["start"], s["kind"], s["end"]) for s in x.as_py()]


def digest(words: Iterator[str] | list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def together(found: DataFrame, known: DataFrame) -> DataFrame:
    """entity, term, low, high: a row for each document that holds one of the known entities (entity, n_entity) and the
    term; a few rows of other entities may be among them.

    low and high are the least and greatest of the pair's contexts there. Beside the entity, a context is the words
    beside it; further off, a document is one context: the words beside the entity (the least digest) and beside the
    term's first mention, so that copies have one context and other texts have their own. An entity of one document
    only gives the terms that stand beside it in two contexts, as no others can have two.
    """
    bits = bitmap(known.where("n_entity > 1").select(F.col("entity").alias("h")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, names = MAP_BITS - 1, ["entity", "term", "low", "high"]
        who, terms, lows, highs = [], [], [], []
        made = lambda: pa.record_batch([pa.array(who, pa.int64()), pa.array(terms, pa.string()), pa.array(lows, pa.int64()), pa.array(highs, pa.int64())], names)
        for batch in batches:
            for spans, body in zip(*batch.columns, strict=True):
                t, held = body.as_py(), spans_of(spans)
                words = free_terms(t, held)
                about: dict[int, int] = {}
                beside: dict[int, dict[str, tuple[int, int]]] = {}
                for s in held:
                    near = terms_beside(words, s)
                    context = digest(near)
                    for e in entities(t, s):
                        about[e] = min(context, about.get(e, context))
                        seen = beside.setdefault(e, {})
                        for w in near:
                            low, high = seen.get(w, (context, context))
                            seen[w] = min(context, low), max(context, high)
                if any(bits[e & mask] for e in about):
                    own: dict[str, int] = {}
                    for i, (w, _, _) in enumerate(words):
                        if w not in own:
                            own[w] = digest(x[0] for x in words[max(0, i - NEAR) : i + NEAR + 1])
                for e, context in about.items():
                    near = beside.get(e, {})
                    if bits[e & mask]:
                        far = {w: xxhash.xxh64_intdigest(f"{context}:{c}") - (1 << 63) for w, c in own.items() if w not in near}
                        made_of = near | {w: (c, c) for w, c in far.items()}
                    else:
                        made_of = {w: x for w, x in near.items() if x[0] < x[1]}
                    for w, (low, high) in made_of.items():
                        who.append(e), terms.append(w), lows.append(low), highs.append(high)
                    if len(who) >= ROWS:
                        yield made()
                        who, terms, lows, highs = [], [], [], []
        yield made()

    texts = found.where("body IS NOT NULL").select("spans", "body")
    return texts.mapInArrow(rows, "entity long, term string, low long, high long")


def revealing_terms(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """entity, term, share, bits of the terms that pass the thresholds.

    share is the part of all documents with the term that hold the entity too, anywhere, bits the pointwise mutual
    information of the two over documents, with SMOOTHING documents added to each count. All counts are of rows, those
    of copies and repeated rows too; copies of one context count once towards CONTEXTS.
    """
    n = float(found.count())
    gain = lambda both, one, other: F.log2((both + SMOOTHING) * (n + SMOOTHING) / ((one + SMOOTHING) * (other + SMOOTHING)))
    c = F.col
    named = found.where("body IS NOT NULL").select(F.explode("entities").alias("entity"))
    # no term gains more bits than its entity's own share of documents allows
    known = named.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    known = cut(known.where(gain(c("n_entity"), c("n_entity"), c("n_entity")) >= BITS))
    pairs = together(found, known).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both"), F.min("low").alias("low"), F.max("high").alias("high"))
    assert CONTEXTS == 2  # two contexts, exactly, where least and greatest differ; more would need their distinct count
    pairs = pairs.where("low < high").join(known, "entity")  # counted by entity and term first, so that no entity is one key

    def passing(counts: DataFrame) -> DataFrame:
        n_term = F.greatest("n_term", "n_both")
        rows = pairs.join(counts, "term").withColumns({"share": c("n_both") / n_term, "bits": gain(c("n_both"), c("n_entity"), n_term)})
        return rows.where((c("share") >= SHARE) & (c("bits") >= BITS))

    # both fall as n_term grows, so a pair that fails by the documents with entities alone fails by all of them
    pairs = cut(passing(document_counts(found.where("body IS NOT NULL"), text="body")).select("entity", "term", "n_both", "n_entity"))
    return passing(document_counts(docs, pairs.select("term").distinct(), text)).select("entity", "term", "share", "bits")


def mentions(found: DataFrame, flagged: DataFrame) -> DataFrame:
    """k1, k2, terms (start, end, share): every mention of a flagged term in every document that names its entity.

    Pairs pass a bitmap of the flagged ones first; the join drops the few others.
    """
    bits = bitmap(flagged.select(F.xxhash64("term").bitwiseXOR(F.col("entity")).alias("h")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask, set_ = MAP_BITS - 1, np.frombuffer(bits, np.uint8)
        places = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for k1, k2, spans, entities, body in zip(*batch.columns, strict=True):
                at: dict[str, list[dict[str, int]]] = {}
                for w, a, b in free_terms(body.as_py(), spans_of(spans)):
                    at.setdefault(w, []).append({"start": a, "end": b})
                words = [*at]
                hashes = np.array([xxhash.xxh64_intdigest(w, 42) & mask for w in words], np.int64)
                for e in entities.as_py():
                    out += [(k1.as_py(), k2.as_py(), e, words[i], at[words[i]]) for i in np.flatnonzero(set_[hashes ^ (e & mask)])]
                if len(out) >= ROWS:
                    yield made(out, places)
                    out = []
            yield made(out, places)

    def made(out: list[tuple], places: pa.DataType) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), places)
        return pa.record_batch([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["k1", "k2", "entity", "term", "places"])

    texts = found.where("body IS NOT NULL").select("k1", "k2", "spans", "entities", "body")
    held = texts.mapInArrow(rows, "k1 long, k2 long, entity long, term string, places array<struct<start:int,end:int>>")
    held = held.join(flagged, ["entity", "term"]).groupBy("k1", "k2", "term").agg(F.max("share").alias("share"), F.any_value("places").alias("places"))
    one = F.transform("places", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.col("share").alias("share")))
    return held.groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_list(one))).alias("terms"))


def all_spans(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """k1, k2, doc_id, spans (by pattern), terms (start, end, share of the terms that reveal one) of every row.

    Null counts as empty. Entities are email and ip addresses, cards and phones as the patterns find them, and the groups
    they belong to (see entities). A term that reveals one is marked wherever it stands in a document that names it.
    Repeated rows give their rows; no other columns are read.
    """
    found = table(find_base(docs, id, text), "personal")
    flagged = cut(revealing_terms(docs, found, text))
    empty = F.array().cast("array<struct<start:int,end:int,share:double>>")
    return found.drop("entities", "body").join(mentions(found, flagged), ["k1", "k2"], "left").withColumn("terms", F.coalesce("terms", empty))


def pii_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term of every row."""
    line = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    rank = lambda s: F.array_position(F.array(*map(F.lit, (*KINDS, "term"))), s["kind"])
    text = lambda spans: F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank(s).alias("k"), line(s).alias("line")))), lambda x: x["line"]), ",")
    terms = F.transform("terms", lambda x: F.struct(x["start"].alias("start"), F.lit("term").alias("kind"), x["end"].alias("end")))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    return all_spans(docs).select("doc_id", *counts, F.sha2(text(F.col("spans")), 256).alias("base_sha256"), text(F.concat("spans", terms)).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def generalised(term: str) -> str:
    """The class of a term, which any number of terms share, in place of the term."""
    return "[CODE]" if any(c.isdigit() for c in term) else "[NAME]" if term[0].isupper() else "[WORD]"


def sanitise(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with personal data replaced by its kind in brackets, and revealing terms by their class ([NAME], [CODE] or
    [WORD]) or, at REMOVE, by nothing.

    Overlapping spans are one, named after the first. Texts without spans, null ones too, stay as they are.
    """

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x, spans, terms in zip(batch.column("_text"), batch.column("_spans"), batch.column("_terms"), strict=True):
                t, held = x.as_py(), [(s["start"], s["end"], f"[{s['kind'].upper()}]") for s in spans.as_py() or ()]
                held += [(s["start"], s["end"], "" if s["share"] >= REMOVE else generalised(t[s["start"] : s["end"]])) for s in terms.as_py() or ()]
                if t is not None and held:
                    parts, done = [], 0
                    for a, b, name in sorted(held):
                        if a >= done:
                            parts += [t[done:a], name]
                        done = max(done, b)
                    t = "".join([*parts, t[done:]])
                out.append(t)
            names = [n for n in batch.schema.names if n not in ("_text", "_spans", "_terms")]
            yield pa.record_batch([pa.array(out, pa.string()) if n == text else batch.column(n) for n in names], names)

    spans = all_spans(docs, id, text).where("size(spans) > 0 OR size(terms) > 0").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("spans").alias("_spans"), F.col("terms").alias("_terms")).dropDuplicates(["_k1", "_k2"])
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumns({"_k1": F.xxhash64(F.lit(1), F.col(id)), "_k2": F.xxhash64(raw), "_text": F.col(text)}).join(spans, ["_k1", "_k2"], "left").drop("_k1", "_k2")
    schema = docs.schema
    return rows.mapInArrow(clean, schema).select(*docs.columns)
