"""A quality classifier: random Fourier features of document statistics, ridge regression by summed normal equations,
isotonic calibration."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

FEATURES = 400
RIDGE = 1e-3
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
THRESHOLD = 0.3
BINS = 1000
ROWS_A_PARTITION = 20_000
#: Documents longer than this pass zlib in pieces of it.
ZLIB_BYTES = 1 << 20
CLASSES = np.zeros((256, 12))
for _k, _set in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".", b",;:", b"!", b"?", b"#*$%&<>@\\^~`_=+{}[]", b"|", bytes(range(128, 256))]):
    CLASSES[np.frombuffer(_set, np.uint8), _k] = 1


def statistics(text: str | None) -> list[float]:
    """Numbers that describe a whole text; all finite, for empty texts too."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = counts @ CLASSES / size
    p = counts[counts > 0] / size
    lengths = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    line_lengths = np.fromiter(map(len, lines), np.float64, len(lines)) if lines else np.zeros(1)
    pairs, triples = zip(words, words[1:], strict=False), zip(words, words[1:], words[2:], strict=False)
    packed = sum(len(zlib.compress(raw[i : i + ZLIB_BYTES], 1)) for i in range(0, len(raw), ZLIB_BYTES))
    ends = sum(w[-1] in b".,;:!?" for w in words)
    capital = sum(65 <= w[0] <= 90 for w in words)
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    odd = sum(not (97 <= (w[-1] | 32) <= 122 or w[-1] > 127 or w[-1] in b".,") for w in words)
    return [
        np.log1p(len(words)), np.log1p(len(raw)), np.log1p(len(lines)), lengths.mean(), lengths.std(), np.log1p(lengths.max()),
        len(set(words)) / n, len(set(pairs)) / n, len(set(triples)) / n, np.log1p(line_lengths.mean()), np.log1p(line_lengths.std()), len(set(lines)) / m,
        float(-(p * np.log2(p)).sum()) if len(p) else 0.0, packed / size, ends / n, capital / n, upper / n, odd / n, float((lengths <= 3).mean()), *np.sqrt(shares).tolist(),
    ]


def document_statistics(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, x (statistics of the whole text) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [statistics(x.as_py()) for x in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.list_(pa.float64()))], ["doc_id", "x"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(rows, f"doc_id {kind}, x array<double>")


def fold(id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


@dataclass
class Model:
    """mean and scale of the statistics, the random features, their weights, and the calibrated steps."""

    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Whose products approximate a Gaussian kernel; the statistics themselves and 1 come after them."""
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / len(self.shifts)) * np.cos(z @ self.waves + self.shifts), z / 10, np.ones((len(z), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.round(np.interp(self.raw(x), self.edges, self.values), 6)


def summed(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The normal equations of rows (x, y): each partition sums its own, Spark sums their rows."""
    width = len(model.shifts) + len(model.mean) + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist())
            if len(x):
                f = model.features(x)
                total += f.T @ np.concatenate([f, batch.column(1).to_numpy()[:, None]], axis=1)
        yield pa.record_batch([pa.array(range(width), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held[i] = held.get(i, 0) + v.values.to_numpy()
        if held:
            yield pa.record_batch([pa.array([*held], pa.int32()), pa.array([*held.values()], pa.list_(pa.float64()))], ["i", "v"])

    parts = rows.select("x", "y").mapInArrow(sums, "i int, v array<double>").repartition("i").mapInArrow(add, "i int, v array<double>")
    total = np.zeros((width, width + 1))
    for r in parts.collect():  # width rows
        total[r.i] = r.v
    return total[:, :-1], total[:, -1]


def isotonic(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to means by weighted squares: adjacent violators are pooled."""
    blocks: list[list[float]] = []
    for w, m in zip(weights.tolist(), means.tolist(), strict=True):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, n2 = blocks.pop()
            w1, m1, n1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), n1 + n2])
    return np.repeat([b[1] for b in blocks], [int(b[2]) for b in blocks])


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = 7) -> Model:
    """A model of rows (x, y, fold): fold CALIBRATION calibrates, fold HELD_OUT is left alone, the others teach.

    All labelled rows are used. What comes to the driver are sums of a fixed size and a histogram of BINS scores.
    Without labels every score is 1; with one fold alone the calibration is the labels' mean.
    """
    rows = labelled.where(F.col("y").isNotNull() & (F.col("fold") != HELD_OUT))
    teach = rows.where(F.col("fold") != CALIBRATION)
    first = teach.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.count("v").alias("n")).orderBy("k").collect()
    if not first:
        d = len(statistics(""))
        return Model(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(d + 2), np.zeros(1), np.ones(1))
    mean, scale, n = np.array([r.m for r in first]), np.array([r.s if r.s > 1e-9 else 1.0 for r in first]), first[0].n
    r = np.random.default_rng(seed)
    width = np.sqrt(len(mean))  # of the kernel, in standard deviations
    model = Model(mean, scale, r.normal(size=(len(mean), features)) / width, r.uniform(0, 2 * np.pi, features), np.zeros(0), np.zeros(1), np.ones(1))
    a, b = summed(teach.repartition(max(1, -(-n // ROWS_A_PARTITION)), "doc_id"), model)
    model.weights = np.linalg.solve(a + ridge * n * np.eye(len(b)) / features, b)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).to_pylist()
            raw = model.raw(np.array(x)) if x else np.zeros(0)
            yield pa.record_batch([pa.array(np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)), batch.column(1)], ["bin", "y"])

    held = rows.where(F.col("fold") == CALIBRATION).select("x", "y").mapInArrow(bins, "bin int, y double").groupBy("bin").agg(F.count("y").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    if not held:
        (m,) = teach.agg(F.avg("y")).first()
        model.values = np.array([m])
        return model
    weights = np.array([h.n for h in held], float)
    model.edges = np.array([(h.bin + 0.5) / BINS * 2 - 0.5 for h in held])
    model.values = isotonic(weights, np.array([h.y for h in held]) / weights)
    return model


def scored(statistics: DataFrame, model: Model) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).to_pylist()
            yield pa.record_batch([batch.column(0), pa.array(model.score(np.array(x)) if x else np.zeros(0))], ["doc_id", "score"])

    kind = statistics.schema["doc_id"].dataType.simpleString()
    return statistics.select("doc_id", "x").mapInArrow(rows, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.3) of every row of docs.

    labels has id and label (0 or 1, nulls ignored); a document labelled twice teaches twice. Scores come from the
    text's statistics alone. Rows held out are those whose id's crc32 is divisible by 5. Null counts as empty.
    """
    held = cut(document_statistics(docs, id, text))
    labelled = held.join(labels.select(F.col(id).alias("doc_id"), F.col(label).cast("double").alias("y")), "doc_id")
    model = fit(labelled.withColumn("fold", fold(F.col("doc_id"))))
    out = scored(held, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
