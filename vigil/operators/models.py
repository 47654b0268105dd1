"""Outlier scores of user windows: histograms and isolation trees."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.state import settle
from .ranks import empirical, quantiles

# fixed values
QUANTILE, MIN_ROWS, MIN_MEMBERS, MIN_BINS, MAX_BINS, TOP = 0.995, 100, 5, 5, 20, 3
TREES, MAX_SAMPLES, SEED = 200, 256, 42
FEATURES = (
    "event_count_log", "failure_rate", "other_outcome_rate", "source_type_distinct_log", "source_ip_distinct_log", "resource_distinct_log", "action_distinct_log", "read_rate", "write_rate", "network_bytes_log",
    "first_seen_ip_rate", "first_seen_resource_rate", "first_seen_action_rate",
)


class ModelError(ValueError):
    pass


def features(windows: DataFrame, keep: tuple[str, ...] = ("user_name", "window_size", "window_start")) -> DataFrame:
    """The derived numbers of each window: logarithms of counts and rates with denominators of 1 at least."""
    at_least = lambda c, low: F.greatest(F.col(c).cast("double"), F.lit(low))
    log = lambda c: F.log1p(at_least(c, 0.0))
    rate = lambda c, of: F.col(c) / at_least(of, 1.0)
    made: dict[str, Column] = {"event_count_log": log("event_count"), "failure_rate": rate("failure_count", "event_count"), "other_outcome_rate": rate("other_outcome_count", "event_count"), "read_rate": rate("read_action_count", "event_count"), "write_rate": rate("write_action_count", "event_count"), "network_bytes_log": log("network_bytes_total")}
    made |= {f"{k}_distinct_log": log(f"{k}_distinct_count") for k in ("source_type", "source_ip", "resource", "action")}
    made |= {f"first_seen_{k}_rate": rate(f"first_seen_{k}_count", f"{v}_distinct_count") for k, v in (("ip", "source_ip"), ("resource", "resource"), ("action", "action"))}
    return windows.select(*keep, *[made[f].alias(f) for f in FEATURES])


def long_features(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """keys, feature, value: a row for each number of each vector."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value")) for f in FEATURES])
    return vectors.select(*keys, F.explode(pairs).alias("_x")).select(*keys, "_x.*")


def inner_fractions(total: Column) -> Column:
    """Those of the quantiles that are the edges of a histogram of total values."""
    bins = F.greatest(F.lit(MIN_BINS), F.least(F.lit(MAX_BINS), F.ceil(F.sqrt(total)))).cast("int")
    return F.transform(F.sequence(F.lit(1), bins - 1), lambda i: i / bins)


def fit_histograms(vectors: DataFrame, group: str) -> DataFrame:
    """group, feature, n, low, high, edges, counts of the training vectors of each group of MIN_ROWS and more.

    Inner quantiles of the features, without repeats, are the edges; a value's bin is the number of edges not above it.
    """
    long = long_features(vectors, [group])
    sizes = vectors.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_ROWS)
    long = long.join(sizes.select(group), group, "left_semi")

    ends = long.groupBy(group, "feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    cuts = quantiles(long, [group, "feature"], inner_fractions).select(group, "feature", F.col("total").alias("n"), F.array_sort(F.array_distinct("q")).alias("edges"))
    binned = long.join(cuts, [group, "feature"]).groupBy(group, "feature", F.size(F.filter("edges", lambda e: e <= F.col("value"))).alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    held = binned.groupBy(group, "feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "c"))).alias("counts"))  # a bin each
    return ends.join(cuts, [group, "feature"]).join(held, [group, "feature"])


def raw_scores(vectors: DataFrame, histograms: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """keys, group, raw score (9 digits, so that no order of summing shows) and contributions of vectors."""
    keys = [*keys, *([] if group in keys else [group])]
    rows = long_features(vectors, keys).join(histograms, [group, "feature"])
    v, size = F.col("value"), F.size("edges") + 1
    count = F.coalesce(F.try_element_at("counts", F.size(F.filter("edges", lambda e: e <= v))), F.lit(0))
    outside = (v < F.col("low")) | (v > F.col("high"))
    rows = rows.withColumn("part", -F.log(F.when(outside, 1.0).otherwise(count + 1.0) / (F.col("n") + size)))
    parts = F.array_sort(F.collect_list(F.struct((-F.round("part", 9)).alias("minus"), "feature")))
    return rows.groupBy(*keys).agg(F.round(F.sum("part"), 9).alias("raw"), parts.alias("contributions"))


def judged(rows: DataFrame, known: DataFrame, group: str | list[str], quantile: float = QUANTILE, fire_only: bool = False) -> DataFrame:
    """rows (group, raw, ...) with threshold, percentile among known (group, raw, and n where a row stands for more), score
    and whether they fire; fire_only leaves out those that do not before they are ranked."""
    keys = [group] if isinstance(group, str) else group
    counts = ["n"] if "n" in known.columns else []
    limits = quantiles(known.select(*keys, F.col("raw").alias("value"), *counts), keys, lambda _: F.array(F.lit(quantile))).select(*keys, F.col("q")[0].alias("threshold"))
    if fire_only:
        rows = rows.join(limits, keys).where(F.col("raw") >= F.col("threshold"))
    out = empirical(rows, known.select(*keys, "raw", *counts), keys, "raw")
    out = out if fire_only else out.join(limits, keys)
    tail = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("percentile") - quantile) / (1 - quantile)))
    return out.withColumns({"score": F.bround(60 + 40 * tail).cast("int"), "fires": F.col("raw") >= F.col("threshold")})


def scored(vectors: DataFrame, training: DataFrame, group: str, keys: list[str], quantile: float = QUANTILE) -> DataFrame:
    """vectors' raw score, empirical percentile among the group's training scores, threshold, score and top features.

    keys name a row within its group, in vectors and in training.
    """
    histograms = settle(fit_histograms(training, group))
    known = settle(raw_scores(training, histograms, group, keys).select(group, "raw"))
    rows = judged(raw_scores(vectors, histograms, group, keys), known, group, quantile)
    return rows.withColumn("top_features", F.transform(F.slice("contributions", 1, TOP), lambda x: x["feature"])).drop("contributions")


def _tree(rows: np.ndarray, seed: int, t: int) -> dict:
    """An isolation tree over rows: arrays of split feature (-1 at a leaf), split, left child (the right one follows it),
    and the path length a leaf stands for."""
    take, rng = len(rows), np.random.default_rng([seed, t])
    feature, split, left, path = [], [], [], []
    todo = [(np.arange(take), 0)]
    while todo:  # breadth first: children are added in pairs, so the right one follows the left
        own, depth = todo.pop(0)
        x = rows[own]
        low, high = x.min(0), x.max(0)
        open_ = np.flatnonzero(high > low)
        if len(own) <= 1 or depth >= math.ceil(math.log2(max(take, 2))) or not len(open_):
            feature.append(-1), split.append(0.0), left.append(-1), path.append(depth + average_path(len(own)))
            continue
        f = int(rng.choice(open_))
        s = float(rng.uniform(low[f], high[f]))
        below = x[:, f] <= s
        feature.append(f), split.append(s), left.append(len(feature) + len(todo)), path.append(0.0)
        todo += [(own[below], depth + 1), (own[~below], depth + 1)]
    return {"feature": feature, "split": split, "left": left, "path": path, "take": take}


def average_path(n: int) -> float:
    """The mean length of an unsuccessful search in a binary search tree of n keys."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def fit_forest(training: DataFrame, group: str, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """The isolation trees of each group of MIN_ROWS and more: group, tree, feature, split, left, path, take.

    Each tree sees MAX_SAMPLES rows of all of the group's, those of least hash for the tree. Rows whose hash is far from
    the least are passed over where they are, so what is shuffled are some hundred rows a tree, whatever the group's size,
    and each tree is a task's work of its own.
    """
    most = MAX_SAMPLES + 8 * math.isqrt(MAX_SAMPLES)  # so many are expected below the bound: enough but for one case in 10^9
    sizes = training.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_ROWS)
    named = training.select(group, F.xxhash64(*sorted(training.columns)).alias("_h"), *FEATURES).join(sizes, group)
    place = lambda t: F.pmod(F.xxhash64("_h", t), F.col("_n"))
    chosen = named.withColumn("tree", F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: place(t) < most)))
    chosen = chosen.withColumn("_i", F.row_number().over(Window.partitionBy(group, "tree").orderBy(place(F.col("tree")), "_h"))).where(F.col("_i") <= MAX_SAMPLES)
    kind = training.schema[group].dataType.simpleString()

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_i")  # the same rows, the same trees
        t = int(part["tree"].iloc[0])
        made = pd.DataFrame([{group: part[group].iloc[0], "tree": t, **_tree(part[list(FEATURES)].to_numpy(), seed, t)}])
        return made

    return chosen.select(group, "tree", "_i", *FEATURES).groupBy(group, "tree").applyInPandas(fit, f"{group} {kind}, tree int, feature array<int>, split array<double>, left array<int>, path array<double>, take int")


def forest_scores(vectors: DataFrame, forest: DataFrame, group: str, keys: list[str], block: int = 20_000) -> DataFrame:
    """keys, group, raw (0 to 1, higher: easier to isolate), of vectors by their group's trees.

    Groups are dealt into blocks of some block vectors; each block meets a copy of its group's trees.
    """
    keys = [*keys, *([] if group in keys else [group])]
    sizes = vectors.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    rows = vectors.select(*keys, *FEATURES).join(sizes, group).withColumn("_block", F.pmod(F.xxhash64(*keys), F.col("_blocks")).cast("int")).drop("_blocks")
    copies = forest.join(sizes, group).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    kinds = ", ".join(f"{k} {vectors.schema[k].dataType.simpleString()}" for k in keys)

    def score(own: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        out = own[keys].copy()
        if not len(own) or not len(trees):
            return out.iloc[:0].assign(raw=pd.Series(dtype=float))
        x, total = own[list(FEATURES)].to_numpy(), np.zeros(len(own))
        every = np.arange(len(own))
        for t in trees.itertuples():
            feature, split, left, path = (np.asarray(c) for c in (t.feature, t.split, t.left, t.path))
            at = np.zeros(len(own), np.int64)
            while (inner := feature[at] >= 0).any():
                f = feature[at]
                step = left[at] + (x[every, np.maximum(f, 0)] > split[at])
                at = np.where(inner, step, at)
            total += path[at]
        out["raw"] = np.round(2.0 ** (-total / len(trees) / average_path(int(trees["take"].iloc[0]))), 9)
        return out

    return rows.groupBy(group, "_block").cogroup(copies.groupBy(group, "_block")).applyInPandas(score, f"{kinds}, raw double")


def forest_scored(vectors: DataFrame, training: DataFrame, group: str, keys: list[str], quantile: float = QUANTILE, trees: int = TREES) -> DataFrame:
    """vectors' raw isolation score, percentile, threshold, score, and the features furthest from the training median
    in MADs: context, not attribution."""
    forest = settle(fit_forest(training, group, trees))
    scores = settle(forest_scores(vectors, forest, group, keys))
    known = scores.select(group, "raw") if training is vectors else settle(forest_scores(training, forest, group, keys).select(group, "raw"))
    return judged(scores, known, group, quantile).join(furthest(vectors, training, group, keys), [*keys, *([] if group in keys else [group])])


def furthest(vectors: DataFrame, training: DataFrame, group: str, keys: list[str]) -> DataFrame:
    """keys, group, top_features: the TOP features of each vector that are furthest from its group's training median in
    MADs. A group's medians are one row, so that a vector is told where it lies and makes no rows of its own."""
    both = [group, "feature"]
    half = lambda _: F.array(F.lit(0.5))
    long = long_features(training, [group])
    middle = settle(quantiles(long, both, half).select(*both, F.col("q")[0].alias("median")))
    spread = quantiles(long.join(middle, both).select(*both, F.abs(F.col("value") - F.col("median")).alias("value")), both, half).select(*both, F.col("q")[0].alias("mad"))
    entry = F.struct("feature", F.struct("median", "mad"))
    limits = settle(middle.join(spread, both).groupBy(group).agg(F.map_from_entries(F.collect_list(entry)).alias("_at")))  # a feature each
    at = lambda f: F.col("_at")[f]
    far = F.array(*[F.struct((-F.abs(F.col(f) - at(f)["median"]) / F.greatest(at(f)["mad"], F.lit(1e-9))).alias("minus"), F.lit(f).alias("feature")) for f in FEATURES])
    tops = F.transform(F.slice(F.array_sort(far), 1, TOP), lambda x: x["feature"]).alias("top_features")
    return vectors.join(limits, group).select(*keys, *([] if group in keys else [group]), tops)
