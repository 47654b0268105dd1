"""The whole batch chain, from accepted events to alerts, as one lazily built plan."""

from __future__ import annotations

from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import baseline, correlation, detection, features, fusion
from ..operators import sessions as session_ops
from ..settings import BASELINE
from ..sources.state import settle, settle_by


class Chain:
    """Each stage as a DataFrame, built when first asked for.

    Stages that others read more than once are settled in the shared checkpoint folder, so that the plans that follow
    start from their rows. Events are dealt by user once, and what is settled of users stays dealt so (settle_by): the
    stages behind shuffle nothing but what goes to groups. as_of defaults to the newest event's time (one row read from the events).
    baseline_config and overrides are those of the operators.
    """

    def __init__(self, events: DataFrame, peers: DataFrame, rules: list[dict[str, Any]] | None = None, as_of_ms: int | None = None, overrides: dict | None = None, baseline_config: dict = BASELINE, suppressed: DataFrame | None = None):
        self.events, self._peers, self.rules, self.overrides, self.config, self.suppressed = events, peers, rules or [], overrides, baseline_config, suppressed
        self._as_of = as_of_ms

    @cached_property
    def as_of(self) -> int:
        return self._as_of if self._as_of is not None else (self.events.agg(F.max("event_time_ms")).first()[0] or 0)

    @cached_property
    def peers(self) -> DataFrame:
        return settle(self._peers)  # a row a user, which half of the stages join

    @cached_property
    def tasks(self) -> int:
        return features.tasks_of(self.events)

    def kept(self, *parts: DataFrame) -> DataFrame:
        """parts settled by user, in as many tasks as the events."""
        return settle_by("user_name", self.tasks, *parts)

    @cached_property
    def dealt(self) -> DataFrame:
        return self.kept(self.events)

    @cached_property
    def parts(self) -> DataFrame:
        return self.kept(*features.counted_and_named(self.dealt))

    @cached_property
    def windows(self) -> DataFrame:
        return self.kept(features.windows_in(self.parts))

    @cached_property
    def values(self) -> DataFrame:
        return features.values_in(self.parts)

    @cached_property
    def bounds(self) -> DataFrame:
        return features.activity_bounds(self.events)

    @cached_property
    def sessions(self) -> DataFrame:
        return session_ops.sessions(self.dealt)

    @cached_property
    def spans(self) -> DataFrame:
        """Of the sessions what incidents need."""
        samples = [f"{c}_samples" for c in session_ops.SAMPLES]
        return self.kept(self.sessions.select("user_name", "session_id", "start_time", "first_event_id", "last_event_time", *samples))

    @cached_property
    def personal(self) -> DataFrame:
        return self.kept(baseline.personal_baselines(self.windows, self.as_of, config=self.config))

    @cached_property
    def groups(self) -> DataFrame:
        return settle(baseline.group_baselines(self.windows, self.personal, self.peers, self.as_of, config=self.config))

    @cached_property
    def value_counts(self) -> DataFrame:
        first = self.parts.where("window_size = 86400").groupBy("user_name").agg(F.min("first_ms").alias("first_time_ms"))
        return self.kept(baseline.value_counts(self.values, first, self.peers, self.as_of))

    @cached_property
    def value_baselines(self) -> DataFrame:
        return self.own_values.unionByName(self.group_values)

    @cached_property
    def own_values(self) -> DataFrame:
        return baseline.own_values(self.value_counts)

    @cached_property
    def group_values(self) -> DataFrame:
        return baseline.group_values(self.value_counts)

    @cached_property
    def scoped(self) -> DataFrame:
        tested = self.windows.where(F.col("window_size").isin(*detection.SIZES))
        return detection.window_policy(detection.scopes(tested, self.personal, self.groups, self.peers), self.values, self.overrides)

    @cached_property
    def numeric(self) -> DataFrame:
        return detection.numeric_candidates(self.scoped)

    @cached_property
    def valued(self) -> DataFrame:
        return detection.value_candidates(self.scoped, self.values, self.own_values, self.group_values)

    @cached_property
    def ruled(self) -> DataFrame:
        return detection.rule_candidates(self.dealt, self.windows, self.values, self.rules)

    @cached_property
    def found(self) -> tuple[DataFrame, ...]:
        """The candidates in parts, of which most stay dealt by user; for who reads them once."""
        own, others = (detection.value_candidates(self.scoped, self.values, *v) for v in ((self.own_values, None), (None, self.group_values)))
        return self.numeric, own, others, self.ruled

    @cached_property
    def candidates(self) -> DataFrame:
        return self.kept(*self.found)

    @cached_property
    def tops(self) -> DataFrame:
        """The first events of every window with a candidate."""
        sizes = tuple(sorted({*detection.SIZES, *(r["window_size"] for r in self.rules if r["scope"] == "window")}))
        return self.kept(detection.window_evidence(self.candidates.where("window_size > 0"), self.dealt, sizes))

    @cached_property
    def own_events(self) -> DataFrame:
        return detection.event_items(self.candidates, self.dealt)

    @cached_property
    def evidence(self) -> DataFrame:
        return detection.evidence(self.candidates, self.tops, self.own_events)

    @cached_property
    def keyed(self) -> DataFrame:
        return self.kept(correlation.group_keys(self.candidates, self.spans))

    @cached_property
    def incidents(self) -> DataFrame:
        return correlation.incidents(self.keyed.where("detector_mode = 'active'"), self.tops, self.own_events, self.values, self.spans)

    @cached_property
    def rated(self) -> DataFrame:
        """Of the incidents what their risk depends on, for those who read it more than once."""
        return self.kept(self.incidents.select("user_name", "incident_key", "first_seen", "incident_type", "aggregation_score", "detector_family_count", "source_types"))

    @cached_property
    def assessments(self) -> DataFrame:
        return fusion.assessments(self.incidents, self.suppressed, now_ms=self._as_of)

    @cached_property
    def alerts(self) -> DataFrame:
        return fusion.alerts(self.assessments)
