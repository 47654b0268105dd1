"""Constants of the analytics whose values decide results."""

# fixed values: sizes and limits
WINDOW_SIZES = (60, 300, 3600, 86400)
SESSION_GAP_S = 1800
SAMPLE_LIMIT = 64
EVIDENCE_LIMIT = 20
HISTORY_DAYS = 30
BASELINE_SIZES = (3600, 86400)
VALUE_WINDOW_S = 3600
READ_SUFFIXES = ("_read", "_clone", "_checkout", "_pull")
WRITE_SUFFIXES = ("_write", "_push", "_delete", "_create", "_modify", "_rename", "_move")

METRICS = (
    "event_count", "success_count", "failure_count", "other_outcome_count", "source_type_distinct_count", "source_ip_distinct_count", "resource_distinct_count",
    "action_distinct_count", "read_action_count", "write_action_count", "network_bytes_total", "first_seen_ip_count", "first_seen_resource_count", "first_seen_action_count",
)

#: Ready from so many active days and samples; peers also from so many members.
BASELINE = {"min_active_days": 14, "min_samples": 20, "min_peer_members": 5, "min_peer_active_days": 14, "min_peer_samples": 100}
DETECTION = {"rare_share_threshold": 0.01, "rare_event_count_max": 3, "p95_score": 60, "p99_score": 80, "new_value_score": 75, "rare_value_score": 55}
CORRELATION = {"bucket_s": 3600, "session_window_s": 3600, "bonus": 5, "bonus_cap": 20}
FUSION = {"alert_threshold": 80, "critical_threshold": 90, "cross_system_bonus": 10, "family_bonus": 3, "family_bonus_cap": 10, "daily_alerts": 3}
