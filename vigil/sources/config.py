"""Settings of sources, brokers, policies and models from small YAML files: sections of scalars, lists and sections."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

from ..settings import DETECTION, FUSION

# fixed values
SOURCE_TYPES = ("auto", "svn", "sso", "gitlab", "hiklink")
POLICY = {"rare_event_count_max": int, "p95_score": int, "p99_score": int, "new_value_score": int, "rare_value_score": int, "rare_share_threshold": float}
FUSION_NAMES = {"alert_threshold": "alert_threshold", "critical_threshold": "critical_threshold", "cross_system_bonus": "cross_system_bonus", "detector_family_bonus": "family_bonus", "detector_family_bonus_cap": "family_bonus_cap", "per_user_daily_alert_limit": "daily_alerts"}
MODEL = {"threshold_quantile": float, "min_training_samples": int, "min_peer_members": int, "top_feature_count": int, "hbos_min_bins": int, "hbos_max_bins": int, "isolation_forest_estimators": int, "isolation_forest_max_samples": int, "random_state": int}


class ConfigError(ValueError):
    pass


def _scalar(text: str) -> Any:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    return {"true": True, "false": False}.get(text, text)


def read_settings(path: str | Path) -> dict[str, Any]:
    """The file's settings as nested dictionaries and lists, by indentation. Values are text, true or false."""
    lines = [x.rstrip() for x in Path(path).read_text(encoding="utf-8").splitlines() if x.strip() and not x.lstrip().startswith("#")]
    depth = [len(x) - len(x.lstrip()) for x in lines]

    def block(i: int, indent: int) -> tuple[Any, int]:
        out: Any = [] if lines[i].lstrip().startswith("- ") else {}
        while i < len(lines) and depth[i] == indent:
            body = lines[i].strip()
            if isinstance(out, list):
                if not body.startswith("- "):
                    break
                if ":" in body and not body[2:].strip().startswith(("'", '"')) and re.match(r"- [\w.-]+:(\s|$)", body):
                    lines[i], depth[i] = " " * (indent + 2) + body[2:], indent + 2
                    value, i = block(i, indent + 2)
                    out.append(value)
                else:
                    out.append(_scalar(body[2:]))
                    i += 1
                continue
            key, colon, rest = body.partition(":")
            if not colon or body.startswith("- "):
                raise ConfigError(f"neither a setting nor a list: {body}")
            i += 1
            if rest.strip():
                out[key.strip()] = _scalar(rest)
            elif i < len(lines) and (depth[i] > indent or (depth[i] == indent and lines[i].lstrip().startswith("- "))):
                out[key.strip()], i = block(i, depth[i])
            else:
                out[key.strip()] = {}
        return out, i

    if not lines:
        return {}
    out, end = block(0, depth[0])
    if end < len(lines):
        raise ConfigError(f"unexpected indentation: {lines[end].strip()}")
    return out


def _typed(settings: dict[str, Any], kinds: dict[str, type]) -> dict[str, Any]:
    out = {}
    for k, v in settings.items():
        try:
            out[k] = kinds[k](v) if k in kinds else v
        except (TypeError, ValueError) as error:
            raise ConfigError(f"{k} must be a number") from error
    return out


def sources(path: str | Path) -> list[dict[str, Any]]:
    """source_id, source_type, record_mode, paths and the rest of every source."""
    held = read_settings(path)
    include = bool(held.get("raw", {}).get("include_text_in_event", False))
    return [{"include_raw_text": include, **s} for s in held.get("sources", [])]


def kafka(path: str | Path) -> dict[str, Any]:
    return read_settings(path).get("kafka", {})


def provider(path: str | Path) -> dict[str, Any]:
    return _typed(read_settings(path).get("llm", {}), {"timeout_seconds": int, "sample_limit": int})


def fusion(path: str | Path) -> dict[str, Any]:
    """The policy of fusion.assessments, with what the file leaves out as it is by default."""
    held = _typed(read_settings(path).get("fusion", {}), {k: int for k in FUSION_NAMES})
    return FUSION | {own: held[name] for name, own in FUSION_NAMES.items() if name in held}


def detection(path: str | Path) -> tuple[dict[str, Any], dict[str, dict[str, Any]]]:
    """The defaults of detection.window_policy and the overrides of source types."""
    held = read_settings(path).get("detection", {})
    overrides = held.pop("source_type", {})
    return DETECTION | _typed(held, POLICY), {k: _typed(v, POLICY) for k, v in overrides.items()}


def models(path: str | Path) -> dict[str, Any]:
    return _typed(read_settings(path).get("model_detection", {}), MODEL)


def validated_source(values: dict[str, str]) -> dict[str, Any]:
    """The settings of a source that a person entered, or ConfigError for what is wrong."""
    def need(holds: Any, message: str) -> None:
        if not holds:
            raise ConfigError(message)

    of = lambda name, default="": values.get(name, default).strip()
    line = lambda text, most: 0 < len(text) <= most and not re.search(r"[\r\n]", text)
    kind, ident, source_type = of("kind", "local"), of("source_id"), of("source_type", "auto")
    need(kind in ("local", "kafka"), "a source is local or kafka")
    need(re.fullmatch(r"[A-Za-z0-9._-]{1,64}", ident), "source_id has 1 to 64 letters, digits, dots, underscores and hyphens")
    need(source_type in SOURCE_TYPES, f"unknown source type {source_type}")
    out = {"kind": kind, "source_id": ident, "source_type": source_type, "product": of("product") or None, "format_version": of("format_version") or None, "include_raw_text": of("include_raw_text") == "true"}
    if kind == "local":
        need(of("record_mode", "line") in ("line", "object"), "record_mode is line or object")
        need(line(of("path"), 1000), "a path or pattern is needed")
        return out | {"record_mode": of("record_mode", "line"), "paths": [of("path")]}
    topics = [t.strip() for t in of("topics").split(",") if t.strip()]
    need(line(of("bootstrap_servers"), 1000), "bootstrap servers are needed")
    need(topics and all(line(t, 249) for t in topics), "a topic is needed")
    need(line(of("group_id"), 255), "a group is needed")
    return out | {"bootstrap_servers": of("bootstrap_servers"), "topics": topics, "group_id": of("group_id")}


