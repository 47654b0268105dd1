"""Text of raw records: kind, format, template and redaction, as column expressions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: an access log line, and names of fields that are never shown
ACCESS = r"^\d+\.\d+\.\d+\.\d+ - \S+ \[[^\]]+\] \"\S+ "
SENSITIVE = r"(?i)\b(\w*(?:password|passwd|token|authorization|api[_-]?key|secret)\w*)\s*=\s*[^\s,;]+"

SENSITIVE_KEY = re.compile(r"(?i)password|passwd|token|authorization|api[_-]?key|secret")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once for a row, however often body names it. A column that is named again within
    a lambda or a branch is worked out again there, so that nested functions of a record would multiply."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last_of(pairs: Column) -> Column:
    """Pairs (k, v) whose key does not come again, in their order. By sorting, so that a long record takes no square time."""
    numbered = F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), (-i).alias("minus"), p["v"].alias("v")))
    kept = let(F.array_sort(numbered), lambda s: F.filter(s, lambda p, i: (i == 0) | (F.get(s, i - 1)["k"] != p["k"])))
    back = F.array_sort(F.transform(kept, lambda p: F.struct((-p["minus"]).alias("i"), p["k"].alias("k"), p["v"].alias("v"))))
    return F.transform(back, lambda p: F.struct(p["k"].alias("k"), p["v"].alias("v")))


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode's too."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def is_json(text: Column) -> Column:
    """Whether the whole text is one JSON value: the parser itself would take a value that other text follows."""
    inside = lambda a, b: F.try_parse_json(F.concat(F.lit(a), text, F.lit(b))).isNotNull()
    return inside("[", "]") & inside('{"a":', "}")


def detect_format(text: Column) -> Column:
    """empty, json, json_like, key_value, apache_access or text; null counts as empty."""

    def of(t: Column) -> Column:
        opens = F.startswith(t, F.lit("{"))
        return (
            F.when(t == "", "empty").when(opens & is_json(t), "json").when(opens, "json_like").when(F.regexp_like(t, F.lit(r"(?U)\b\w+=")), "key_value").when(F.regexp_like(t, F.lit(ACCESS)), "apache_access").otherwise("text")
        )

    return let(strip(F.coalesce(text, F.lit(""))), of)


def detect_source(text: Column) -> Column:
    """svn, sso, gitlab, hiklink or unknown, by what the record looks like."""

    def of(t: Column, valid: Column, keys: Column) -> Column:
        has = lambda *names: F.coalesce(F.array_size(F.array_intersect(keys, F.array(*map(F.lit, names)))) == len(names), F.lit(False))
        named = F.when(has("shortName", "eventType"), "sso").when(has("username", "route"), "gitlab")
        return named.when(F.startswith(t, F.lit("{")) & ~valid & F.contains(t, F.lit("uid:")) & F.contains(t, F.lit("attribute2:")), "hiklink").otherwise("unknown")

    valid = lambda t: F.try_parse_json(F.when(F.startswith(t, F.lit("{")), t)).isNotNull()
    keyed = lambda t: let(valid(t), lambda ok: let(F.json_object_keys(F.when(ok, t)), lambda keys: of(t, ok, keys)))
    return let(strip(F.coalesce(text, F.lit(""))), lambda t: F.when(F.regexp_like(t, F.lit(ACCESS)), "svn").otherwise(keyed(t)))


def template_hint(text: Column) -> Column:
    """The record with addresses, long numbers and values masked; at most 500 characters."""
    t = F.regexp_replace(strip(text), r"(?U)\b\d+\.\d+\.\d+\.\d+\b", "<IP>")
    t = F.regexp_replace(t, r"(?U)\b\d{2,}\b", "<NUM>")
    return F.left(F.regexp_replace(t, r"=(?!<)(\S+)", "=<VAR>"), F.lit(500))


def redact(text: Column) -> Column:
    """key=value pairs with sensitive keys show <REDACTED> for the value."""
    return F.regexp_replace(text, SENSITIVE, "$1=<REDACTED>")


def _hidden(document: dict) -> dict:
    """The object with <REDACTED> for the value of every sensitive key, objects within it too; lists stay as they are."""
    return {k: "<REDACTED>" if SENSITIVE_KEY.search(k) else _hidden(v) if isinstance(v, dict) else v for k, v in document.items()}


def redact_any(text: Column) -> Column:
    """redact for what is no JSON; of a JSON object all sensitive keys at any depth, with its keys sorted; any other JSON
    as it is. Objects are few among logs, and only they go through Python."""

    @F.pandas_udf("string")
    def hidden(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if not isinstance(t, str) else json.dumps(_hidden(json.loads(t)), ensure_ascii=False, sort_keys=True))

    document = is_json(text)
    thing = F.startswith(strip(text), F.lit("{")) & document
    return F.when(thing, hidden(F.when(thing, text))).when(document, text).otherwise(redact(text))


def key_values(text: Column) -> Column:
    """key=value pairs as a map; of repeated keys the last one counts."""
    pairs = F.regexp_extract_all(text, F.lit(r"(\w+=\S+)"))
    halves = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("v")))
    return F.map_from_entries(last_of(halves)).cast("map<string,string>")
