"""Values that a record's functions name often are worked out once for a record."""

from pyspark.sql import functions as F

from vigil.functions import parsing, registry, text

PAIRS = {"parser_id": "pairs", "status": "active", "parser_type": "key_value", "field_candidates": {"a": "", "b": "", "c": ""}, "schema_mapping": {"a": "user.name", "b": "network.bytes", "c": "event.action"}}


def _plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_lines_of_a_loose_object_are_split_once(spark):
    rows = spark.createDataFrame([("a: 1",)], "t string")
    assert _plan(rows.select(parsing.parse_hiklink(F.col("t")).alias("e"))).count("split(") == 1


def test_pairs_are_looked_for_once_whatever_is_mapped(spark):
    rows = spark.createDataFrame([("a=1 b=2 c=3", "s", "k")], "raw_text string, source_id string, source_type string")
    assert _plan(rows.select(text.key_values(F.col("raw_text")).alias("m"))).count("regexp_extract_all(") == 1
    chosen = registry.select_parser(rows, [PAIRS])
    assert _plan(chosen).count("regexp_extract_all(") == 1
    assert chosen.select("parser.id", "parser.values").first()["values"]["network.bytes"] == "2"


def test_source_is_told_from_a_text_stripped_once(spark):
    rows = spark.createDataFrame([(' {"username": 1, "route": 2} ',)], "t string")
    told = rows.select(text.detect_source(F.col("t")).alias("s"))
    assert _plan(told).count("^\\s+") == 1 and told.first().s == "gitlab"


def test_last_of_repeated_keys_counts(spark):
    many = " ".join(f"k{i % 1000}={i}" for i in range(4000))
    rows = spark.createDataFrame([("b=1 a=2 b=3 c=4 a=5",), (many,), ("",), (None,)], "t string").select(text.key_values(F.col("t")).alias("m"))
    first, second, empty, none = (r.m for r in rows.collect())
    assert first == {"b": "3", "c": "4", "a": "5"} and second == {f"k{i}": str(3000 + i) for i in range(1000)}
    assert empty == {} and none is None
    told = spark.createDataFrame([('{\n uid: "u",\n uid: "v",\n path: "p",\n path: null\n}',)], "t string").select(parsing.parse_hiklink(F.col("t")).alias("e")).first().e
    assert told.user_name == "v" and told.action == "p" and told.extensions == {"uid": "v", "path": "p"}
