"""A record's text is matched and read once, and records of few row groups are parsed by all cores."""

import re

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from vigil.functions import parsing
from vigil.source_queries import numbered
from vigil.sources.tables import read

LINE = '10.0.0.1 - u [02/Jan/2024:03:04:05 +0200] "GET /a HTTP/1.1" 200 5'


def _plan(df) -> str:
    return df._jdf.queryExecution().analyzed().toString()


def test_an_access_line_is_matched_once_for_all_groups(spark):
    rows = spark.createDataFrame([(LINE,)], "t string")
    assert _plan(rows.select(parsing.parse_svn(F.col("t")).alias("e"))).count(parsing.SVN) == 2  # whether it is one, and its groups


def test_a_document_is_read_once(spark):
    rows = spark.createDataFrame([("{}",)], "t string")
    for parse in (parsing.parse_sso, parsing.parse_gitlab):
        plan = _plan(rows.select(parse(F.col("t")).alias("e")))
        assert plan.count("parse_json(") + plan.count("parseJson(") == 1


def test_groups_of_odd_access_lines(spark):
    lines = [
        LINE, LINE + ' "ua"', LINE + ' "u a\n x" put /t r7', LINE + ' "ua" get-file /t\x01x r7 z', LINE.replace("GET", 'G"ET'), LINE.replace("HTTP/1.1", " \n x y"), LINE.replace("u [", "$1 ["), LINE.replace("/a", "\\$9"), LINE + "\n" + LINE,
        LINE.replace("200 5", "99999999999999999999 5"), "\n" + LINE, LINE.replace("+0200", '"0200'), LINE.replace("02/Jan", "02/Foo"), "x", "", None,
    ]
    got = {r.t: r.e for r in spark.createDataFrame([(x,) for x in lines], "t string").select("t", parsing.parse_svn(F.col("t")).alias("e")).collect()}
    for line in lines:
        m, e = re.match(parsing.SVN, line, re.ASCII) if line is not None else None, got[line]
        if not m or "/Foo/" in line or '"0200' in line:
            assert e is None, line
            continue
        status = int(m[7]) if int(m[7]) < 2**63 else None
        assert (e.source_ip, e.user_name, e.method, e.path, e.status_code, e.bytes, e.user_agent, e.resource_name) == (m[1], m[2], m[4], m[5], status, int(m[8]), m[9], m[11] or m[5]), line
        assert e.time == "2024-01-02T03:04:05+02:00"


def test_rows_of_one_row_group_are_dealt_to_all_cores(spark, tmp_path):
    rows = pq.read_table("/root/testdata/sf0.001/events.parquet")
    many = pa.concat_tables([rows] * (250_000 // len(rows) + 1)).combine_chunks()
    many = many.set_column(0, "event_id", pa.array(range(len(many))))
    pq.write_table(many, tmp_path / "events.parquet", row_group_size=len(many))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str((tmp_path / "events.parquet").stat().st_size // 8))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert read(spark, str(tmp_path), "events").rdd.getNumPartitions() >= 4  # parts of a file, of which one has the rows
        held = [r["count"] for r in numbered(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sum(held) == len(many) and len(held) >= 4 and max(held) < len(many) / 2
