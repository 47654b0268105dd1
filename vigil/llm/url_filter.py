"""URL rules by Bloom filter cascades over the corpus's lookup keys. DataFrame functions only."""

from __future__ import annotations

import csv
import math
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Most hashes of a level: the first one lets about one in 2^30 other keys through at most.
MAX_HASHES = 30
#: A cascade whose first level would be larger is not sent to the executors: its keys are joined by shuffle.
MAX_BYTES = 16 << 20
#: Bits in a byte of a level, so that a byte is also a character.
BYTE = 7
LISTED_HOSTS = Path(__file__).with_name("listed_hosts.csv")


def place(key: Column, level: int, k: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level * MAX_HASHES + k)), F.lit(bits))


@dataclass(frozen=True)
class Level:
    """A Bloom filter as one binary value of the plan, in which hashes bits a key are set. Each level hashes in its own
    way, or keys that meet in one would meet in all."""

    number: int
    table: bytes
    bits: int
    hashes: int

    def hit(self, key: Column) -> Column:
        """Whether all the key's bits are set."""
        table = F.lit(self.table)

        def one(k: int) -> Column:
            bit = place(key, self.number, k, self.bits)
            byte = F.ascii(F.substring(table, F.floor(bit / BYTE).cast("int") + 1, F.lit(1)).cast("string"))
            return F.getbit(byte.cast("long"), F.pmod(bit, F.lit(BYTE)).cast("int")) == 1

        out = one(0)
        for k in range(1, self.hashes):
            out = out & one(k)
        return out


@dataclass(frozen=True)
class Cascade:
    """Levels in turn hold listed keys and other keys; a key's fate is told by the first level it misses."""

    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for null (false), the listed keys and every key of the universe."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed([*enumerate(self.levels)]):
            out = F.when(level.hit(key), out).otherwise(F.lit(i % 2 == 1))
        return F.coalesce(key.isNotNull() & out, F.lit(False))


def level_size(listed: int, others: int, first: bool) -> tuple[int, int]:
    """Bits and hashes of a level that holds listed keys against others. The first lets through about listed / sqrt(2)
    of the others, however many they are; each later one half of what it is held against."""
    hashes = min(MAX_HASHES, max(1, math.ceil(math.log2(max(2.0, others * math.sqrt(2) / listed))))) if first else 1
    return max(64, math.ceil(listed * hashes / math.log(2))), hashes


def fit_level(number: int, keys: DataFrame, bits: int, hashes: int) -> Level:
    """The level that holds the keys (column key). What comes to the driver is its bytes, bits / BYTE at most."""
    bit = F.explode(F.array(*[place(F.col("key"), number, k, bits) for k in range(hashes)]))
    value = F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("b", F.lit(BYTE)).cast("int"))).alias("v")
    table = bytearray(bits // BYTE + 1)
    for r in keys.select(bit.alias("b")).groupBy(F.floor(F.col("b") / BYTE).alias("at")).agg(value).collect():
        table[r["at"]] = r.v
    return Level(number, bytes(table), bits, hashes)


def fit_cascade(listed: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """A cascade over listed and universe (a column key each; nulls and repeats are ignored).

    Its size follows the listed keys: the first level has some 1.44 bits a key for each halving from the universe to
    them, all others together some 6. Ends when a level lets nothing of the other side through. None where the first
    level alone would pass max_bytes.
    """
    listed = cut(listed.select("key").where("key IS NOT NULL").distinct())
    others = cut(universe.select("key").where("key IS NOT NULL").distinct().join(listed, "key", "left_anti"))
    through, levels, counts = [listed, others], [], [listed.count(), others.count()]
    while n := counts[len(levels) % 2]:
        own, other = len(levels) % 2, (len(levels) + 1) % 2
        bits, hashes = level_size(n, counts[other], not levels)
        if bits > 8 * max_bytes:
            return None
        level = fit_level(len(levels), through[own], bits, hashes)
        levels.append(level)
        through[other] = cut(through[other].where(level.hit(F.col("key"))))
        counts[other] = through[other].count()
    return Cascade(tuple(levels))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ://."""
    url = F.coalesce(url, F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Rules (host, then path prefix) that would fit, longest first, ties by the longer host."""
    keys = F.flatten(F.transform(host_suffixes(host), lambda h: F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.char_length(path)), lambda n: F.concat(h, F.substring(path, F.lit(1), n)))))
    return F.reverse(F.array_sort(F.transform(keys, lambda k: F.struct(F.char_length(k).alias("n"), F.instr(k, "/").alias("h"), k.alias("k")))))["k"]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], hosts: DataFrame, id: str = "page_id", url: str = "url", max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page.

    rules: (verdict, host and path prefix), such as ("block", "example.org/es/"): fits the host and its subdomains
    where the path starts with the prefix; the longest wins. Without one, a page is blocked if its host or a parent
    is listed in hosts (column host), else allowed. Null and malformed urls have empty parts and are allowed.
    Rows are kept one for one, repeated ids too. Lists whose cascade would pass max_bytes are joined by shuffle, with
    the same result.
    """
    spark = pages.sparkSession
    lengths = sorted({len(r) - r.index("/") for _, r in rules})
    host, path = url_parts(F.col(url))
    parsed = pages.select(F.col(id).alias("page_id"), host.alias("host"), path.alias("path"))
    paths = cut(parsed.select("host", F.substring("path", 1, max(lengths, default=1)).alias("path")).distinct())  # all that keys are made of
    keys = rule_keys(F.col("host"), F.col("path"), lengths)
    looked_up = paths.select(F.explode(keys).alias("key"))
    allow, block = (fit_cascade(spark.createDataFrame([(r,) for w, r in rules if w == v], "key string"), looked_up) for v in ("allow", "block"))
    parsed = parsed.withColumn("rule", F.get(F.filter(keys, lambda k: allow.contains(k) | block.contains(k)), 0))
    suffixes, names = host_suffixes(F.col("host")), hosts.select(F.col("host").alias("key"))
    every = paths.select("host").distinct().select("host", F.explode(suffixes).alias("key"))
    listed = fit_cascade(names, every, max_bytes)
    if listed is None:
        held = every.join(names.distinct(), "key", "left_semi").select("host", F.lit(True).alias("_listed")).distinct()
        parsed = parsed.join(held, "host", "left")
    else:
        parsed = parsed.withColumn("_listed", F.exists(suffixes, listed.contains))
    verdict = F.when(F.col("rule").isNull(), F.when(F.col("_listed"), "block").otherwise("allow"))
    verdict = verdict.when(block.contains(F.col("rule")), "block").otherwise("allow")
    return parsed.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


#: Rules of the production query.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def listed_hosts(spark: SparkSession, path: str | Path = LISTED_HOSTS) -> DataFrame:
    """host: the blocked hosts of a CSV file beside the driver. Longer lists are better read as a table by Spark."""
    with open(path, newline="") as f:
        return spark.createDataFrame([(r["host"],) for r in csv.DictReader(f)], "host string")


ORACLE = r"""
WITH parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, regexp_extract(coalesce(url, ''), '^.*?://(.*)$', 1) AS rest FROM pages)),
rules(action, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
spam AS (SELECT s || '.example.' || t AS h FROM (VALUES ('adult-x'), ('ads-track'), ('casino-win'), ('cheap-pills'), ('free-bets'), ('spam-farm')) a(s), (VALUES ('com'), ('net'), ('org')) b(t)),
urls AS (SELECT DISTINCT host, path FROM parts),
fits AS (SELECT host, path, h || p AS rule, action, row_number() OVER (PARTITION BY host, path ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
listed AS (SELECT DISTINCT host FROM urls JOIN spam ON host = h OR ends_with(host, '.' || h))
SELECT page_id, parts.host AS host, parts.path AS path, rule, coalesce(action, CASE WHEN listed.host IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM parts LEFT JOIN fits ON parts.host = fits.host AND parts.path = fits.path AND k = 1 LEFT JOIN listed ON parts.host = listed.host
"""
