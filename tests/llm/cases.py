"""Small awkward documents that every corpus operator has to take."""

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, length long, rank long, _n long, key string"


def words(n: int, seed: int, pool: int = 400) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmno") for _ in range(r.randint(2, 8))) if r.random() < 0.5 else f"w{r.randrange(pool)}" for _ in range(n))


def texts() -> list[str | None]:
    long = words(9000, 1)
    base = words(220, 2)
    return [
        None, "", " ", "\n\n", "a", "été ünï ñ 漢字 🙂", "x" * 5000, "ab " * 900, long, long, base, base, base, base.replace("w1", "v1"), base[:700] + " tail of its own " + base[700:],
        "Mail ana.b@mail.example.org or +44 20 7946 0958, 4111 1111 1111 1111 and 10.2.3.44 now.", "line one is here\nline one is here\n\nline two\nline one is here",
        "one two three four five " * 4, "tab\tand\x0bvt  two spaces \n \n mixed  <|endoftext|> end", *[words(40 + 37 * i, 10 + i) for i in range(25)],
    ]


def documents(spark: SparkSession, rows: list[str | None] | None = None) -> DataFrame:
    """With columns whose names the operators could use themselves, null sources and ids that are not in order."""
    rows = texts() if rows is None else rows
    source = lambda i: None if i % 7 == 3 else f"s{i % 3 if i % 2 else 0}"
    return spark.createDataFrame([((i * 7919) % 100003, t, None, source(i), 5, 1, 2, 3, "k") for i, t in enumerate(rows)], SCHEMA)
