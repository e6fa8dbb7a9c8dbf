"""Small inputs and brute-force results for the corpus operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def prose(seed: int, n: int, vocabulary: int = 4000) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}{draw.choice(['', '', ',', '.'])}" for _ in range(n))


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows of (doc_id, text) or (doc_id, text, source) as documents, over three partitions."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3) if full else spark.createDataFrame([], DOCS)


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and blank texts, repeated rows, ties and one very long text."""
    long = prose(1, 20_000)
    return [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", "b"), (4, "one", "b"), (5, "two words", None), (None, "no key here", "a"),
        (None, None, None), (6, prose(2, 60), "a"), (6, prose(2, 60), "a"), (6, prose(3, 60), "a"), (7, long, "b"), (8, long + " end", "b"),
        (9, "Ünïcödé … text “quoted”\r\nsecond\x0bline", "c"), (10, prose(2, 60), "c"),
    ]


def clashing(docs: DataFrame, *names: str) -> DataFrame:
    """Extra columns with names that operators might use themselves."""
    for i, name in enumerate(names):
        docs = docs.withColumn(name, docs["doc_id"] * 0 + i)
    return docs


def least_reachable(ids: list, links: list[tuple]) -> dict:
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
