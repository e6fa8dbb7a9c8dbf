"""Words, column names and tables that the operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
_TRIMMED = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of `df` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def word_count(text: Column) -> Column:
    """Words of a text as a long; null counts as none."""
    bare = F.trim(F.coalesce(text, F.lit("")), F.lit(_TRIMMED))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, SPACE + "+"))).cast("long")


def row_key(df: DataFrame, seed: int, columns: Sequence[str]) -> Column:
    """A hexadecimal hash of the named columns: the same in every run, and spread evenly.

    Rows that agree in these columns share a key; nulls are told apart from texts.
    """
    parts = [F.coalesce(F.md5(col(c).cast("string").cast("binary")), F.lit("null")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Jobs planned inside send texts to Python in Arrow batches of about this size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
