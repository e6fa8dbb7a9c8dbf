"""Writers: dated results and the coordinate cache."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.functions.sql import q


def write_dated(df: DataFrame, path: str, run_date: date, fmt: str = "parquet") -> None:
    """Write under run_date=YYMMDD; a rerun of the same day replaces that day only."""
    target = f"{path}/run_date={run_date:%y%m%d}"
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(target)


def new_cache_rows(resolved: DataFrame, cache: DataFrame, key: str = "Location") -> DataFrame:
    """Resolved rows whose key the cache does not hold yet, one per key; null keys and keys without a hit stay out."""
    values = [c for c in resolved.columns if c != key]
    found = resolved.where(F.col(f"`{values[0]}`").isNotNull() & F.col(f"`{key}`").isNotNull())
    # any_value would do, but min makes a rerun give the same row
    one_each = found.groupBy(key).agg(F.min(F.struct(*values)).alias("v")).select(key, "v.*")
    return one_each.join(cache, key, "left_anti")


def read_cache(spark: SparkSession, path: str, key: str = "Location") -> DataFrame:
    """The cache with one row per key, however often the key was appended: the least of its rows, as new_cache_rows takes.

    Two runs at once may both append a key; a lookup in the plain files would then multiply facts.
    """
    cache = spark.read.parquet(path)
    values = [c for c in cache.columns if c != key]
    one_each = cache.groupBy(q(key)).agg(F.min(F.struct(*[F.col(q(c)) for c in values])).alias("_v"))
    return one_each.select(q(key), "_v.*").select(*[q(c) for c in cache.columns])


def append_cache(resolved: DataFrame, cache: DataFrame, path: str, key: str = "Location") -> None:
    """Append the new rows to the cache table."""
    new_cache_rows(resolved, cache, key).write.mode("append").parquet(path)


class BrokenInvariant(ValueError):
    """A result breaks a rule that it was to keep; nothing has been written."""


def require(report: DataFrame, rules: dict[str, str]) -> None:
    """Raise unless the one row of a quality report keeps every rule, an SQL condition on its columns; unknown is broken."""
    row = report.selectExpr(*[f"coalesce({rule}, FALSE) AS _{i}" for i, rule in enumerate(rules.values())], "to_json(struct(*)) AS _row").first()
    broken = [name for i, name in enumerate(rules) if row is None or not row[f"_{i}"]]
    if broken:
        raise BrokenInvariant(f"broken: {', '.join(broken)}; report: {row['_row'] if row else 'empty'}")


def write_checked(df: DataFrame, report: DataFrame, rules: dict[str, str], path: str, run_date: date, fmt: str = "parquet") -> None:
    """write_dated behind a gate: the report is checked first, and a broken rule leaves the files of the day as they are."""
    require(report, rules)
    write_dated(df, path, run_date, fmt)
