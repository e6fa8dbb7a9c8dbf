"""Search suggestions from an index of the distinct values, so that a keystroke does not scan the rows."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.functions.sql import lit, one_of, q
from paylens.operators.facets import NOT_GIVEN
from paylens.session import ensure_checkpoint_dir

GRAM = 3


@dataclass(frozen=True)
class SuggestIndex:
    """Distinct values with their counts; postings (gram, key, n, first_seen) of all parts of up to GRAM letters; rows per gram."""

    values: DataFrame
    postings: DataFrame
    grams: DataFrame


def grams_of(text: str, longest: int = GRAM) -> str:
    """The distinct parts of 1 to `longest` letters of a text."""
    parts = [f"transform(sequence(1, greatest(length({text}) - {n - 1}, 0)), i -> substring({text}, i, {n}))" for n in range(2, longest + 1)]
    # sequence counts down where it has nowhere to go up
    parts = [f"CASE WHEN length({text}) >= {n} THEN {p} ELSE array() END" for n, p in enumerate(parts, 2)]
    return f"array_distinct(concat(filter(split({text}, ''), c -> c <> ''), {', '.join(parts)}))"


def build_index(df: DataFrame, column: str, seq: str, path: str | None = None) -> SuggestIndex:
    """Write the index of a column to a folder, one of the shared folder's unless given.

    Values that are null or filled in as not given are left out. Postings are ordered by gram and value, so that the files of one gram are
    few, and those of a frequent gram several.
    """
    spark, path = df.sparkSession, path or f"{ensure_checkpoint_dir(df.sparkSession)}/suggest-{uuid.uuid4().hex}"
    key = q(column)
    counted = df.where(f"{key} <> {lit(NOT_GIVEN)}").groupBy(key).agg(F.expr("count(*) AS n"), F.expr(f"min({q(seq)}) AS first_seen"))
    counted.selectExpr(f"{key} AS key", "n", "first_seen").write.parquet(f"{path}/values")
    values = spark.read.parquet(f"{path}/values")
    postings = values.selectExpr(f"explode({grams_of('lower(key)')}) AS gram", "key", "n", "first_seen")
    postings.repartitionByRange("gram", "key").sortWithinPartitions("gram").write.parquet(f"{path}/postings")
    postings = spark.read.parquet(f"{path}/postings")
    postings.groupBy("gram").agg(F.expr("count(*) AS n")).write.parquet(f"{path}/grams")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> SuggestIndex:
    return SuggestIndex(*[spark.read.parquet(f"{path}/{name}") for name in ("values", "postings", "grams")])


def suggest(index: SuggestIndex, column: str, query: str, limit: int | None = 10) -> DataFrame:
    """The rows of suggest_values, from the index alone.

    A query of up to GRAM letters is a gram. Of a longer one the rarest gram is looked up, and its values are
    compared with the query. An empty query takes all values.
    """
    text = query.lower()
    if not text:
        found = index.values
    else:
        gram = text
        if len(text) > GRAM:
            parts = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
            known = {r["gram"]: r["n"] for r in index.grams.where(one_of("gram", parts)).collect()}
            # a part that no value has settles it
            gram = min(parts, key=lambda g: known.get(g, 0))
        found = index.postings.where(f"gram = {lit(gram)} AND contains(lower(key), {lit(text)})")
    found = found.selectExpr(f"key AS {q(column)}", "n", "first_seen").orderBy(F.desc("n"), "first_seen")
    return found if limit is None else found.limit(limit)
