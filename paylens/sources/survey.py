"""Survey sources: landed JSON envelopes, response files, exported sheets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paylens.functions.sql import lit, q
from paylens.functions.text import null_if_missing
from paylens.schema import COORDINATES_SCHEMA, RAW_SCHEMA

ENVELOPE_SCHEMA = "iTotalRecords bigint, aaData array<array<string>>"


def normalise_nulls(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Null for the texts that mean "missing" in the given string columns (default: all of them)."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    chosen = set(columns)
    return df.selectExpr(*[f"{null_if_missing(q(c))} AS {q(c)}" if c in chosen else q(c) for c in df.columns])


def read_text_table(
    spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False
) -> DataFrame:
    """Comma-separated file with a header and doubled quotes; the schema is given, never inferred."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("nullValue", "NA")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return normalise_nulls(df)


def read_responses(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return read_text_table(spark, path, RAW_SCHEMA, multi_line)


def read_coordinates(spark: SparkSession, path: str) -> DataFrame:
    return read_text_table(spark, path, COORDINATES_SCHEMA)


def unwrap(envelope: DataFrame, records: str = "aaData") -> DataFrame:
    """One row (id, html, landed) per pair of the envelope; pairs with an empty id are left out.

    `landed` is the place a pair was found at: struct(file, place in the envelope). It orders responses
    the way they came in, files by name. Without a column `file` that part is empty.
    """
    file = "file" if "file" in envelope.columns else "''"
    pairs = envelope.selectExpr(f"{file} AS file", f"posexplode({q(records)}) AS (place, pair)")
    return pairs.selectExpr(
        "get(pair, 0) AS id", "get(pair, 1) AS html", "named_struct('file', file, 'place', place) AS landed"
    ).where("id <> ''")


def unwrap_text(df: DataFrame, column: str) -> DataFrame:
    """Same for envelopes held as JSON text in a column."""
    return unwrap(df.select(F.from_json(column, ENVELOPE_SCHEMA).alias("e")).select("e.*"))


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """Landed JSON envelopes, one document per file; one task reads a file."""
    landed = spark.read.schema(ENVELOPE_SCHEMA).option("multiLine", True).json(path)
    return unwrap(landed.selectExpr("*", "_metadata.file_path AS file"))


def table_from_sheet(
    sheet: DataFrame, month: str, measures: dict[str, str], month_format: str = "yyyy-MM-dd"
) -> DataFrame:
    """Long table (month, measure, value) of an exported sheet.

    `measures` maps sheet columns to measure names. Preamble and footer rows have no date in
    the month column and fall out; other sheet columns are never read.
    """
    dated = sheet.selectExpr(
        f"try_to_date({q(month)}, {lit(month_format)}) AS month",
        *[f"try_cast({q(c)} AS DOUBLE) AS {q(name)}" for c, name in measures.items()],
    ).where("month IS NOT NULL")
    return dated.unpivot(["month"], list(measures.values()), "measure", "value")


def sheet_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """SQL expressions as text cells c0, c1, ... of a sheet."""
    return df.selectExpr(*[f"CAST({e} AS STRING) AS c{i}" for i, e in enumerate(columns)])
