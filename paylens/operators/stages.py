"""Columns added in stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from paylens.functions.sql import q


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add or replace columns by SQL expressions, in one projection."""
    kept = [f"{columns[c]} AS {q(c)}" if c in columns else q(c) for c in df.columns]
    new = [f"{e} AS {q(c)}" for c, e in columns.items() if c not in df.columns]
    return df.selectExpr(*kept, *new)


def add_staged(df: DataFrame, stages: Sequence[dict[str, str]], outputs: dict[str, str]) -> DataFrame:
    """Compute stages one after the other and keep only `outputs`, each an SQL expression."""
    names = [q(c) for c in df.columns if c not in outputs]
    for stage in stages:
        df = df.selectExpr("*", *[f"{e} AS {q(c)}" for c, e in stage.items()])
    return df.selectExpr(*names, *[f"{e} AS {q(c)}" for c, e in outputs.items()])
