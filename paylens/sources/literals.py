"""Small tables written in code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from paylens.functions.sql import lit, q


def literal_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """Rows as a table of known size, so that joins to it need no hint and no shuffle.

    A table made from a Python list would count as one of unknown, large size.
    """
    fields = T.StructType.fromDDL(ddl).fields
    columns = ", ".join(f"CAST(col{i + 1} AS {f.dataType.simpleString()}) AS {q(f.name)}" for i, f in enumerate(fields))
    values = ", ".join("(" + ", ".join(lit(v) for v in row) + ")" for row in rows)
    if not rows:
        values = "(" + ", ".join("NULL" for _ in fields) + ")"
    table = spark.sql(f"SELECT {columns} FROM VALUES {values}")
    return table if rows else table.where("FALSE")
