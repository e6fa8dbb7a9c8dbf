"""Pages of a ranking from a stored copy in rank order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.functions.sql import q
from paylens.operators.ranking import global_rank

BLOCK = 1_000_000


def store_ranked(df: DataFrame, value: str, seq: str, path: str, ascending: bool = True, block: int = BLOCK) -> DataFrame:
    """Rank all rows once and write them to a folder with one directory per `block` places; returns the stored table.

    The rank is that of global_rank. A task writes one block, whatever the values are.
    """
    ranked = global_rank(df, value, seq, ascending).selectExpr("*", f"rank DIV {block} AS block")
    ranked.repartition("block").sortWithinPartitions("block", "rank").write.partitionBy("block").parquet(path)
    return open_ranked(df.sparkSession, path)


def open_ranked(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("block", F.col("block").cast("bigint"))


def page_of(stored: DataFrame, page: int, per_page: int, block: int = BLOCK) -> DataFrame:
    """Page `page`, from 0, in rank order: only the blocks that hold its places are read."""
    first, last = page * per_page, (page + 1) * per_page - 1
    rows = stored.where(f"block BETWEEN {first // block} AND {last // block} AND rank BETWEEN {first} AND {last}")
    return rows.select(*[q(c) for c in stored.columns if c != "block"]).orderBy("rank")
