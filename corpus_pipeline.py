"""From documents to packed batches: the stages and the job that runs them one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm.minhash import keep_one
from paylens.llm.mixing import mix
from paylens.llm.packing import pack
from paylens.llm.suffixes import remove_repeats
from paylens.llm.tables import col, table
from paylens.llm.toxicity import fit_chain, predict
from paylens.session import stored

# near duplicates share this much of their five-word shingles; with 11 half-keys a side of 3 minhashes each, a pair at
# 0.80 meets in some table with probability 0.9993
NEAR_PERCENT = 80
NEAR_HALVES = 11


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier chain does not reject; it is fitted on `labels`."""
    kept = [col(c) for c in docs.columns]
    return predict(docs, fit_chain(docs, table(spark, sf_dir, "labels"))).where("NOT is_toxic").select(*kept)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, which are linked from a similarity of 0.8 on."""
    return keep_one(docs, percent=NEAR_PERCENT, halves=NEAR_HALVES).select(*[col(c) for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated passages; one that has no word left goes. n_chars follows the text."""
    cut = remove_repeats(docs, keep=docs.columns).where(r"n_removed = 0 OR text RLIKE '[^\\x20\\x09-\\x0D]'")
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*[col(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mix(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document goes: bucket, batch and slot. A repeated document has a place for each repeat."""
    return pack(docs).select("doc_id", "length", "bucket", "boundary", "batch", "slot", "padding")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_batches),
]

# a trained model, minhash, a suffix sort and the choice of length buckets have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each on the stored result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = stored(docs)
    return docs
