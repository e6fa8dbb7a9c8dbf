"""Landed JSON envelopes of any size, each read by several tasks.

A JSON reader takes a file as one row in one task. Here files are cut at the border between two pairs, `"],["`: a quote inside a
JSON string is always escaped, so that no string can hold it. What stands between two borders is completed to an envelope of
its own and parsed. A file whose pieces do not add up to one envelope, with its pairs at the end of the last list
opened, is read again as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.functions.sql import lit, one_of
from paylens.operators.joins import lookup_join
from paylens.session import stored
from paylens.sources.survey import ENVELOPE_SCHEMA, unwrap

BORDER = '"],["'
# a member put at the end of each piece: where it is missing, the envelope has ended before
_END = '"~end":1}'
# files that are read as a whole are named in the plan up to this number, beyond it a join finds them
NAMED_FILES = 1000


def envelope_pieces(spark: SparkSession, path: str, records: str = "aaData") -> DataFrame:
    """One row per piece of a file: file, block, seq, pairs, and whether it is the first, the last and sound.

    `seq` orders the pieces of a block. A piece mostly holds one pair; where a pair ends or begins without a text there is no border,
    so it may hold several.
    """
    pieces = spark.read.option("lineSep", BORDER).text(path).selectExpr(
        "_metadata.file_path AS file", "_metadata.file_block_start AS block", "monotonically_increasing_id() AS seq", "value"
    )
    as_first = f"from_json(concat(value, '\"]],', {lit(_END)}), 'map<string,string>')"
    as_next = f"from_json(concat('{{\"{records}\":[[\"', value, '\"]],', {lit(_END)}), 'map<string,string>')"
    parsed = pieces.selectExpr("file", "block", "seq", "value", f"CASE WHEN ltrim(value) LIKE '{{%' THEN {as_first} END AS whole")
    # inside an envelope a piece has no member names, so it cannot be taken for a first one
    first = f"coalesce(map_contains_key(whole, {lit(records)}), FALSE)"
    parsed = parsed.selectExpr("file", "block", "seq", f"{first} AS first", f"CASE WHEN {first} THEN whole ELSE {as_next} END AS members")
    parsed = parsed.selectExpr("file", "block", "seq", "first", "map_keys(members) AS names", f"try_element_at(members, {lit(records)}) AS held")
    parsed = parsed.selectExpr("*", "from_json(held, 'array<array<string>>') AS pairs", "NOT names[size(names) - 1] <=> '~end' AS last")
    one = f"size(filter(names, x -> x = {lit(records)})) = 1"
    open_end = f"last OR names[size(names) - 2] = {lit(records)}"
    sound = f"coalesce({one} AND ({open_end}) AND (held IS NULL OR pairs IS NOT NULL), FALSE)"
    return parsed.selectExpr("file", "block", "seq", "first", "last", f"{sound} AS sound", "coalesce(pairs, array()) AS pairs")


def read_split_envelopes(spark: SparkSession, path: str, records: str = "aaData") -> DataFrame:
    """The rows of read_envelopes, `landed` included, from files that are split like any other text.

    The pieces are parsed once, when this is called, and stored in the shared folder; places follow from the counts of the blocks
    before and the place of a piece in its block. Only blocks with pieces of no or several pairs need their running counts.
    Files that are not laid out as one compact envelope are read as read_envelopes does. Spaced files have no borders
    and are one piece.
    """
    pieces = stored(envelope_pieces(spark, path, records))
    blocks = pieces.groupBy("file", "block").agg(
        F.expr("sum(size(pairs)) AS held"),
        F.expr("min(seq) AS start"),
        F.expr("count_if(first) AS firsts"),
        F.expr("count_if(last) AS lasts"),
        F.expr("bool_and(sound) AS sound"),
        F.expr("bool_or(size(pairs) <> 1) AS uneven"),
    )
    every = "OVER (PARTITION BY file)"
    layout = blocks.selectExpr(
        "file", "block", "start", "uneven",
        "sum(held) OVER (PARTITION BY file ORDER BY block ROWS UNBOUNDED PRECEDING) - held AS base",
        f"bool_and(sound) {every} AND sum(firsts) {every} = 1 AND sum(lasts) {every} = 1 AS compact",
    )
    layout = stored(layout)
    placed = lookup_join(pieces, layout, ["file", "block"], "inner").where("compact")
    even = placed.where("NOT uneven").selectExpr("file", "base + seq - start AS at", "pairs")
    before = "sum(size(pairs)) OVER (PARTITION BY file, block ORDER BY seq ROWS UNBOUNDED PRECEDING) - size(pairs)"
    uneven = placed.where("uneven").selectExpr("file", f"base + {before} AS at", "pairs")
    found = even.unionByName(uneven).selectExpr("file", "at", "posexplode(pairs) AS (i, pair)")
    found = found.selectExpr("get(pair, 0) AS id", "get(pair, 1) AS html", "named_struct('file', file, 'place', CAST(at + i AS INT)) AS landed")
    found = found.where("id <> ''")
    other = layout.where("NOT compact").select("file").distinct()
    named = [r["file"] for r in other.limit(NAMED_FILES + 1).collect()]
    if not named:
        return found
    whole = spark.read.schema(ENVELOPE_SCHEMA.replace("aaData", records)).option("multiLine", True).json(path).selectExpr("*", "_metadata.file_path AS file")
    whole = whole.where(one_of("file", named)) if len(named) <= NAMED_FILES else whole.join(other, "file", "left_semi")
    return found.unionByName(unwrap(whole, records))
