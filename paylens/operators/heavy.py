"""The most frequent values by a summary of bounded size and a second pass, where a proof holds, and a full count where not."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.sql import not_null, q
from paylens.operators.aggregates import topn_values
from paylens.sources.literals import literal_table

TRACKED = 4096
# A frequent-items summary of m counters errs by 3.5 / m of all rows at most, and names what certainly has more than its error; so
# a value that it does not name may have twice that.
_MISS = 7


def heavy_topn(df: DataFrame, column: str, n: int, seq: str, tracked: int = TRACKED) -> DataFrame:
    """The rows of topn_values without a shuffle of all distinct values, where frequent values stand out.

    One pass makes mergeable summaries that track `tracked` values; those they name are counted exactly in a second pass. A value
    that is not named has at most 7 / `tracked` of all rows. If the n-th of the counts is above that, nothing is
    missing; else, as on flat data, all values are counted. Both passes run when this is called.
    """
    known = df.where(not_null([column]))
    summary = known.selectExpr("count(*) AS rows", f"approx_top_k({q(column)}, {tracked}, {tracked}) AS top").first()
    values = [r["item"] for r in summary["top"] or []]
    # as many as were asked for may be cut off
    if n <= len(values) < tracked:
        kind = df.select(q(column)).schema.fields[0].dataType.simpleString()
        listed = literal_table(df.sparkSession, [(v,) for v in values], f"{q(column)} {kind}")
        counted = topn_values(known.join(F.broadcast(listed), column, "left_semi"), column, n, seq)
        found = counted.collect()
        if len(found) == n and found[-1]["n"] > _MISS * summary["rows"] / tracked:
            ddl = ", ".join(f"{q(f.name)} {f.dataType.simpleString()}" for f in counted.schema.fields)
            return literal_table(df.sparkSession, [tuple(r) for r in found], ddl).orderBy(F.desc("n"), "first_seen")
    return topn_values(df, column, n, seq)
