"""De-duplication that remembers: a state of distinct responses, merged with each new landing.

A state has one row per distinct response: a 128-bit digest of its columns, the columns, the id that came first, when it came, and
the number of copies. Rows are found by digest and compared on their columns. Merging is an aggregate in which order does not
matter, so landings may come in any order, and twice counted copies are the only trace of a landing merged twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.sql import q

_OWN = ("digest", "first_id", "first_seen", "copies")


def _digest(columns: Sequence[str]) -> str:
    """Null and text are told apart by the length that stands before a text."""
    parts = [f"CASE WHEN {q(c)} IS NULL THEN '-' ELSE concat(length(CAST({q(c)} AS STRING)), ':', CAST({q(c)} AS STRING)) END" for c in columns]
    return f"md5(concat_ws(',', {', '.join(parts)}))"


def landing_state(df: DataFrame, ident: str = "id", seq: str | None = None) -> DataFrame:
    """The state of one landing: rows equal in everything but `ident` and `seq` are one response; the least `seq` came first."""
    order = seq or ident
    same = [c for c in df.columns if c not in (ident, order)]
    return (
        df.groupBy(*[q(c) for c in same])
        .agg(F.expr(f"min_by({q(ident)}, {q(order)}) AS first_id"), F.expr(f"min({q(order)}) AS first_seen"), F.expr("count(*) AS copies"))
        .selectExpr(f"{_digest(same)} AS digest", *[q(c) for c in same], "first_id", "first_seen", "copies")
    )


def merge_states(*states: DataFrame) -> DataFrame:
    """One state of several; equal digests are one response only if the columns agree."""
    same = [q(c) for c in states[0].columns if c not in _OWN]
    every = reduce(lambda a, b: a.unionByName(b), states)
    return every.groupBy("digest", *same).agg(
        F.expr("min_by(first_id, first_seen) AS first_id"), F.expr("min(first_seen) AS first_seen"), F.expr("sum(copies) AS copies")
    )


def unseen(state: DataFrame, landing: DataFrame) -> DataFrame:
    """Responses of a landing's state that an earlier state has not: what is left to clean and geocode."""
    same = [c for c in landing.columns if c not in _OWN]
    old = state.selectExpr("digest AS _digest", *[f"{q(c)} AS _old_{i}" for i, c in enumerate(same)])
    on = " AND ".join(["digest = _digest", *[f"{q(c)} <=> _old_{i}" for i, c in enumerate(same)]])
    return landing.join(old, F.expr(on), "left_anti")
