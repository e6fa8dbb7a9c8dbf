"""Cross-filtering from one evaluation of each filter, and a stored cube that answers a moving filter without the rows.

A row's state is a number with one bit per filter, set where the row fails it. A facet counts the rows whose state has no bit but
its own, so that any number of facets and histograms share one pass and no condition is evaluated twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.sql import lit, one_of, q
from paylens.operators.distributions import bin_of, edges
from paylens.operators.facets import FilterSet
from paylens.session import stored

STATE = "_failed"


@dataclass(frozen=True)
class Bins:
    """Equal-width bins of a measure from lo to hi; values outside are ignored."""

    lo: float
    hi: float
    bins: int = 20

    def number(self, column: str) -> str:
        ends = edges(lit(float(self.lo)), lit(float(self.hi)))
        inside = f"CAST({q(column)} AS DOUBLE) BETWEEN {ends[0]} AND {ends[1]}"
        return f"CASE WHEN {inside} THEN {bin_of(f'CAST({q(column)} AS DOUBLE)', *ends, self.bins)} END"


def _bit(filters: FilterSet, attribute: str) -> int:
    """The bit of an attribute's filter; 0 where it has none."""
    names = list(filters.conditions)
    return 1 << names.index(attribute) if attribute in names else 0


def with_state(df: DataFrame, filters: FilterSet) -> DataFrame:
    """Add the state: a bit for each filter that a row fails; unknown is failed. Up to 63 filters."""
    if len(filters.conditions) > 63:
        raise ValueError("a state holds 63 filters")
    bits = [f"CASE WHEN {c} THEN 0L ELSE {1 << i}L END" for i, c in enumerate(filters.conditions.values())]
    return df.selectExpr("*", f"{' + '.join(bits) or '0L'} AS {STATE}")


def _passes(filters: FilterSet, *but: str) -> str:
    """No failed filter but those of some attributes."""
    own = sum({_bit(filters, a) for a in but})
    return f"({STATE} & {~own}L) = 0" if own else f"{STATE} = 0"


def _entries(filters: FilterSet, facets: Sequence[str], histograms: dict[str, Bins], but: str | None = None) -> str:
    """One struct (facet, key, hit) per facet and histogram of a row."""
    keys = {**{a: f"CAST({q(a)} AS STRING)" for a in facets}, **{a: f"CAST({b.number(a)} AS STRING)" for a, b in histograms.items()}}
    without = (but,) if but else ()
    return ", ".join(
        f"named_struct('facet', {lit(a)}, 'key', {key}, 'hit', CASE WHEN {_passes(filters, a, *without)} THEN 1L ELSE 0L END)" for a, key in keys.items()
    )


def _with_empty_bins(entries: DataFrame, histograms: dict[str, Bins]) -> DataFrame:
    """Entries of histograms without those outside, and one without a hit for each bin."""
    if not histograms:
        return entries
    found = entries.where(f"NOT ({one_of('facet', histograms)} AND key IS NULL)")
    for a, b in histograms.items():
        empty = entries.sparkSession.range(b.bins).selectExpr(f"{lit(a)} AS facet", "CAST(id AS STRING) AS key", "0L AS hit")
        found = found.unionByName(empty, allowMissingColumns=True)
    return found


def cross_counts(df: DataFrame, filters: FilterSet, facets: Sequence[str], histograms: dict[str, Bins] | None = None) -> DataFrame:
    """(facet, key, count): all facets and histograms, each under the other filters, from one pass.

    The key of a histogram is the number of the bin. Keys come from all rows, so that one without passing rows has count 0; empty
    bins are there too. A column may be a facet or a histogram, not both.
    """
    histograms = histograms or {}
    # the state is computed below the generator, so once
    entries = with_state(df, filters).selectExpr(f"inline(array({_entries(filters, facets, histograms)}))")
    return _with_empty_bins(entries, histograms).groupBy("facet", "key").agg(F.expr("sum(hit) AS count"))


def moving_filter_cube(
    df: DataFrame, filters: FilterSet, moving: str, facets: Sequence[str], histograms: dict[str, Bins] | None = None, step: Bins | None = None
) -> DataFrame:
    """Counts from which the facets follow for any filter on `moving` while the other filters stay: (facet, key, at, count).

    `at` is a value of `moving`, or with `step` the number of its bin, null outside; a filter may be any condition on it. The cube has a
    row for each key of a facet and value of `at` that occur together, so it grows with the keys, not with the rows. The facet of
    `moving` itself does not depend on its filter. The result is stored.
    """
    histograms = histograms or {}
    at = step.number(moving) if step else q(moving)
    entries = _entries(filters, facets, histograms, but=moving)
    found = with_state(df, filters).selectExpr(f"{at} AS at", STATE, "*").selectExpr("at", f"inline(array({entries}))")
    found = _with_empty_bins(found, histograms)
    own = f"CASE WHEN facet <> {lit(moving)} THEN at END"
    return stored(found.selectExpr("facet", "key", f"{own} AS at", "hit").groupBy("facet", "key", "at").agg(F.expr("sum(hit) AS count")))


def move_filter(cube: DataFrame, moving: str, condition: str) -> DataFrame:
    """(facet, key, count) under a new condition on `at`, from the cube alone. Keys without passing rows have count 0."""
    counts = f"coalesce(sum(CASE WHEN facet = {lit(moving)} OR ({condition}) THEN count END), 0L)"
    return cube.groupBy("facet", "key").agg(F.expr(f"{counts} AS count"))
