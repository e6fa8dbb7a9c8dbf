"""Cross-filtering: named filters, facet counts under the other filters, search suggestions.

Conditions are SQL expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.sql import lit, one_of, q
from paylens.operators.aggregates import category_rank
from paylens.operators.distributions import bin_of, edges, numbers, value_span, with_all_bins
from paylens.operators.stages import add_columns

NOT_GIVEN = "N/A"


def fill_not_given(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Show null as "N/A"; done once, before any facet work, so keys and filters agree."""
    return add_columns(df, {c: f"coalesce(CAST({q(c)} AS STRING), {lit(NOT_GIVEN)})" for c in columns})


def membership(column: str, values: Sequence) -> str:
    """One of the selected values."""
    return one_of(q(column), values)


def toggle(selected: Sequence, value) -> list:
    """The selection after a value is switched on or off."""
    return [v for v in selected if v != value] if value in selected else [*selected, value]


def value_range(column: str, start: float, end: float, cap: float | None = None) -> str:
    """Closed range; an end within a thousandth of the cap means no upper limit."""
    if cap and end > cap - cap * 0.001 // 1:
        return f"{q(column)} >= {lit(start)}"
    return f"{q(column)} BETWEEN {lit(start)} AND {lit(end)}"


def text_search(column: str, query: str) -> str:
    """"" takes all rows, "any" those with a text, "none" those without, else a part of the text.

    A value filled in by fill_not_given counts as none.
    """
    given = f"coalesce({q(column)} NOT IN ('', {lit(NOT_GIVEN)}), FALSE)"
    special = {"": "TRUE", "any": given, "none": f"NOT {given}"}
    return special.get(query, f"contains(lower({q(column)}), {lit(query.lower())})")


@dataclass(frozen=True)
class FilterSet:
    """One condition per attribute, joined by AND. An unknown condition counts as not met."""

    conditions: dict[str, str] = field(default_factory=dict)

    def with_filter(self, attribute: str, condition: str) -> FilterSet:
        return FilterSet({**self.conditions, attribute: condition})

    def without(self, attribute: str) -> FilterSet:
        return FilterSet({a: c for a, c in self.conditions.items() if a != attribute})

    def moved(self, old: str, new: str, condition: str) -> FilterSet:
        """The filter of one measure handed over to another, as when pay is shown inflation-adjusted."""
        return self.without(old).with_filter(new, condition)

    def passes(self) -> str:
        return " AND ".join(f"coalesce({c}, FALSE)" for c in self.conditions.values()) or "TRUE"


def named_filter(filters: dict[str, str], chosen: str) -> str:
    """The condition a caller has registered under a name."""
    return filters[chosen]


def flag_rows(df: DataFrame, filters: FilterSet, out: str = "passes") -> DataFrame:
    """Keep every row and say whether it passes all filters."""
    return add_columns(df, {out: filters.passes()})


def facet_counts(df: DataFrame, filters: FilterSet, facets: Sequence[str]) -> DataFrame:
    """(facet, key, count): each facet counts the rows that pass all filters but its own.

    One scan for all facets. Keys come from all rows, so a key without passing rows has count 0;
    no second aggregate or join is needed for that. Counts shrink before the shuffle.
    """
    entries = ", ".join(
        f"named_struct('facet', {lit(a)}, 'key', CAST({q(a)} AS STRING),"
        f" 'hit', CASE WHEN {filters.without(a).passes()} THEN 1L ELSE 0L END)"
        for a in facets
    )
    return (
        df.selectExpr(f"inline(array({entries}))")
        .groupBy("facet", "key")
        .agg(F.expr("sum(hit) AS count"))
    )


def facet_order(
    counts: DataFrame, by: str = "key", ascending: bool = True, order: Sequence[str] | None = None
) -> DataFrame:
    """Bars of one facet by an explicit list, by numeric or text key, or by count."""
    if order is not None:
        return counts.orderBy(F.expr(category_rank("key", order)).asc_nulls_last(), "key")
    if by == "count":
        return counts.orderBy(F.asc("count") if ascending else F.desc("count"), "key")
    number = F.expr("try_cast(key AS DOUBLE)")
    if ascending:
        return counts.orderBy(number.asc_nulls_last(), F.asc("key"))
    return counts.orderBy(number.desc_nulls_last(), F.desc("key"))


def facet_histogram(
    df: DataFrame, filters: FilterSet, column: str, lo: float | None = None, hi: float | None = None, bins: int = 20
) -> DataFrame:
    """Histogram of a measure for the rows that pass the other filters.

    The range is that of all rows, filtered or not, where it is not given; values outside are ignored. Equal
    ends get a range one unit wide around them.
    """
    passing = df.where(filters.without(column).passes())
    if lo is None or hi is None:
        span = value_span(numbers(df, column))
        passing = passing.withColumn("_span", span)
    ends = edges(*[f"_span.{name}" if end is None else lit(float(end)) for name, end in (("lo", lo), ("hi", hi))])
    counted = (
        passing.where(f"{q(column)} BETWEEN {ends[0]} AND {ends[1]}")
        .selectExpr(f"{bin_of(f'CAST({q(column)} AS DOUBLE)', *ends, bins)} AS bin")
        .groupBy("bin")
        .agg(F.expr("count(*) AS count"))
    )
    every = with_all_bins(counted, bins)
    if lo is None or hi is None:
        every = every.withColumn("_span", span)
    left = f"{ends[0]} + bin * (({ends[1]} - {ends[0]}) / {bins})"
    return every.selectExpr("bin", f"{left} AS left", "coalesce(count, 0L) AS count")


def suggest_values(df: DataFrame, column: str, query: str, seq: str, limit: int | None = 10) -> DataFrame:
    """Values that contain the query, most frequent first; equal counts by first appearance."""
    key = q(column)
    found = (
        df.where(f"{key} <> {lit(NOT_GIVEN)} AND contains(lower({key}), {lit(query.lower())})")
        .groupBy(key)
        .agg(F.expr("count(*) AS n"), F.expr(f"min({q(seq)}) AS first_seen"))
        .orderBy(F.desc("n"), "first_seen")
    )
    return found if limit is None else found.limit(limit)
