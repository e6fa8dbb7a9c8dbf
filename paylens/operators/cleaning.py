"""Row filters, repairs and conversions of survey responses. Conditions are SQL expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions import text as t
from paylens.functions.sql import lit, lookup, one_of, q
from paylens.operators.joins import share_of
from paylens.operators.stages import add_columns


def clean_literals(df: DataFrame, edits: dict[str, Sequence[tuple[str, str]]]) -> DataFrame:
    """Literal replacements per column, in order; nothing is read as a pattern."""
    return add_columns(
        df, {c: reduce(lambda e, step: t.replace_literal(e, *step), steps, q(c)) for c, steps in edits.items()}
    )


def remap_values(df: DataFrame, column: str, mapping: dict[str, str]) -> DataFrame:
    """Replace whole values; values without an entry stay."""
    return df.replace(mapping, subset=[column])


def regex_repair(df: DataFrame, columns: Sequence[str], pattern: str, replacement: str) -> DataFrame:
    return add_columns(
        df, {c: f"regexp_replace({q(c)}, {lit(pattern)}, {lit(replacement)})" for c in columns}
    )


def drop_equal(df: DataFrame, column: str, value) -> DataFrame:
    """Leave out rows that equal the value; rows with null stay."""
    return df.where(f"NOT ({q(column)} <=> {lit(value)})")


def drop_ids(df: DataFrame, denied: DataFrame | Sequence[int], on: str = "id") -> DataFrame:
    """Leave out the listed ids, rows without an id stay.

    A list in code becomes a filter of the scan, a table an anti-join; ids are unique, so no key
    of that join is hot.
    """
    if isinstance(denied, DataFrame):
        return df.join(denied.select(q(on)), on, "left_anti")
    return drop_matching(df, one_of(q(on), denied))


def drop_matching(df: DataFrame, condition: str) -> DataFrame:
    """Leave out rows for which the condition holds; an unknown condition keeps the row."""
    return df.where(f"NOT coalesce({condition}, FALSE)")


def drop_bad_batch(df: DataFrame, school: str, stamp: str, place: str, bad_stamp, bad_place: str) -> DataFrame:
    """Leave out one known bad batch: school given, one month, one place."""
    return drop_matching(
        df, f"{q(school)} IS NOT NULL AND {q(stamp)} = {lit(bad_stamp)} AND {q(place)} = {lit(bad_place)}"
    )


def parse_month_year(df: DataFrame, stamp: str, year: str = "Year") -> DataFrame:
    """Turn the stamp column into the first of its month and add the year."""
    return add_columns(add_columns(df, {stamp: t.month_from_stamp(q(stamp))}), {year: f"year({q(stamp)})"})


def coerce_numeric(df: DataFrame, column: str) -> DataFrame:
    """Whole numbers; rows whose text is no number are left out."""
    return add_columns(df, {column: t.coerce_int(q(column))}).where(f"{q(column)} IS NOT NULL")


# Fixed value: hours per week times weeks per year of a full-time post.
HOURS_PER_YEAR = 40 * 52


def annualise(df: DataFrame, amount: str, unit: str, status: str) -> DataFrame:
    """Hourly pay of full-time posts as yearly pay; all other rows stay."""
    hourly = f"{q(unit)} = 'hour' AND {q(status)} = 'Full-time'"
    return add_columns(
        df, {amount: f"CASE WHEN {hourly} THEN {q(amount)} * {HOURS_PER_YEAR} ELSE {q(amount)} END"}
    )


def min_threshold(df: DataFrame, column: str, minimum: float) -> DataFrame:
    return df.where(f"{q(column)} >= {lit(minimum)}")


def apply_corrections(df: DataFrame, fixes: DataFrame, on: str = "id") -> DataFrame:
    """Overwrite fields of single rows; a null in `fixes` leaves the field as it is.

    `fixes` has one row per id, so the left join neither multiplies rows nor meets a hot key.
    """
    fields = [c for c in fixes.columns if c != on]
    renamed = fixes.selectExpr(q(on), *[f"{q(c)} AS _fix_{i}" for i, c in enumerate(fields)])
    types = dict(df.dtypes)
    fixed = {
        c: f"coalesce(CAST(_fix_{i} AS {types[c]}), {q(c)}) AS {q(c)}" for i, c in enumerate(fields)
    }
    return df.join(renamed, on, "left").selectExpr(*[fixed.get(c, q(c)) for c in df.columns])


def fx_normalise(df: DataFrame, amount: str, unit: str, rates: dict[str, float], target: str = "year") -> DataFrame:
    """Convert amounts of listed units, half-even to whole units, then rename the unit.

    A rate of 1 only renames. The dictionary is a handful of units written in code.
    """
    kind = dict(df.dtypes)[amount]
    cases = " ".join(
        f"WHEN {q(unit)} = {lit(u)} THEN CAST(bround({q(amount)} * {lit(float(r))}, 0) AS {kind})"
        for u, r in rates.items()
        if r != 1
    )
    converted = f"CASE {cases} ELSE {q(amount)} END" if cases else q(amount)
    renamed = f"CASE WHEN {one_of(q(unit), rates)} THEN {lit(target)} ELSE {q(unit)} END"
    return add_columns(df, {amount: converted, unit: renamed})


def allowlist_split(df: DataFrame, column: str, allowed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows with an allowed value, and the counts of every other value, null included."""
    ok = f"coalesce({one_of(q(column), allowed)}, FALSE)"
    return df.where(ok), df.where(f"NOT {ok}").groupBy(q(column)).agg(F.expr("count(*) AS n"))


def pattern_audit(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text matches the pattern anywhere; null never does."""
    return df.where(f"{q(column)} RLIKE {lit(pattern)}")


def quality_report(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """One row with the number of rows and of violations per rule; the caller decides what to do."""
    return df.selectExpr("count(*) AS rows", *[f"count_if({rule}) AS {q(name)}" for name, rule in rules.items()])


def status_breakdown(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """One row with the count of each value and of unspecified rows, in one pass."""
    named = {v.lower().replace("-", "_").replace(" ", "_"): v for v in values}
    return df.selectExpr(
        *[f"count_if({q(column)} = {lit(v)}) AS {q(name)}" for name, v in named.items()],
        f"count_if({q(column)} IS NULL) AS not_specified",
    )


def bucket_midpoint(df: DataFrame, column: str, midpoints: dict[str, float], out: str) -> DataFrame:
    """Number that stands for a bucket label; labels without one give null."""
    return add_columns(df, {out: lookup(q(column), midpoints)})


def dedup_keep_first(df: DataFrame, ident: str = "id", seq: str | None = None) -> DataFrame:
    """Of rows equal in everything but the id, keep the id that came first.

    A hash aggregate: copies shrink before the shuffle, so a third of all rows being one copy
    group costs one row per task.
    """
    order = seq or ident
    same = [q(c) for c in df.columns if c not in (ident, order)]
    first = [F.expr(f"min_by({q(ident)}, {q(order)}) AS {q(ident)}")]
    if order != ident:
        first.append(F.expr(f"min({q(order)}) AS {q(order)}"))
    return df.groupBy(*same).agg(*first).select(*[q(c) for c in df.columns])


def duplicate_audit(df: DataFrame, ident: str = "id", shares: int | None = None) -> DataFrame:
    """Every row that has a twin in everything but the id, with the size of its group.

    Joining the rows back to the repeated groups would send a hot group to one task. So each row
    goes to one of `shares` parts of its group by its id, twice the number of shuffle partitions unless given, and a group is written
    once for each part that occurs in it: twice for a pair, at most `shares` times for any group. The
    parts are the bits of numbers, which a hash aggregate can hold. Rows meet by a hash of all columns, and the
    columns are compared after it.
    """
    shares = shares or 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = range(-(-shares // 64))
    same = [c for c in df.columns if c != ident]
    hashed = f"xxhash64({', '.join(q(c) for c in same)})"
    shared = df.selectExpr("*", f"{share_of([ident], shares)} AS _share", f"{hashed} AS _hash")
    bits = [F.expr(f"bit_or(CASE WHEN _share DIV 64 = {w} THEN shiftleft(1L, _share % 64) ELSE 0L END) AS _bits_{w}") for w in words]
    parts = [f"transform(filter(sequence(0, 63), i -> bit_get(_bits_{w}, i) = 1), i -> i + {64 * w})" for w in words]
    repeated = (
        shared.groupBy(*[q(c) for c in same], "_hash")
        .agg(F.expr("count(*) AS copies"), *bits)
        .where("copies > 1")
        .selectExpr(
            *[f"{q(c)} AS _same_{i}" for i, c in enumerate(same)], "_hash AS _hash_2", "copies",
            f"explode(concat({', '.join(parts)})) AS _part",
        )
    )
    on = " AND ".join(["_share = _part", "_hash = _hash_2", *[f"{q(c)} <=> _same_{i}" for i, c in enumerate(same)]])
    return shared.join(repeated, F.expr(on)).select(*[q(c) for c in df.columns], "copies")
