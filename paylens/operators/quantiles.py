"""Exact quantiles per group without holding a group in one task.

Spark's own median keeps every distinct value of a group in one buffer. Here a value becomes a 64-bit key in the
same order, the bits of the double, and ranks are found digit by digit: the first bits of the keys cut a group into cells, running
counts over the cells tell which of them hold the wanted ranks, and only their values are ordered. A cell with more than SMALL
values is cut again by the next bits, so that no task orders more, however values are spread. The cells depend on
the values alone, so the result does not depend on sampling, task order or retries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions.sql import lit, not_null, q
from paylens.session import source_bytes

# Bits of a key that are left out at each level. The first leaves sign, exponent and 12 bits: a cell spans 0.024 % of its values. The
# last cuts into runs of a million doubles.
SHIFTS = (40, 20)
# distinct values of a cell that one task may order
SMALL = 8192
# bytes of source tables from which on cells are cut again
DEEP_FROM = 64 << 20
_LEAST_NORMAL, _LEAST = "2.2250738585072014E-308D", "4.9E-324D"


def key_of(v: str) -> str:
    """The bits of a double as a long in the order of the values; both zeros are 0, NaN is null.

    The exponent comes from a logarithm, which may be one off, and a power of two, which is exact; so are the quotient
    and the fraction.
    """
    power = f"pow(2D, least(floor(log2(abs({v}))), 1023))"
    power = f"CASE WHEN {power} > abs({v}) THEN {power} / 2 WHEN {power} * 2 <= abs({v}) THEN {power} * 2 ELSE {power} END"
    normal = f"(CAST(rint(log2({power})) AS BIGINT) + 1023) * {1 << 52}L + CAST((abs({v}) / ({power}) - 1) * {1 << 52}L AS BIGINT)"
    size = (
        f"CASE WHEN abs({v}) < {_LEAST_NORMAL} THEN CAST(abs({v}) / {_LEAST} AS BIGINT)"
        f" WHEN abs({v}) = double('infinity') THEN {2047 << 52}L WHEN NOT isnan({v}) THEN {normal} END"
    )
    return f"(CASE WHEN {v} < 0 THEN -1L ELSE 1L END * {size})"


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Rows per (group, value) for non-null groups and values, combined before the shuffle."""
    names = [q(k) for k in keys]
    return (
        df.where(not_null([*keys, value]))
        .selectExpr(*names, f"CAST({q(value)} AS DOUBLE) AS _v")
        .where("NOT isnan(_v)")
        .groupBy(*names, "_v")
        .agg(F.expr("count(*) AS _n"))
    )


def _list(*columns: str) -> str:
    return ", ".join(columns)


def _parts(keys: Sequence[str], ranks: str, shifts: Sequence[int]) -> tuple[list[str], list[str]]:
    """Common table expressions from {counts} down to the small cells that hold the wanted ranks, and the names of the latter."""
    names = [q(k) for k in keys]
    # keys are never null, and declared so: a null check pushed into one branch would make branches differ, and the shuffled
    # counts would be computed twice instead of shared
    steps = [f"_keyed AS (SELECT *, coalesce({key_of('_v')}, 0L) AS _bits FROM {{counts}})"]
    near = []
    for level, shift in enumerate(shifts):
        source, above = ("_keyed", []) if level == 0 else (f"_large{level}", ["_base", "_total"])
        inside = [*names, *above[:1]]
        group = f"PARTITION BY {_list(*inside)}" if inside else ""
        rows = "_total" if above else f"sum(_held) OVER ({group})"
        start = f"{'_base + ' if above else ''}sum(_held) OVER ({group} ORDER BY _cell ROWS UNBOUNDED PRECEDING) - _held"
        steps += [
            f"_rows{level} AS (SELECT {_list(*names, *above, '_v', '_n', '_bits')}, shiftright(_bits, {shift}) AS _cell FROM {source})",
            f"_sums{level} AS (SELECT {_list(*names, *above, '_cell')}, sum(_n) AS _held, count(*) AS _values, min(_v) AS _lo, max(_v) AS _hi"
            f" FROM _rows{level} GROUP BY {_list(*names, *above, '_cell')})",
            f"_cells{level} AS (SELECT {_list(*names, '_cell')}, _held, _values, _lo, _hi, {rows} AS _rows, {start} AS _start FROM _sums{level})",
            f"_found{level} AS (SELECT * FROM _cells{level} WHERE exists(array({ranks}), r -> r >= _start AND r < _start + _held))",
        ]
        joined = f"FROM _rows{level} JOIN _found{level} USING ({_list(*names, '_cell')})"
        last = level == len(shifts) - 1
        steps.append(f"_near{level} AS (SELECT {_list(*names, '_v', '_n', '_start', '_rows')} {joined}{'' if last else f' WHERE _values <= {SMALL}'})")
        near.append(f"_near{level}")
        if not last:
            # mostly there are none, and the engine leaves out what follows once it knows
            steps.append(f"_large{level + 1} AS (SELECT {_list(*names, '_v', '_n', '_bits')}, _start AS _base, _rows AS _total {joined} WHERE _values > {SMALL})")
    return steps, near


def quantile_steps(counts: DataFrame, keys: Sequence[str], probs: dict[str, float], deep: bool | None = None) -> list[str]:
    """Common table expressions that end in `_picked`, the quantiles of {counts} with the rows of each group.

    The statement has the levels below the first if `deep`, and unless told where the tables behind the counts are
    larger than DEEP_FROM: smaller ones have no cell that is too large for a task, and planning takes longer than running.
    """
    if deep is None:
        deep = source_bytes(counts) > DEEP_FROM
    names = [q(k) for k in keys]
    position = {name: f"((_rows - 1) * {lit(float(p))})" for name, p in probs.items()}
    steps, near = _parts(keys, _list(*[f"floor({p}), ceil({p})" for p in position.values()]), SHIFTS if deep else SHIFTS[:1])
    # a few small cells per group are left; those of a group in one place serve the window and the aggregate
    near = " UNION ALL ".join(f"SELECT * FROM {n}" for n in near)
    before = f"_start + sum(_n) OVER (PARTITION BY {_list(*names, '_start')} ORDER BY _v ROWS UNBOUNDED PRECEDING)"

    def at(rank: str) -> str:
        return f"max(CASE WHEN {rank} >= _to - _n AND {rank} < _to THEN _v END)"

    ends = [f"{at(f'{side}({p})')} AS {q(f'_{side}_{n}')}" for n, p in position.items() for side in ("floor", "ceil")]
    between = [f"{q('_floor_' + n)} + ({q('_ceil_' + n)} - {q('_floor_' + n)}) * ({p} - floor({p})) AS {q(n)}" for n, p in position.items()]
    return [
        *steps,
        f"_near AS (SELECT /*+ REPARTITION({_list(*names) or 1}) */ * FROM ({near}))",
        f"_ordered AS (SELECT {_list(*names, '_v', '_n', '_rows')}, {before} AS _to FROM _near)",
        f"_ends AS (SELECT {_list(*names, *ends)}, max(_rows) AS _rows FROM _ordered{' GROUP BY ' + _list(*names) if names else ''})",
        f"_picked AS (SELECT {_list(*names, *between, '_rows')} FROM _ends)",
    ]


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], probs: dict[str, float], deep: bool | None = None) -> DataFrame:
    """Quantiles, linear between neighbouring ranks, of a value_counts table; a value may have several rows."""
    wanted = _list(*[q(k) for k in keys], *[q(n) for n in probs])
    # one statement, as each step of a composed table is analysed anew
    return counts.sparkSession.sql(f"WITH {', '.join(quantile_steps(counts, keys, probs, deep))} SELECT {wanted} FROM _picked", counts=counts)


def group_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], approximate: bool = False
) -> DataFrame:
    """Quantiles of a numeric column per group; null keys and values are left out.

    `approximate` trades exactness for a single pass over very large groups; it returns elements
    of the data and never a mean of two.
    """
    if approximate:
        known = df.where(not_null([*keys, value]))
        return known.groupBy(*[q(k) for k in keys]).agg(
            *[F.expr(f"CAST(percentile_approx({q(value)}, {lit(float(p))}) AS DOUBLE) AS {q(n)}") for n, p in probs.items()]
        )
    return quantiles_of_counts(value_counts(df, keys, value), keys, probs)


def group_median(
    df: DataFrame, keys: Sequence[str], value: str, out: str = "median", approximate: bool = False
) -> DataFrame:
    return group_quantiles(df, keys, value, {out: 0.5}, approximate)
