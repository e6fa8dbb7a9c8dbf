"""The batch job from raw responses to the cleaned, enriched, inflation-adjusted table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylens.functions import text as t
from paylens.functions.sql import lit, q
from paylens.operators import cleaning as c
from paylens.operators import timeseries as ts
from paylens.operators.joins import HotKeys, enrich_location, fill_from_gazetteer, shared_hot_keys, unresolved_keys
from paylens.operators.stages import add_columns
from paylens.schema import CLEAN_SCHEMA, RAW_COLUMNS, SCHOOL_COLUMNS
from paylens.session import stored
from paylens.sources.literals import literal_table
from paylens.sources.survey import normalise_nulls


@dataclass(frozen=True)
class Rules:
    """Settings of one survey. The defaults are fixed values of the survey this library was made for."""

    spam_ages: tuple[str, ...] = ("103",)
    denied_before_dedup: tuple[int, ...] = (12734, 2653)
    denied_after_geocoding: tuple[int, ...] = (5573, 8747)
    denied_after_units: tuple[int, ...] = (3616,)
    experience_remap: dict[str, str] = field(
        default_factory=lambda: {"31- >40": "31-40", "31-": "31-40", "40": "> 40"}
    )
    school_pattern: str = "University of Hawai.i at M.noa"
    school_name: str = "University of Hawaiʻi at Mānoa"
    bad_batch_stamp: str = "Jun '24"
    bad_batch_place: str = "Austin, TX, US"
    minimum_pay: int = 10000
    # id, salary, unit, bonus: amounts given in other currencies, at 0.72 and 1.08
    corrections: tuple[tuple[int, int | None, str | None, str | None], ...] = (
        (17102, 75600, "year", "5760"),
        (4576, None, None, "27000"),
        (3825, None, None, "2160"),
    )
    unit_rates: dict[str, float] = field(default_factory=lambda: {"CADyear": 0.72, "localcurrencyyear": 1.0})
    allowed_units: tuple[str, ...] = ("year", "hour")
    place_suffix: str = ", US"


@dataclass(frozen=True)
class Refreshed:
    clean: DataFrame
    unresolved_places: DataFrame
    dropped_places: DataFrame
    rejected_units: DataFrame
    report: DataFrame


def typed_responses(raw: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Typed, repaired, de-duplicated responses; satisfaction is still the text that was given.

    Of equal responses the one that landed first stays, by the column `landed` where there is one and
    else by id. `landed` ends here.
    """
    seq = ["landed"] if "landed" in raw.columns else []
    df = add_columns(normalise_nulls(raw.select(*RAW_COLUMNS, *seq)), {"id": "CAST(id AS BIGINT)"})
    df = c.clean_literals(
        df,
        {
            "Undergraduate School": [("UG:", "")],
            "Graduate School": [("Grad:", "")],
            "Post-Graduate School": [("PhD:", "")],
            "Salary Unit": [("per", "")],
            "Gender": [("Gender: ", "")],
            "Licensed": [("Licensed", "Yes")],
        },
    )
    df = c.remap_values(df, "Years of Experience", rules.experience_remap)
    for age in rules.spam_ages:
        df = c.drop_equal(df, "Age", age)
    df = c.drop_ids(df, rules.denied_before_dedup)
    df = c.regex_repair(df, SCHOOL_COLUMNS, rules.school_pattern, rules.school_name)
    df = c.dedup_keep_first(df, seq=seq[0] if seq else None).drop("landed")
    df = c.drop_bad_batch(
        df, "Post-Graduate School", "Date", "Location", rules.bad_batch_stamp, rules.bad_batch_place
    )
    df = c.parse_month_year(df, "Date")
    return add_columns(
        df,
        {"Salary": t.parse_thousands("Salary"), "Vacation Days": "try_cast(`Vacation Days` AS DOUBLE)"},
    )


def clean_responses(raw: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Typed, repaired, de-duplicated responses of every work status with a satisfaction."""
    return c.coerce_numeric(typed_responses(raw, rules), "Job Satisfaction")


def quality(
    typed: DataFrame,
    coordinates: DataFrame,
    gazetteer: DataFrame,
    index: DataFrame,
    rules: Rules = Rules(),
    hot: Callable[[], HotKeys] | None = None,
) -> DataFrame:
    """One row: missing answers of the typed responses, before any is dropped, and rows dropped per step.

    `index` is the price index without gaps. One pass: every response is flagged, and one aggregate counts
    the flags. A response counts for the first step that drops it, in the order of the refresh.
    """
    paid = c.annualise(typed, "Salary", "Salary Unit", "Work Status")
    known = coordinates.selectExpr("Location", "Latitude", "Longitude")
    placed, _ = fill_from_gazetteer(enrich_location(paid, known, hot=hot), gazetteer, keep_missing=True, hot=hot)
    latest = index.selectExpr("max(CASE WHEN value IS NOT NULL THEN date END)").scalar()
    months = index.where("value IS NOT NULL").selectExpr("date AS Date", "TRUE AS _month")
    flagged = placed.join(F.broadcast(months), "Date", "left").withColumn("_latest", latest)  # one row per month
    missing = {
        "missing_salary": "Salary IS NULL",
        "missing_satisfaction": f"({t.coerce_int('`Job Satisfaction`')}) IS NULL",
        "missing_coordinates": "Latitude IS NULL OR Longitude IS NULL",
        "missing_index": "NOT coalesce(_month OR Date > _latest, FALSE)",
    }
    fixed = ", ".join(lit(i) for i, _, unit, _ in rules.corrections if unit in rules.allowed_units)
    units = ", ".join(lit(u) for u in [*rules.allowed_units, *rules.unit_rates])
    steps = {
        "dropped_satisfaction": missing["missing_satisfaction"],
        "dropped_part_time": "`Work Status` <=> 'Part-time'",
        "dropped_pay": f"coalesce(Salary < {lit(rules.minimum_pay)}, TRUE)",
        "dropped_place": "Latitude IS NULL",
        "dropped_ids": f"id IN ({', '.join(lit(i) for i in (*rules.denied_after_geocoding, *rules.denied_after_units)) or 'NULL'})",
        "dropped_unit": f"NOT coalesce(`Salary Unit` IN ({units}), FALSE) AND NOT coalesce(id IN ({fixed or 'NULL'}), FALSE)",
    }
    first = " ".join(f"WHEN coalesce({rule}, FALSE) THEN {lit(name)}" for name, rule in steps.items())
    counted = flagged.selectExpr(*[f"({rule}) AS {name}" for name, rule in missing.items()], f"CASE {first} END AS _step")
    return c.quality_report(
        counted, {**{n: n for n in missing}, **{n: f"_step = {lit(n)}" for n in steps}, "kept": "_step IS NULL"}
    )


def refresh(
    raw: DataFrame,
    coordinates: DataFrame,
    gazetteer: DataFrame,
    price_index: DataFrame,
    rules: Rules = Rules(),
    store: bool = False,
) -> Refreshed:
    """Everything from raw responses to the final table, as one lazy plan.

    `price_index` is one monthly series (series_id, date, value). Its gaps are filled first. With
    `store`, the cleaned responses are written to the shared folder at once, for callers who use
    several of the results: else each of them repeats the cleaning.
    """
    typed = typed_responses(raw, rules)
    if store:
        typed = stored(typed)
    responses = c.coerce_numeric(typed, "Job Satisfaction")
    df = c.drop_equal(responses, "Work Status", "Part-time")
    df = c.annualise(df, "Salary", "Salary Unit", "Work Status")
    df = c.min_threshold(df, "Salary", rules.minimum_pay)
    df = c.clean_literals(df, {"Firm Size": [(" People", ""), ("501 +", "501+")]})
    unresolved = unresolved_keys(df, coordinates)
    # keys are counted once for all lookups of the refresh, and only where a table is too large to broadcast
    hot = shared_hot_keys(df, "Location")
    df, dropped = fill_from_gazetteer(enrich_location(df, coordinates, hot=hot), gazetteer, hot=hot)
    df = c.clean_literals(df, {"Location": [(rules.place_suffix, "")]})
    df = c.drop_ids(df, rules.denied_after_geocoding)
    fixes = literal_table(
        df.sparkSession, rules.corrections, "id bigint, Salary bigint, `Salary Unit` string, `Annual Bonus` string"
    )
    df = c.apply_corrections(df, fixes)
    df = add_columns(df, {"Annual Bonus": t.strip_to_number("`Annual Bonus`")})
    df = c.fx_normalise(df, "Salary", "Salary Unit", rules.unit_rates)
    df = c.drop_ids(df, rules.denied_after_units)
    df, rejected = c.allowlist_split(df, "Salary Unit", rules.allowed_units)
    index = ts.interpolate_gaps(price_index)
    df = ts.join_month_fallback(df, index, "Date", "CPIAUCSL")
    df = ts.inflation_adjust(
        df, "Salary", "CPIAUCSL", ts.current_value(index), "Inflation Adjusted Salary"
    )
    clean = df.selectExpr(
        *[f"CAST({q(f.name)} AS {f.dataType.simpleString()}) AS {q(f.name)}" for f in CLEAN_SCHEMA.fields]
    )
    report = quality(typed, coordinates, gazetteer, index, rules, hot)
    return Refreshed(clean, unresolved, dropped, rejected, report)
