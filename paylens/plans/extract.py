"""Extraction of the 21 response fields from survey cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from paylens.functions import text as t
from paylens.functions.sql import lit, q
from paylens.schema import RAW_COLUMNS


def extract_cards(
    cards: DataFrame, ident: str = "id", html: str = "html", keep: Sequence[str] = (), spread: bool = True
) -> DataFrame:
    """One response of 21 text columns per card, then the columns of `keep`; what a card lacks is null.

    A card costs far more to take apart than to move, and a landed file is read by one task. So cards are
    spread by id first, over as many tasks as the session shuffles into; `spread` can be turned off where
    many files do that already. The response comes out of a generator, so that later filters stay
    above it and no pattern runs twice.
    """
    page = q(html)
    if spread:
        cards = cards.repartition(q(ident))
    stages = [
        {
            "mood": t.tag_attribute(page, "img", "data-original-title", "emoticon"),
            "head": t.element(page, "h3"),
            "firm": t.list_items(t.element(page, "ul", "subcol-1")),
            "person": t.list_items(t.element(page, "ul", "subcol-2")),
            "schools": t.list_items(t.element(page, "ul", "subcol-3")),
            "stamp": t.plain_text(t.element(page, "div", "date-stamp")),
        },
        {
            "pay": t.plain_text(t.element("head", "span", "salary")),
            "after_slash": t.texts_after("head", "span", "slash"),
            "firm_tags": t.firm_tags("firm"),
            "person_tags": t.person_tags("person"),
        },
    ]
    kept = [f"{q(c)} AS _kept_{i}" for i, c in enumerate(keep)]
    df = cards.selectExpr(f"CAST({q(ident)} AS STRING) AS id", f"{page}", *kept)
    for stage in stages:
        df = df.selectExpr("*", *[f"{e} AS {c}" for c, e in stage.items()])
    firm, person = t.firm_fields("firm_tags"), t.person_fields("person_tags")

    def given(e: str) -> str:
        return f"nullif({e}, '')"

    def after_slash(index: int) -> str:
        return given(t.strip(t.decode_entities(f"try_element_at(after_slash, {index})")))

    fields = {
        "id": "id",
        "Job Satisfaction": "get(split(mood, ': '), 1)",
        "Salary": given(t.digits_and_commas("pay")),
        "Salary Unit": given(t.letters_only("pay")),
        "Location": after_slash(1),
        "Job Title": after_slash(-1),
        "Firm Type": firm["firm_type"],
        "Firm Size": firm["firm_size"],
        "Health Insurance": firm["health_insurance"],
        "Overtime": firm["overtime"],
        "Vacation Days": firm["vacation_days"],
        "Annual Bonus": firm["annual_bonus"],
        "Work Status": person["work_status"],
        "Years of Experience": person["years_of_experience"],
        "Age": person["age"],
        "Gender": person["gender"],
        "Licensed": person["licensed"],
        "Undergraduate School": t.first_with_prefix("schools", "UG:"),
        "Graduate School": t.first_with_prefix("schools", "Grad:"),
        "Post-Graduate School": t.first_with_prefix("schools", "PhD:"),
        "Date": given("stamp"),
    }
    response = ", ".join([*[f"{lit(c)}, {fields[c]}" for c in RAW_COLUMNS], *[f"{lit(c)}, _kept_{i}" for i, c in enumerate(keep)]])
    return df.selectExpr(f"inline(array(named_struct({response})))")
