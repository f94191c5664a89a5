"""From raw answers to the analysis table.

Every derived column is an expression on the respondent's own row, so the table needs no shuffle,
and a query that uses three of the columns computes only those three.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import zip_longest

from pyspark.sql import DataFrame

from headcount.functions import codes as K
from headcount.functions.columns import (
    band,
    classify,
    code_prefix,
    date_from_parts,
    if_else,
    is_in,
    null_codes,
    recode,
    row_max,
    row_total,
    weekday,
    with_exprs,
)
from headcount.operators.filters import exclude_ids, keep_positive

CONTACTS = (*K.FACE_TO_FACE, *K.PHYSICAL)


# A topic is a list of layers of derived columns; a layer may use the layers above it. Topics do not
# use each other, so layers at the same depth go into one projection.
Topic = list[dict[str, str]]


def occupation() -> str:
    """Healthcare worker first, then keyworker; "Other" needs both answers known."""
    other, hcw, keyworker = K.OCCUPATION_LEVELS
    return classify(
        [
            (f"hcw = {K.HCW_YES}", hcw),
            (f"keyworker = {K.KEYWORKER_YES}", keyworker),
            (f"hcw <> {K.HCW_YES} AND keyworker <> {K.KEYWORKER_YES}", other),
        ]
    )


def weekend(day: str) -> str:
    return if_else(is_in(day, K.WEEKEND_DAYS), *K.WEEKEND_LABELS)


DATES: Topic = [
    {"date_ymd": date_from_parts("survey_year", "survey_month", "survey_day")},
    {"weekday": weekday("date_ymd"), "yesterday": weekday("date_sub(date_ymd, 1)")},
    {"weekday2": weekend("weekday"), "yesterday2": weekend("yesterday")},
]

AGES: Topic = [
    {
        "age": band("age_years", K.AGE),
        "age2": band("age_years", K.AGE2),
        "age3": band("age_years", K.AGE3),
        "age4": band("age_years", K.AGE4),
    }
]

# Totals by kind, by contact age, and overall: the sum, and the larger of the two kinds.
CONTACT_TOTALS: Topic = [
    {c: null_codes(c) for c in CONTACTS},
    {
        "total_face_to_face": row_total(*K.FACE_TO_FACE),
        "total_physical": row_total(*K.PHYSICAL),
        **{t: row_total(f, p) for t, f, p in zip(K.TOTAL_BY_CONTACT, K.FACE_TO_FACE, K.PHYSICAL)},
    },
    {
        "total_contacts": row_total("total_face_to_face", "total_physical"),
        "total_contactsLD": row_max("total_face_to_face", "total_physical"),
    },
]

HOUSEHOLD: Topic = [
    {c: null_codes(c) for c in K.HOUSEHOLD_MEMBERS},
    {
        "household_size": f"{row_total(*K.HOUSEHOLD_MEMBERS)} + 1",
        "N_0to17yo": row_total(*K.HOUSEHOLD_CHILDREN),
    },
    {
        "household_size2": band("household_size", K.HOUSEHOLD),
        "alone": if_else("household_size = 1", *K.ALONE_LABELS),
        "children_in_house": if_else("N_0to17yo = 0", *K.CHILDREN_LABELS),
    },
    {"Children": if_else(f"children_in_house = '{K.CHILDREN_LABELS[1]}'", *K.YES_NO)},
]

OCCUPATION: Topic = [
    {
        "occupation": occupation(),
        "occupation2": occupation(),
        "SOC2010Major": code_prefix("soc_code", 1),
        "SOC2010SubMajor": code_prefix("soc_code", 2),
        "SOC2010Minor": code_prefix("soc_code", 3),
    }
]

LABELS: Topic = [{"sex2": recode("sex", K.SEX_LABELS), "selfisolation_un": recode("isolation", K.ISOLATION_LABELS)}]


def derive_columns(df: DataFrame, *topics: Topic) -> DataFrame:
    """Add the columns of some topics, one projection per depth."""
    for layers in zip_longest(*topics, fillvalue={}):
        df = with_exprs(df, {c: text for layer in layers for c, text in layer.items()})
    return df


def select_cases(raw: DataFrame, excluded: Sequence[int] | DataFrame = ()) -> DataFrame:
    """Leave out the excluded cases and everyone whose age is hidden or unknown."""
    return keep_positive(exclude_ids(raw, "respondent_id", excluded), "age_years")


def clean(raw: DataFrame, excluded: Sequence[int] | DataFrame = ()) -> DataFrame:
    """The analysis table: selected cases with every derived column. ``excluded`` names respondents
    to leave out; none by default."""
    return derive_columns(select_cases(raw, excluded), DATES, AGES, CONTACT_TOTALS, HOUSEHOLD, OCCUPATION, LABELS)
