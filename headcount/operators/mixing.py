"""Contact (mixing) matrices: who reports contacts with whom."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from headcount.functions.columns import name
from headcount.operators.cells import require_integer, summarise, value_cells

WITH_QUARTILES = ("mean", "median", "sd", "total", "q25", "q75", "n")
WITH_IQR = ("mean", "median", "sd", "iqr", "total", "n")


def mixing_matrix(
    df: DataFrame, respondent: str, contacts: Mapping[str, str], stats: Sequence[str] = WITH_IQR
) -> DataFrame:
    """Statistics of contacts per respondent band and contact band, as one long table.

    ``contacts`` maps a contact column to the band it asks about. All bands are counted in one
    scan and one shuffle; only answers of zero or more take part.
    """
    cols = list(contacts)
    require_integer(df, cols)
    keys = ["age_respondent", "age_contact"]
    bands = [f"CAST({name(c)} AS BIGINT) AS {name(label)}" for c, label in contacts.items()]
    long = (
        df.selectExpr(f"{name(respondent)} AS age_respondent", *bands)
        .unpivot(["age_respondent"], [name(label) for label in contacts.values()], "age_contact", "contacts")
        .filter("contacts >= 0")
    )
    return summarise(value_cells(long, keys, "contacts"), keys, stats)
