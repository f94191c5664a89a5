"""Fixed values of the questionnaire: codes, band edges and level names.

These have to be exactly what published results were computed with, so they are
written out here and nowhere else. Operators take them as parameters.
"""

from __future__ import annotations

from dataclasses import dataclass

# -- fixed values: answers that mean "no answer" ------------------------------
SENTINELS = (-11, -10, -9, -1)
ISOLATION_MISSING = (-9999, -11, -10, -9, -1)
HIDDEN_AGE = -11

# -- fixed value: the one case left out of every analysis ----------------------
EXCLUDED_IDS = (9142,)


@dataclass(frozen=True)
class Bands:
    """Labels over half-open ranges (edges[i], edges[i+1]]; the last edge may be None (no upper end)."""

    edges: tuple
    labels: tuple

    def __post_init__(self):
        if len(self.edges) != len(self.labels) + 1:
            raise ValueError("bands need one more edge than labels")


# -- fixed values: band schemes ------------------------------------------------
AGE = Bands((0, 4, 17, 69, None), ("0 - 4", "5 - 17", "18 - 69", "70+"))
AGE2 = Bands(
    (0, 4, 17, 29, 49, 69, None),
    ("0 - 4", "5 - 17", "18 - 29", "30 - 49", "50 - 69", "70+"),
)
AGE3 = Bands(
    (0, 4, 17, 29, 39, 49, 59, 69, None),
    ("0 - 4", "5 - 17", "23 - 29", "30 - 39", "40 - 49", "50 - 59", "60 - 69", "70+"),
)
AGE4 = Bands((0, 49, None), ("0 - 49", "50+"))
HOUSEHOLD = Bands((0, 1, 2, 3, 4, None), ("1", "2", "3", "4", "5+"))

# -- fixed values: contact columns and the age band each one asks about --------
FACE_TO_FACE = {
    "f2f_0_4": "0 - 4",
    "f2f_5_17": "5 - 17",
    "f2f_18_69": "18 - 69",
    "f2f_70": "70+",
}
PHYSICAL = {
    "phys_0_4": "0 - 4",
    "phys_5_17": "5 - 17",
    "phys_18_69": "18 - 69",
    "phys_70": "70+",
}
TOTAL_BY_CONTACT = {
    "total_0to4": "0 - 4",
    "total_5to17": "5 - 17",
    "total_18to69": "18 - 69",
    "total_70over": "70+",
}
HOUSEHOLD_MEMBERS = ("hh_0_4", "hh_5_17", "hh_18_69", "hh_70")
HOUSEHOLD_CHILDREN = ("hh_0_4", "hh_5_17")

# -- fixed values: recodes -----------------------------------------------------
SEX_LABELS = {1: "Male", 2: "Female"}
ISOLATION_LABELS = {
    1: "No",
    2: "Yes, am now",
    3: "Yes, but have stopped",
    9: "Prefer not to say",
    -9999: "UNK",
    -11: "UNK",
    -10: "UNK",
    -9: "UNK",
    -1: "UNK",
}
ALONE_LABELS = ("Live alone", "Multiple Occp")
CHILDREN_LABELS = ("No children", "Children")
YES_NO = ("Yes", "No")
WEEKEND_LABELS = ("Weekend", "Weekday")
HCW_YES = 2
HCW_NO = (1, 3, 8, 9)
KEYWORKER_YES = 1
KEYWORKER_NO = (2, 9)

# -- fixed values: level order; the first level is the regression reference ----
WEEKDAY_LEVELS = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
WEEKEND_DAYS = ("Sat", "Sun")
OCCUPATION_LEVELS = ("Other", "HCW", "Keyworker")
ISOLATION_LEVELS = ("No", "Yes, am now", "Yes, but have stopped", "Prefer not to say", "UNK")

MODEL_FACTORS = {
    "age3": AGE3.labels,
    "sex2": ("Male", "Female"),
    "household_size2": HOUSEHOLD.labels,
    "Children": ("No", "Yes"),
    "yesterday2": ("Weekday", "Weekend"),
    "occupation2": OCCUPATION_LEVELS,
    "selfisolation_un": ISOLATION_LEVELS,
}
