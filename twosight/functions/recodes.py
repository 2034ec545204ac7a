"""Recodes of survey answers and item attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from twosight.functions.nulls import col, is_in, matches

# --- fixed values: answer texts, labels and regions that results must match ---
CONFIDENT = ["Moderately confident", "Extremely confident"]
NOT_CONFIDENT = ["Not confident at all", "Slightly confident"]
RANK_LOWER = ["among the lowest accuracies (0-20%)", "lower than most accuracies (21-40%)"]
RANK_MEDIAN = ["approximately equal to the median accuracy (41-60%)"]
AGE_BANDS = [("<18", None, 17), ("18-24", 18, 24), ("25-34", 25, 34), ("35-59", 35, 59), ("60-78", 60, 78)]
AGE_TOP = "79+"
DEGREE_PATTERN = "Associate|Bachelor|Graduate"
REGIONS = {
    "northeast": [
        "Connecticut", "Maine", "Massachusetts", "New Hampshire", "Rhode Island", "Vermont", "New York", "New Jersey",
        "Pennsylvania",
    ],
    "midwest": [
        "Illinois", "Indiana", "Michigan", "Ohio", "Wisconsin", "Iowa", "Kansas", "Minnesota", "Missouri", "Nebraska",
        "North Dakota", "South Dakota",
    ],
    "west": [
        "Arizona", "Colorado", "Idaho", "Montana", "Nevada", "New Mexico", "Utah", "Wyoming", "Alaska", "California",
        "Hawaii", "Oregon", "Washington",
    ],
}
RFEL = "RFEL"
RFEL_SCORE = 6
# --- end of fixed values ---


def confidence_class(answer: Column | str) -> Column:
    """Five answers to three classes; a missing answer falls in the middle class."""
    a = col(answer)
    return (
        F.when(a.isin(CONFIDENT), "Confident").when(a.isin(NOT_CONFIDENT), "Not confident")
        .otherwise("Somewhat confident")
    )


def rank_class(answer: Column | str) -> Column:
    """Stated rank to Lower/Median/Higher; a missing answer counts as Higher."""
    a = col(answer)
    return F.when(a.isin(RANK_LOWER), "Lower").when(a.isin(RANK_MEDIAN), "Median").otherwise("Higher")


def age_band(age: Column | str) -> Column:
    a = col(age)
    band = F
    for label, low, high in AGE_BANDS:
        test = a <= high if low is None else a.between(low, high)
        band = band.when(test, label)
    return band.otherwise(AGE_TOP)


def region(location: Column | str, regions: dict[str, list[str]] | None = None) -> Column:
    band = F
    for name, members in (regions or REGIONS).items():
        band = band.when(is_in(location, members), name)
    return band.otherwise("other")


def has_degree(education: Column | str) -> Column:
    return F.when(matches(education, DEGREE_PATTERN), 1).otherwise(0)


def human_or_model(kind: Column | str) -> Column:
    """Merge the types of answers given by people (``h``, ``hr``) into ``h``."""
    return F.when(col(kind).contains("h"), "h").otherwise(col(kind))


def prior_score_label(prs: Column | str) -> Column:
    return F.coalesce(col(prs), F.lit(RFEL))


def prior_score_number(prs: Column | str) -> Column:
    p = prior_score_label(prs)
    return F.when(p == RFEL, float(RFEL_SCORE)).otherwise(p.try_cast("double"))


def present(value: Column | str) -> Column:
    return col(value).isNotNull().cast("int")


def percent_and_count(share: Column | str, n: Column | str) -> Column:
    """Text cell such as ``12.5% (34)``."""
    return F.concat(F.call_function("format_number", col(share) * 100, F.lit("0.###")), F.lit("% ("), col(n).cast("string"), F.lit(")"))
