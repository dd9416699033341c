"""Number display and the sort order of special labels."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import TOTAL_LABEL

# The order in which these labels are shown.
RANKS: dict[str, dict[str, int]] = {
    "CCY": {"USD": 1, "CAD": 2, "EUR": 3, "GBP": 4, "JPY": 5},
    "EVENT": {"SOD": 1, "NEW": 2, "AMEND": 3, "CXL": 4, "NOW": 5},
}

# Days per tenor unit, and month names.
TENOR_DAYS = {"Y": 365, "W": 7, "D": 1, "M": 31, "B": 1}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

UNRANKED = 1 << 31


def accounting(value: Column) -> Column:
    """Whole number, thousands commas, half-even, negatives in parentheses; -0.4 shows as ``(0)``, a negative zero as ``0``."""
    text = F.format_number(value, 0)
    return F.when(value == 0, F.lit("0")).when(text.startswith("-"), F.concat(F.lit("("), F.substring(text, 2, 100), F.lit(")"))).otherwise(text)


def parse_accounting(text: Column) -> Column:
    """The number shown by :func:`accounting`; null when the text holds none."""
    digits = F.regexp_replace(text, "[(),]", "").try_cast("double")
    return F.when(text.startswith("("), -digits).otherwise(digits)


def rounded(value: Column) -> Column:
    """Whole number with thousands commas, halves rounded up."""
    return F.format_number(F.floor(value + F.lit(0.5)).cast("bigint"), 0)


def rank(label: Column, order: Mapping[str, int]) -> Column:
    """Position of a label in a fixed order, null when it has none."""
    table = F.create_map(*[F.lit(part) for entry in order.items() for part in entry])
    return table[label]


def rank_text(label: Column, order: Mapping[str, int]) -> Column:
    """The sort text of a ranked label: a space for a total, the rank, or the label itself."""
    return (
        F.when(label == TOTAL_LABEL, F.lit(" "))
        .otherwise(F.coalesce(rank(label, order).cast("string"), label))
    )


def tenor_days(label: Column, as_of: dt.date | str | Column) -> Column:
    """Days from ``as_of`` to a tenor such as ``3M``, ``2024-06-15`` or ``Jun-24``; 0 when it is neither.

    ``as_of`` is an argument, never the clock, so that results can be repeated.
    """
    start = as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")
    count = F.substring(label, F.lit(1), F.length(label) - 1)
    count = F.when(F.trim(count) == "", F.lit(0.0)).otherwise(count.try_cast("double"))
    iso = r"^(\d{4})-?(\d{2})-?(\d{2})"
    month = r"(?i)^([a-z]{3})-(\d{2})"
    iso_date = F.try_to_date(
        F.concat_ws("-", *[F.regexp_extract(label, iso, g) for g in (1, 2, 3)]), "yyyy-MM-dd"
    )
    month_number = F.array_position(
        F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(label, month, 1))
    )
    month_date = F.when(
        month_number > 0,
        F.make_date(
            F.concat(F.lit("20"), F.regexp_extract(label, month, 2)).try_cast("int"),
            month_number.cast("int"),
            F.lit(15),
        ),
    )
    days = None
    for unit in ("Y", "W", "D", "M", "B"):
        amount = (count * TENOR_DAYS[unit]).cast("bigint")
        test = label.endswith(unit)
        days = F.when(test, amount) if days is None else days.when(test, amount)
    days = days.when(label.rlike(iso), F.datediff(iso_date, start).cast("bigint"))
    days = days.when(label.rlike(month), F.datediff(month_date, start).cast("bigint"))
    return F.coalesce(days.otherwise(F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def tenor_text(days: Column) -> Column:
    """The seven-character sort text of a tenor; negative numbers sort as text."""
    return F.substring(F.concat(F.lit("000000"), days.cast("string")), -7, 7)


def sort_key(label: Column, is_total: Column, attribute: str, as_of: dt.date | str | None = None,
             tenors: tuple[str, ...] = ("TENOR",), ranks: Mapping[str, Mapping[str, int]] | None = None) -> Column:
    """An orderable struct: totals first, then by rank or tenor length, then by text."""
    ranks = RANKS if ranks is None else ranks
    number, text = F.lit(UNRANKED).cast("bigint"), label
    if attribute in ranks:
        number = F.coalesce(rank(label, ranks[attribute]).cast("bigint"), number)
    elif attribute in tenors:
        if as_of is None:
            raise ValueError(f"as_of is needed to order {attribute}")
        number = tenor_days(label, as_of)
    shown_first = F.when(is_total, F.lit(0)).otherwise(F.lit(1))
    return F.struct(
        shown_first.alias("level"),
        F.when(is_total, F.lit(0).cast("bigint")).otherwise(number).alias("number"),
        text.alias("text"),
    )
