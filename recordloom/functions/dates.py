"""Dates of records as column expressions: parsing, other spellings and the time they speak of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: formats of stored dates, tried in this order
STORED_FORMATS = ["MM/dd/yyyy HH:mm:ss", "M/d/yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy", "M/d/yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "yyyy/MM/dd", "d MMMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMM yyyy"]
# fixed values: other spellings of a date
ALTERNATIVE_FORMATS = ["dd/MM/yyyy", "yyyy-MM-dd", "MMMM dd, yyyy", "MMM dd, yyyy", "dd MMMM yyyy"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_date(x: Column | str, formats: list[str] | None = None) -> Column:
    """Timestamp of the first format that fits; null when none does."""
    t = F.trim(_c(x))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in formats or STORED_FORMATS])


def alternative_dates(ts: Column | str) -> Column:
    return F.concat_ws(", ", *[F.date_format(_c(ts), f) for f in ALTERNATIVE_FORMATS])


def week_of_year(ts: Column | str) -> Column:
    """Week number when week 1 begins on January 1 and weeks begin on Sunday."""
    d = _c(ts)
    return F.floor((F.dayofyear(d) - 1 + F.dayofweek(F.trunc(d, "year")) - 1) / 7) + 1


def time_of_day(ts: Column | str) -> Column:
    """Labels of the time of day, most special first, joined by commas."""
    d = _c(ts)
    h, m = F.hour(d), F.minute(d)
    lab = lambda cond, text: F.when(cond, F.lit(text))
    return F.array_join(
        F.array_compact(
            F.array(
                lab((h == 12) & (m <= 15), "noon"), lab((h == 12) & (m <= 15), "midday"), lab((h == 0) & (m <= 15), "midnight"), lab((h == 23) & (m >= 45), "near midnight"),
                lab(h.between(5, 11), "morning"), lab(h.between(5, 7), "early morning"), lab(h.between(10, 11), "late morning"),
                lab(h.between(12, 16), "afternoon"), lab(h.between(12, 13), "early afternoon"), lab(h.between(15, 16), "late afternoon"),
                lab(h.between(17, 20), "evening"), lab(h.between(17, 18), "early evening"),
                lab((h >= 21) | (h < 5), "night"), lab(h >= 21, "late night"), lab(h < 5, "early night"),
            )
        ),
        ", ",
    )


def temporal_context(ts: Column | str) -> Column:
    """Lines that name time of day, month, quarter, weekday, year and week of a timestamp; null for null."""
    d = _c(ts)
    year = F.year(d).cast("string")
    return F.when(
        d.isNotNull(),
        F.concat_ws(
            "\n", F.concat(F.lit("Time of Day: "), time_of_day(d)), F.concat(F.lit("Month: "), F.date_format(d, "MMMM"), F.lit(" "), year), F.concat(F.lit("Quarter: Q"), F.quarter(d).cast("string"), F.lit(" "), year),
            F.concat(F.lit("Day of Week: "), F.date_format(d, "EEEE")), F.concat(F.lit("Year: "), year), F.concat(F.lit("Week of Year: Week "), week_of_year(d).cast("string"), F.lit(" of "), year),
        ),
    )
