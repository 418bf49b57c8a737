"""Row-level column expressions. All stay inside JVM code generation."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from aerocal.config import MONTH_NUMBERS, SENTINELS, TEMPERATURE_RANGE, Compensation, SplitSpec

__all__ = [
    "affine",
    "all_present",
    "any_present",
    "ppb_to_ppm",
    "clean_number",
    "clean_text",
    "compensate_ozone",
    "compose_timestamp",
    "date_plus_hours",
    "in_months",
    "mask_outside",
    "masked",
    "month_label",
    "month_number",
    "parse_day_first",
    "parse_mixed",
    "percent_error",
    "shift_hours",
    "signed_error",
    "split_label",
    "two_point_scale",
    "within_time",
]

# Only plain decimal text is a reading. Java's own parser would also take
# "1.5d", hexadecimal floats and infinities.
_DECIMAL = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def clean_text(c: Column) -> Column:
    """Trimmed lower-case text, for header comparison."""
    return F.lower(F.trim(c))


def clean_number(c: Column, sentinels: Iterable[str] = SENTINELS) -> Column:
    """Text reading to double; sentinels and anything unparseable become null."""
    text = F.trim(c)
    usable = ~text.isin(*sentinels) & text.rlike(_DECIMAL)
    return F.when(usable, text.try_cast("double"))


def month_number(c: Column) -> Column:
    """Spanish month name, any case, to its two-digit number; unknown -> null."""
    pairs = [F.lit(v) for item in MONTH_NUMBERS.items() for v in item]
    return F.try_element_at(F.create_map(*pairs), clean_text(c))


def _iso_from_day_first(text: Column) -> Column:
    """Rewrite day-first dates to year-month-day so one cast parses them.

    Two-digit years follow the POSIX pivot: 69..99 are 19xx, 00..68 are 20xx.
    """
    text = F.regexp_replace(text, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?!\d)", "$3-$2-$1")
    text = F.regexp_replace(
        text, r"^(\d{1,2})[/-](\d{1,2})[/-](69|[7-9]\d)(?!\d)", "19$3-$2-$1"
    )
    return F.regexp_replace(text, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2})(?!\d)", "20$3-$2-$1")


def parse_day_first(c: Column, strict: bool = False) -> Column:
    """Day-first date-time text to TIMESTAMP_NTZ; bad text -> null.

    ``strict`` takes only ``d/m/yy H:M`` with a two-digit year.
    """
    text = F.trim(c)
    parsed = _iso_from_day_first(text).try_cast("timestamp_ntz")
    if strict:
        return F.when(text.rlike(r"^\d{1,2}/\d{1,2}/\d{2} \d{1,2}:\d{1,2}$"), parsed)
    return F.when(text.rlike(r"^\d{1,2}[/-]\d{1,2}[/-]\d{2}(\d{2})?(\D|$)"), parsed)


def parse_mixed(c: Column) -> Column:
    """ISO first, then month-first as US exports write it, then day-first."""
    text = F.trim(c)
    us = F.regexp_replace(text, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?!\d)", "$3-$1-$2")
    return F.coalesce(
        text.try_cast("timestamp_ntz"), us.try_cast("timestamp_ntz"), parse_day_first(text)
    )


def compose_timestamp(day: Column, hour: Column, year: int | Column | None = None) -> Column:
    """Date text ``d/m/yy`` plus hour 1..24 to TIMESTAMP_NTZ; hour 24 rolls over.

    ``year`` overrides the parsed year. A bad date or hour, or a date that does
    not exist in that year, gives null so the caller can quarantine the row.
    """
    date = F.try_to_date(F.trim(day), "d/M/yy")
    # Two-digit years follow the POSIX pivot, as everywhere else here.
    date = F.when(F.year(date) >= 2069, F.add_months(date, -1200)).otherwise(date)
    zero = F.lit(0)
    if year is not None:
        y = F.lit(year) if isinstance(year, int) else year
        date = F.try_make_timestamp_ntz(y, F.month(date), F.day(date), zero, zero, zero)
    hours = F.when(F.trim(hour).rlike(r"^\d{1,2}([.]0*)?$"), F.trim(hour).try_cast("double"))
    return date_plus_hours(date, hours.cast("int"))


def date_plus_hours(day: Column, hours: Column) -> Column:
    """Date (or midnight) plus whole hours, as TIMESTAMP_NTZ."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(hours=hours)


def shift_hours(ts: Column, hours: int) -> Column:
    return ts + F.make_dt_interval(hours=F.lit(hours))


def within_time(ts: Column, first: str, last: str) -> Column:
    """Both ends inclusive."""
    return ts.between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"))


def month_label(ts: Column) -> Column:
    """'2025-03'. Cut from the text, so the session's zone plays no part."""
    return F.substring(ts.cast("string"), 1, 7)


def in_months(ts: Column, months: Sequence[int], year: int | None = None) -> Column:
    hit = F.month(ts).isin(*months)
    return hit if year is None else hit & (F.year(ts) == year)


def split_label(ts: Column, spec: SplitSpec = SplitSpec()) -> Column:
    """'train', 'test' or null by month of year."""
    return F.when(in_months(ts, spec.train_months, spec.year), F.lit("train")).when(
        in_months(ts, spec.test_months, spec.year), F.lit("test")
    )


def mask_outside(c: Column, low: float = TEMPERATURE_RANGE[0], high: float = TEMPERATURE_RANGE[1]) -> Column:
    """Values outside [low, high] become null."""
    return F.when(c.between(low, high), c)


def all_present(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def any_present(columns: Iterable[str]) -> Column:
    return F.coalesce(*[F.col(c) for c in columns]).isNotNull()


def masked(condition: Column, value: Column) -> Column:
    """Value where the condition holds, null elsewhere."""
    return F.when(condition, value)


def ppb_to_ppm(c: Column) -> Column:
    return c / 1000.0


def compensate_ozone(
    o3: Column, temp: Column, rh: Column, k: Compensation = Compensation()
) -> Column:
    """Ozone corrected for temperature and humidity; null in, null out."""
    return (
        o3 / k.divisor
        + k.temp_sq * temp * temp
        + k.temp * temp
        + k.rh_sq * rh * rh
        + k.rh * rh
        + k.constant
    )


def two_point_scale(
    raw: Column, raw_low: Column, raw_high: Column, ref_low: Column, ref_high: Column
) -> Column:
    """Map [raw_low, raw_high] onto [ref_low, ref_high]; zero raw range -> null."""
    return F.try_divide((raw - raw_low) * (ref_high - ref_low), raw_high - raw_low) + ref_low


def affine(x: Column, alpha: Column, beta: Column) -> Column:
    return alpha + beta * x


def signed_error(ref: Column, measured: Column) -> Column:
    return ref - measured


def percent_error(ref: Column, measured: Column) -> Column:
    """100 * (ref - measured) / ref, null where the reference is zero."""
    return 100.0 * (ref - measured) / F.nullif(ref, F.lit(0.0))
