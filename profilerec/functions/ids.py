"""Identifier, money, timestamp and event-type normalisation as pure column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted number text, the legacy id suffix and the characters kept in money text.
NUMBER_PATTERN = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
LEGACY_SUFFIX_PATTERN = r"_[0-9]+$"
NOT_MONEY_PATTERN = r"[^0-9.\-]"
UNKNOWN_PRODUCT = "unknown_product"

# Text formats tried in this order after the ISO forms.
TIMESTAMP_FORMATS = (
    "M/d/yyyy H:mm",
    "M/d/yyyy H:mm:ss",
    "M/d/yyyy",
    "d/M/yyyy H:mm",
    "d/M/yyyy H:mm:ss",
    "d/M/yyyy",
)


def strip_text(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _fraction_text(number: Column) -> Column:
    """Plain decimal text of a non-integral double, scientific below 1e-4."""
    java_text = number.cast("string")
    plain = F.regexp_replace(java_text.try_cast("decimal(38,20)").cast("string"), r"0+$", "")
    mantissa = F.regexp_replace(F.regexp_extract(java_text, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    exponent = F.lpad(F.regexp_extract(java_text, r"E-([0-9]+)$", 1), 2, "0")
    tiny = F.abs(number) < 1e-4
    return F.when(tiny, F.concat(mantissa, F.lit("e-"), exponent)).otherwise(plain)


def normalize_user_id(c: Column) -> Column:
    """Null or blank to '', integral number text to integer text, other numbers to decimal text."""
    text = strip_text(c.cast("string"))
    is_number = text.rlike(NUMBER_PATTERN)
    number = F.when(is_number, text.try_cast("double"))
    integral = number == F.floor(number).cast("double")
    lowered = F.lower(text)
    return (
        F.when(text.isNull() | (text == ""), F.lit(""))
        .when(lowered.rlike(r"^[+-]?nan$"), F.lit("nan"))
        .when(lowered.rlike(r"^\+?inf(inity)?$"), F.lit("inf"))
        .when(lowered.rlike(r"^-inf(inity)?$"), F.lit("-inf"))
        .when(integral, F.coalesce(number.try_cast("decimal(38,0)").cast("string"), text))
        .when(is_number, F.coalesce(_fraction_text(number), text))
        .otherwise(text)
    )


def normalize_product_id(c: Column, strip_legacy_suffix: bool = True) -> Column:
    """Null to '', trimmed text, one trailing ``_<digits>`` removed."""
    text = strip_text(F.coalesce(c.cast("string"), F.lit("")))
    return F.regexp_replace(text, LEGACY_SUFFIX_PATTERN, "") if strip_legacy_suffix else text


def parse_money(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), NOT_MONEY_PATTERN, "").try_cast("double")


def parse_timestamp(c: Column) -> Column:
    """First format that parses, month before day; null when none does."""
    text = strip_text(c.cast("string"))
    parsed = [F.when(text.rlike(r"^[0-9]{4}-"), text.try_cast("timestamp_ntz"))]
    for fmt in TIMESTAMP_FORMATS:
        parsed.append(F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz"))
    return F.coalesce(*parsed)


def canonical_event_type(c: Column) -> Column:
    return F.lower(strip_text(c.cast("string")))


def time_parts(ts: Column) -> dict[str, Column]:
    return {
        "year": F.year(ts),
        "month": F.month(ts),
        "day": F.dayofmonth(ts),
        "day_of_week": F.weekday(ts),
        "hour": F.hour(ts),
    }


def format_ts(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
