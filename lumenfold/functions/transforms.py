"""From a customer's value to what a form field takes: named transforms, formats of input types, options."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import WS, last_four, format_date, normalize_mobile, normalize_pincode, trim

# What forms call genders and categories.
GENDER_FULL = {"male": "Male", "female": "Female", "transgender": "Transgender", "other": "Other"}
GENDER_SHORT = {"male": "M", "female": "F", "transgender": "T", "other": "O"}
CATEGORY_CODE = {"general": "GEN", "obc": "OBC", "sc": "SC", "st": "ST", "ews": "EWS", "other": "OTHER"}
CATEGORY_FULL = {"general": "General", "obc": "OBC", "sc": "Scheduled Caste", "st": "Scheduled Tribe", "ews": "EWS", "other": "Other"}

_ISO = r"^(\d{4})-(\d{2})-(\d{2})$"


def _given(value: Column) -> Column:
    """The value without blanks around it; null where nothing is left."""
    return F.nullif(trim(value), F.lit(""))


def _iso(value: Column, made: Callable[[Column, Column, Column], Column]) -> Column:
    v = _given(value)
    return F.when(v.rlike(_ISO), made(*[F.regexp_extract(v, _ISO, i) for i in (1, 2, 3)]))


def _named(value: Column, names: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.lower(_given(value)))


def _title(value: Column) -> Column:
    words = F.split(_given(value), f"{WS}+")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def _plain_number(value: Column) -> Column:
    bare = F.regexp_replace(_given(value), f"(?:[,₹]|{WS})", "")
    return F.when(bare.rlike(r"^[0-9]+(\.[0-9]+)?$"), bare)


# The names of the transforms.
TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "date.ddmmyyyy": lambda v: format_date(_given(v)),
    "date.ddmmyyyy_dash": lambda v: _iso(v, lambda y, m, d: F.concat_ws("-", d, m, y)),
    "date.yyyymmdd": lambda v: _iso(v, lambda y, m, d: F.concat(y, m, d)),
    "date.iso": lambda v: _iso(v, lambda y, m, d: F.concat_ws("-", y, m, d)),
    "date.day": lambda v: _iso(v, lambda y, m, d: d),
    "date.month": lambda v: _iso(v, lambda y, m, d: m),
    "date.year": lambda v: _iso(v, lambda y, m, d: y),
    "text.upper": lambda v: F.upper(_given(v)),
    "text.lower": lambda v: F.lower(_given(v)),
    "text.titlecase": _title,
    "text.nospace": lambda v: F.regexp_replace(_given(v), f"{WS}+", ""),
    "mobile.10digit": lambda v: normalize_mobile(v)["value"],
    "mobile.e164": lambda v: F.concat(F.lit("+91"), normalize_mobile(v)["value"]),
    "pin.6digit": lambda v: normalize_pincode(v)["value"],
    "aadhaar.last4": last_four,
    "gender.full": lambda v: _named(v, GENDER_FULL),
    "gender.mf": lambda v: _named(v, GENDER_SHORT),
    "category.code": lambda v: _named(v, CATEGORY_CODE),
    "category.full": lambda v: _named(v, CATEGORY_FULL),
    "number.plain": _plain_number,
}


def transformed(name: Column, value: Column) -> Column:
    """The value by the transform that a row names: as it is without a name, null on doubt or for an unknown name."""
    out = F.when(F.coalesce(name, F.lit("")) == "", value)
    for known, f in TRANSFORMS.items():
        out = out.when(name == known, f(value))
    return out


def _padded(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def _date(v: Column) -> Column:
    day_first = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$"
    d, m, y = (F.regexp_extract(v, day_first, i) for i in (1, 2, 3))
    return F.when(v.rlike(day_first), F.concat_ws("-", y, _padded(m), _padded(d))).otherwise(v)


def _time(v: Column) -> Column:
    clock = r"(?i)^(\d{1,2})[:.](\d{2})(?:[:.]\d{2})?\s*(am|pm)?$"
    v = trim(v)
    hour, minute, half = F.regexp_extract(v, clock, 1).try_cast("int"), F.regexp_extract(v, clock, 2), F.lower(F.regexp_extract(v, clock, 3))
    hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    return F.when(v.rlike(clock) & (hour <= 23), F.concat(_padded(hour.cast("string")), F.lit(":"), minute)).otherwise(v)


def _month(v: Column) -> Column:
    year_first, month_first = r"^(\d{4})[-/](\d{1,2})$", r"^(\d{1,2})[-/](\d{4})$"
    at = F.regexp_extract
    return F.when(v.rlike(year_first), F.concat_ws("-", at(v, year_first, 1), _padded(at(v, year_first, 2)))).when(v.rlike(month_first), F.concat_ws("-", at(v, month_first, 2), _padded(at(v, month_first, 1)))).otherwise(v)


def _week(v: Column) -> Column:
    week = r"^(\d{4})[-/]?[wW]?(\d{1,2})$"
    return F.when(v.rlike(week), F.concat(F.regexp_extract(v, week, 1), F.lit("-W"), _padded(F.regexp_extract(v, week, 2)))).otherwise(v)


def _color(v: Column) -> Column:
    digits = F.lower(F.regexp_replace(v, "^#", ""))
    return F.when(digits.rlike("^[0-9a-f]{6}$"), F.concat(F.lit("#"), digits)).when(digits.rlike("^[0-9a-f]{3}$"), F.concat(F.lit("#"), F.regexp_replace(digits, "(.)", "$1$1"))).otherwise(v)


def formatted(input_type: Column, value: Column) -> Column:
    """The value as the input type wants it; what has no such form stays as it is, without blanks around it."""
    v = trim(value)
    moment = r"^(\S+)[T\s]+(.+)$"
    both = F.concat(_date(F.regexp_extract(v, moment, 1)), F.lit("T"), _time(F.regexp_extract(v, moment, 2)))
    return F.when(input_type == "date", _date(v)).when((input_type == "datetime-local") & v.rlike(moment), both).when(input_type == "time", _time(v)).when(input_type == "month", _month(v)).when(input_type == "week", _week(v)).when(input_type == "color", _color(v)).otherwise(v)


def clamped(value: Column, least: Column, most: Column) -> Column:
    """The number in the value within a slider's bounds (0 and 100 where it names none); null without a number."""
    number = F.regexp_extract(F.regexp_replace(value, r"[^\d.-]", ""), r"^-?(?:\d+\.?\d*|\.\d+)", 0).try_cast("double")
    low, high = (F.coalesce(F.nullif(b, F.lit("")), F.lit(d)).try_cast("double") for b, d in ((least, "0"), (most, "100")))
    held = F.when(high.isNotNull(), F.least(F.greatest(number, F.coalesce(low, number)), high)).otherwise(F.greatest(number, F.coalesce(low, number)))
    return F.when(number.isNotNull(), F.regexp_replace(held.cast("string"), r"\.0$", ""))


def matched_option(options: Column, value: Column) -> Column:
    """The option (struct of value and label) that a value stands for: by its exact value, else by value, label, beginning or (beyond three characters) part of the label, white space and case aside; the first of equals."""
    plain = lambda c: F.lower(trim(F.regexp_replace(c, f"{WS}+", " ")))
    wanted = plain(value)
    first = lambda hit: F.get(F.filter(options, hit), F.lit(0))
    return F.coalesce(
        first(lambda o: o["value"] == value),
        first(lambda o: plain(o["value"]) == wanted),
        first(lambda o: plain(o["label"]) == wanted),
        first(lambda o: F.startswith(plain(o["label"]), wanted)),
        first(lambda o: (F.length(wanted) > 3) & F.contains(plain(o["label"]), wanted)),
    )
