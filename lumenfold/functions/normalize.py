"""Normalisation of names, phone numbers, codes and dates in Indian formats, as Column expressions.

Functions that validate return struct(value, original, valid, reason): value is null and reason set where the input
is empty or malformed. Null inputs count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' regular expressions see it.
WS = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: The same characters one by one.
BLANKS = "\t\n\v\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
ZERO_WIDTH = r"[\u200b-\u200d\ufeff]"
MOBILE, PIN, PAN, IFSC = r"^[6-9][0-9]{9}$", r"^[1-8][0-9]{5}$", r"^[A-Z]{5}[0-9]{4}[A-Z]$", r"^[A-Z]{4}0[A-Z0-9]{6}$"
EMAIL = rf"^(?:(?!{WS})[^@])+@(?:(?!{WS})[^@])+\.(?:(?!{WS})[^@]){{2,}}$"

# Tables of the Verhoeff checksum (dihedral group D5 and its permutation).
VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 2, 3, 4, 0, 6, 7, 8, 9, 5],
    [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7],
    [4, 0, 1, 2, 3, 9, 5, 6, 7, 8],
    [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2],
    [7, 6, 5, 9, 8, 2, 1, 0, 4, 3],
    [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9],
    [1, 5, 7, 6, 2, 8, 3, 0, 9, 4],
    [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7],
    [9, 4, 5, 3, 1, 2, 6, 8, 7, 0],
    [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5],
    [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]
# Month names and their short forms.
MONTHS = {"jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12}


def trim(c: Column) -> Column:
    """c without white space at either end, in time linear in it (a pattern would try every run of blanks)."""
    return F.btrim(c, F.lit(BLANKS))


def digits(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]+", "")


def _checked(original: Column, candidate: Column, *reasons: tuple[Column, str]) -> Column:
    """The struct of a candidate value: the first reason whose condition holds makes it invalid."""
    reason = F.lit(None).cast("string")
    for condition, name in reversed(reasons):
        reason = F.when(condition, F.lit(name)).otherwise(reason)
    return F.struct(F.when(reason.isNull(), candidate).alias("value"), F.coalesce(original, F.lit("")).alias("original"), reason.isNull().alias("valid"), reason.alias("reason"))


def search_mobile(c: Column) -> Column:
    """The last ten digits, without any validation."""
    return F.right(F.regexp_replace(c, "[^0-9]", ""), F.lit(10))


def normalize_mobile(c: Column) -> Column:
    d = digits(c)
    short = F.when(F.length(d) <= 10, d).when(d.startswith("91"), F.substring(d, 3, 1 << 30)).otherwise(F.regexp_replace(d, "^0+", ""))
    bare = F.when((F.length(short) == 11) & short.startswith("0"), F.substring(short, 2, 10)).otherwise(short)
    return _checked(c, bare, (d == "", "EMPTY"), (F.length(bare) != 10, "LENGTH"), (~bare.rlike(MOBILE), "PREFIX"))


def e164_mobile(c: Column) -> Column:
    return F.concat(F.lit("+91"), normalize_mobile(c)["value"])


def format_mobile(c: Column) -> Column:
    v = normalize_mobile(c)["value"]
    return F.concat(F.substring(v, 1, 5), F.lit(" "), F.substring(v, 6, 5))


def normalize_name(c: Column) -> Column:
    cleaned = trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), ZERO_WIDTH, ""), f"{WS}+", " "))
    return _checked(c, cleaned, (cleaned == "", "EMPTY"))


def name_key(c: Column) -> Column:
    """A loose key to compare names by: lower case, Latin and Devanagari letters and single blanks only."""
    return trim(F.regexp_replace(F.regexp_replace(F.lower(c), rf"(?!{WS})[^a-z\u0900-\u097f]", ""), f"{WS}+", " "))


def normalize_pincode(c: Column) -> Column:
    d = digits(c)
    return _checked(c, d, (d == "", "EMPTY"), (F.length(d) != 6, "LENGTH"), (~d.rlike(PIN), "RANGE"))


def _code(c: Column, pattern: str) -> Column:
    v = F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), f"{WS}+", ""))
    return _checked(c, v, (v == "", "EMPTY"), (~v.rlike(pattern), "FORMAT"))


def normalize_pan(c: Column) -> Column:
    return _code(c, PAN)


def normalize_ifsc(c: Column) -> Column:
    return _code(c, IFSC)


def normalize_email(c: Column) -> Column:
    v = F.lower(trim(F.coalesce(c, F.lit(""))))
    return _checked(c, v, (v == "", "EMPTY"), (~v.rlike(EMAIL), "FORMAT"))


def passes_verhoeff(c: Column) -> Column:
    """Twelve digits, not beginning with 0 or 1, whose Verhoeff checksum is 0."""
    d = digits(c)
    table_d = F.array(*[F.lit(x) for row in VERHOEFF_D for x in row])
    table_p = F.array(*[F.lit(x) for row in VERHOEFF_P for x in row])
    step = lambda acc, i: F.element_at(table_d, acc * 10 + F.element_at(table_p, (i % 8) * 10 + F.substring(d, F.lit(12) - i, F.lit(1)).cast("int") + 1) + 1)
    return F.when((F.length(d) == 12) & ~d.rlike("^[01]"), F.aggregate(F.sequence(F.lit(0), F.lit(11)), F.lit(0), step) == 0).otherwise(False)


def last_four(c: Column) -> Column:
    d = digits(c)
    return F.when(F.length(d) >= 4, F.right(d, F.lit(4)))


def parse_date(c: Column) -> Column:
    """ISO dates, day-month-year (two-digit years up to 30 are 20xx) and dates with a month's name, as ISO text."""
    t = trim(F.coalesce(c, F.lit("")))
    iso, dmy, named = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})$", r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{2}|[0-9]{4})$", rf"^([0-9]{{1,2}})(?:{WS}|-)+([A-Za-z]+)(?:{WS}|[-,])+([0-9]{{4}})$"
    part = lambda p, i: F.regexp_extract(t, p, i)
    months = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    month = F.element_at(months, F.lower(part(named, 2)))
    y = part(dmy, 3).try_cast("int")
    year = F.when(F.length(part(dmy, 3)) == 4, y).when(y > 30, y + 1900).otherwise(y + 2000)
    text = lambda y, m, d: F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-"), F.lpad(d.cast("string"), 2, "0"))
    candidate = F.when(t.rlike(iso), text(part(iso, 1), part(iso, 2), part(iso, 3))).when(t.rlike(dmy), text(year, part(dmy, 2), part(dmy, 1))).when(t.rlike(named), text(part(named, 3), month, part(named, 1)))
    known = t.rlike(iso) | t.rlike(dmy) | t.rlike(named)
    return _checked(c, candidate, (t == "", "EMPTY"), (~known, "UNRECOGNISED_FORMAT"), (t.rlike(named) & month.isNull(), "UNKNOWN_MONTH"), (candidate.try_cast("date").isNull(), "INVALID_DATE"))


def format_date(c: Column) -> Column:
    p = r"^([0-9]{4})-([0-9]{2})-([0-9]{2})"
    return F.when(c.rlike(p), F.concat_ws("/", *[F.regexp_extract(c, p, i) for i in (3, 2, 1)]))


def age(birth: Column, as_of: Column) -> Column:
    """Whole years from birth (ISO text or date) to as_of; null below 0 and from 130 on."""
    born = F.when(birth.cast("string").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), birth.cast("string").try_cast("date"))
    early = (F.month(as_of) < F.month(born)) | ((F.month(as_of) == F.month(born)) & (F.dayofmonth(as_of) < F.dayofmonth(born)))
    years = F.year(as_of) - F.year(born) - early.cast("int")
    return F.when((years >= 0) & (years < 130), years)


def format_inr(amount: Column) -> Column:
    """Whole rupees with lakh grouping, rounded half away from zero: ₹1,23,456."""
    whole = F.round(F.abs(amount)).cast("decimal(38,0)").cast("string")
    head, tail = F.left(whole, F.length(whole) - 3), F.right(whole, F.lit(3))
    grouped = F.when(F.length(whole) <= 3, whole).otherwise(F.concat(F.regexp_replace(head, r"(\d)(?=(\d\d)+$)", "$1,"), F.lit(","), tail))
    sign = F.when((amount < 0), F.lit("-₹")).otherwise(F.lit("₹"))
    return F.when(amount.isNotNull() & ~F.isnan(amount.cast("double")), F.concat(sign, grouped))
