"""Lenient casts and date/time forms of header values, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_int(c: Column) -> Column:
    """Integer text only: '3.0' gives null."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("long"))


def to_float(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def multi_value(array: Column) -> Column:
    """Several values as one backslash-separated string."""
    return F.array_join(F.filter(array, lambda x: x.isNotNull()), "\\")


def dicom_date(c: Column) -> Column:
    """Eight digits become yyyy-mm-dd, ISO dates pass, anything else is null."""
    t = F.trim(c)
    iso = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")
    return F.when(iso.rlike(r"^\d{4}-\d{2}-\d{2}$"), iso)


def dicom_time(c: Column) -> Column:
    """HHMMSS[.f] becomes HH:MM:SS[.f]; values with a colon pass; anything else is null."""
    t = F.trim(c)
    return F.when(t.contains(":"), t).when(t.rlike(r"^\d{6}(\.\d+)?$"), F.regexp_replace(t, r"^(\d{2})(\d{2})(\d{2})", "$1:$2:$3"))


def to_date(c: Column) -> Column:
    """The calendar date of a header date; impossible dates are null."""
    return F.try_to_date(dicom_date(c), "yyyy-MM-dd")


#: The order in which the places of year, month and day are tried, in digits alone and with separators.
DIGIT_ORDERS, SPLIT_ORDERS = ("Ymd", "dmY", "mdY"), ("Ymd", "dmY", "mdY", "Ydm")
_PART = {"Y": r"(\d{4})", "m": "(1[0-2]|0[1-9]|[1-9])", "d": r"(3[0-1]|[1-2]\d|0[1-9]|[1-9])"}
_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: A month's name, whole or its first three letters.
_MONTH = "(?i:(" + "|".join(f"{m}{rest}" for m, rest in zip(_MONTHS, ("(?:uary)?", "(?:ruary)?", "(?:ch)?", "(?:il)?", "", "(?:e)?", "(?:y)?", "(?:ust)?", "(?:t(?:ember)?)?", "(?:ober)?", "(?:ember)?", "(?:ember)?"), strict=True)) + r")\.?)"
_DAY = r"(\d{1,2})(?:st|nd|rd|th)?"


def _date_of(text: Column, pattern: str, order: str) -> Column:
    """The calendar date of a text whose groups are year, month and day in this order; null if it has none."""
    part = {p: F.regexp_extract(text, pattern, i + 1) for i, p in enumerate(order)}
    month = part["m"]
    if _MONTH in pattern:
        month = F.array_position(F.array(*map(F.lit, _MONTHS)), F.lower(F.substring(part["m"], 1, 3))).cast("string")
    joined = F.concat_ws("-", part["Y"], F.lpad(month, 2, "0"), F.lpad(part["d"], 2, "0"))
    return F.when(text.rlike(pattern), F.try_to_date(joined, "yyyy-MM-dd"))


def birth_date(c: Column) -> Column:
    """A date in one of many forms, the first that gives a calendar date: digits alone; parts of one
    or two digits and a year of four between any separators; a month by name; a date before a time."""
    t = F.trim(c)
    digits = [_date_of(t, "^" + "".join(_PART[p] for p in order) + "$", order) for order in DIGIT_ORDERS]
    even = F.regexp_replace(F.regexp_replace(t, r"[./_\\]", "-"), r"\s+", "-")
    split = [_date_of(even, "^" + "-".join(_PART[p] for p in order) + "$", order) for order in SPLIT_ORDERS]
    named = [_date_of(t, rf"^{_DAY}[\s.-]*{_MONTH}[\s,.-]*(\d{{4}})$", "dmY"), _date_of(t, rf"^{_MONTH}[\s.-]*{_DAY}[\s,.-]+(\d{{4}})$", "mdY"), _date_of(t, rf"^(\d{{4}})[\s,.-]*{_MONTH}[\s.-]*{_DAY}$", "Ymd")]
    timed = _date_of(t, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})[T ]\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?Z?$", "Ymd")
    return F.coalesce(*digits, *split, *named, timed)


def date_in_uid(uid: Column, first_year: int = 1980, last_year: int = 2100) -> Column:
    """The first valid yyyymmdd inside a UID whose year lies within bounds. Every position is
    tried, digits may overlap."""
    at = F.sequence(F.lit(1), F.greatest(F.length(uid) - 7, F.lit(1)))
    parts = F.transform(at, lambda i: F.substring(uid, i, F.lit(8)))
    dates = F.transform(F.filter(parts, lambda p: p.rlike(r"^\d{8}$")), lambda p: F.try_to_date(p, "yyyyMMdd"))
    return F.try_element_at(F.filter(dates, lambda d: d.isNotNull() & F.year(d).between(first_year, last_year)), F.lit(1))


def parse_bool(c: Column) -> Column:
    t = F.lower(F.trim(c))
    number = t.try_cast("double")
    return F.when(t.isin("1", "true", "t", "yes", "y"), True).when(t.isin("0", "false", "f", "no", "n"), False).when(number.isNotNull(), number != 0)


def parse_b_values(c: Column) -> Column:
    """Sorted distinct whole numbers from 0 to 20000 in a list split by \\ / , or blanks."""
    numbers = F.transform(F.split(c, r"[\\/,\s]+"), lambda x: F.floor(x.try_cast("double")).cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & x.between(0, 20000))))


_LIST = r"^\s*\[.*\]\s*$"


def _list_items(c: Column) -> Column:
    """The items of a list's text, quotes off; commas inside quotes do not split."""
    inner = F.regexp_replace(F.trim(c), r"^\[|\]$", "")
    item = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,'"\s][^,'"]*"""
    found = F.regexp_extract_all(inner, F.lit(item), 0)
    return F.transform(found, lambda x: F.regexp_replace(F.trim(x), r"^(['\"])(.*)\1$", "$2"))


def flatten_list(c: Column) -> Column:
    """"['A', 'B']" becomes A\\B; other text passes."""
    return F.when(c.rlike(_LIST), F.array_join(_list_items(c), "\\")).otherwise(c)


def _in_long(number: Column) -> Column:
    """The whole part of a number; null beyond what a long holds."""
    return F.when(F.abs(number) < 9.2e18, number.cast("long"))


def first_integer(c: Column) -> Column:
    """The first whole number of a list's text, or a number's whole part; null if there is none."""
    items = F.filter(_list_items(c), lambda x: x.rlike(r"^[+-]?\d+$"))
    number = F.trim(c).try_cast("double")
    return F.when(c.rlike(_LIST), F.try_element_at(items, F.lit(1)).try_cast("long")).otherwise(F.when(~F.isnan(number), _in_long(number)))


def first_float(c: Column) -> Column:
    """The first number of a list's text, or the number; 0 for what lies closer to it than 1e-300, null beyond 1e300."""
    numbers = F.filter(F.transform(_list_items(c), lambda x: x.try_cast("double")), lambda x: x.isNotNull())
    found = F.when(c.rlike(_LIST), F.try_element_at(numbers, F.lit(1))).otherwise(F.trim(c).try_cast("double"))
    return F.when((F.abs(found) < 1e-300) & (found != 0), 0.0).when(F.abs(found) > 1e300, None).otherwise(found)
