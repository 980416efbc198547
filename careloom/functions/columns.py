"""Column expressions for typing, predicates and code clean-up. All stay inside codegen."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from careloom.constants import AGE_BANDS, FIRST_YEAR, LAST_YEAR, OTHER_BAND


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- typing -------------------------------------------------------------------------------


def age_band(age: str | Column) -> Column:
    """Inclusive band label of an age; anything that is no age in range is 'Other'.

    The age is the place in a fixed table, so it is worked out once and not twice per band.
    """
    labels = [OTHER_BAND] * (max(hi for _, hi in AGE_BANDS) + 1)
    for lo, hi in reversed(AGE_BANDS):
        labels[lo: hi + 1] = [f"{lo}-{hi}"] * (hi + 1 - lo)
    return F.coalesce(F.get(F.array(*[F.lit(x) for x in labels]), col(age).try_cast("int")), F.lit(OTHER_BAND))


def parse_yyyymmdd(text: str | Column) -> Column:
    """Date of an eight-digit text, null when it is no calendar date.

    Dashes are put in and the text is cast: far cheaper than a format parser, which matters as
    every raw claim passes here.
    """
    c = col(text).cast("string")
    dashed = F.concat_ws("-", F.substring(c, 1, 4), F.substring(c, 5, 2), F.substring(c, 7, 2))
    return F.when(c.rlike("^[0-9]{8}$"), dashed.try_cast("date"))


def event_year(text: str | Column) -> Column:
    return F.year(parse_yyyymmdd(text))


def clean_int(text: str | Column) -> Column:
    """Integer of a text; blank, 'NULL' and non-numbers become null."""
    c = F.trim(col(text).cast("string"))
    return F.when((c != "") & (F.upper(c) != "NULL"), c.try_cast("int"))


def blank_to_null(text: str | Column) -> Column:
    c = F.trim(col(text))
    return F.when(c != "", c)


def time_parts(ts: str | Column) -> dict[str, Column]:
    c = col(ts)
    return {
        "year": F.year(c),
        "month": F.month(c),
        "quarter": F.quarter(c),
        "week": F.weekofyear(c),
        "day": F.dayofmonth(c),
    }


def season(ts: str | Column) -> Column:
    month = F.month(col(ts))
    return (
        F.when(month.isin(12, 1, 2), "winter")
        .when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isNotNull(), "autumn")
    )


# --- predicates ---------------------------------------------------------------------------


def is_valid_claim(
    key: str | Column, date_text: str | Column, first: int = FIRST_YEAR, last: int = LAST_YEAR
) -> Column:
    """Key present and the eight-digit date falls in the years in scope. Never null.

    Every raw claim passes here, so no format parser is used, and the text is mentioned seldom, as a filter
    works an expression out at each mention. Eight characters that make a number above 10,000,000 are
    eight digits; the first year must be 1000 or later. With dashes put in, the cast knows the calendar.
    """
    text = col(date_text).cast("string")
    number = text.try_cast("int")
    dashed = F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))
    in_scope = (
        (F.length(text) == 8)
        & (number >= max(first, 1000) * 10_000)
        & (number < (last + 1) * 10_000)
        & dashed.try_cast("date").isNotNull()
    )
    return col(key).isNotNull() & F.coalesce(in_scope, F.lit(False))


def is_plausible_date(date: str | Column, lo: int = 1900, hi: int = 2100) -> Column:
    """Year strictly between the bounds."""
    year = F.year(col(date))
    return F.coalesce((year > lo) & (year < hi), F.lit(False))


def in_age_and_year(
    age: str | Column, date: str | Column, year: int, lo: int = 1, hi: int = 114
) -> Column:
    """Age in range and date in the calendar year.

    The upper bound is the midnight that starts 31 December, so later times of that day fall
    out, exactly as in a comparison with a date literal.
    """
    ts = col(date).cast("timestamp_ntz")
    window = ts.between(
        F.lit(f"{year}-01-01").cast("timestamp_ntz"), F.lit(f"{year}-12-31").cast("timestamp_ntz")
    )
    return F.coalesce(col(age).between(lo, hi) & window, F.lit(False))


def any_code_in(codes: Iterable[str], slots: Iterable[str | Column]) -> Column:
    """True when any slot holds one of the codes; null slots count as no match."""
    wanted = list(codes)
    hit = F.lit(False)
    for slot in slots:
        hit = hit | F.coalesce(col(slot).isin(wanted), F.lit(False))
    return hit


def code_prefix(prefixes: Iterable[str], code: str | Column) -> Column:
    """Code starts with a prefix once dots and blanks are gone.

    A prefix that already holds ``%`` or ``_`` is used as the LIKE pattern itself.
    """
    flat = F.translate(F.upper(col(code)), ". ", "")
    hit = F.lit(False)
    for prefix in prefixes:
        p = re.sub(r"[. ]", "", prefix.upper())
        hit = hit | F.coalesce(flat.like(p if re.search("[%_]", p) else p + "%"), F.lit(False))
    return hit


def is_excluded_code(code: str | Column, excluded: Iterable[str]) -> Column:
    """Excluded code, or a text that contains one in any letter case."""
    low = F.lower(col(code))
    hit = F.lit(False)
    for word in sorted({w.lower() for w in excluded}):
        hit = hit | low.contains(word)
    return F.coalesce(hit, F.lit(False))


# --- codes --------------------------------------------------------------------------------

# Fixed value: shape of a diagnosis code inside a longer text.
ICD_SHAPE = r"([A-Z][0-9]{2}(\.?[A-Z0-9]{1,4})?)"


def normalize_icd(code: str | Column, keep_unmatched: bool = False) -> Column:
    """Undotted diagnosis code found in the text.

    Blank gives null. A text without a code gives '' (or, with ``keep_unmatched``, null so that
    a caller can fall back to the raw text).
    """
    up = F.upper(blank_to_null(code))
    token = F.replace(F.regexp_extract(up, ICD_SHAPE, 1), F.lit("."), F.lit(""))
    return F.nullif(token, F.lit("")) if keep_unmatched else token


def normalize_cpt(code: str | Column) -> Column:
    return F.translate(F.upper(col(code)), ". ", "")


def flatten_code(code: str | Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(col(code)), "[^A-Z0-9]", "")


def matches_variant(code: str | Column, wanted: str, mode: str = "contains") -> Column:
    """Compare flattened codes by ``contains``, ``startswith`` or ``equals``."""
    flat, target = flatten_code(code), re.sub("[^A-Z0-9]", "", wanted.upper())
    if mode == "contains":
        return flat.contains(target)
    if mode == "startswith":
        return flat.startswith(target)
    if mode == "equals":
        return flat == target
    raise ValueError(f"unknown mode {mode!r}")


def pipe_join(values: str | Column) -> Column:
    return F.array_join(F.sort_array(col(values)), "|")
