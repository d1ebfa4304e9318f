"""Parsing of raw text cells into numbers, dates and null kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that stand for a missing value, and currency prefixes of numbers.
MISSING_TOKENS = ["unknown", "null", "none", "nan", "n/a"]
CURRENCY_PREFIXES = ["PKR", "USD", "EUR", "$", "€"]
NON_FINITE = ["inf", "+inf", "-inf", "infinity", "+infinity", "-infinity", "nan"]


def is_date(raw: Column) -> Column:
    """Whether the first ten characters are a date in one of five formats."""
    day = F.substring(raw, 1, 10)
    shapes = {r"^\d{4}-\d{2}-\d{2}$": "yyyy-MM-dd", r"^\d{4}/\d{2}/\d{2}$": "yyyy/MM/dd", r"^\d{2}-\d{2}-\d{4}$": "dd-MM-yyyy", r"^\d{2}/\d{2}/\d{4}$": "dd/MM/yyyy"}
    tries = [F.when(day.rlike(k), F.try_to_timestamp(day, F.lit(v))) for k, v in shapes.items()]
    tries.append(F.when(day.rlike(r"^\d{2}/\d{2}/\d{4}$"), F.try_to_timestamp(day, F.lit("MM/dd/yyyy"))))
    return F.coalesce(*tries).isNotNull()


def strict_date(raw: Column) -> Column:
    """Year-first dates, with - or /; anything else, or an impossible day, is null."""
    return F.when(raw.rlike(r"^\d{4}([-/])\d{2}\1\d{2}$"), F.to_date(F.try_to_timestamp(F.regexp_replace(raw, "/", "-"), F.lit("yyyy-MM-dd"))))


def parse_number(raw: Column) -> Column:
    """A double from text with at most one currency prefix, one trailing % (not divided) and well-grouped commas."""
    prefix = "|".join(["PKR", "USD", "EUR", r"\$", "€"])
    x = F.regexp_replace(F.regexp_replace(F.trim(raw), rf"^(?i:{prefix})\s*", ""), r"\s*%$", "")
    grouped = x.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d*)?$")
    plain = x.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    value = F.when(grouped, F.regexp_replace(x, ",", "").try_cast("double")).when(plain, x.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def unit_of(raw: Column) -> Column:
    """The currency prefix or percent sign of a cell, else 'plain'."""
    t = F.upper(F.trim(raw))
    return F.coalesce(F.when(t.endswith("%"), "%"), *[F.when(t.startswith(p), p) for p in CURRENCY_PREFIXES], F.lit("plain"))


def missing_reason(raw: Column) -> Column:
    """Why a cell counts as missing: null, blank, token or non_finite; null for a value."""
    t = F.trim(raw)
    low = F.lower(t)
    return F.when(raw.isNull(), "null").when(t == "", "blank").when(low.isin(MISSING_TOKENS), "token").when(low.isin(NON_FINITE), "non_finite")


# Literals of a source that say a value is not known.
UNKNOWN_LITERALS = ["unknown", "n/a", "na", "null"]


def null_kind(raw: Column) -> Column:
    """NULL, EMPTY, UNKNOWN_LITERAL or VALUE."""
    t = F.lower(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    return F.when(raw.isNull(), "NULL").when(t == "", "EMPTY").when(t.isin(UNKNOWN_LITERALS), "UNKNOWN_LITERAL").otherwise("VALUE")
