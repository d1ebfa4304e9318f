"""Normalisation of dates, amounts, currencies, references, names and descriptions."""

from __future__ import annotations

import operator
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyward.functions.dates import parse_date

# Accepted currency codes, and legal suffixes of company names.
CURRENCIES = (
    "AED AFN ALL AMD ANG AOA ARS AUD AWG AZN BAM BBD BDT BGN BHD BIF BMD BND BOB BRL BSD BTN BWP BYN BZD CAD CDF CHF CLP CNY COP CRC CUP CVE CZK DJF DKK DOP DZD EGP ERN ETB EUR FJD FKP GBP GEL GHS GIP GMD GNF GTQ GYD "
    "HKD HNL HTG HUF IDR ILS INR IQD IRR ISK JMD JOD JPY KES KGS KHR KMF KPW KRW KWD KYD KZT LAK LBP LKR LRD LSL LYD MAD MDL MGA MKD MMK MNT MOP MRU MUR MVR MWK MXN MYR MZN NAD NGN NIO NOK NPR NZD OMR PAB PEN PGK "
    "PHP PKR PLN PYG QAR RON RSD RUB RWF SAR SBD SCR SDG SEK SGD SHP SLE SLL SOS SRD SSP STN SYP SZL THB TJS TMT TND TOP TRY TTD TWD TZS UAH UGX USD UYU UZS VES VND VUV WST XAF XAG XAU XCD XDR XOF XPF YER ZAR ZMW ZWL"
).split()
LEGAL_SUFFIXES = ["LTD", "LIMITED", "LLC", "LLP", "PVT", "PRIVATE", "INC", "INCORPORATED", "CORP", "CORPORATION", "PLC", "GMBH", "SA", "NV", "BV", "CO"]


def _strip(raw: Column) -> Column:
    return F.regexp_replace(raw, r"^\s+|\s+$", "")


def normalize_date(raw: Column, dayfirst: bool = False) -> Column:
    """A free-form date, month first where a text leaves it open unless dayfirst; see dates.parse_date."""
    return parse_date(raw, dayfirst)


def normalize_amount(raw: Column, direction: Column | None = None) -> Column:
    """struct(amount decimal(28,8) without sign, direction): both null for a text that is no amount.

    Parentheses and a minus, before or after, mean DR; all but digits and marks is dropped. The last of , and . is the
    decimal mark where both occur; commas alone group thousands unless one or two digits follow the last. A given direction wins.
    """
    t = _strip(raw)
    parens = t.startswith("(") & t.endswith(")") & (F.length(t) > 1)
    t = F.when(parens, _strip(F.regexp_replace(t, r"^\(|\)$", ""))).otherwise(t)
    sign = F.regexp_extract(t, r"^.+([+-])$", 1)
    digits = F.regexp_replace(F.when(sign != "", F.regexp_replace(t, r"[+-]$", "")).otherwise(t), r"[^\d,.\-]", "")
    comma, dot = digits.contains(","), digits.contains(".")
    comma_last = digits.rlike(r",[^.]*$")
    european = F.regexp_replace(F.regexp_replace(digits, r"\.", ""), ",", ".")
    cents = F.concat(F.regexp_replace(F.regexp_replace(digits, r",[^,]*$", ""), ",", ""), F.lit("."), F.regexp_extract(digits, r",([^,]*)$", 1))
    plain = F.regexp_replace(digits, ",", "")
    clean = F.when(comma & dot, F.when(comma_last, european).otherwise(plain)).when(comma & digits.rlike(r",[^,]{1,2}$"), cents).otherwise(plain)
    value = F.when(clean.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), clean.try_cast("decimal(28,8)"))
    value = F.when(parens | (sign == "-"), -F.abs(value)).otherwise(value)
    way = F.when(value < 0, "DR").when(value.isNotNull(), "CR")
    return F.struct(F.abs(value).alias("amount"), (way if direction is None else F.when(value.isNotNull(), F.coalesce(direction, way))).alias("direction"))


def normalize_currency(raw: Column) -> Column:
    code = F.upper(_strip(raw))
    return F.when(code.isin(CURRENCIES), code)


def normalize_reference(raw: Column) -> Column:
    return F.upper(F.regexp_replace(raw, r"[^A-Za-z0-9]", ""))


def normalize_counterparty(raw: Column, suffixes: list[str] | tuple[str, ...] = tuple(LEGAL_SUFFIXES)) -> Column:
    """White space collapsed, trailing legal suffixes out as often as they occur (any case, with . or , after them), and . , and spaces off both ends."""
    t = F.regexp_replace(_strip(raw), r"\s+", " ")
    words = "|".join(re.escape(x.rstrip(".")) for x in suffixes)
    return F.regexp_replace(F.regexp_replace(t, rf"(?i)((^| )({words})[.,]*)+$", ""), r"^[ .,]+|[ .,]+$", "")


@F.pandas_udf(StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def normalize_description(raw: Column, compatibility: bool = True) -> Column:
    """NFKC (no built-in has it), control characters out, white space collapsed."""
    t = _nfkc(raw) if compatibility else raw
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"(?U)\s+", " "))


def row_fingerprint(*columns: Column) -> Column:
    """SHA-256 over the fields joined by 0x1F; nulls count as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns]), 256)


def next_period(period: Column) -> Column:
    return F.date_format(F.add_months(F.to_date(F.concat(period, F.lit("-01"))), 1), "yyyy-MM")


# Words that leave a text to a person, and phrases of hardship by category, first match first.
REVIEW = r"\b(no|not|never|without|resolved|used to)\b"
HARDSHIP = (
    ("temporary_income_disruption", r"(?:my )?(?:salary|income|wages?) (?:has been |is |was )?(?:delayed|stopped|reduced)"),
    ("payment_difficulty", r"(?:cannot|can.t|unable to) (?:manage|afford|pay)"),
)


def hardship(text: Column, declared: Column | None = None) -> Column:
    """struct(status, category, source, evidence): DECLARED, INFERRED_SIGNAL with the words found, or UNKNOWN; a declared category wins, then words that need review."""
    low = F.lower(F.coalesce(text, F.lit("")))
    none = F.lit(None).cast("string")
    made = lambda status, category, source, evidence: F.struct(F.lit(status).alias("status"), category.alias("category"), F.lit(source).alias("source"), evidence.alias("evidence"))
    found = F.when(low.rlike(REVIEW), made("UNKNOWN", none, "text_requires_review", none))
    for name, pattern in HARDSHIP:
        found = found.when(low.rlike(pattern), made("INFERRED_SIGNAL", F.lit(name), "member_text", F.regexp_extract(low, pattern, 0)))
    found = found.otherwise(made("UNKNOWN", none, "unknown", none))
    return found if declared is None else F.when(F.coalesce(declared, F.lit("")) != "", made("DECLARED", declared, "member_declared_form", none)).otherwise(found)


def hardship_class(text: Column, declared: Column | None = None) -> Column:
    """The status of hardship()."""
    return hardship(text, declared)["status"]


def ungrounded_numbers(narrative: Column, evidence: Column, tolerance: float = 0.01) -> Column:
    """Numbers of a narrative, as written, that no evidence number (rounded to cents) is within tolerance of, absolute or relative; integers up to 20 are prose."""
    number = lambda x: F.regexp_replace(x, "[,%]", "").cast("double")
    near = lambda x, e: F.abs(x - F.round(e, 2)) <= F.greatest(F.lit(tolerance), F.abs(F.round(e, 2)) * tolerance)
    found = F.regexp_extract_all(narrative, F.lit(r"(-?\d[\d,]*\.?\d*%?)"), F.lit(1))
    prose = lambda x: (number(x) == F.floor(number(x))) & (F.abs(number(x)) <= 20)
    return F.filter(found, lambda x: ~prose(x) & ~F.exists(evidence, lambda e: near(number(x), e)))


# The shapes of a version and of a clause of a version constraint.
_VERSION = r"^\s*(\d+)\.(\d+)\.(\d+)"
_CLAUSE = r"(>=|<=|>|<|==)\s*(\d+\.\d+\.\d+)"
_TESTS = {">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt, "==": operator.eq}


def satisfies(version: str, constraint: str) -> bool:
    """Whether a semantic version meets every clause of a constraint such as '>=1.0.0 <2.0.0'; ValueError if either cannot be read."""
    own, clauses = re.match(_VERSION, version), re.findall(_CLAUSE, constraint)
    if not own or not clauses:
        raise ValueError(f"cannot read {version!r} or {constraint!r}")
    return all(_TESTS[op](tuple(map(int, own.groups())), tuple(map(int, bound.split(".")))) for op, bound in clauses)


def _version(text: Column) -> Column:
    return F.when(text.rlike(_VERSION), F.array(*[F.regexp_extract(text, _VERSION, i).cast("int") for i in (1, 2, 3)]))


def satisfies_column(version: Column, constraint: Column | str) -> Column:
    """satisfies() of columns of versions and constraints; null where either cannot be read."""
    clauses = F.regexp_extract_all(F.lit(constraint) if isinstance(constraint, str) else constraint, F.lit(rf"({_CLAUSE})"), F.lit(1))
    own = _version(version)

    def met(c: Column) -> Column:
        op, bound = F.regexp_extract(c, r"^(\D+?)\s*\d", 1), _version(F.regexp_extract(c, r"(\d+\.\d+\.\d+)", 1))
        out = F.lit(False)
        for name, test in _TESTS.items():
            out = F.when(op == name, test(own, bound)).otherwise(out)
        return out

    return F.when(own.isNotNull() & (F.size(clauses) > 0), F.forall(clauses, met))


def meets_column(version: str, constraint: Column) -> Column:
    """satisfies() of a version under a column of constraints; null where a constraint cannot be read."""
    return satisfies_column(F.lit(version), constraint)
