"""Validation of imported records: each row by the first rule it breaks, each batch held as a whole if any row or total is wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.normalize import normalize_currency, normalize_reference

#: Logical fields that a mapping must name.
REQUIRED = ("amount", "currency", "direction", "value_date", "reference")


def apply_mapping(raw: DataFrame, mapping: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of raw under their logical names; ValueError for a mapping without a required field, or columns that do not exist."""
    if lacking := [x for x in REQUIRED if x not in mapping]:
        raise ValueError(f"the mapping must include {', '.join(lacking)}")
    if missing := [c for c in mapping.values() if c not in raw.columns]:
        raise ValueError(f"missing mapped columns: {', '.join(missing)}")
    return raw.select(*keep, *[F.col(f"`{c}`").cast("string").alias(x) for x, c in mapping.items()])


def row_problem(period: Column) -> Column:
    """The first rule that a row of mapped texts breaks, or null.

    AMOUNT_FORMAT (digits with at most 8 after a point), AMOUNT_RANGE (1e20 and more), DIRECTION (DR or CR), VALUE_DATE (yyyy-MM-dd or
    yyyyMMdd), OUTSIDE_PERIOD, CURRENCY, REFERENCE (no letter or digit). A null text is an empty one.
    """
    text = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")
    amount, whole = text("amount"), F.regexp_replace(F.regexp_extract(text("amount"), r"^(\d*)", 1), "^0+", "")
    checks = [
        (~amount.rlike(r"^[0-9]+(\.[0-9]{1,8})?$"), "AMOUNT_FORMAT"), (F.length(whole) > 20, "AMOUNT_RANGE"), (~F.upper(text("direction")).isin("DR", "CR"), "DIRECTION"), (value_date().isNull(), "VALUE_DATE"),
        (F.date_format(value_date(), "yyyy-MM") != period, "OUTSIDE_PERIOD"), (normalize_currency(text("currency")).isNull(), "CURRENCY"), (normalize_reference(text("reference")) == "", "REFERENCE"),
    ]
    out = F.lit(None).cast("string")
    for broken, name in reversed(checks):
        out = F.when(broken, name).otherwise(out)
    return out


def value_date() -> Column:
    day = F.regexp_replace(F.coalesce(F.col("value_date"), F.lit("")), r"^\s+|\s+$|-(?=\d\d(-|$))", "")
    shaped = F.trim(F.coalesce(F.col("value_date"), F.lit(""))).rlike(r"^\s*\d{4}(-\d{2}-\d{2}|\d{4})\s*$")
    return F.when(shaped, F.to_date(F.try_to_timestamp(day, F.lit("yyyyMMdd"))))


def validated(rows: DataFrame, period: str) -> DataFrame:
    """rows of mapped texts with problem, and typed amount, direction, value_date, currency and reference_canonical where there is none."""
    good = F.col("problem").isNull()
    own = rows.withColumn("problem", row_problem(F.col(period)))
    typed = {
        "typed_amount": F.trim("amount").try_cast("decimal(28,8)"), "typed_direction": F.upper(F.trim("direction")), "typed_date": value_date(), "typed_currency": normalize_currency(F.col("currency")), "reference_canonical": normalize_reference(F.col("reference")),
    }
    return own.withColumns({k: F.when(good, v) for k, v in typed.items()})


def batch_reports(rows: DataFrame, batch: str, expected: DataFrame | None = None) -> DataFrame:
    """(batch, n_rows, n_errors, row_count_error, status): ACCEPTED, or HELD if a row is wrong, or their number is not the expected one (batch, expected); rows are validated()."""
    report = rows.groupBy(batch).agg(F.count("*").alias("n_rows"), F.count("problem").alias("n_errors"))
    report = report.join(expected, batch, "full").withColumns({"n_rows": F.coalesce("n_rows", F.lit(0)), "n_errors": F.coalesce("n_errors", F.lit(0))}) if expected is not None else report.withColumn("expected", F.lit(None).cast("long"))
    # only rows without an error count towards the total
    wrong = F.coalesce(F.col("n_rows") - F.col("n_errors") != F.col("expected"), F.lit(False))
    held = (F.col("n_errors") > 0) | wrong | (F.col("n_rows") == 0)
    return report.select(batch, "n_rows", "n_errors", wrong.alias("row_count_error"), F.when(held, "HELD").otherwise("ACCEPTED").alias("status"))


def accepted(rows: DataFrame, reports: DataFrame, batch: str) -> DataFrame:
    """Rows of accepted batches; a held batch gives none."""
    return rows.join(reports.where("status = 'ACCEPTED'").select(batch), batch, "left_semi")
