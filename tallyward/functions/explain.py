"""Texts about one finding: its explanation, and the reply to a question by the words it holds.

A finding is a struct column (row, model, method, layer, score, severity, confidence, threshold, message,
drivers array<struct<feature, reason>>, recommended_action). A null or zero row is the column as a whole.
Null fields read as empty; a finding without drivers gives its message instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that mark each intent, in the order in which intents are tried, and the sentences.
WHY = ("why", "kyun", "kyo", "reason", "waja")
MEASURE = ("threshold", "score", "confidence", "risk")
ACTION = ("fix", "action", "karna", "next", "review")
EXPLANATION = "Row %s was flagged by %s in %s. The score is %s (%s) because %s. Threshold used: %s. Recommended next step: %s"
REPLY_WHY = "This anomaly was flagged because %s. The detector was %s using %s."
REPLY_MEASURE = "The score is %s on a capped 0-100 risk index, with confidence %s. The threshold was: %s."
REPLY_OTHER = "For row %s, the main finding is: %s Main drivers: %s."
NO_ROW, NO_ACTION, NO_ACTION_REPLY, NO_DRIVERS = "column-level", "Review the source record.", "Review the row values and verify the source record.", "model threshold evidence"
MOST_DRIVERS = 4


def _text(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit(""))


def _row(finding: Column) -> Column:
    row = finding["row"].cast("string")
    return F.when(row.isNull() | row.isin("", "0"), NO_ROW).otherwise(row)


def _drivers(finding: Column, between: str, opening: str, closing: str, missing: Column) -> Column:
    named = F.transform(F.slice(finding["drivers"], 1, MOST_DRIVERS), lambda d: F.concat(_text(d["feature"]), F.lit(opening), _text(d["reason"]), F.lit(closing)))
    return F.when(F.size(named) > 0, F.array_join(named, between)).otherwise(missing)


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))  # parts of words count


def explanation(finding: Column) -> Column:
    why = _drivers(finding, "; ", ": ", "", _text(finding["message"]))
    fields = [_text(finding[x]) for x in ("model", "layer", "score", "severity")]
    return F.format_string(EXPLANATION, _row(finding), *fields, why, _text(finding["threshold"]), F.coalesce(finding["recommended_action"], F.lit(NO_ACTION)))


def intent(message: Column) -> Column:
    """WHY, MEASURE, ACTION or OTHER: the first intent that has a word in the message. A null message is OTHER."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.when(_any(low, WHY), "WHY").when(_any(low, MEASURE), "MEASURE").when(_any(low, ACTION), "ACTION").otherwise("OTHER")


def reply(message: Column, finding: Column) -> Column:
    """The reply to a question about a finding."""
    asked, said = intent(message), _text(finding["message"])
    drivers = lambda missing: _drivers(finding, ", ", " (", ")", missing)
    why = F.format_string(REPLY_WHY, drivers(said), _text(finding["model"]), _text(finding["method"]))
    measure = F.format_string(REPLY_MEASURE, *[_text(finding[x]) for x in ("score", "confidence", "threshold")])
    other = F.format_string(REPLY_OTHER, _row(finding), said, drivers(F.lit(NO_DRIVERS)))
    return F.when(asked == "WHY", why).when(asked == "MEASURE", measure).when(asked == "ACTION", F.coalesce(finding["recommended_action"], F.lit(NO_ACTION_REPLY))).otherwise(other)
