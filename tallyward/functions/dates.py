"""Free-form dates as native expressions.

A text may hold a weekday, a time with a zone, ordinals, a month by name, and up to three numbers with any
separators, or one run of digits. The numbers are given their roles by size and place:

* with a month by name: a number of more than two digits or above 31 is the year, else the day comes first
  after or before the name and the year last; a name in the third place follows year and day
* without: a first number that is a year leads year, month, day (year, day, month with dayfirst, where that
  can be); a first number above 12 leads day, month, year; else month, day, year, or day, month with dayfirst

Years of two digits lie within fifty years of today. Parts that are absent come from a default date, a
day of it beyond the month's end is the last. A time's zone does not move the date. Empty texts, texts with other words,
more than three numbers and impossible dates are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NAMES = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_MONTH = rf"(?<![a-z])(?:{_NAMES})(?![a-z])"
_ZONE = r"\s*(?:(?:z|utc|gmt)?\s*[+-]\d{2}:?\d{2}|z|utc|gmt)?"
_CLOCK = rf"\d{{1,2}}:\d{{2}}(?::\d{{2}}(?:[.,]\d+)?)?(?:\s*[ap]\.?m\.?)?{_ZONE}(?![\d:])|\d{{1,2}}\s*[ap]\.?m\b\.?{_ZONE}"
_TIME = rf"(?:(?<=\d)t|(?<![\d:]))(?:{_CLOCK})|(?<=\d)t\d{{4}}(?:\d{{2}})?(?!\d){_ZONE}"
_FILL = r"(?<![a-z])(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?(?![a-z])|(?<=\d)(?:st|nd|rd|th)(?![a-z])|(?<![a-z])(?:at|on|and|ad|of|t|m)(?![a-z])"


def _members(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_date(raw: Column, dayfirst: bool = False, *, default: Column | None = None, today: Column | None = None) -> Column:
    """The date of a free-form text, or null."""
    today = F.current_date() if today is None else today
    default = today if default is None else default
    lower = F.lower(F.regexp_replace(raw, r"^\s+|\s+$", ""))
    clean = F.struct(lower.rlike(_CLOCK).alias("clock"), F.regexp_replace(F.regexp_replace(lower, _TIME, " "), _FILL, " ").alias("text"))
    return _let(clean, lambda t: _let(_tokens(t), lambda p: _let(_roles(p, dayfirst), lambda f: _made(f, default, today))))


def _tokens(t: Column) -> Column:
    """struct(n strings of digits, place of the month's name among them, month or 0, odd: other words, clock)."""
    text = t["text"]
    name = F.substring(F.regexp_extract(text, rf"({_MONTH})", 1), 1, 3)
    month = F.array_position(F.array(*[F.lit(m) for m in "jan feb mar apr may jun jul aug sep oct nov dec".split()]), name).cast("int")

    def split(parts: Column) -> Column:
        before = _members(parts[0])
        n = F.concat(before, F.coalesce(_members(F.get(parts, F.lit(1))), F.array().cast("array<string>")))
        odd = F.regexp_replace(text, _MONTH, " ").rlike(r"[^\d\s.,;/'\-]") | F.coalesce(F.get(parts, F.lit(1)).rlike(_MONTH), F.lit(False))
        return F.struct(n.alias("n"), F.size(before).alias("place"), F.coalesce(month, F.lit(0)).alias("month"), odd.alias("odd"), t["clock"].alias("clock"))

    def cut(p: Column) -> Column:
        # one run of digits is a whole date
        one = F.get(p["n"], F.lit(0))
        pieces = lambda *ends: F.array(*[F.substring(one, a, b) for a, b in ends])
        alone = (p["month"] == 0) & (F.size(p["n"]) == 1)
        n = F.when(alone & F.length(one).isin(8, 12, 14), pieces((1, 4), (5, 2), (7, 2))).when(alone & (F.length(one) == 6), pieces((1, 2), (3, 2), (5, 2))).otherwise(p["n"])
        values = F.transform(n, lambda x: F.struct(x.try_cast("int").alias("v"), (F.length(x) > 2).alias("long")))
        return F.struct(values.alias("n"), p["place"].alias("place"), p["month"].alias("month"), p["odd"].alias("odd"), p["clock"].alias("clock"))

    return _let(_let(F.split(text, _MONTH, 2), split), cut)


def _roles(p: Column, dayfirst: bool) -> Column:
    """struct(y, m, d, century): the numbers' roles; a part that is null comes from the default, and a null struct is no date."""
    at = [F.get(p["n"], F.lit(i)) for i in range(3)]
    v, long = [x["v"] for x in at], [F.coalesce(x["long"], F.lit(False)) for x in at]
    size, place, month, swap = F.size(p["n"]), p["place"], p["month"], F.lit(dayfirst)
    year_like = (v[0] > 31) | long[0]
    none = F.lit(None).cast("int")
    role = lambda y, m, d: F.struct(y.alias("y"), m.alias("m"), d.alias("d"), (long[0] | long[1] | long[2]).alias("century"))
    by_name = (
        F.when(size == 0, role(none, month, none))
        .when((size == 1) & (v[0] > 31), role(v[0], month, none)).when(size == 1, role(none, month, v[0]))
        .when(size > 2, None)
        .when(long[0] & ~long[1], role(v[0], month, v[1])).when(long[1] & ~long[0], role(v[1], month, v[0]))
        .when(place < 2, F.when(v[0] > 31, role(v[0], month, v[1])).otherwise(role(v[1], month, v[0])))
        .otherwise(F.when(v[1] > 31, role(v[1], month, v[0])).otherwise(role(v[0], month, v[1])))
    )
    by_number = (
        F.when(size == 1, F.when(v[0] > 31, role(v[0], none, none)).otherwise(role(none, none, v[0])))
        .when(size == 2, F.when(v[0] > 31, role(v[0], v[1], none)).when(v[1] > 31, role(v[1], v[0], none)).when(swap & (v[1] <= 12), role(none, v[1], v[0])).otherwise(role(none, v[0], v[1])))
        .when(size > 3, None)
        .when(year_like, F.when(swap & (v[2] <= 12), role(v[0], v[2], v[1])).otherwise(role(v[0], v[1], v[2])))
        .when((v[0] > 12) | (swap & (v[1] <= 12)), role(v[2], v[1], v[0]))
        .otherwise(role(v[2], v[0], v[1]))
    )
    # a text that was only a time is the default date
    return F.when(p["odd"], None).when(month > 0, by_name).when(size > 0, by_number).when(p["clock"], role(none, none, none))


def _made(f: Column, default: Column, today: Column) -> Column:
    now = F.year(today)
    near = f["y"] + F.floor(now / 100).cast("int") * 100
    near = F.when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
    whole = F.struct(F.coalesce(F.when((f["y"] < 100) & ~f["century"], near).otherwise(f["y"]), F.year(default)).alias("y"), F.coalesce(f["m"], F.month(default)).alias("m"), f["d"].alias("d"))

    def day(w: Column) -> Column:
        start = F.when(w["y"].between(1, 9999) & w["m"].between(1, 12), F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-01", w["y"], w["m"]), F.lit("yyyy-MM-dd"))))
        return _let(start, lambda s: _let(F.coalesce(w["d"], F.least(F.dayofmonth(default), F.dayofmonth(F.last_day(s)))), lambda d: F.when((d >= 1) & (d <= F.dayofmonth(F.last_day(s))), F.date_add(s, d - 1))))

    return F.when(f.isNotNull(), _let(whole, day))
