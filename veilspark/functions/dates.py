"""Dates that move by one offset for each note and keep their format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import draw
from . import patterns as P
from .text import let, replaced, scan

ANCHOR_YEAR = 2020  # of dates that name no year
_MONTH, _MON = "(?:" + "|".join(P.MONTH_NAMES) + ")", "(?:" + "|".join(P.MONTH_SHORT) + ")"
# The formats that are kept, in the order in which they are tried (what the text looks like, the pattern
# that reads it, the one that writes it).
FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d", "yyyy-MM-dd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", "MM/dd/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy", "MM-dd-yyyy"),
    (rf"(?i)^{_MONTH} \d{{1,2}}, \d{{4}}$", "MMMM d, yyyy", "MMMM dd, yyyy"),
    (rf"(?i)^{_MON} \d{{1,2}}, \d{{4}}$", "MMM d, yyyy", "MMM dd, yyyy"),
    (rf"(?i)^\d{{1,2}} {_MONTH} \d{{4}}$", "d MMMM yyyy", "dd MMMM yyyy"),
    (rf"(?i)^\d{{1,2}} {_MON} \d{{4}}$", "d MMM yyyy", "dd MMM yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy", "dd/MM/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy", "dd-MM-yyyy"),
    (r"^\d{8}$", "yyyyMMdd", "yyyyMMdd"),
    (rf"(?i)^{_MONTH} \d{{4}}$", "MMMM yyyy", "MMMM yyyy"),
]
DATETIMES = [
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", "yyyy-M-d H:mm:ss", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$", "yyyy-M-d H:mm", "yyyy-MM-dd HH:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss", "MM/dd/yyyy HH:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm", "MM/dd/yyyy HH:mm"),
    (r"(?i)^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2} (AM|PM)$", "M/d/yyyy h:mm a", "MM/dd/yyyy hh:mm a"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}$", "yyyy-M-d'T'H:mm:ss", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}Z$", "yyyy-M-d'T'H:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
]
# Dates in words that are in none of the formats are read after a clean-up (no ordinal ends, points or commas, months by
# three letters) and written as FALLBACK.
LOOSE = ["MMM d yyyy", "d MMM yyyy", "MMM yyyy", "yyyy MMM d"]
FALLBACK = "MM/dd/yyyy"


def offset_days(doc: Column, seed: int = 0) -> Column:
    """The note's shift: -365 to -30 days."""
    return (-30 - draw.below(draw.key(seed, doc, "shift"), 336)).cast("int")


def _read(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("date")


def _four_digit(text: Column) -> Column:
    """m/d/yy with the century: 69 to 99 are 1900s."""
    yy = F.regexp_extract(text, r"(\d\d)$", 1)
    return F.concat(F.regexp_replace(text, r"\d\d$", ""), F.when(yy <= "68", "20").otherwise("19"), yy)


def _cleaned(text: Column) -> Column:
    out = F.regexp_replace(text, r"(?i)(?<=\d)(st|nd|rd|th)\b", "")
    out = F.regexp_replace(out, r"(?i)\b(" + "|".join(P.MONTH_SHORT) + r")[a-z]*", "$1")
    return F.trim(F.regexp_replace(out, r"[\s.,/-]+", " "))


def _loose(text: Column, days: Column) -> Column:
    """A date with a month in words, written as FALLBACK."""
    in_words = text.rlike(rf"(?i)^[\d\s.,/-]*(?:st|nd|rd|th)?[\s.,/-]*{P.MON}[\d\s.,/-]*(?:(?:st|nd|rd|th)[\d\s.,/-]*)?$")
    read = let(_cleaned(text), lambda t: F.coalesce(*[_read(t, f) for f in LOOSE]))
    return F.when(in_words, let(read, lambda d: F.when(F.year(d).between(1900, 2100), F.date_format(F.date_add(d, days), FALLBACK))))


def shift_whole(text: Column, days: Column) -> Column:
    """A date that is all of the text, moved and written in its format; null if it is none, if its year is not in
    1900 to 2100, or if digits would change the length by over 2."""
    tries = []
    moved = lambda d, write: F.date_format(F.date_add(d, days), write)
    kept_as = lambda write: lambda d: F.when(F.year(d).between(1900, 2100), moved(d, write))
    for shape, read, write in FORMATS:
        tries.append(F.when(text.rlike(shape), let(_read(text, read), kept_as(write))))
    for sep in "/-":
        shape = rf"^\d{{1,2}}{sep}\d{{1,2}}{sep}\d{{2}}$"
        tries.insert(3, F.when(text.rlike(shape), moved(_read(_four_digit(text), f"M{sep}d{sep}yyyy"), f"MM{sep}dd{sep}yy")))
    tries.append(F.when(text.rlike(r"^\d{1,2}/\d{1,2}$"), moved(_read(F.concat(text, F.lit(f"/{ANCHOR_YEAR}")), "M/d/yyyy"), "MM/dd")))
    tries.append(F.when(text.rlike(r"^(19\d\d|20\d\d|2100)$"), moved(_read(F.concat(text, F.lit("-07-01")), "yyyy-MM-dd"), "yyyy")))
    return let(F.coalesce(*tries, _loose(text, days)), lambda out: F.when(~text.rlike(r"^[\d/-]+$") | (F.abs(F.length(out) - F.length(text)) <= 2), out))


def shift_embedded(text: Column, days: Column) -> Column:
    """The text with each date in it moved; null if that changes nothing."""
    moved = replaced(text, P.EMBEDDED_DATE, lambda m: F.coalesce(shift_whole(m, days), m))
    return let(moved, lambda out: F.when(out != text, out))


def disguise(text: Column, days: Column) -> Column:
    """Digits turned by the offset (by 5 where that would leave them), letters as x, the rest as it is."""
    turn = F.pmod(days, F.lit(10))
    turned = F.substring(F.lit("01234567890123456789"), (F.when(turn == 0, 5).otherwise(turn) + 1).cast("int"), F.lit(10))
    return F.regexp_replace(F.call_function("translate", text, F.lit("0123456789"), turned), r"\p{L}", "x")


def shift_date(text: Column, days: Column) -> Column:
    return let(F.trim(text), lambda t: F.coalesce(shift_whole(t, days), shift_embedded(t, days), disguise(t, days)))


def shift_datetime(text: Column, days: Column) -> Column:
    """A date with a time keeps the time and the format; anything else is shifted as a date."""

    def of(t: Column) -> Column:
        tries = [F.when(t.rlike(shape), F.date_format(F.try_to_timestamp(t, F.lit(read)) + F.make_dt_interval(days), write)) for shape, read, write in DATETIMES]
        day = F.regexp_extract(t, r"^(\d{1,2}/\d{1,2}/\d{2}) (\d{1,2}:\d{2})$", 1)
        short = F.concat(_four_digit(day), F.lit(" "), F.regexp_extract(t, r"(\d{1,2}:\d{2})$", 1))
        tries.append(F.when(day != "", F.date_format(F.try_to_timestamp(short, F.lit("M/d/yyyy H:mm")) + F.make_dt_interval(days), "MM/dd/yy HH:mm")))
        return F.coalesce(*tries, shift_date(t, days))

    return let(F.trim(text), of)


def birth(text: Column, k: Column) -> Column:
    """A date of birth within two years of the one given, in its format and never equal to it; without one that can
    be read, that of an adult."""
    salted = lambda salt, n: draw.below(F.concat_ws("|", k, F.lit(salt)), n)

    def other(write: str) -> Callable[[Column], Column]:
        return lambda d: changed(d, write)

    def changed(d: Column, write: str) -> Column:
        one = F.make_date(F.year(d) + (salted("y0", 5) - 2).cast("int"), (salted("m0", 12) + 1).cast("int"), (salted("d0", 28) + 1).cast("int"))
        return F.when(d.isNotNull(), let(one, lambda x: F.date_format(F.when(x == d, F.date_add(d, 1)).otherwise(x), write)))

    def of(t: Column) -> Column:
        tries = [F.when(t.rlike(shape), let(_read(t, read), other(write))) for shape, read, write in FORMATS[:7]]
        some = F.make_date((salted("y", 72) + 1935).cast("int"), (salted("m", 12) + 1).cast("int"), (salted("d", 28) + 1).cast("int"))
        return F.coalesce(*tries, F.date_format(some, "MM/dd/yyyy"))

    return let(F.trim(text), of)


def cap_age(text: Column) -> Column:
    """The first number, if it is 89 or more, as 90+."""
    n = F.regexp_extract(text, r"\d+", 0)
    return F.when(n.rlike(r"^0*(89|9\d|[1-9]\d{2,})$"), F.concat(F.regexp_extract(text, r"^\D*", 0), F.lit("90+"), F.regexp_replace(text, r"^\D*\d+", ""))).otherwise(text)


def found_dates(text: Column) -> Column:
    return scan(text, P.DATE_TOKEN)
