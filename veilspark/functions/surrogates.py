"""Realistic replacements, each a function of (seed, note, type, value): the same value in a note gets the same one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates, draw
from . import vocab as V

Generator = Callable[[Column, Column, Column], Column]  # text, key, doc


def _digits_in(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^0-9]", ""))


def ssn(text: Column, k: Column, doc: Column) -> Column:
    part = lambda i, low, high: draw.between(F.concat_ws("|", k, F.lit(str(i))), low, high).cast("string")
    a, b, c = part(1, 100, 999), part(2, 10, 99), part(3, 1000, 9999)
    return F.when(text.rlike(r"^\d{9}$"), F.concat(a, b, c)).otherwise(F.concat_ws("-", a, b, c))


def mrn(text: Column, k: Column, doc: Column) -> Column:
    """The leading letters (MRN if none), a hyphen if there was one, as many digits (8 if none)."""
    prefix = F.regexp_extract(text, r"^([A-Za-z]+)[-_]?", 1)
    n = _digits_in(text)
    return F.concat(F.when(prefix == "", "MRN").otherwise(prefix), F.when(text.contains("-"), "-").otherwise(""), draw.chars(k, F.when(n == 0, 8).otherwise(n)))


def identifier(text: Column, k: Column, doc: Column) -> Column:
    """At least 4 digits and capitals, one for each letter or digit."""
    return draw.chars(k, F.greatest(F.lit(4), F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))), draw.BASE36)


def license_number(text: Column, k: Column, doc: Column) -> Column:
    letters, digits = F.length(F.regexp_replace(text, r"[^\p{L}]", "")), _digits_in(text)
    upper = lambda n: draw.chars(F.concat_ws("|", k, F.lit("L")), n, draw.BASE36[10:])
    return F.when((letters > 0) & (digits > 0), F.concat(upper(letters), draw.chars(k, digits))).when(digits > 0, draw.chars(k, F.greatest(F.lit(6), digits))).otherwise(F.concat(upper(F.lit(2)), draw.chars(k, F.lit(6))))


def npi(text: Column, k: Column, doc: Column) -> Column:
    return F.concat(F.regexp_extract(text, r"^([A-Za-z]+)[-_:\s]*", 1), draw.chars(k, F.lit(10)))


def phone(text: Column, k: Column, doc: Column) -> Column:
    """In the format of the original: (ddd) ddd-dddd, ddd-ddd-dddd or points, with +1 otherwise."""
    part = lambda i, low, high: draw.between(F.concat_ws("|", k, F.lit(str(i))), low, high).cast("string")
    a, e, s = part(1, 200, 999), part(2, 200, 999), part(3, 1000, 9999)
    sep = F.when(text.contains("."), ".").otherwise("-")
    paren = F.concat(F.lit("("), a, F.lit(")"), F.when(text.rlike(r"\)\s"), " ").otherwise(""), e, sep, s)
    return F.when(text.rlike(r"^\(\d{3}\)\s*\d{3}[-.]?\d{4}"), paren).when(text.rlike(r"^\d{3}[-.]?\d{3}[-.]?\d{4}"), F.concat(a, sep, e, sep, s)).otherwise(F.concat(F.lit("+1 ("), a, F.lit(") "), e, F.lit("-"), s))


def email(text: Column, k: Column, doc: Column) -> Column:
    return F.concat(F.lower(draw.pick(F.concat_ws("|", k, F.lit("a")), V.FIRST_POOL)), F.lit("."), F.lower(draw.pick(F.concat_ws("|", k, F.lit("b")), V.LAST_POOL)), draw.below(F.concat_ws("|", k, F.lit("c")), 1000).cast("string"), F.lit("@example.org"))


def street(text: Column, k: Column, doc: Column) -> Column:
    return F.concat(draw.between(F.concat_ws("|", k, F.lit("n")), 100, 9999).cast("string"), F.lit(" "), draw.pick(F.concat_ws("|", k, F.lit("s")), V.STREETS))


def place(doc_key: Column, part: int) -> Column:
    """City (0), state (1) or three-digit ZIP (2) of the note's one place."""
    return draw.pick(doc_key, [p[part] for p in V.PLACES])


def zip_code(text: Column, k: Column, doc: Column) -> Column:
    """In the note's place, in the format of the original: 5 digits with 4 more, 5, or 3."""
    area = place(doc, 2)
    rest, four = draw.chars(F.concat_ws("|", k, F.lit("z")), F.lit(2)), draw.chars(F.concat_ws("|", k, F.lit("p")), F.lit(4))
    return F.when(text.rlike(r"\d-?\d{4}$") & (_digits_in(text) >= 8), F.concat(area, rest, F.lit("-"), four)).when(text.rlike(r"^\d{3}$"), area).otherwise(F.concat(area, rest))


def county(text: Column, k: Column, doc: Column) -> Column:
    return F.concat(draw.pick(k, V.CITIES), F.lit(" County"))


GENERATORS: dict[str, Generator] = {
    "SSN": ssn,
    "MEDICAL_RECORD_NUMBER": mrn,
    "CERTIFICATE_LICENSE_NUMBER": license_number,
    "NPI": npi,
    "PHONE_NUMBER": phone,
    "FAX_NUMBER": phone,
    "EMAIL": email,
    "STREET_ADDRESS": street,
    "CITY": lambda t, k, d: place(d, 0),
    "STATE": lambda t, k, d: place(d, 1),
    "COUNTY": county,
    "POSTCODE": zip_code,
    "AGE": lambda t, k, d: dates.cap_age(t),
    "TIME": lambda t, k, d: t,
    "COUNTRY": lambda t, k, d: t,
}


def register(type_: str, generator: Generator) -> None:
    """A site's own generator for a type: a function of the span's text, the draw's key and the note's key."""
    GENERATORS[type_] = generator


def key_of(seed: int, doc: Column, type_: Column, text: Column) -> Column:
    return draw.key(seed, doc, type_, F.lower(F.trim(text)))


def surrogate(doc: Column, type_: Column, text: Column, seed: int = 0) -> Column:
    """The replacement of a span that is no name; unknown types get an identifier."""
    k, d, days = key_of(seed, doc, type_, text), draw.key(seed, doc, "place"), dates.offset_days(doc, seed)
    out = F.when(type_ == "DATE", dates.shift_date(text, days)).when(type_ == "DATE_TIME", dates.shift_datetime(text, days)).when(type_ == "DATE_OF_BIRTH", dates.birth(text, k))
    for name, make in GENERATORS.items():
        out = out.when(type_ == name, make(text, k, d))
    return out.otherwise(identifier(text, k, d))
