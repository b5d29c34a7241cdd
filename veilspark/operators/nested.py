"""The passes over the spans of one note, as expressions on a row: spans is an array of (start, end, type, text), note
the text. Nothing is joined and nothing shuffled; the tables of spans in the other modules go through by_note()."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import vocab as V
from ..functions.text import cut, let, scan

SPANS = "array<struct<start:int,end:int,type:string,text:string>>"
SPAN = "struct<start:int,end:int,type:string,text:string>"
REACH = 256  # characters on either side of a span in which the word or number that it is part of is looked for
WORD = r"[\p{L}\p{N}]"
FEW = 64  # names that are looked for one by one


def none() -> Column:
    return F.array().cast(SPANS)


def span(start: Column, end: Column, type_: Column | str, text: Column) -> Column:
    kind = F.lit(type_) if isinstance(type_, str) else type_
    return F.struct(start.alias("start"), end.alias("end"), kind.alias("type"), text.alias("text"))


def by_note(spans: DataFrame, notes: DataFrame, make: Callable[[Column, Column], Column]) -> DataFrame:
    """A pass over tables of spans (doc_id, start, end, type, text) and notes (doc_id, text): one shuffle by note.
    Rows without doc_id belong together; spans of a doc_id go to every note that has it."""
    nested = spans.groupBy(F.col("doc_id").alias("_d")).agg(F.collect_list(F.struct("start", "end", "type", "text")).cast(SPANS).alias("_spans"))
    rows = nested.join(notes.select("doc_id", F.col("text").alias("_note")), F.col("doc_id").eqNullSafe(F.col("_d")))
    return rows.select("doc_id", F.explode(make(F.col("_spans"), F.col("_note"))).alias("_s")).select("doc_id", "_s.*")


def of_note(notes: DataFrame, make: Callable[[Column], Column], score: float) -> DataFrame:
    """doc_id, start, end, type, text, score of what make finds in each note."""
    return notes.select("doc_id", F.explode(make(F.col("text"))).alias("_s")).select("doc_id", "_s.*", F.lit(score).alias("score"))


def fold(spans: Column, kind: str, step: Callable[[Column, Column, Column], Column]) -> Column:
    """Spans in order from the left: step(kept, the last kept one, the next) gives the kept ones, of the type given.
    No step casts what is kept: that would copy all of it once a span."""
    empty = F.array().cast(kind)
    return F.aggregate(spans, empty, lambda acc, s: let(F.try_element_at(acc, F.lit(-1)), lambda last: step(acc, last, s)))


def more(kept: Column, s: Column) -> Column:
    return F.concat(kept, F.array(s))


def instead(kept: Column, s: Column) -> Column:
    """kept with its last one replaced."""
    return F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(s))


def meets(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def with_uncovered(spans: Column, found: Column) -> Column:
    """spans and those found that overlap none of them."""
    return let(spans, lambda old: F.concat(old, F.filter(found, lambda s: ~F.exists(old, lambda x: meets(x, s)))))


def is_medical(word: Column, extra: tuple[str, ...] = ()) -> Column:
    return F.lower(F.trim(word)).isin([*V.MEDICAL, *(w.lower() for w in extra)])


def is_name(s: Column) -> Column:
    return s["type"].isin(V.NAMES)


def _around(note: Column, s: Column) -> tuple[Column, Column]:
    begin = F.greatest(s["start"] - REACH, F.lit(0))
    return F.substring(note, begin + 1, s["start"] - begin), F.substring(note, s["end"] + 1, F.lit(REACH))


def _grown(note: Column, s: Column, left: Column, right: Column) -> Column:
    start, end = s["start"] - left, s["end"] + right
    return span(start, end, s["type"], cut(note, start, end))


def whole_names(spans: Column, note: Column, extra: tuple[str, ...] = ()) -> Column:
    """Names that end inside a word take the whole word; medical words drop; equal ones become one (NAME if their
    types differ)."""

    def one(s: Column) -> Column:
        before, after = _around(note, s)
        left, right = F.length(F.regexp_extract(before, "[A-Za-z]*$", 0)), F.length(F.regexp_extract(after, "^[A-Za-z]*", 0))
        grown = let(F.struct(left.alias("l"), right.alias("r")), lambda n: F.when(n["l"] + n["r"] == 0, s).otherwise(let(_grown(note, s, n["l"], n["r"]), lambda g: F.when(~is_medical(g["text"], extra), g))))
        return F.when(is_name(s), grown).otherwise(s)

    kind = lambda s: F.when(is_name(s), "name").otherwise(s["type"])
    rows = F.array_sort(F.array_compact(F.transform(spans, one)))

    def step(kept: Column, last: Column, s: Column) -> Column:
        same = F.coalesce((last["start"] == s["start"]) & (last["end"] == s["end"]) & (kind(last) == kind(s)), F.lit(False))
        both = span(s["start"], s["end"], F.when(last["type"] == s["type"], s["type"]).otherwise("NAME"), s["text"])
        return F.when(same, instead(kept, both)).otherwise(more(kept, s))

    # Names come together however their types are called.
    ordered = let(rows, lambda r: F.concat(F.filter(r, is_name), F.filter(r, lambda s: ~is_name(s))))
    return fold(ordered, SPANS, step)


def _words(names: Column, base: Column, type_: str, extra: tuple[str, ...]) -> Column:
    """Words of names as spans; short and medical ones are none."""
    kept = F.filter(scan(names, P.NAME_WORD), lambda m: (F.length(m["text"]) >= 2) & ~is_medical(m["text"], extra))
    return F.transform(kept, lambda m: span(base + m["start"], base + m["end"], type_, m["text"]))


def by_title(note: Column, type_: str = "NAME", extra: tuple[str, ...] = ()) -> Column:
    """Capitalised words after a title on the same line."""
    return F.flatten(F.transform(scan(note, P.TITLE), lambda m: let(F.regexp_replace(m["text"], P.TITLE_HEAD, ""), lambda n: _words(n, m["end"] - F.length(n), type_, extra))))


def by_credential(note: Column, type_: str = "NAME", extra: tuple[str, ...] = ()) -> Column:
    """Capitalised words before a comma and a credential."""
    return F.flatten(F.transform(scan(note, P.CREDENTIAL), lambda m: _words(F.regexp_replace(m["text"], P.CREDENTIAL_TAIL, ""), m["start"], type_, extra)))


def by_gazetteer(note: Column, names: list[str], extra: tuple[str, ...] = ()) -> Column:
    """Capitalised words of a name list that the note never has in small letters and that begin no sentence."""
    lower = sorted({n.lower() for n in names})
    listed = F.array(*map(F.lit, lower))
    # Of a short list only its own words are looked for, else all; a listed word that the pattern cannot match is found by neither.
    words = [n for n in lower if re.fullmatch("[a-z]{3,}", n)]
    one_of = lambda words, else_: rf"(?=[{''.join(sorted({w[0] for w in words}))}])\b(?:{'|'.join(words)})\b" if 0 < len(words) <= FEW else else_
    capital, small_ones = one_of([w.capitalize() for w in words], P.GAZETTEER), one_of(words, P.LOWER_WORD)

    def found(small: Column) -> Column:
        def keep(m: Column) -> Column:
            before = F.trim(F.translate(F.substring(note, F.greatest(m["start"] - 1, F.lit(1)), F.least(m["start"], F.lit(2))), "\n\t\r", "   "))
            word = F.lower(m["text"])
            return F.array_contains(listed, word) & ~F.array_contains(small, word) & (before != "") & ~before.rlike(r"[.!?:;]$") & ~is_medical(m["text"], extra)

        return F.transform(F.filter(scan(note, capital), keep), lambda m: span(m["start"], m["end"], "NAME", m["text"]))

    return let(F.array_distinct(F.regexp_extract_all(note, F.lit(small_ones), F.lit(0))), found)


def without_medical(spans: Column, extra: tuple[str, ...] = ()) -> Column:
    return F.filter(spans, lambda s: ~(is_name(s) & is_medical(s["text"], extra)))


def without_medical_pairs(spans: Column) -> Column:
    """Spans without both of two neighbouring names (0 to 3 characters apart) that are a medical term together."""

    def hits(rows: Column) -> Column:
        def hit(s: Column, i: Column) -> Column:
            def pair(nxt: Column) -> Column:
                two = F.lower(F.concat(F.trim(s["text"]), F.lit(" "), F.trim(nxt["text"])))
                glued = F.lower(F.concat(F.trim(s["text"]), F.trim(nxt["text"])))
                return F.coalesce(is_name(s) & is_name(nxt) & (nxt["start"] - s["end"]).between(0, 3) & (two.isin(V.MEDICAL_PAIRS) | glued.isin(V.MEDICAL)), F.lit(False))

            return let(F.get(rows, i + 1), pair)

        return F.transform(rows, hit)

    return let(F.array_sort(spans), lambda rows: let(hits(rows), lambda h: F.filter(rows, lambda s, i: ~(F.get(h, i) | F.coalesce(F.get(h, i - 1), F.lit(False))))))


def without_time_words(spans: Column) -> Column:
    return F.filter(spans, lambda s: ~(s["type"].isin(V.DATES) & F.lower(F.trim(s["text"])).isin(V.TIME_WORDS)))


def safe_ranges(note: Column) -> Column:
    """array<struct<start,end,strict>> of rooms and of clock times in the context of one: a line with a tab or
    without letters, or 'at' just before. A clock time protects what lies strictly within it."""
    kind = "array<struct<start:int,end:int,strict:boolean>>"
    rooms = F.transform(scan(note, P.ROOM), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(False).alias("strict")))

    def in_context(m: Column) -> Column:
        line = F.concat(F.substring_index(F.substring(note, F.lit(1), m["start"]), "\n", -1), m["text"], F.substring_index(F.substring(note, m["end"] + 1, F.lit(1 << 30)), "\n", 1))
        before = F.substring(note, F.greatest(m["start"] - 7, F.lit(1)), F.least(m["start"], F.lit(8)))
        return let(line, lambda t: t.contains("\t") | ~t.rlike(r"\p{L}")) | before.rlike(r"(?i)\bat\s*$")

    clocks = F.transform(F.filter(scan(note, P.CLOCK), in_context), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(True).alias("strict")))
    return F.concat(rooms.cast(kind), clocks.cast(kind))


def is_safe(s: Column, ranges: Column) -> Column:
    return F.exists(ranges, lambda r: (r["start"] <= s["start"]) & (s["end"] <= r["end"]) & (~r["strict"] | (r["start"] < s["start"]) | (s["end"] < r["end"])))


def without_safe(spans: Column, note: Column) -> Column:
    """Spans that lie in no room and strictly in no clock time."""
    return let(safe_ranges(note), lambda ranges: F.filter(spans, lambda s: ~F.coalesce(is_safe(s, ranges), F.lit(False))))


def words_of(text: Column) -> Column:
    """Small-letter words of a name without titles."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(V.TITLES))


def name_tokens(spans: Column) -> Column:
    """array<struct<kind,token,start>> (kind: first or last): of FIRST_NAME the first word, of LAST_NAME the last, of
    NAME the last, and the first too if there are two."""
    kind = "array<struct<kind:string,token:string,start:int>>"

    def of(s: Column) -> Column:
        one = lambda k, w: F.struct(F.lit(k).alias("kind"), w.alias("token"), s["start"].alias("start"))

        def picked(w: Column) -> Column:
            last, first = one("last", F.try_element_at(w, F.lit(-1))), one("first", F.try_element_at(w, F.lit(1)))
            by_type = F.when(s["type"] == "FIRST_NAME", F.array(first)).when(s["type"] == "LAST_NAME", F.array(last)).otherwise(F.when(F.size(w) > 1, F.array(last, first)).otherwise(F.array(last)))
            return F.when(F.size(w) > 0, by_type).otherwise(F.array().cast(kind))

        return let(words_of(s["text"]), picked)

    return F.flatten(F.transform(F.filter(spans, is_name), of)).cast(kind)


def patient(tokens: Column) -> Column:
    """struct<first,last>: the most frequent token of each kind, the first met of equals."""

    def best(kind: str) -> Column:
        def top(mine: Column) -> Column:
            each = F.transform(F.array_distinct(F.transform(mine, lambda t: t["token"])), lambda w: let(F.filter(mine, lambda t: t["token"] == w), lambda same: F.struct((-F.size(same)).alias("n"), F.array_min(F.transform(same, lambda t: t["start"])).alias("at"), w.alias("token"))))
            return F.array_min(each)["token"]

        return let(F.filter(tokens, lambda t: t["kind"] == kind), top)

    return F.struct(best("first").alias("first"), best("last").alias("last"))


def patient_of(spans: Column) -> Column:
    return let(name_tokens(spans), patient)


def swept_for(spans: Column, note: Column, who: Column, extra: tuple[str, ...] = ()) -> Column:
    """spans and each further mention of the patient's first or last name that is not all in small letters."""
    fit = lambda w: F.when((F.length(w) >= 2) & ~is_medical(w, extra), w)

    def found(names: Column) -> Column:
        words = scan(note, F.concat(F.lit(r"(?Ui)\b(?:"), F.array_join(F.array_compact(F.array(names["first"], names["last"])), "|"), F.lit(r")\b")))
        mentions = F.filter(words, lambda m: m["text"].rlike("^[A-Za-z]+$") & (m["text"] != F.lower(m["text"])))
        made = F.transform(mentions, lambda m: span(m["start"], m["end"], F.when(F.lower(m["text"]).eqNullSafe(names["first"]), "FIRST_NAME").otherwise("LAST_NAME"), m["text"]))
        return F.when(names["first"].isNull() & names["last"].isNull(), none()).otherwise(made)

    fitting = lambda w: F.struct(fit(w["first"]).alias("first"), fit(w["last"]).alias("last"))
    return let(let(who, fitting), lambda names: with_uncovered(spans, found(names)))


def joined_dates(spans: Column, note: Column) -> Column:
    """Spans with the parts of a date joined: a date takes the dates that follow at most one / or - away, and times
    at most 3 characters away, if at least two came together and they read as month, day and year. Otherwise its
    first part stays and the search goes on with the next one."""
    state = f"struct<group:{SPANS},until:int,out:{SPANS}>"
    make = lambda group, until, out: F.struct(group.alias("group"), until.alias("until"), out.alias("out"))

    def flushed(acc: Column) -> Column:
        g = acc["group"]

        def closed(whole: Column) -> Column:
            one = F.array(span(F.get(g, F.lit(0))["start"], acc["until"], "DATE", whole))
            return F.concat(acc["out"], F.when((F.size(g) >= 2) & whole.rlike(P.NUMERIC_DATE), one).otherwise(g))

        return F.when(F.size(g) == 0, acc["out"]).otherwise(let(cut(note, F.get(g, F.lit(0))["start"], acc["until"]), closed))

    def step(acc: Column, s: Column) -> Column:
        g, gap = acc["group"], s["start"] - acc["until"]
        goes_on = (F.size(g) > 0) & ((s["type"].isin(V.DATES) & gap.between(0, 1) & cut(note, acc["until"], s["start"]).rlike("^[/-]?$")) | ((s["type"] == "TIME") & gap.between(0, 3)))
        grown = make(more(g, s), F.greatest(acc["until"], s["end"]), acc["out"])
        return F.when(goes_on, grown).when(s["type"].isin(V.DATES), make(F.array(s), s["end"], flushed(acc))).otherwise(make(none(), F.lit(0), more(flushed(acc), s)))

    return F.aggregate(F.array_sort(spans), make(none(), F.lit(0), none()).cast(state), step, flushed)


def trimmed_dates(spans: Column) -> Column:
    """Dates without a digit drop; where exactly one date stands in the span, the span shrinks to it."""

    def one(s: Column) -> Column:
        return F.when(s["type"].isin(V.DATES), let(scan(s["text"], P.DATE_TOKEN), lambda m: F.when(F.size(m) == 1, span(s["start"] + m[0]["start"], s["start"] + m[0]["end"], s["type"], m[0]["text"])).otherwise(s))).otherwise(s)

    return F.transform(F.filter(spans, lambda s: ~s["type"].isin(V.DATES) | s["text"].rlike(r"\d")), one)


def _neighbours(spans: Column, note: Column, joins: Callable[[Column, Column, Column], Column], type_: Callable[[Column, Column], Column]) -> Column:
    """Spans with those that join (the last one, the next, the gap's text) the one before as one."""
    kind = "struct<start:int,end:int,type:string,text:string,until:int,from:string>"  # until, from: of the last one taken in
    made = lambda s, until, from_: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["text"].alias("text"), until.alias("until"), from_.alias("from"))
    ordered = F.transform(F.array_sort(spans), lambda s: made(s, s["end"], s["type"]))

    def step(kept: Column, last: Column, s: Column) -> Column:
        end = F.greatest(last["end"], s["end"])
        both = F.struct(last["start"].alias("start"), end.alias("end"), type_(last, s).alias("type"), cut(note, last["start"], end).alias("text"), s["end"].alias("until"), s["from"].alias("from"))
        together = F.coalesce(joins(last, s, cut(note, last["until"], s["start"])), F.lit(False))
        return F.when(together, instead(kept, both)).otherwise(more(kept, s))

    return F.transform(fold(ordered, f"array<{kind}>", step), lambda s: span(s["start"], s["end"], s["type"], s["text"]))


def joined_same_type(spans: Column, note: Column, max_gap: int = 2) -> Column:
    """Neighbours of one type at most max_gap characters of blank, / - . : or , apart become one."""
    return _neighbours(spans, note, lambda a, b, gap: (a["from"] == b["type"]) & (b["start"] - a["until"]).between(0, max_gap) & gap.rlike(r"^[ /\-.:,]*$"), lambda a, b: a["type"])


def combined_names(spans: Column, note: Column) -> Column:
    """Names with only blanks, points, commas, hyphens, quotes and at most one initial between them (15 characters)
    become one NAME; a span of another type between them keeps them apart."""
    name = lambda t: t.isin(V.NAMES)
    return _neighbours(spans, note, lambda a, b, gap: name(a["from"]) & name(b["type"]) & (b["start"] - a["until"]).between(0, 15) & gap.rlike(P.NAME_GAP), lambda a, b: F.lit("NAME"))


def split_names(spans: Column) -> Column:
    """Names cut after a word's point and blank; each piece shrinks to its letters, empty ones vanish."""
    after = r"(?<=[A-Za-z]{2}\.)\s+"

    def pieces(s: Column) -> Column:
        ends = lambda gaps: F.concat(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("text"))), gaps)

        def of(gaps: Column) -> Column:
            def piece(g: Column, i: Column) -> Column:
                stop = F.coalesce(F.get(gaps, i + 1)["start"], F.length(s["text"]))
                x = cut(s["text"], g["end"], stop)
                head = F.length(F.regexp_extract(x, r"^[^\p{L}]*", 0))
                core = F.regexp_replace(F.regexp_replace(x, r"^[^\p{L}]+", ""), r"[^\p{L}]+$", "")
                at = s["start"] + g["end"] + head
                return span(at, at + F.length(core), s["type"], core)

            return let(F.filter(F.transform(gaps, piece), lambda p: p["text"] != ""), lambda kept: F.when(F.size(kept) > 0, kept).otherwise(F.array(span(s["start"], s["start"] + F.length(s["text"]), s["type"], s["text"]))))

        return F.when(is_name(s) & s["text"].rlike(after), let(ends(scan(s["text"], after)), of)).otherwise(F.array(s))

    return F.flatten(F.transform(spans, pieces))


def repaired_identifiers(spans: Column, note: Column) -> Column:
    """Identifiers without a digit drop; one that runs into a word gives up its last letters; one that is part of a
    run of digits takes the whole run of up to 6, else drops, as does the tail of a ZIP+4; streets take whole words."""

    def shortened(s: Column) -> Column:
        back = F.length(F.regexp_extract(s["text"], r"\p{L}+$", 0))
        runs_on = F.substring(note, s["end"] + 1, F.lit(1)).rlike(r"^\p{L}") & s["text"].rlike(r"\p{L}$")
        return F.when(runs_on, _grown(note, s, F.lit(0), -back)).otherwise(s)

    def digits(s: Column) -> Column:
        before, after = _around(note, s)

        def whole(n: Column) -> Column:
            tail = F.regexp_replace(before, r"\d*$", "").rlike(r"\d{5}-$")
            return F.when(tail, F.lit(None)).when(n["l"] + n["r"] == 0, s).when(n["l"] + n["r"] + F.length(s["text"]) <= 6, _grown(note, s, n["l"], n["r"]))

        sizes = F.struct(F.length(F.regexp_extract(before, r"\d*$", 0)).alias("l"), F.length(F.regexp_extract(after, r"^\d*", 0)).alias("r"))
        return F.when(s["text"].rlike(r"^\d+$"), let(sizes, whole)).otherwise(s)

    def street(s: Column) -> Column:
        before, after = _around(note, s)
        left = F.when(s["text"].rlike(f"^{WORD}"), F.length(F.regexp_extract(before, f"{WORD}*$", 0))).otherwise(0)
        right = F.when(s["text"].rlike(f"{WORD}$"), F.length(F.regexp_extract(after, f"^{WORD}*", 0))).otherwise(0)
        return _grown(note, s, left, right)

    def one(s: Column) -> Column:
        ident = F.when(s["text"].rlike(r"\d"), let(shortened(s), digits))
        return F.when(s["type"].isin(V.IDENTIFIERS), ident).when(s["type"] == "STREET_ADDRESS", street(s)).otherwise(s)

    return F.array_compact(F.transform(spans, one))


def trimmed_identifiers(spans: Column) -> Column:
    """Identifiers lose what is no letter or digit at their ends; empty ones drop."""

    def one(s: Column) -> Column:
        head = F.length(F.regexp_extract(s["text"], r"^[^\p{L}\p{N}]*", 0))
        core = F.regexp_replace(F.regexp_replace(s["text"], r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", "")
        return F.when(s["type"].isin(V.IDENTIFIERS), let(core, lambda c: span(s["start"] + head, s["start"] + head + F.length(c), s["type"], c))).otherwise(s)

    return F.filter(F.transform(spans, one), lambda s: F.length(s["text"]) > 0)


def retyped_births(spans: Column, note: Column) -> Column:
    """A DATE with a mention of birth in the 50 characters before it is a DATE_OF_BIRTH."""

    def one(s: Column) -> Column:
        before = F.lower(F.substring(note, F.greatest(s["start"] - 49, F.lit(1)), F.least(s["start"], F.lit(50))))
        return F.when((s["type"] == "DATE") & before.rlike("dob:|dob :|date of birth|birth date|birthdate"), span(s["start"], s["end"], "DATE_OF_BIRTH", s["text"])).otherwise(s)

    return F.transform(spans, one)


def without_overlaps(spans: Column) -> Column:
    """Of overlapping spans the longest stays, then the earliest, then the first type by name."""
    kind = "array<struct<len:int,start:int,end:int,type:string,text:string>>"
    ranked = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct((s["start"] - s["end"]).alias("len"), s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["text"].alias("text"))))).cast(kind)
    kept = F.aggregate(ranked, F.array().cast(kind), lambda acc, s: F.when(F.exists(acc, lambda x: meets(x, s)), acc).otherwise(more(acc, s)))
    return F.transform(kept, lambda s: span(s["start"], s["end"], s["type"], s["text"]))
