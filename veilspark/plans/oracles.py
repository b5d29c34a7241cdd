"""SQL for DuckDB that gives the same rows as the queries of the catalogue, written apart from them."""

from __future__ import annotations

from ..functions import vocab as V
from ..sources import notes as N

L = V.sql_list


def _choice(n: str, words: list[str]) -> str:
    return f"[{L(words)}][({n}) % {len(words)} + 1]"


_PARTS = [
    ("O", "'PROGRESS NOTE' || chr(10) || 'Patient: '"),
    ("FIRST_NAME", _choice("c", N.FIRST)),
    ("O", "' '"),
    ("LAST_NAME", _choice("c", N.LAST)),
    ("O", "chr(10) || 'DOB: '"),
    ("DATE_OF_BIRTH", "strftime(date '1930-01-01' + ((c * 37) % 25000)::int, '%m/%d/%Y')"),
    ("O", "chr(10) || 'MRN: '"),
    ("MEDICAL_RECORD_NUMBER", "lpad(o::varchar, 8, '0')"),
    ("O", "chr(10) || 'Date of Service: '"),
    ("DATE", "strftime(odate, '%m/%d/%Y')"),
    ("O", "chr(10) || 'Addr: '"),
    ("STREET_ADDRESS", "(100 + c % 900)::varchar || ' MAPLE ST'"),
    ("O", "' / TULSA OK '"),
    ("POSTCODE", "(73000 + c % 999)::varchar || case when c % 3 = 0 then '' else '-' || lpad((o % 10000)::varchar, 4, '0') end"),
    ("O", "chr(10) || 'Phone: '"),
    ("PHONE_NUMBER", "'(405) 555-' || lpad((c % 10000)::varchar, 4, '0')"),
    ("O", "chr(10) || 'Email: '"),
    ("EMAIL", f"lower({_choice('c', N.FIRST)}) || '.' || c::varchar || '@example.com'"),
    ("O", "chr(10) || 'SSN: '"),
    ("SSN", "(100 + c % 800)::varchar || '-' || (10 + o % 90)::varchar || '-' || (1000 + o % 9000)::varchar"),
    ("O", "chr(10) || 'ARRIVE' || chr(9) || lpad((o % 24)::varchar, 2, '0') || lpad((o % 60)::varchar, 2, '0') || chr(10) || 'Location: RM0' || (o % 10)::varchar || chr(10) || case c % 2 when 0 then 'She is a ' else 'He is a ' end"),
    ("AGE", "(20 + c % 80)::varchar"),
    ("O", "case c % 2 when 0 then ' year old female. Seen by Dr. ' else ' year old male. Seen by Dr. ' end"),
    ("LAST_NAME", _choice("o", N.DOCTORS)),
    ("O", "chr(10) || 'Hx' || chr(9) || 'Appendectomy' || chr(9)"),
    ("DATE", "(1950 + o % 70)::varchar"),
    ("O", "chr(10) || 'Anion Gap 12. Started clozapine 100mg.'"),
]
_LABELS = L([label for label, _ in _PARTS])
BASE = f"""with seg as (select o_orderkey as o, c_custkey as c, o_orderdate as odate from orders join customer on o_custkey = c_custkey),
parts as (select o as doc_id, o, c, [{', '.join(x for _, x in _PARTS)}] as p from seg),
notes as (select doc_id, o, c, array_to_string(p, '') as text from parts),
gold as (
  select doc_id, o, c, i, length(array_to_string(p[1:i-1], ''))::int as start, (length(array_to_string(p[1:i-1], '')) + length(p[i]))::int as "end", [{_LABELS}][i] as type, p[i] as text
  from (select *, unnest(range(1, {len(_PARTS) + 1})) as i from parts) where [{_LABELS}][i] <> 'O'),
days as (select doc_id, (-30 - h % 336)::int as days from (select doc_id, ('0x' || substr(md5('0|' || doc_id || '|shift'), 1, 8))::bigint as h from notes))"""
SPAN = 'doc_id, start, "end", type, text'


def h(key: str) -> str:
    return f"('0x' || substr(md5({key}), 1, 8))::bigint"


def chars(key: str, n: str, alphabet: str = "0123456789") -> str:
    return f"coalesce(list_aggregate(list_transform(range(1, {n} + 1), lambda i: substr('{alphabet}', (({h(key + ' || chr(124) || i')} % {len(alphabet)}) + 1)::int, 1)), 'string_agg', ''), '')"


def pick(key: str, pool: list[str]) -> str:
    return f"[{L(pool)}][({h(key)} % {len(pool)} + 1)::int]"


def scan(pattern: str, of: str = "notes", skip: int = 0, drop: int = 0) -> str:
    """Matches with offsets; skip and drop: characters of the match before and after what counts."""
    return f"""select doc_id, (pos + {skip})::int as start, (pos + length(x) - {drop})::int as "end", substr(x, 1 + {skip}, length(x) - {skip} - {drop}) as text from (
  select doc_id, m[i] as x, list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i-1], lambda y: length(y))), 0) as pos
  from (select *, unnest(range(1, len(m) + 1)) as i from (select doc_id, regexp_extract_all(text, '{pattern}') as m, regexp_split_to_array(text, '{pattern}') as g from {of})))"""


EMAIL, PHONE, SSN, DATE = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z]+", r"\(?[2-9]\d{2}\)?[\s.-]\d{3}[\s.-]\d{4}", r"\d{3}-\d{2}-\d{4}", r"\d{2}/\d{2}/\d{4}"
SENTENCE = r"[.!?]\s+[A-Z]|\n\s*\n"
ZIP = r"OK \d{5}(?:-\d{4})?"
CLOCK = r"\t(?:[01]\d|2[0-3])[0-5]\d\n"


def _made(types: str, out: str, extra: str = "") -> str:
    """doc_id, text, out of gold spans; k is the draw's key, d the note's."""
    return BASE + f""", z as (select gold.doc_id, text, type, '0|' || gold.doc_id || '|' || type || '|' || lower(trim(text)) as k, '0|' || gold.doc_id || '|place' as d, days{extra}
  from gold join days using (doc_id) where type in ({L(types.split())}))
select doc_id, text, {out} as out from z"""


def _n(key: str, low: int, high: int) -> str:
    return f"({h(key)} % {high - low + 1} + {low})::varchar"


def _part(i: int, low: int, high: int) -> str:
    return _n(f"k || '|{i}'", low, high)


def all_sql() -> dict[str, str]:
    gold = BASE + f" select {SPAN} from gold"
    shift = "case when length(text) = 10 then strftime(strptime(text, '%m/%d/%Y')::date + days, '%m/%d/%Y') else strftime(make_date(case when length(text) = 4 then text::int else 2000 end, 7, 1) + days, '%Y') end"
    places = V.PLACES
    digits = "length(regexp_replace(text, '[^0-9]', '', 'g'))"
    letters = "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))"
    base36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    patient = "gold where i in (2, 4)"
    new = lambda pool, real, part: f"(list_filter([{L(pool)}], lambda w: lower(w) <> {real}))[({h('pk || ' + chr(39) + '|' + part + chr(39))} % len(list_filter([{L(pool)}], lambda w: lower(w) <> {real})) + 1)::int]"
    sex_words = lambda words: f"len(regexp_extract_all(lower(text), '\\b(?:{words})\\b'))"
    male = f"{sex_words('he|him|his|mr')} + 4 * {sex_words('male|gentleman')}"
    female = f"{sex_words('she|her|hers|mrs|ms|miss')} + 4 * {sex_words('female|woman|lady')}"
    sex = f"case when {male} > {female} then 'M' when {female} > {male} then 'F' else 'U' end"
    tokens = "select g.doc_id, type, lower(text) as token, i, start from gold g where type in ('FIRST_NAME', 'LAST_NAME')"
    token_re = "[A-Za-z0-9]+|[^A-Za-z0-9\\s]"
    bilou = BASE + f""", tok as ({scan(token_re)}),
tagged as (
  select t.doc_id, t.start as s, t."end" as e, g.type, t.start = g.start as first, t."end" = g."end" as last
  from tok t left join gold g on g.doc_id = t.doc_id and t."end" > g.start and t.start < g."end"),
lab as (select *, case when type is null then 'O' else (case when first and last then 'U' when first then 'B' when last then 'L' else 'I' end) || '-' || type end as label from tagged)"""
    out = {
        "notes_text": BASE + " select doc_id, text from notes",
        "notes_gold_spans": gold,
        "validate_notes": BASE + f", v as (select doc_id, len(regexp_extract_all(text, '{token_re}'))::int as token_count from notes) select doc_id, token_count, token_count > 4096 as exceeds_limit, case when token_count <= 4096 then 1 else ceil(token_count / 3244.0)::int end as estimated_chunks from v",
        "scan_email": BASE + " " + scan(EMAIL),
        "scan_phone": BASE + " " + scan(PHONE),
        "scan_ssn": BASE + " " + scan(SSN),
        "detector_plugin": BASE + f" select {SPAN} from gold where type = 'SSN'",
        "scan_zip": BASE + " " + scan(ZIP),
        "scan_date": BASE + " " + scan(DATE),
        "scan_room": BASE + " " + scan(r"RM\d{2}"),
        "scan_clock": BASE + " " + scan(CLOCK, skip=1, drop=1),
        "recognizers": BASE + "".join(f", s{i} as ({scan(p, skip=k)})" for i, (p, k) in enumerate(((ZIP, 3), (PHONE, 0), (SSN, 0), (EMAIL, 0), (DATE, 0)))) + " " + " union all ".join(f"select doc_id, start, \"end\", '{t}' as type, text from s{i}" for i, t in enumerate(("POSTCODE", "PHONE_NUMBER", "SSN", "EMAIL", "DATE"))),
        "recall_title": BASE + f" select doc_id, start, \"end\", 'NAME' as type, text from gold where i = 24",
        "recall_credential": f"""with t as (select c_custkey as doc_id, {_choice('c_custkey', N.FIRST)} as f, {_choice('c_custkey', N.LAST)} as l from customer),
u as (select doc_id, upper(substr(f, 1, 1)) || lower(substr(f, 2)) as f, l from t)
select doc_id, 8 as start, (8 + length(f))::int as "end", 'NAME' as type, f as text from u
union all select doc_id, (9 + length(f))::int, (9 + length(f) + length(l))::int, 'NAME', l from u""",
        "recall_gazetteer": BASE + " select doc_id, start, \"end\", 'NAME' as type, text from gold where i = 4 and text in ('Kowalczyk', 'Garcia')",
        "patient_top_name": BASE + f""", t as ({tokens}),
n as (select doc_id, type, token, count(*) as n, min(start) as pos from t group by all),
r as (select *, row_number() over (partition by doc_id, type order by n desc, pos, token) as r from n)
select doc_id, max(case when type = 'FIRST_NAME' then token end) as first, max(case when type = 'LAST_NAME' then token end) as last from r where r = 1 group by doc_id""",
        "patient_sex": BASE + f" select doc_id, {sex} as sex from notes",
        "patient_sweep": BASE + f" select {SPAN} from {patient}",
        "resolve_override": BASE + f""", q as (select n.doc_id, {sex} as sex, lower(a.text) as first, lower(b.text) as last, 'person|' || lower(a.text) || '|' || lower(b.text) as pk
  from (select doc_id, text from notes) n join gold a on a.doc_id = n.doc_id and a.i = 2 join gold b on b.doc_id = n.doc_id and b.i = 4)
select doc_id, first, last, case sex when 'M' then {new(V.MALE_POOL, 'first', 'f')} when 'F' then {new(V.FEMALE_POOL, 'first', 'f')} else {new(V.FIRST_POOL, 'first', 'f')} end as new_first, {new(V.LAST_POOL, 'last', 'l')} as new_last from q""".replace(f"select n.doc_id, {sex}", f"select n.doc_id, {sex.replace('lower(text)', 'lower(n.text)')}"),
        "whitelist_anti": gold,
        "whitelist_pair_filter": gold,
        "timeword_filter": gold,
        "safe_veto": gold,
        "merge_same_type": gold,
        "merge_dates": BASE + " select doc_id, start, \"end\", case when type = 'DATE_OF_BIRTH' then 'DATE' else type end as type, text from gold",
        "combine_names": BASE + f""" select doc_id, min(start) as start, max("end") as "end", 'NAME' as type, string_agg(text, ' ' order by i) as text from {patient} group by doc_id
union all select {SPAN} from gold where i not in (2, 4)""",
        "split_names": BASE + f""" select doc_id, (start - 4)::int as start, (start - 2)::int as "end", 'NAME' as type, 'Dr' as text from gold where i = 24
union all select doc_id, start, "end", 'NAME', text from gold where i = 24""",
        "dedupe_chunks": BASE + ' select doc_id, start, "end", type from gold',
        "repair_fragments": BASE + f" select {SPAN} from gold where type = 'LAST_NAME'",
        "repair_ids": BASE + f" select {SPAN} from gold where type = 'SSN'",
        "complete_street": BASE + f" select {SPAN} from gold where type = 'STREET_ADDRESS'",
        "trim_ids": BASE + f" select {SPAN} from gold where type = 'MEDICAL_RECORD_NUMBER'",
        "date_trim": BASE + f" select {SPAN} from gold where type = 'DATE_OF_BIRTH'",
        "dob_retype": BASE + """ select g.doc_id, g.start, g."end", case when g.type = 'DATE' and regexp_matches(lower(substr(n.text, greatest(g.start - 49, 1), least(g.start, 50))), 'dob:|dob :|date of birth|birth date|birthdate') then 'DATE_OF_BIRTH' else g.type end as type, g.text
from gold g join notes n on n.doc_id = g.doc_id""",
        "overlap_resolution": gold,
        "sur_ssn": _made("SSN", f"concat_ws('-', {_part(1, 100, 999)}, {_part(2, 10, 99)}, {_part(3, 1000, 9999)})"),
        "sur_mrn": _made("MEDICAL_RECORD_NUMBER", f"'MRN' || {chars('k', '8')}"),
        "sur_id": _made("MEDICAL_RECORD_NUMBER SSN", chars("k", "greatest(4, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')))", base36)),
        "sur_license": _made("MEDICAL_RECORD_NUMBER EMAIL", f"case when {letters} > 0 then {chars('k || ' + chr(39) + '|L' + chr(39), letters, base36[10:])} || {chars('k', digits)} else {chars('k', 'greatest(6, ' + digits + ')')} end"),
        "sur_npi": _made("MEDICAL_RECORD_NUMBER", chars("k", "10")),
        "sur_phone": _made("PHONE_NUMBER", f"'(' || {_part(1, 200, 999)} || ') ' || {_part(2, 200, 999)} || '-' || {_part(3, 1000, 9999)}"),
        "sur_email": _made("EMAIL", f"lower({pick('k || ' + chr(39) + '|a' + chr(39), V.FIRST_POOL)}) || '.' || lower({pick('k || ' + chr(39) + '|b' + chr(39), V.LAST_POOL)}) || ({h('k || ' + chr(39) + '|c' + chr(39))} % 1000)::varchar || '@example.org'"),
        "sur_street": _made("STREET_ADDRESS", f"{_n('k || ' + chr(39) + '|n' + chr(39), 100, 9999)} || ' ' || {pick('k || ' + chr(39) + '|s' + chr(39), V.STREETS)}"),
        "sur_city": _made("STREET_ADDRESS", pick("d", [p[0] for p in places])),
        "sur_state": _made("STREET_ADDRESS", pick("d", [p[1] for p in places])),
        "sur_county": _made("STREET_ADDRESS", f"{pick('k', V.CITIES)} || ' County'"),
        "sur_zip": _made("POSTCODE", f"{pick('d', [p[2] for p in places])} || {chars('k || ' + chr(39) + '|z' + chr(39), '2')} || case when length(text) > 5 then '-' || {chars('k || ' + chr(39) + '|p' + chr(39), '4')} else '' end"),
        "shift_dates": _made("DATE DATE_OF_BIRTH", shift),
        "shift_embedded": _made("DATE_OF_BIRTH", "'on ' || strftime(strptime(text, '%m/%d/%Y')::date + days, '%m/%d/%Y') || ' seen'"),
        "shift_datetimes": _made("DATE_OF_BIRTH", "strftime(strptime(text, '%m/%d/%Y')::date + days, '%m/%d/%Y') || ' 05:54'"),
        "date_fallback": _made("MEDICAL_RECORD_NUMBER", "translate(text, '0123456789', substr('01234567890123456789', case when days % 10 = 0 then 6 else ((days % 10) + 10) % 10 + 1 end, 10)) || '-xx'"),
        "age_cap": _made("AGE", "case when text::int >= 89 then '90+' else text end"),
        "preserve_case": _made("FIRST_NAME", "case when text = upper(text) then 'O''NEIL MC-DONALD' else 'O''Neil Mc-Donald' end"),
        "masked_display": _made("LAST_NAME", "substr(text, 1, 1) || repeat('*', length(text) - 1)"),
        "rewrite_notes": BASE + f" select doc_id, array_to_string(list_transform(range(1, {len(_PARTS) + 1}), lambda j: case when [{_LABELS}][j] = 'O' then p[j] else '[' || [{_LABELS}][j] || ']' end), '') as text from parts",
        "patient_backstop": BASE + f" select doc_id, regexp_replace(text, '\\b(?:{'|'.join(N.LAST)})\\b', 'Xyz', 'g') as text from notes",
        "date_digit_sanitize": BASE + " select doc_id, text from notes",
        "dob_cleanup": BASE + " select doc_id, text from notes",
        "leak_after_deid": "select 0::bigint as leaks",
        "leak_residual": BASE + f""", t as (select distinct doc_id, token from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from gold where type in ('FIRST_NAME', 'LAST_NAME')) where length(token) >= 2),
w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as token from notes)
select w.doc_id, w.token, count(*) as n from w join t on t.doc_id = w.doc_id and t.token = w.token group by all""",
        "score_by_type": BASE + """, r as (select type, case when type in ('POSTCODE', 'PHONE_NUMBER', 'SSN', 'EMAIL', 'DATE_OF_BIRTH') or (type = 'DATE' and length(text) = 10) then 1 else 0 end as hit from gold)
select type, count(*) as gold, sum(hit)::bigint as hit, round(sum(hit)::double / count(*), 6) as recall from r group by rollup (type)""",
        "score_precision": BASE + f""", c as ({scan(CLOCK, skip=1, drop=1)}),
r as (select case when exists (select 1 from gold g where g.doc_id = c.doc_id and g.start < c."end" and c.start < g."end") then 1 else 0 end as hit from c)
select type, count(*) as pred, sum(hit)::bigint as hit, round(sum(hit)::double / count(*), 6) as precision from (select 'DATE' as type, hit from r) group by rollup (type)""",
        "malformed_dates": BASE + " select doc_id, 2 as n from notes",
        "gaz_delta": BASE + " select doc_id, start, \"end\" from gold where i = 4 and text in ('Garcia', 'Kowalczyk')",
        "bilou_labels": f"select 0 as label_id, 'O' as label, 'O' as tag, null::varchar as type union all select (1 + 4 * (i - 1) + (j - 1))::int, substr('BILU', j, 1) || '-' || [{L(V.ENTITY_TYPES)}][i], substr('BILU', j, 1), [{L(V.ENTITY_TYPES)}][i] from (select unnest(range(1, {len(V.ENTITY_TYPES) + 1}))::int as i), (select unnest(range(1, 5))::int as j)",
        "spans_to_bilou": bilou + " select label, count(*) as n from lab group by label",
        "bilou_decode": BASE + ' select doc_id, type, start, "end" from gold',
        "class_weights": bilou + f", n as (select label, count(*) as n from lab group by label), t as (select sum(n) as total from n), a as (select 'O' as label union all select substr('BILU', j, 1) || '-' || t from (select unnest([{L(V.ENTITY_TYPES)}]) as t), (select unnest(range(1, 5))::int as j)) select a.label, coalesce(n.n, 0)::bigint as n, round(coalesce(least(total::double / (n.n * {len(V.ENTITY_TYPES) * 4 + 1})::double, 10.0), 1.0), 9) as weight from a left join n using (label), t",
        "token_metrics": """with r as (select quality = 1 as g, toxic = 1 or doc_id % 3 = 0 as p from labels),
c as (select count(*) as n, count(*) filter (where g = p)::double as same, count(*) filter (where g)::double as e, count(*) filter (where p and g)::double as tp, count(*) filter (where p and not g)::double as fp, count(*) filter (where g and not p)::double as fn from r)
select n as tokens, round(same / n, 6) as accuracy, round(tp / e, 6) as entity_accuracy, round(tp / (tp + fp), 6) as precision, round(tp / (tp + fn), 6) as recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) as f1 from c""",
        "split_80_20": f"select doc_id, {h(chr(39) + '42|' + chr(39) + ' || doc_id')} % 100 < 80 as train from documents",
        "domain_histogram": "select lang, count(*) as n from documents group by lang",
        "distinct_labels": BASE + " select distinct type from gold",
        "top_tokens": "select token, count(*) as n from (select unnest(regexp_extract_all(text, '[a-z]{4,}')) as token from documents) group by token order by n desc, token limit 40",
    }
    out |= _audit(gold, bilou)
    out["sentence_boundary"] = _boundary(250, 200)
    makers = {"SSN": out["sur_ssn"], "MEDICAL_RECORD_NUMBER": out["sur_mrn"], "PHONE_NUMBER": out["sur_phone"], "EMAIL": out["sur_email"], "STREET_ADDRESS": out["sur_street"], "POSTCODE": out["sur_zip"], "DATE": out["shift_dates"], "DATE_OF_BIRTH": _dob(), "AGE": out["age_cap"]}
    out |= _whole(makers, sex, new)
    out["dob_surrogate"] = _dob()
    out["sur_names_unique"] = _unique_names()
    return out


def _audit(gold: str, bilou: str) -> dict[str, str]:
    """SQL of the checks on detection and filters, and of further branches of the passes."""
    baited = BASE + f""", clock as (select doc_id, strpos(text, 'ARRIVE' || chr(9))::int + 6 as pos, text from notes),
bait as (select {SPAN} from gold
  union all select doc_id, (pos + 2)::int, (pos + 4)::int, 'DATE', substr(text, pos + 3, 2) from clock
  union all select doc_id, (strpos(text, 'Location: RM') + 9)::int, (strpos(text, 'Location: RM') + 13)::int, 'POSTCODE', substr(text, strpos(text, 'Location: RM') + 10, 4) from notes)"""
    is_room = "(type = 'POSTCODE' and text like 'RM%')"
    is_clock = "(type = 'DATE' and length(text) = 2)"
    listed = BASE + """, found as (select doc_id, c, start, "end", text from gold where i = 4 and text in ('Kowalczyk', 'Garcia')
  union all select doc_id, c, (strpos(text, 'Anion Gap') + 5)::int, (strpos(text, 'Anion Gap') + 8)::int, 'Gap' from notes
  union all select doc_id, c, (strpos(text, 'Phone') - 1)::int, (strpos(text, 'Phone') + 4)::int, 'Phone' from notes)"""
    ids = "select label_id, label from (select 0 as label_id, 'O' as label union all select (1 + 4 * (i - 1) + (j - 1))::int, substr('BILU', j, 1) || '-' || [{types}][i] from (select unnest(range(1, {n}))::int as i), (select unnest(range(1, 5))::int as j))".format(types=L(V.ENTITY_TYPES), n=len(V.ENTITY_TYPES) + 1)
    part = lambda i, skip, size, type_: f"select doc_id, (start + {skip})::int as start, (start + {skip} + {size})::int as \"end\", '{type_}' as type, substr(text, 1 + {skip}, {size}) as text from gold where i = {i}"
    whole = lambda i, type_: f"select doc_id, start, (start + length(regexp_extract(text, '^[0-9]+')))::int as \"end\", '{type_}' as type, regexp_extract(text, '^[0-9]+') as text from gold where i = {i}"
    return {
        "spans_to_bilou_tokens": bilou + ' select doc_id, s as start, e as "end", label from lab',
        "training_records": bilou + f", ids as ({ids}) select doc_id as uid, count(*)::int as n_tokens, sum(label_id)::int as label_sum, 128 as width from lab join ids using (label) group by doc_id",
        "note_token_count": BASE + " select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9]+|[^A-Za-z0-9\\s]'))::int as n_tokens from notes",
        "shift_years": _made("DATE", "strftime(make_date(case when length(text) = 4 then text::int else 2000 end, 7, 1) + days, '%Y')") + " where length(text) = 4",
        "leak_provider": BASE + """ select doc_id, start, "end", text as token from gold where i = 24 and doc_id % 2 = 0
union all select doc_id, (strpos(text, 'Appendectomy') - 1)::int, (strpos(text, 'Appendectomy') + 11)::int, 'Appendectomy' from notes""",
        "list_cost": listed + """, a as (select (doc_id % 3)::int as corpus, text = 'Gap' as term from found where not (text = 'Garcia' and doc_id % 2 = 0))
select corpus, count(*) as added, count(*) filter (where term) as terms, count(*) filter (where not term) as names, round(count(*) filter (where term) / count(*)::double, 6) as term_share from a group by corpus""",
        "neighbour_contexts": listed + """, w as (select f.text, regexp_extract_all(substr(n.text, greatest(f.start - 18, 0) + 1, least(f.start, 18)), '[A-Za-z]+') as l, regexp_extract_all(substr(n.text, f."end" + 1, 18), '[A-Za-z]+') as r from found f join notes n using (doc_id)),
c as (select substr(text, 1, 1) || repeat('*', length(text) - 1) as token, coalesce(l[-1], '^') || ' _ ' || coalesce(r[1], '$') as context, count(*) as n from w group by all)
select * from (select *, row_number() over (partition by token order by n desc, context)::int as rank from c) where rank <= 2""",
        "entity_counts": BASE + " select type, count(*) as n from gold group by type",
        "veto_by_type": baited + f"""select type, count(*) as gold, count(*) filter (where {is_room} or {is_clock} or (type = 'DATE' and regexp_matches(text, '^([01][0-9]|2[0-3])[0-5][0-9]$')))::bigint as overlap,
  count(*) filter (where {is_room} or {is_clock}) as vetoed from bait group by type""",
        "veto_differences": baited + f"""select {SPAN}, 'missing' as side from bait where type = 'AGE' and doc_id % 7 = 0 union all select {SPAN}, 'unexpected' from bait where {is_clock} and doc_id % 5 = 0""",
        "first_with_gold": BASE + ", g as (select doc_id, ['Healthcare', 'Finance', 'Public Health Services'][(doc_id % 3)::int + 1] as domain, count(*)::int as n_spans from gold where doc_id % 4 <> 0 group by all) select doc_id, domain, n_spans from g where domain ilike '%health%' order by doc_id limit 100",
        "first_misses": BASE + f" select {SPAN} from gold where not (type in ('POSTCODE', 'PHONE_NUMBER', 'SSN', 'EMAIL', 'DATE_OF_BIRTH') or (type = 'DATE' and length(text) = 10)) order by doc_id, start limit 50",
        "best_epoch": """with r as (select doc_id % 10 as epoch, quality = 1 as g, toxic = 1 or doc_id % 3 = 0 as p from labels),
f as (select epoch, round(2 * (count(*) filter (where p and g)) / ((count(*) filter (where p or g)) + (count(*) filter (where p and g)))::double, 1) as f1 from r group by epoch)
select epoch, f1 from f order by f1 desc, epoch limit 1""",
        "masked_spans": BASE + """ select doc_id::varchar as study_id, start, "end", type, regexp_replace(text, '[0-9]', '#', 'g') as masked from gold""",
        "shared_words": """with w as (select doc_id, regexp_extract_all(lower(text), '[a-z]{4,}') as w from documents) select a.doc_id, list_has_any(a.w, b.w) as shared from w a join w b on b.doc_id = a.doc_id + 1""",
        "name_union": f"select distinct lower(unnest([{L([*N.FIRST, *N.LAST, *N.DOCTORS, 'Kowalczyk', 'Garcia', 'Gap', 'Maple', 'Phone'])}])) as name",
        "repair_ids_branches": BASE + f""" {whole(12, 'MEDICAL_RECORD_NUMBER')} union all {whole(20, 'MEDICAL_RECORD_NUMBER')}
union all select * from ({part(14, 0, 5, 'MEDICAL_RECORD_NUMBER')}) union all select doc_id, start, (start + length(regexp_extract(text, '^[0-9]+ MAPLE')))::int, 'STREET_ADDRESS', regexp_extract(text, '^[0-9]+ MAPLE') from gold where i = 12
union all select doc_id, (strpos(text, 'Gap 12') + 3)::int, (strpos(text, 'Gap 12') + 5)::int, 'MEDICAL_RECORD_NUMBER', '12' from notes""",
        "merge_gaps": BASE + f""" select {SPAN} from gold where length(text) <> 10 or type not in ('DATE', 'DATE_OF_BIRTH') or doc_id % 2 = 0
union all select doc_id, (start + 3)::int, "end", type, substr(text, 4) from gold where length(text) = 10 and type in ('DATE', 'DATE_OF_BIRTH') and doc_id % 2 = 1""",
        "sweep_mentions": BASE + f""", q as (select n.doc_id, length(n.text) + 1 as pos, a.text as f, b.text as l from notes n join gold a on a.doc_id = n.doc_id and a.i = 2 join gold b on b.doc_id = n.doc_id and b.i = 4)
select {SPAN} from gold where i in (2, 4)
union all select doc_id, pos::int, (pos + length(f))::int, 'FIRST_NAME', upper(substr(f, 1, 1)) || lower(substr(f, 2)) from q
union all select doc_id, (pos + length(f) + 1)::int, (pos + length(f) + 1 + length(l))::int, 'LAST_NAME', upper(l) from q""",
    }


def _whole(makers: dict[str, str], sex: str, new) -> dict[str, str]:
    """SQL of the whole de-identification, of the map back, and of the ZIP sweep over notes whose spans are in clear."""
    expr = {t: q[q.rindex("select doc_id, text, ") + len("select doc_id, text, ") : q.rindex(" as out from z")] for t, q in makers.items()}
    cases = " ".join(f"when '{t}' then {x}" for t, x in expr.items())
    person = BASE + f""", typed as (
  select g.doc_id, i, start, "end", g.text, case when g.type = 'DATE' and regexp_matches(lower(substr(n.text, greatest(g.start - 49, 1), least(g.start, 50))), 'dob:|dob :|date of birth|birth date|birthdate') then 'DATE_OF_BIRTH' else g.type end as type
  from gold g join notes n on n.doc_id = g.doc_id),
q as (select n.doc_id, {sex.replace('lower(text)', 'lower(n.text)')} as sex, lower(a.text) as first, lower(b.text) as last, lower(e.text) as doctor, 'person|' || lower(a.text) || '|' || lower(b.text) as pk
  from notes n join gold a on a.doc_id = n.doc_id and a.i = 2 join gold b on b.doc_id = n.doc_id and b.i = 4 join gold e on e.doc_id = n.doc_id and e.i = 24),
r as (select *, case sex when 'M' then {new(V.MALE_POOL, 'first', 'f')} when 'F' then {new(V.FEMALE_POOL, 'first', 'f')} else {new(V.FIRST_POOL, 'first', 'f')} end as new_first, {new(V.LAST_POOL, 'last', 'l')} as new_last from q),
f as (select *, list_filter([{L(V.LAST_POOL)}], lambda w: not list_contains([first, last, doctor, lower(new_first), lower(new_last)], lower(w))) as free from r)"""
    made = lambda src: f"""z as (select t.doc_id, i, start, text, type, '0|' || t.doc_id || '|' || type || '|' || lower(trim(text)) as k, '0|' || t.doc_id || '|place' as d, days from {src} t join days using (doc_id) where i not in (2, 4, 24)),
s as (select doc_id, i, type, text, case type {cases} end as out from z)"""  # noqa: E731
    like = lambda out: f"case when text = upper(text) then upper({out}) else {out} end"
    unique = f"""t as (select distinct doc_id, case type when 'FIRST_NAME' then 'first' else 'last' end as kind, lower(text) as token from gold where type in ('FIRST_NAME', 'LAST_NAME')),
u as (select doc_id, list(token) as reserved from t group by doc_id),
v as (select t.*, list_filter(case kind when 'first' then [{L(V.FIRST_POOL)}] else [{L(V.LAST_POOL)}] end, lambda w: not list_contains(reserved, lower(w))) as free, row_number() over (partition by t.doc_id, kind order by md5('0|' || token), token) - 1 as k from t join u on u.doc_id = t.doc_id),
nm as (select doc_id, kind, token, free[(({h("'0|' || doc_id || '|' || kind")} % len(free) + k) % len(free) + 1)::int] as surrogate from v)"""
    code = "p[14]"
    area = f"{pick('d', [x[2] for x in V.PLACES])}"
    swept = f"{area} || {chars('k || ' + chr(39) + '|z' + chr(39), '2')} || case when length({code}) > 5 then '-' || {chars('k || ' + chr(39) + '|p' + chr(39), '4')} else '' end"
    return {
        "deid_full": person + ", " + made("typed") + f""",
segs as (select doc_id, i, [{_LABELS}][i] as label, p[i] as x from (select *, unnest(range(1, {len(_PARTS) + 1})) as i from parts) where [{_LABELS}][i] = 'O'
  union all select doc_id, i, type, out from s
  union all select doc_id, 2, 'NAME', new_first from f union all select doc_id, 4, 'O', new_last from f
  union all select doc_id, 24, 'LAST_NAME', free[({h("'0|' || doc_id || '|last'")} % len(free) + 1)::int] from f)
select doc_id, string_agg(x, '' order by i) as text, count(*) filter (where label <> 'O')::int as n_spans from segs group by doc_id""",
        "surrogate_map": BASE + ", " + made("gold") + f""", {unique},
a as (select doc_id, i, type, text, out from s union all select g.doc_id, i, type, text, {like('surrogate')} from gold g join nm on nm.doc_id = g.doc_id and nm.token = lower(g.text) and nm.kind = case type when 'FIRST_NAME' then 'first' else 'last' end where i in (2, 4, 24))
select doc_id, arg_max(text, i) as original, arg_max(out, i) as surrogate, type, list_has_any(regexp_extract_all(lower(arg_max(out, i)), '[a-z]+'), [{L(V.MEDICAL)}]) as collision from a where text <> out group by doc_id, type, lower(text), lower(out)""",
        "zip_backstop": BASE + f""", x as (select doc_id, p, '0|' || doc_id || '|place' as d, '0|' || doc_id || '|place|' || {code} as k from parts)
select doc_id, array_to_string(p[1:13], '') || {swept} || array_to_string(p[15:], '') as text from x""",
    }


def _boundary(target: int, reach: int) -> str:
    """The pattern takes the capital that follows a sentence end with it, so its length is taken off again."""
    low = target - reach
    near = lambda of, end: f"select doc_id, arg_min({low} + {end}, {{'d': abs({low} + {end} - {target}), 'p': {low} + {end}}}) as p from {of} group by doc_id"
    return f"""with w as (select doc_id, case when length(text) > {low} then substr(text, {low + 1}, least({target + reach}, length(text)) - {low}) else '' end as text from documents),
a as ({scan(SENTENCE, 'w')}), b as ({scan(chr(92) + 'n', 'w')}),
s as ({near('a', '("end" - case when regexp_matches(text, ' + chr(39) + '[A-Z]$' + chr(39) + ') then 1 else 0 end)')}), l as ({near('b', '"end"')})
select d.doc_id, coalesce(s.p, l.p, {target})::int as "at" from documents d left join s using (doc_id) left join l using (doc_id)"""


def _dob() -> str:
    d = "strptime(text, '%m/%d/%Y')::date"
    q = lambda s: f"k || '|{s}'"
    one = f"make_date((year({d}) + {h(q('y0'))} % 5 - 2)::int, ({h(q('m0'))} % 12 + 1)::int, ({h(q('d0'))} % 28 + 1)::int)"
    return _made("DATE_OF_BIRTH", f"strftime(case when {one} = {d} then {d} + 1 else {one} end, '%m/%d/%Y')")


def _unique_names() -> str:
    return BASE + f""", t as (select distinct doc_id, case type when 'FIRST_NAME' then 'first' else 'last' end as kind, lower(text) as token from gold where type in ('FIRST_NAME', 'LAST_NAME')),
r as (select doc_id, list(token) as reserved from t group by doc_id),
f as (select t.*, list_filter(case kind when 'first' then [{L(V.FIRST_POOL)}] else [{L(V.LAST_POOL)}] end, lambda w: not list_contains(reserved, lower(w))) as free,
    row_number() over (partition by t.doc_id, kind order by md5('0|' || token), token) - 1 as k from t join r on r.doc_id = t.doc_id)
select doc_id, kind, token, free[(({h("'0|' || doc_id || '|' || kind")} % len(free) + k) % len(free) + 1)::int] as surrogate from f"""
