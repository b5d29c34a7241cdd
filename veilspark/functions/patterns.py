"""Regular expressions (Java syntax). What a pattern must match is fixed: results depend on it character by character.
A scan tries a pattern at every character, so one begins with a look at the first character, which fails most places at
once, before word ends and what stands behind; runs that cannot end earlier are possessive."""

from __future__ import annotations

from .vocab import CREDENTIALS, STATES

U = "(?U)"
MM, DD, YYYY = "(?:1[0-2]|0?[1-9])", "(?:3[01]|[12]\\d|0?[1-9])", "(?:19|20)\\d{2}"
MONTH_NAMES = "January February March April May June July August September October November December".split()
MONTH_SHORT = [m[:3] for m in MONTH_NAMES]
MON = "(?:" + "|".join([*MONTH_NAMES, *[m for m in MONTH_SHORT[:8] if m != "May"], "Sept", *MONTH_SHORT[8:]]) + ")"
EMAIL = U + r"\b[\w.+-]++@[\w-]++\.[\w.-]+\b"
PHONE = r"(?=[(2-9])(?<!\d)\(?[2-9]\d{2}\)?[\s.-]\d{3}[\s.-]\d{4}(?!\d)"
SSN = r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
STATE_ZIP = r"(?=[A-Z]{2}\s)\b(?:" + "|".join(STATES) + r")\s{1,4}\d{5}(?:-\d{4})?(?![-\d])"
DATE = rf"(?=\d)(?<![\d/]){MM}[/-]{DD}[/-](?:{YYYY}|\d\d)(?![\d/])"
ROOM = r"(?=R)\bRM\d{2}\b"
CLOCK = r"(?=[0-2])(?<![\d/:.,-])(?:[01]\d|2[0-3])[0-5]\d(?![\d/:.,-])"
BP = r"(?=[Bb])\b(?i:bp)\:?\s{0,2}(?:[6-9][0-9]|1[0-9][0-9])/(?:[2-9][0-9]|1[0-9][0-9])\b"
_BLANK = r"[^\S\r\n]"  # on the same line
_NAMES = rf"[A-Z][a-zA-Z'\-]+(?:{_BLANK}+[A-Z][a-zA-Z'\-]+){{0,2}}"
_TITLE = rf"(?:Dr|Mr|Mrs|Ms|Miss|Mx|Nurse|Doctor|Prof|Professor|RN|NP|PA)\.?{_BLANK}+"
TITLE, TITLE_HEAD, TITLE_NAMES = rf"(?=[DMNPR])\b{_TITLE}{_NAMES}", f"^{_TITLE}", f"{_NAMES}$"
_CREDENTIAL = rf"{_BLANK}*,{_BLANK}*(?:" + "|".join(CREDENTIALS) + ")"
CREDENTIAL = rf"\b[A-Z][a-zA-Z'\-]+(?:,?{_BLANK}+[A-Z][a-zA-Z'\-]+){{0,2}}" + _CREDENTIAL + r"\b"
CREDENTIAL_TAIL = _CREDENTIAL + "$"
NAME_WORD = r"[A-Za-z'\-]+"
GAZETTEER = r"(?=[A-Z])\b[A-Z][a-z]{2,}\b"
LOWER_WORD = r"\b[a-z]{2,}\b"
NUMERIC_DATE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}"
EMBEDDED_DATE = r"\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2}|\b(?:19|20)\d{2}\b"
TIME = r"(?:[ \t]+\d{1,2}:\d{2}(?::\d{2})?(?:\s*[APap]\.?[Mm]\.?)?)?"
DATE_TOKEN = (
    rf"(?<!\d)(?:{YYYY}-{MM}-{DD}|{MM}[/-]{DD}[/-]\d{{2,4}}|{MON}\.?\s+{DD}(?:st|nd|rd|th)?,?\s+{YYYY}|{DD}(?:st|nd|rd|th)?\s+{MON}\.?\s+{YYYY}|{MM}[/-]{DD}|{YYYY}{MM}{DD}|{YYYY})(?!\d){TIME}"
)
SENTENCE = r"[.!?]\s+(?=[A-Z])|\n\s*\n"
NAME_GAP = r"^[\s.,\-']+[A-Z]?\.?[\s.,\-']*$|^[\s.,\-']*$"
TRAILING_DIGITS = r"(\b\d{1,2}/\d{1,2}/\d{4})\d+"
DOB_LINE = r"(?imd)^(DOB:\s*).*?(\d{1,2}[/-]\d{1,2}[/-]\d{2,4}).*$"
ZIP_PLUS4 = r"(?=\d)(?<![A-Za-z\d-])\d{5}-\d{4}(?![-\d])"
ZIP_STATE = r"(?=[A-Z]{2})\b(?:" + "|".join(STATES) + r")\b\s+\d{5}(?![-\d])"
ZIP_SHORT = r"(?=\d)(?<![A-Za-z\d-])\d{5}-\d{1,3}(?![-\d])"
ZIP_GLUED = r"(?=\d)(?<=[A-Za-z])\d{4,5}-\d{4}(?![-\d])"
ZIP_HINT = r"(?=[-\s])(?:(?<=\d{4})-\d|\s\d{5})"  # what a text has wherever one of the four is found
STATE_WORD = r"(?=[A-Z]{2})\b(?:" + "|".join(STATES) + r")\b"
# Providers in running text, for the leak check: by credential, after Dr and after Nurse; names may go over a line's end.
_PERSON = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,2}"
PROVIDERS = [r"\b[A-Z][a-z]+(?:,?\s+[A-Z][a-z]+){0,2}\s*,\s*(?:RN|LPN|MD|DO|NP|DNP|APRN|PharmD|MSW|LCSW|DPM|CRNA|CNM|FNP)\b", rf"\bDr\.?\s+{_PERSON}", rf"\bNurse\s+{_PERSON}"]
