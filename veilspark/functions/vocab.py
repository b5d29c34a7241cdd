"""Word lists, label names and surrogate pools."""

from __future__ import annotations

# Names that the engine's results depend on.
TITLES = "dr mr mrs ms miss prof md do rn np pa phd jr sr ii iii iv".split()
STATES = "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY".split()
TIME_WORDS = "week weeks day days month months year years hour hours minute minutes second seconds morning afternoon evening night tonight today tomorrow yesterday daily weekly monthly yearly am pm noon midnight".split()
CREDENTIALS = "RN LPN MD DO NP DNP APRN PA-C PharmD RPh MSW LCSW LSW DPM DDS CRNA CNM MBBS FNP AGNP ACNP".split()
ENTITY_TYPES = (
    "FIRST_NAME LAST_NAME DATE DATE_OF_BIRTH DATE_TIME TIME AGE SSN MEDICAL_RECORD_NUMBER HEALTH_PLAN_BENEFICIARY_NUMBER ACCOUNT_NUMBER CUSTOMER_ID "
    "EMPLOYEE_ID UNIQUE_ID BIOMETRIC_IDENTIFIER CERTIFICATE_LICENSE_NUMBER PHONE_NUMBER FAX_NUMBER EMAIL STREET_ADDRESS CITY COUNTY STATE POSTCODE COUNTRY"
).split()
NAMES = ["FIRST_NAME", "LAST_NAME", "NAME"]
DATES = ["DATE", "DATE_TIME", "DATE_OF_BIRTH"]
IDENTIFIERS = "SSN MEDICAL_RECORD_NUMBER HEALTH_PLAN_BENEFICIARY_NUMBER ACCOUNT_NUMBER CUSTOMER_ID EMPLOYEE_ID UNIQUE_ID BIOMETRIC_IDENTIFIER CERTIFICATE_LICENSE_NUMBER".split()
KEPT = ["TIME", "COUNTRY"]

# Medical words that are no surnames: whoever bears a disease's or an instrument's name would stay in the note. A site
# adds its own with EngineConfig.extra_terms.
MEDICAL = (
    "patient nurse doctor hospital clinic ward surgery hemoglobin hematocrit platelets glucose creatinine sodium potassium chloride bicarbonate "
    "bilirubin albumin lipase troponin lactate cefepime clozapine metformin insulin heparin warfarin aspirin propranolol lisinopril atorvastatin "
    "morphine fentanyl appendectomy cholecystectomy colonoscopy bradycardia tachycardia hypertension pneumonia sepsis anemia asthma diabetes "
    "mchc mch mcv wbc rbc ecg mri echo ultrasound radiology urinalysis abdomen thorax "
    "present absent stable acute chronic"
).split()
MEDICAL_PAIRS = ["anion gap", "bun creatinine", "heart rate", "blood pressure", "chest pain"]

FIRST_POOL = [a + b for a in ("Ar", "Bel", "Cor", "Del", "Em", "Fal", "Gar", "Hal") for b in ("a", "en", "is", "on", "wyn", "ett")]
MALE_POOL, FEMALE_POOL = FIRST_POOL[1::2], FIRST_POOL[::2]
LAST_POOL = [a + b for a in ("Ash", "Birch", "Clay", "Dun", "East", "Fern", "Glen", "Holl") for b in ("brook", "croft", "dale", "field", "mont", "well")]
STREETS = [a + " " + b for a in ("Alder", "Cedar", "Juniper", "Laurel", "Poplar", "Willow") for b in ("Ave", "Ln", "Rd")]
CITIES = [a + b for a in ("North", "South", "West", "Lake") for b in ("haven", "ridge", "view", "ford", "port")]
PLACES = [(c, STATES[(7 * i) % len(STATES)], str(100 + 37 * i)) for i, c in enumerate(CITIES)]

# The labels of the training corpus and the entity types that they stand for.
LABELS = {t.lower(): t for t in ENTITY_TYPES}
LABELS |= {"first_name": "FIRST_NAME", "last_name": "LAST_NAME", "date_of_birth": "DATE_OF_BIRTH", "phone_number": "PHONE_NUMBER", "postcode": "POSTCODE", "street_address": "STREET_ADDRESS"}


def sql_list(words: list[str]) -> str:
    """A SQL array literal that Spark and DuckDB both read (as array(...) and [...] in turn)."""
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)
