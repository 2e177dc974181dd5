"""National identifier formats.

``pattern`` is a Java regular expression over ASCII digits and letters, ``valid`` the SQL test of a match
m (None: the shape is all there is to test, and earns no bonus), ``facts`` the SQL of its metadata.
"""

from __future__ import annotations

from typing import NamedTuple


class Format(NamedTuple):
    country: str
    id_type: str
    confidence: float
    pattern: str
    valid: str | None = None
    facts: str = "map()"


_DIGITS = r"(?<![0-9])%s(?![0-9])"
_WORD = r"(?<![A-Za-z0-9])%s(?![A-Za-z0-9])"
_ANYCASE = r"(?i)(?<![A-Za-z0-9])%s(?![A-Za-z0-9])"
_DATE = "int(substr(m, {0}, 2)) between 1 and 12 and int(substr(m, {1}, 2)) between 1 and 31"
_ZA_FACTS = (
    "map('date_of_birth', concat(if(int(left(m, 2)) >= 30, '19', '20'), left(m, 2), '-', substr(m, 3, 2), '-', substr(m, 5, 2)),"
    " 'gender', if(int(substr(m, 7, 4)) < 5000, 'female', 'male'), 'citizenship', if(substr(m, 11, 1) = '0', 'citizen', 'permanent_resident'))"
)
_EG_FACTS = "map('date_of_birth', concat(if(left(m, 1) = '2', '19', '20'), substr(m, 2, 2), '-', substr(m, 4, 2), '-', substr(m, 6, 2)), 'governorate_code', substr(m, 8, 2))"

# Formats, their confidence, order and context words.
FORMATS = {
    "NG_NIN": Format("NG", "NIN", 0.55, _DIGITS % "[0-9]{11}", "true"),
    "NG_BVN": Format("NG", "BVN", 0.80, _DIGITS % "22[0-9]{9}", "true"),
    "NG_PVC": Format("NG", "PVC", 0.60, _ANYCASE % r"[0-9]{2}\s?[A-Z0-9]{2}\s?[A-Z0-9]{2}\s?[A-Z0-9]{2}\s?[0-9]{4}\s?[0-9]{3}\s?[0-9]{4}"),
    "NG_TIN": Format("NG", "TIN", 0.50, _DIGITS % "[0-9]{10}(?:-[0-9]{4})?", "true"),
    "NG_RC": Format("NG", "RC", 0.90, _ANYCASE % r"(?:RC|BN)\s?[0-9]{5,8}", "replace(upper(m), ' ', '') rlike '^(RC|BN)[0-9]{5,8}$'", "map('entity_type', if(upper(m) like 'RC%', 'limited_liability', 'business_name'))"),
    "NG_DRIVERS": Format("NG", "DRIVERS_LICENCE", 0.85, _WORD % "[A-Z]{3}-[0-9]{10,12}", "true", "map('state_code', left(m, 3))"),
    "KE_ID": Format("KE", "NATIONAL_ID", 0.40, _DIGITS % "[0-9]{7,8}"),
    "KE_KRA_PIN": Format("KE", "KRA_PIN", 0.92, _ANYCASE % "[AP][0-9]{9}[A-Z]", "true", "map('taxpayer_type', if(upper(m) like 'A%', 'individual', 'company'))"),
    "KE_NHIF": Format("KE", "NHIF", 0.45, _DIGITS % "[0-9]{8,9}", "true"),
    "ZA_ID": Format("ZA", "NATIONAL_ID", 0.90, _DIGITS % "[0-9]{13}", f"{_DATE.format(3, 5)} and luhn_check(m)", _ZA_FACTS),
    "ZA_TAX_REF": Format("ZA", "TAX_REFERENCE", 0.50, _DIGITS % "[01239][0-9]{9}", "true"),
    "ZA_PASSPORT": Format("ZA", "PASSPORT", 0.75, _WORD % "[A-Z][0-9]{8}", "true"),
    "GH_CARD": Format("GH", "GHANA_CARD", 0.95, _ANYCASE % "GHA-[0-9]{9}-[0-9]", "true"),
    "GH_SSNIT": Format("GH", "SSNIT", 0.65, _WORD % "[A-Z][A-Z0-9]{12}", "true"),
    "GH_TIN": Format("GH", "TIN", 0.85, _ANYCASE % "[PCG][0-9]{10}", "true", "map('taxpayer_type', case upper(left(m, 1)) when 'P' then 'individual' when 'C' then 'company' else 'government' end)"),
    "RW_NID": Format("RW", "NID", 0.85, _DIGITS % "1[0-9]{15}", "int(substr(m, 2, 4)) between 1900 and 2030", "map('birth_year', substr(m, 2, 4))"),
    "TZ_NIDA": Format("TZ", "NIDA", 0.85, _DIGITS % "[0-9]{20}"),
    "UG_NIN": Format("UG", "NIN", 0.85, _WORD % "C[MF][A-Z0-9]{12}"),
    "ET_KEBELE": Format("ET", "KEBELE_ID", 0.50, _ANYCASE % "ET[-/]?[A-Z]{2,4}[-/]?[0-9]{4,10}"),
    "CI_CNI": Format("CI", "CNI", 0.70, _WORD % "C[0-9]{9,14}"),
    "SN_CNI": Format("SN", "CNI", 0.65, _DIGITS % "[12][0-9]{12}"),
    "CM_CNI": Format("CM", "CNI", 0.40, _DIGITS % "[0-9]{9}"),
    "EG_NID": Format("EG", "NATIONAL_ID", 0.88, _DIGITS % "[23][0-9]{13}", f"{_DATE.format(4, 6)} and int(substr(m, 8, 2)) between 1 and 35", _EG_FACTS),
    "MA_CNIE": Format("MA", "CNIE", 0.60, _WORD % "[A-Z]{1,2}[0-9]{5,7}"),
    "AO_BI": Format("AO", "BI", 0.70, _WORD % "[0-9]{9}[A-Z]{2}[0-9]"),
    "MZ_BI": Format("MZ", "BI", 0.70, _WORD % "[0-9]{12}[A-Z]"),
}

#: The order in which formats claim their spans.
ORDER = {
    "ng": "NG_RC NG_DRIVERS NG_PVC NG_BVN NG_TIN NG_NIN",
    "ke": "KE_KRA_PIN KE_NHIF KE_ID",
    "za": "ZA_ID ZA_PASSPORT ZA_TAX_REF",
    "gh": "GH_CARD GH_TIN GH_SSNIT",
    "africa": "GH_CARD GH_TIN GH_SSNIT KE_KRA_PIN NG_RC NG_DRIVERS NG_PVC ZA_PASSPORT UG_NIN ET_KEBELE AO_BI MZ_BI CI_CNI MA_CNIE"
    " TZ_NIDA RW_NID EG_NID ZA_ID SN_CNI NG_BVN ZA_TAX_REF KE_NHIF NG_TIN NG_NIN CM_CNI KE_ID",
}

CONTEXT = {
    "NG": ["nin", "bvn", "national id", "bank verification", "voter card", "inec", "nimc", "nigeria"],
    "GH": ["ghana card", "national id", "nia", "ghana"],
    "KE": ["kenyan id", "national id", "huduma", "kenya"],
    "ZA": ["south african id", "id number", "sa id", "south africa"],
    "RW": ["rwanda", "nid", "national id"],
    "TZ": ["nida", "tanzania", "national id"],
    "UG": ["nira", "uganda", "national id"],
    "ET": ["kebele", "ethiopia", "fayda"],
    "CI": ["cni", "cote d'ivoire", "ivory coast", "carte nationale"],
    "SN": ["cni", "senegal", "carte nationale"],
    "CM": ["cni", "cameroon", "cameroun", "carte nationale"],
    "EG": ["egypt", "national id", "egyptian id"],
    "MA": ["cnie", "morocco", "moroccan", "carte nationale"],
    "AO": ["angola", "bilhete de identidade", "bi"],
    "MZ": ["mozambique", "bilhete de identidade", "bi"],
}
WINDOW, BONUS, CONTEXT_BONUS = 80, 0.05, 0.15
FOUNDATIONAL = ("NIN", "NATIONAL_ID", "GHANA_CARD")
