"""Mobile numbering plans: country -> (calling code, digits of a local number, digits after the code, prefixes).

Prefixes that begin with 0 are as dialled at home (the 0 falls away behind a calling code), others as
they follow the code. Ranges stand for consecutive prefixes.
"""

# Numbering plans.
PLANS = {
    "NG": ("234", 11, 10, "0703-0708 0802-0819 0901-0909 0912 0913 0915 0916"),
    "KE": ("254", 10, 9, "070-072 074-079 010 011"),
    "ZA": ("27", 10, 9, "060-069 071-074 076 078 079 081-084"),
    "GH": ("233", 10, 9, "020 023-028 050 054 055 059"),
    "TZ": ("255", 10, 9, "061 062 065 067-069 071 074-078"),
    "UG": ("256", 10, 9, "070 071 074 075 077 078"),
    "RW": ("250", 10, 9, "072 073 078"),
    "ET": ("251", 10, 9, "091-097 070 071"),
    "CI": ("225", 10, 10, "01 05 07"),
    "SN": ("221", 9, 9, "70 76-78"),
    "EG": ("20", 11, 10, "010-012 015"),
    "MA": ("212", 10, 9, "06 07"),
    "CM": ("237", 9, 9, "6"),
    "CD": ("243", 10, 9, "081-085 089 097 099"),
    "AO": ("244", 9, 9, "91-96 99"),
    "MZ": ("258", 9, 9, "82-87"),
    "ZW": ("263", 10, 9, "071 073 077 078"),
    "ZM": ("260", 10, 9, "095-097"),
    "BW": ("267", 8, 8, "71-77"),
    "NA": ("264", 10, 9, "081 085"),
    "SD": ("249", 10, 9, "091 092 096 099"),
    "ML": ("223", 8, 8, "6 7"),
    "BF": ("226", 8, 8, "5-7"),
    "NE": ("227", 8, 8, "8 9"),
    "GN": ("224", 9, 9, "62-69"),
    "BJ": ("229", 8, 8, "40-44 46 51-56 61-69 90 91 94-97"),
    "TG": ("228", 8, 8, "90-93 96-99 70 71 79"),
    "SL": ("232", 8, 8, "25 30 33 34 40 44 50 55 76-79 88"),
    "LR": ("231", 8, 7, "55 77 88"),
    "MG": ("261", 10, 9, "032-034 038"),
    "SO": ("252", 8, 8, "61-63 65 66 68 69 90"),
}

#: Countries whose prefixes are written as they follow the calling code, although one begins with 0.
AFTER_CODE = {"CI"}

CANDIDATE = r"(?<![0-9A-Za-z])\+?[0-9][0-9\s\-\.\(\)]{5,18}[0-9](?![0-9A-Za-z])"


def prefixes(country: str) -> list[str]:
    out = []
    for part in PLANS[country][3].split():
        low, _, high = part.partition("-")
        out += [str(n).zfill(len(low)) for n in range(int(low), int(high or low) + 1)]
    return out


def dialled_with_zero(country: str) -> bool:
    return PLANS[country][3].startswith("0") and country not in AFTER_CODE
