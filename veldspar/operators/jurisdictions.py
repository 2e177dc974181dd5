"""Country packs: profiles, mobile networks, strict phone and identifier rules of four countries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.data import identifiers, phones
from veldspar.data import statutes as laws
from veldspar.functions import spans

# Operators and their prefixes as dialled at home; a prefix of two belongs to the later one.
NETWORKS = {
    "NG": {"MTN": "0703 0706 0803 0806 0810 0813 0814 0816 0903 0906 0913 0916", "Glo": "0705 0805 0807 0811 0815 0905 0915", "Airtel": "0701 0708 0802 0808 0812 0901 0902 0904 0907 0912", "9mobile": "0809 0817-0819 0908 0909"},
    "GH": {"MTN": "024 054 055 059", "Vodafone": "020 050", "AirtelTigo": "026 027 056 057"},
    "KE": {"Safaricom": "0701-0729 0740-0749 0757-0759 0768 0769 0790-0799 0110-0115", "Airtel": "0730-0739 0750-0756 0780-0789 0100-0108", "Telkom": "0770-0779"},
    "ZA": {"Vodacom": "060-066 071-073 082", "MTN": "063-067 071 073 078 083", "Cell C": "074 084", "Telkom": "081"},
}
#: identifier -> (country, shape, test, confidence, what context adds, context words, whether context is needed)
PACK_IDS = [
    ("BVN", "NG", r"(?<![0-9])[0-9]{11}(?![0-9])", "s.m like '22%'", 0.90, 0.05, ("bvn", "bank verification", "nibss"), False),
    ("NIN", "NG", r"(?<![0-9])[0-9]{11}(?![0-9])", "s.m not like '22%'", 0.90, 0.10, ("nin", "national identification", "nimc"), False),
    ("TIN", "NG", r"(?<![0-9])[0-9]{10}(?![0-9])", "true", 0.70, 0.10, ("tin", "tax identification", "firs"), True),
    ("KRA_PIN", "KE", r"(?<![A-Za-z0-9])[A-Z][0-9]{9}[A-Z](?![A-Za-z0-9])", "true", 0.90, 0.05, ("kra", "pin", "tax"), False),
    ("NATIONAL_ID", "KE", r"(?<![0-9])[0-9]{7,8}(?![0-9])", "true", 0.60, 0.15, ("national id", "id number", "huduma"), True),
    ("NATIONAL_ID", "ZA", r"(?<![0-9])[0-9]{13}(?![0-9])", "int(substr(s.m, 3, 2)) between 1 and 12 and int(substr(s.m, 5, 2)) between 1 and 31 and luhn_check(s.m)", 0.95, 0.05, ("id number", "sa id", "identity"), False),
    ("GHANA_CARD", "GH", r"(?<![A-Za-z0-9])GHA-[0-9]{9}-[0-9](?![A-Za-z0-9])", "true", 0.95, 0.05, ("ghana card", "nia"), False),
]
NAMES = {"NG": "Nigeria", "KE": "Kenya", "ZA": "South Africa", "GH": "Ghana"}


def available() -> list[str]:
    return sorted(NAMES)


def profile(code: str) -> dict:
    """Identifier formats, phone plan, networks and law of a country; ValueError for one without a pack."""
    code = code.upper()
    if code not in NAMES:
        raise ValueError(f"no pack for {code!r}; there are {', '.join(available())}")
    plan = phones.PLANS[code]
    statute = laws.FOR_JURISDICTION[code]
    return {
        "code": code, "name": NAMES[code], "identifiers": {k: f.pattern for k, f in identifiers.FORMATS.items() if f.country == code},
        "phones": {"calling_code": plan[0], "local_digits": plan[1], "prefixes": phones.prefixes(code)}, "networks": sorted(NETWORKS[code]), "statute": statute, "categories": [line.split()[0] for line in laws.STATUTES[statute][1].strip().splitlines()],
    }


def networks(code: str) -> dict[str, str]:
    """Prefix -> operator."""
    out = {}
    for operator, ranges in NETWORKS[code].items():
        for part in ranges.split():
            low, _, high = part.partition("-")
            out |= {str(n).zfill(len(low)): operator for n in range(int(low), int(high or low) + 1)}
    return out


def network_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, p, o) for c in NETWORKS for p, o in networks(c).items()], "country string, prefix string, operator string")


def network_sql(phone: str, code: str) -> str:
    """Operator of a local or international number; null where the prefix is unknown."""
    known = networks(code)
    calling, size = phones.PLANS[code][0], len(next(iter(known)))
    least = phones.PLANS[code][2] + len(calling)
    local = f"transform(array(regexp_replace({phone}, r'[\\s\\-\\(\\)\\+]+', '')), d -> if(d like '{calling}%' and char_length(d) >= {least}, concat('0', substring(d, {len(calling) + 1})), d))[0]".replace("\\\\", "\\")
    return f"map({', '.join(f'{chr(39)}{p}{chr(39)}, {chr(39)}{o}{chr(39)}' for p, o in known.items())})[left({local}, {size})]"


def strict_phone_sql(phone: str, code: str) -> str:
    """E.164 of a number of the country with a known operator; null otherwise."""
    calling, local, after, _ = phones.PLANS[code]
    d = f"regexp_replace({phone}, r'[\\s\\-\\(\\)\\.\\+]+', '')".replace("\\\\", "\\")
    full = f"case when {d} rlike '^{calling}[0-9]{{{after}}}$' then {d} when {d} rlike '^0[0-9]{{{local - 1}}}$' then concat('{calling}', substring({d}, 2)) end"
    return f"if({network_sql(phone, code)} is not null, concat('+', {full}), null)"


def pack_ids_sql(t: str, code: str) -> str:
    """Array of (id_type, value, confidence): the country's identifiers under its strict rules."""
    parts = []
    for kind, country, shape, test, sure, more, words, needed in PACK_IDS:
        if country != code:
            continue
        near = spans.any_of(list(words), spans.window(t, 80))
        found = f"filter({spans.matches(t, shape)}, s -> {test} and ({near if needed else 'true'}))"
        parts.append(f"transform({found}, s -> named_struct('id_type', '{kind}', 'value', s.m, 'confidence', round(least({sure}D + if({near}, {more}D, 0D), 1D), 4)))")
    return f"concat({', '.join(parts)})"


def enrich_phones(df: DataFrame, column: str, code: str) -> DataFrame:
    """``df`` with network and e164 of a phone column."""
    return df.withColumn("network", F.expr(network_sql(f"`{column}`", code))).withColumn("e164", F.expr(strict_phone_sql(f"`{column}`", code)))
