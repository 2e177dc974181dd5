"""Detectors: text column -> array of detections, in the JVM.

Every function here returns the SQL of a DETECTION array over the SQL of a text, so several detectors
of one document share a projection and nothing is shuffled. ``detect`` attaches them to a DataFrame.
Null text has no detections.
"""

from __future__ import annotations

import ipaddress
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.data import identifiers, money, names, phones, places
from veldspar.functions import spans
from veldspar.functions.shared import fresh, settled

#: What a text must have for any identifier format: four digits in a row, or thirteen capitals and digits.
_IDENTIFIER = "[0-9]{4}|[A-Z][A-Z0-9]{12}"


# ---- national identifiers ------------------------------------------------------------------------


def identifier_sql(t: str, package: str = "africa") -> str:
    """National identifiers of one country (ng, ke, za, gh) or of all; the formats' order settles overlaps.

    Only the package of all countries adds to the confidence when context words are near.
    """
    parts, none = [], f"cast(array() as array<{spans.DETECTION}>)"
    for key in identifiers.ORDER[package].split():
        f = identifiers.FORMATS[key]
        confidence = f.confidence + (identifiers.BONUS if f.valid else 0)
        score = f"least({confidence}D, 1.0D)"
        if package == "africa":
            near = spans.any_of(identifiers.CONTEXT[f.country], spans.window(t, identifiers.WINDOW))
            score = f"least({confidence}D + if({near}, {identifiers.CONTEXT_BONUS}D, 0D), 1.0D)"
        score = f"round({score}, 4)"
        found = spans.matches(t, f.pattern)
        if f.valid and f.valid != "true":
            found = f"filter({found}, s -> transform(array(s.m), m -> {f.valid})[0])"
        identity = "foundational" if f.id_type in identifiers.FOUNDATIONAL else "functional"
        rows = spans.detections(found, f"PII-2-{f.id_type}", f"rule:{f.country.lower()}_{f.id_type.lower()}", score, identity, f"'{f.country}'", f.facts)
        # most texts have few of the formats; the others cost one search each, without arrays
        parts.append(f"case when {t} rlike {spans.quoted(f.pattern)} then {rows} else {none} end")
    found = spans.by_confidence(spans.first_wins(f"flatten(array({', '.join(parts)}))"))
    return f"case when {t} rlike '{_IDENTIFIER}' then {found} else {none} end"


# ---- phones --------------------------------------------------------------------------------------


def _international() -> str:
    """Country of a digit string d that begins with a calling code, else null."""
    cases = []
    for country, (code, _, after, _) in phones.PLANS.items():
        heads = [p.lstrip("0") if phones.dialled_with_zero(country) else p for p in phones.prefixes(country)]
        cases.append(f"when d rlike '^{code}(?=[0-9]{{{after}}}$)(?:{'|'.join(heads)})' then '{country}'")
    return f"case {' '.join(cases)} end"


def _local(country: str) -> str:
    size = phones.PLANS[country][1]
    return f"when d rlike '^(?=[0-9]{{{size}}}$)(?:{'|'.join(phones.prefixes(country))})' then '{country}'"


def phone_country_sql(raw: str, home: str = "NG") -> tuple[str, str]:
    """SQL of (country by calling code, country by local form) of a raw number; null where none fits."""
    digits = f"regexp_replace({raw}, '[^0-9]', '')"
    order = [home, *(c for c in phones.PLANS if c != home)] if home in phones.PLANS else list(phones.PLANS)
    abroad = f"case when {raw} like '+%' or char_length({digits}) > 10 then transform(array({digits}), d -> {_international()})[0] end"
    local = f"transform(array({digits}), d -> case {' '.join(_local(c) for c in order)} end)[0]"
    return abroad, local


def e164_sql(raw: str, home: str = "NG") -> str:
    """The struct (country, international, local) of a raw number; null where no plan fits."""
    codes = ", ".join(f"'{c}', '{p[0]}'" for c, p in phones.PLANS.items())
    trunk = ", ".join(f"'{c}'" for c in phones.PLANS if phones.dialled_with_zero(c))
    digits = f"regexp_replace({raw}, '[^0-9]', '')"
    abroad, local = phone_country_sql(raw, home)
    return f"""transform(array(named_struct('d', {digits}, 'a', {abroad}, 'l', {local})), p -> case
        when char_length(p.d) not between 7 and 15 then null
        when p.a is not null then transform(array(substring(p.d, char_length(map({codes})[p.a]) + 1)), n -> named_struct('country', p.a,
            'international', concat('+', map({codes})[p.a], n), 'local', if(p.a in ({trunk}), concat('0', n), n)))[0]
        when p.l is not null then named_struct('country', p.l,
            'international', concat('+', map({codes})[p.l], if(p.l in ({trunk}), substring(p.d, 2), p.d)), 'local', p.d) end)[0]"""


def phone_sql(t: str, home: str = "NG", repeats: bool = False) -> str:
    """Mobile numbers of 31 countries. A number mentioned again is left out unless ``repeats``."""
    found = spans.matches(t, phones.CANDIDATE, f"{t} rlike '[0-9][^A-Za-z]{{5,}}[0-9]'")
    parsed = f"filter(transform({found}, s -> named_struct('start', s.start, 'end', s.end, 'm', s.m, 'p', {e164_sql('s.m', home)})), s -> s.p is not null)"
    rows = spans.detections(parsed, "PII-3-PHONE", "rule:phone", "0.9D", "inferred", "s.p.country", "map('international', s.p.international, 'country', s.p.country, 'local', s.p.local)")
    if repeats:
        return rows
    return f"""aggregate({rows}, cast(array() as array<{spans.DETECTION}>), (a, s) ->
        case when exists(a, o -> o.metadata['international'] = s.metadata['international']) then a else concat(a, array(s)) end)"""


# ---- network addresses ---------------------------------------------------------------------------


def ipv4_sql(t: str, versions: bool = False) -> str:
    """IPv4 addresses; one shortly after "v" or "version" is a version number unless ``versions``."""
    found = spans.matches(t, r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", rf"{t} rlike r'[0-9]\.[0-9]+\.[0-9]'")
    valid = r"forall(split(s.m, r'\.'), o -> int(o) <= 255 and (char_length(o) = 1 or o not like '0%'))"
    if not versions:
        valid += f" and not substring({t}, greatest(s.start - 16, 0) + 1, least(s.start, 16)) rlike r'(?i)\\bv(?:ersion)?\\b'"
    o = lambda i: rf"int(split(s.m, r'\.')[{i}])"
    flags = {
        "private": f"""{o(0)} in (0, 10, 127) or {o(0)} >= 240 or ({o(0)} = 172 and {o(1)} between 16 and 31) or ({o(0)} = 192 and {o(1)} = 168) or ({o(0)} = 169 and {o(1)} = 254)
            or ({o(0)} = 192 and {o(1)} = 0 and {o(2)} = 0 and not {o(3)} in (9, 10)) or ({o(0)} = 192 and {o(1)} = 0 and {o(2)} = 2) or ({o(0)} = 198 and {o(1)} between 18 and 19)
            or ({o(0)} = 198 and {o(1)} = 51 and {o(2)} = 100) or ({o(0)} = 203 and {o(1)} = 0 and {o(2)} = 113)""",
        "loopback": f"{o(0)} = 127",
        "multicast": f"{o(0)} between 224 and 239",
        "reserved": f"{o(0)} >= 240",
        "link_local": f"{o(0)} = 169 and {o(1)} = 254",
        "unspecified": "s.m = '0.0.0.0'",
    }
    facts = "map('family', 'ipv4', " + ", ".join(f"'{k}', string({v})" for k, v in flags.items()) + ")"
    return spans.detections(f"filter({found}, s -> {valid})", "PII-8-IP_ADDRESS", "rule:ip_ipv4", "1.0D", metadata=facts)


_HEX = "[A-Fa-f0-9]{1,4}"
_IPV6 = re.compile(
    rf"(?<![\w:])(?:::[Ff]{{4}}:[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}|(?:{_HEX}:){{2,7}}{_HEX}|(?:{_HEX}:){{1,6}}:{_HEX}|(?:{_HEX}:){{1,7}}:|::(?:{_HEX}:){{0,6}}{_HEX})"
    r"(?:%[A-Za-z0-9._-]+)?(?![\w:])"
)


def ipv6(text: Column) -> Column:
    """IPv6 addresses; the standard library decides what is one, which no built-in function can."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("m", pa.string()), ("facts", pa.map_(pa.string(), pa.string()))]))

    def found_in(text: str | None) -> list[dict]:
        found = []
        for m in _IPV6.finditer(text or ""):
            address, _, zone = m[0].partition("%")
            try:
                a = ipaddress.IPv6Address(address)
            except ValueError:
                continue
            flags = {"private": a.is_private, "loopback": a.is_loopback, "multicast": a.is_multicast, "reserved": a.is_reserved, "link_local": a.is_link_local, "unspecified": a.is_unspecified, "ipv4_mapped": a.ipv4_mapped is not None}
            facts = {"family": "ipv6"} | {k: str(v).lower() for k, v in flags.items()} | ({"zone": zone} if zone else {})
            found.append({"start": m.start(), "end": m.end(), "m": m[0], "facts": list(facts.items())})
        return found

    @F.arrow_udf("array<struct<start:int,end:int,m:string,facts:map<string,string>>>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([found_in(t) for t in texts.to_pylist()], kind)

    return run.asNondeterministic()(text)


# ---- digital identities --------------------------------------------------------------------------

_METHODS = ("key", "web", "ion", "ethr", "polygon", "jwk", "pkh", "indy", "sov")


def did_sql(t: str) -> str:
    found = spans.matches(t, r"\bdid:[a-z0-9]{1,32}:[A-Za-z0-9._:\-]{4,256}(?![A-Za-z0-9])", f"contains({t}, 'did:')")
    known = f"split(s.m, ':')[1] in ({', '.join(map(repr, _METHODS))})"
    rows = f"filter({found}, s -> split(s.m, ':')[1] <> 'method')"
    facts = f"map('method', split(s.m, ':')[1], 'identifier', array_join(slice(split(s.m, ':'), 3, 999), ':'), 'known_method', string({known}))"
    return spans.detections(rows, "PII-2-DID", "rule:digital_id_did", f"if({known}, 1.0D, 0.7D)", "federated", metadata=facts)


def wallet_sql(t: str) -> str:
    base58 = spans.matches(t, r"(?<![A-Za-z0-9])[13][a-km-zA-HJ-NP-Z1-9]{25,34}(?![A-Za-z0-9])", f"{t} rlike '[A-Za-z0-9]{{26}}'")
    bech32 = spans.matches(t, r"(?<![A-Za-z0-9])(?:bc1|tb1)[a-z0-9]{6,87}(?![A-Za-z0-9])", f"contains({t}, 'bc1') or contains({t}, 'tb1')")
    eth = spans.matches(t, r"(?<![A-Za-z0-9])0x[a-fA-F0-9]{40}(?![A-Za-z0-9])", f"contains({t}, '0x')")
    wallet = "PII-5-CRYPTO_WALLET"
    return f"""concat(
        {spans.detections(base58, wallet, "rule:digital_id_btc_base58", "0.85D", "federated", metadata="map('scheme', 'bitcoin', 'encoding', 'base58check', 'address_type', if(s.m like '1%', 'P2PKH', 'P2SH'))")},
        {spans.detections(bech32, wallet, "rule:digital_id_btc_bech32", "0.9D", "federated", metadata="map('scheme', 'bitcoin', 'encoding', 'bech32', 'address_type', 'SegWit', 'network', if(s.m like 'bc1%', 'mainnet', 'testnet'))")},
        {spans.detections(eth, wallet, "rule:digital_id_eth", "if(substring(s.m, 3) in (lower(substring(s.m, 3)), upper(substring(s.m, 3))), 0.85D, 0.9D)", "federated", metadata="map('scheme', 'ethereum', 'encoding', 'hex', 'checksum_verified', 'false')")})"""


def digital_sql(t: str) -> str:
    return spans.by_start(f"concat({did_sql(t)}, {wallet_sql(t)})")


# ---- money ---------------------------------------------------------------------------------------


def _marks(place: int) -> dict[str, str]:
    """Mark -> currency; a mark of several currencies belongs to the first."""
    out: dict[str, str] = {}
    for code, marks in money.CURRENCIES.items():
        for mark in marks[place]:
            out.setdefault(mark, code)
    return out


def amount_sql(raw: str) -> str:
    """Number in a written amount: the last of two kinds of separators is the decimal one; a lone comma
    is decimal before one or two digits."""
    return f"""transform(array(trim({raw})), r -> coalesce(try_cast(case
        when contains(r, ',') and contains(r, '.') then if(char_length(r) - locate(',', reverse(r)) > char_length(r) - locate('.', reverse(r)),
            replace(replace(r, '.', ''), ',', '.'), replace(r, ',', ''))
        when contains(r, ',') then if(char_length(element_at(split(r, ','), -1)) <= 2, replace(r, ',', '.'), replace(r, ',', ''))
        when contains(r, ' ') then replace(r, ' ', '') else r end as double), 0.0D))[0]"""


def money_sql(t: str) -> str:
    """Amounts with a mark before, a mark after or a word after; earlier kinds win overlaps."""
    parts = []
    for place, shape in enumerate((r"(?iu)(?<![A-Za-z0-9])(?:{marks})\s*{amount}(?![0-9])", r"(?iu)(?<![0-9]){amount}\s*(?:{marks})(?![A-Za-z0-9])", r"(?iu)(?<![0-9]){amount}\s+(?:{marks})(?![A-Za-z])"), 1):
        marks = _marks(place)
        longest = sorted(marks, key=len, reverse=True)
        found = spans.matches(t, shape.format(marks="|".join(map(_literal, longest)), amount=money.AMOUNT), f"{t} rlike '[0-9]'")
        mark = f"trim(regexp_replace(s.m, r'{money.AMOUNT}', ''))"
        exact = ", ".join(f"{spans.quoted(m)}, '{c}'" for m, c in marks.items())
        folded: dict[str, str] = {}
        for m, c in marks.items():
            folded.setdefault(m.lower(), c)
        loose = ", ".join(f"{spans.quoted(m)}, '{c}'" for m, c in folded.items())
        code = f"coalesce(map({exact})[{mark}], map({loose})[lower({mark})])"
        raw = f"regexp_extract(s.m, r'({money.AMOUNT})', 1)"
        facts = f"map('currency', {code}, 'amount', string({amount_sql(raw)}), 'raw_amount', {raw})"
        parts.append(f"filter({spans.detections(found, 'MONEY', 'rule:money', '0.85D', metadata=facts)}, s -> s.metadata['currency'] is not null)")
    return spans.by_start(spans.first_wins(f"concat({', '.join(parts)})"))


def _literal(mark: str) -> str:
    return re.sub(r"([.\\+*?()\[\]{}^$|])", r"\\\1", mark)


# ---- lexicons ------------------------------------------------------------------------------------


def lexicon_pattern(terms: list[str]) -> str:
    longest = sorted(set(terms), key=lambda x: (-len(x), x))
    return r"(?iU)\b(?:" + "|".join(map(_literal, longest)) + r")\b"


def name_sql(t: str, groups: list[list[str]] | None = None, confidence: float = 0.7) -> str:
    """Names of a lexicon of at least three letters; the longest at a place wins."""
    terms = [n for g in groups or names.GROUPS for n in g if len(n) >= 3]
    return spans.detections(spans.matches(t, lexicon_pattern(terms)), "PII-1-NAME", "rule:names_lexicon", f"{confidence}D")


def location_sql(t: str, cities: list[tuple] | None = None, confidence: float = 0.9) -> str:
    """Cities of a gazetteer by any of their names."""
    found = spans.matches(t, lexicon_pattern([n for c in cities or places.cities() for n in (c[0], *c[6])]))
    looked = f"transform({found}, s -> transform(array({city_sql('s.m', cities)}), c -> named_struct('start', s.start, 'end', s.end, 'm', s.m, 'c', c))[0])"
    facts = "map('country', s.c.country, 'country_name', s.c.country_name, 'region', s.c.region, 'canonical_name', s.c.name)"
    return spans.detections(looked, "PII-4-LOCATION", "rule:locations_gazetteer", f"{confidence}D", country="s.c.country", metadata=facts)


def city_sql(name: str, cities: list[tuple] | None = None) -> str:
    """The city of a name in any case, as a struct, or null; a name of several cities belongs to the first as a city's own, else as an alias."""
    known: dict[str, tuple] = {}
    for city in cities or places.cities():
        known[city[0].lower()] = city
        for other in city[6]:
            known.setdefault(other.lower(), city)
    entry = lambda c: f"named_struct('name', {spans.quoted(c[0])}, 'country', {spans.quoted(c[1])}, 'country_name', {spans.quoted(c[2])}, 'region', {spans.quoted(c[3])}, 'lat', '{c[4]}', 'lng', '{c[5]}')"
    return "map(" + ", ".join(f"{spans.quoted(k)}, {entry(c)}" for k, c in known.items()) + f")[lower({name})]"


# ---- contact details (an addition: statutes map them, so they should be found) --------------------


def contact_sql(t: str) -> str:
    """Email addresses and payment card numbers."""
    email = spans.matches(t, r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", f"contains({t}, '@')")
    card = spans.matches(t, r"\b(?:[0-9]{4}[\s\-]?){3}[0-9]{4}\b", f"{t} rlike '[0-9]{{4}}[^A-Za-z]?[0-9]{{4}}'")
    card = f"filter({card}, s -> luhn_check(regexp_replace(s.m, '[^0-9]', '')))"
    return f"concat({spans.detections(email, 'PII-3-EMAIL', 'rule:email', '0.95D')}, {spans.detections(card, 'PII-5-CARD', 'rule:card', '0.9D')})"


# ---- routing -------------------------------------------------------------------------------------

CROSS = ("names", "locations", "ip", "digital_id", "addr", "core")


def default_packages(jurisdiction: str | None) -> list[str]:
    code = (jurisdiction or "").upper()
    return [code.lower() if code in ("NG", "KE", "ZA", "GH") else "africa", *CROSS]


def detect(df: DataFrame, text: str = "text", into: str = "detections", jurisdiction: str | None = None, packages: list[str] | None = None,
           groups: list[list[str]] | None = None, cities: list[tuple] | None = None, repeats: bool = False) -> DataFrame:
    """``df`` and the array of detections of the chosen packages, in the packages' order.

    An unknown package contributes nothing. Only IPv6 and addresses run in Python, and only if asked for.
    """
    t = spans.text_of(text)
    wanted = packages or default_packages(jurisdiction)
    six, found = fresh(df, "ipv6", "addresses")
    parts: list[str] = []
    for name in wanted:
        if name in identifiers.ORDER:
            parts.append(identifier_sql(t, name))
        elif name == "names":
            parts.append(name_sql(t, groups))
        elif name == "locations":
            parts.append(location_sql(t, cities))
        elif name == "ip":
            # only texts that have two colons near each other go to Python
            df = df.withColumn(six, F.when(F.expr(f"{t} rlike '[A-Fa-f0-9]?:[A-Fa-f0-9]{{0,4}}:'"), ipv6(F.expr(t))))
            kind = "array<struct<start:int,end:int,m:string,facts:map<string,string>>>"
            v6 = spans.detections(f"coalesce(`{six}`, cast(array() as {kind}))", "PII-8-IP_ADDRESS", "rule:ip_ipv6", "1.0D", metadata="s.facts")
            parts.append(spans.by_start(f"concat({ipv4_sql(t)}, {v6})"))
        elif name == "digital_id":
            parts.append(digital_sql(t))
        elif name == "contact":
            parts.append(contact_sql(t))
        elif name == "money":
            parts.append(money_sql(t))
        elif name == "addr":
            from veldspar.operators import addresses

            df = df.withColumn(found, F.when(F.expr(f"{t} rlike r'{addresses.HINT}'"), addresses.parse(F.expr(t))))
            facts = "map_filter(map('street', s.components.street, 'city', s.components.city, 'region', s.components.region, 'country', s.components.country), (k, v) -> v is not null)"
            rows = f"transform(coalesce(`{found}`, cast(array() as {addresses.ADDRESS})), a -> named_struct('start', a.start, 'end', a.end, 'm', a.raw, 'components', a.components, 'confidence', a.confidence))"
            parts.append(spans.detections(rows, "PII-4-ADDRESS", "rule:addr_parser", "s.confidence", country="s.components.country", metadata=facts))
        elif name == "core":
            parts.append(phone_sql(t, jurisdiction or "NG", repeats))
    none = f"cast(array() as array<{spans.DETECTION}>)"
    return settled(df.withColumn(into, F.expr(f"concat({', '.join([none, *parts])})")).drop(*{six, found} & set(df.columns)), into)
