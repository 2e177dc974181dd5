"""Entities, personal data and identity evidence of a text: ordered pattern lists with overlap rules.

The lists of one scan are columns of a projection and the overlap rules one fold over them, in the JVM. Backends that need a model are a function given by the caller.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.data import money
from veldspar.functions import spans
from veldspar.functions.shared import fresh, settled
from veldspar.operators import detectors

ENTITY = "struct<text:string,entity_type:string,confidence:double,start:int,end:int,source:string,metadata:map<string,string>>"
PII = "struct<text:string,pii_type:string,confidence:double,start:int,end:int,country:string>"
EVIDENCE = "struct<text:string,label:string,confidence:double,start:int,end:int,detector_source:string,country_hint:string,validator_status:string,metadata:map<string,string>>"

_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_DAY, _MON, _YEAR = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"

# Patterns.
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
URL = r"https?://[^\s<>\x22\x27]+|www\.[^\s<>\x22\x27]+"
DATES = [rf"\b{_DAY}[/\-]{_MON}[/\-]{_YEAR}\b", rf"\b{_YEAR}[/\-]{_MON}[/\-]{_DAY}\b", rf"(?i)\b{_MONTH}\s+[0-9]{{1,2}}(?:,?\s+[0-9]{{4}})?\b", rf"(?i)\b[0-9]{{1,2}}\s+{_MONTH}(?:\s+[0-9]{{4}})?\b"]
ISBN = r"(?i)\bISBN[-:\s]*(?:97[89][-\s]?)?(?:[0-9][-\s]?){9}[0-9Xx]\b|\b97[89][-\s]?(?:[0-9][-\s]?){9}[0-9]\b"
GENERIC_PHONE = r"(?<![0-9])(?:\+?[0-9]{1,3}[\s\-]?)?(?:\(?[0-9]{2,4}\)?[\s\-]?)[0-9]{3,4}[\s\-]?[0-9]{3,4}(?![0-9])"
CARD = r"\b(?:[0-9]{4}[\s\-]?){3}[0-9]{4}\b"
ACCOUNT = r"(?i)(?:account|acct|a/c)\s*(?:number|no|num|#|:|\s)\s*(?:#|:|\s)\s*[0-9]{6,12}"
GENERIC = [
    ("email", EMAIL, 0.95),
    ("swift_bic", r"\b[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}(?:[A-Z0-9]{3})?\b", 0.90),
    ("account_number", ACCOUNT, 0.85),
    ("time", r"\b[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s*(?:AM|PM|am|pm)?\b", 0.85),
    ("date", DATES[1], 0.85),
    ("date", DATES[0], 0.85),
    ("date", DATES[2], 0.85),
    ("postcode", r"\b[0-9]{5}(?:-[0-9]{4})?\b", 0.60),
    ("state", r"(?<=,\s)[A-Z]{2}(?=\s[0-9]{5})", 0.80),
    ("occupation", r"\b(?:Senior|Junior|Chief|Lead|Principal|Staff|Head)\s+(?:[A-Z][a-z]+\s+){0,3}(?:Engineer|Architect|Analyst|Manager|Director|Officer|Scientist|Designer|Developer|Consultant|Administrator)\b", 0.80),
    ("title", r"\b(?:Dr|Prof|Mr|Mrs|Ms|Eng|Rev|Chief|Alhaji|Hajia)\.?\s", 0.75),
]
TITLED = r"\b(?:Dr|Prof|Mr|Mrs|Ms|Miss|Eng|Rev|Chief|Alhaji|Hajia|Hon|Senator|Justice|Barrister|Architect|Pastor|Imam|Sheikh|Dame|Sir|Malam|Mallam)\.?\s+(?:[A-Z][a-z]+(?:\s+|$)){1,4}"
LABELLED = r"(?:[Pp]atient|[Nn]ame|[Cc]lient|[Bb]eneficiary|[Aa]pplicant|[Oo]wner|[Hh]older|[Aa]ttention|[Ss]igned|[Ff]rom|[Dd]ear|[Vv]oter|[Ss]ubscriber)\s*[:=]\s*(?:[A-Z][a-z]*\.?\s+){1,4}[A-Z][a-z]+(?=[,.\s]*(?:[A-Z][a-z]*:|,|\.|$|\s*[0-9]|\s+[a-z]))"
TITLES = ("dr", "prof", "mr", "mrs", "ms", "eng", "rev", "chief", "alhaji", "hajia", "hon")
ID_LABELS = ("national_id", "nin", "bvn", "ghana_card", "kenya_id", "sa_id", "passport_number", "ssn", "tin", "pvc", "aadhaar")
CONTACT_LABELS = ("phone_number", "email", "phone")
FINANCIAL_LABELS = ("account_number", "swift_bic", "iban", "credit_card", "money", "currency")
STRUCTURED_LABELS = (*ID_LABELS, "swift_bic", "iban", "credit_card", "account_number", "postcode", "state")
STAMPED = ("phone_number", "email", "first_name", "last_name", "person", "street_address", "city", "occupation")
PLAIN_LABELS = ("organization", "company", "employer", "location", "city", "state", "country", "occupation", "title", "url", "date_time", "date", "time")


class _Scan:
    """Ordered lists of spans, folded into one array.

    Every list depends on the text alone, so each is a column of one projection; the overlap rules are one
    fold over these columns. No expression occurs twice, so plans grow with the sum of the lists.
    """

    def __init__(self, df: DataFrame, text: str, into: str, kind: str) -> None:
        self.df, self.t, self.kind, self.into = df, spans.text_of(text), kind, into
        self.lists: list[str] = []
        self.rules: list[str] = []

    def add(self, found: str, check: bool = True, drops: str = "") -> _Scan:
        """Append spans; with ``check`` only those that overlap none before them. Spans of one list never overlap each other.

        Spans before them whose type is ``drops`` go if one of the new ones overlaps them.
        """
        self.lists.append(found)
        self.rules.append(f"'check', {str(check).lower()}, 'drops', '{drops}'")
        return self

    def done(self) -> DataFrame:
        columns = fresh(self.df, *(f"scan_{self.into}_{i}" for i in range(len(self.lists))))
        df = self.df.withColumns({c: F.expr(found) for c, found in zip(columns, self.lists)}).transform(settled, *columns)
        before = f"if(g.drops = '', a, filter(a, e -> e.entity_type <> g.drops or not exists(g.s, s -> {spans.overlap('s', 'e')})))" if any("'drops', ''" not in r for r in self.rules) else "a"
        kept = f"if(g.check and size(a) > 0, filter(g.s, s -> not exists(a, o -> {spans.overlap('o', 's')})), g.s)"
        groups = ", ".join(f"named_struct({rule}, 's', `{c}`)" for rule, c in zip(self.rules, columns))
        df = df.withColumn(columns[0], F.expr(f"aggregate(array({groups}), cast(array() as array<{self.kind}>), (a, g) -> concat({before}, {kept}))"))
        df = df.drop(self.into) if self.into in df.columns else df
        return df.withColumnRenamed(columns[0], self.into).drop(*columns[1:])


def _entity(found: str, kind: str, confidence: str, source: str = "'regex'", text: str = "s.m", metadata: str = "map()") -> str:
    return f"transform({found}, s -> named_struct('text', {text}, 'entity_type', '{kind}', 'confidence', cast({confidence} as double), 'start', s.start, 'end', s.end, 'source', {source}, 'metadata', cast({metadata} as map<string,string>)))"


def isbn_sql(raw: str) -> str:
    """Struct (digits, kind): the kind is empty where the check digit is wrong."""
    return f"""transform(array(upper(regexp_replace({raw}, '[^0-9Xx]', ''))), d -> named_struct('digits', d, 'kind', case
        when d rlike '^[0-9]{{13}}$' and aggregate(sequence(1, 13), 0, (a, i) -> a + int(substr(d, i, 1)) * if(i % 2 = 1, 1, 3)) % 10 = 0 then 'ISBN-13'
        when d rlike '^[0-9]{{9}}[0-9X]$' and aggregate(sequence(1, 10), 0, (a, i) -> a + if(substr(d, i, 1) = 'X', 10, int(substr(d, i, 1)) * (11 - i))) % 11 = 0 then 'ISBN-10'
        else '' end))[0]"""


def extract(df: DataFrame, text: str = "text", into: str = "entities", types: list[str] | None = None, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """Entities in the order they are looked for; only ISBN, phone, money and date respect earlier spans.

    ``types`` limits what is looked for. ``model`` maps the text column to an array of entities of its own
    (a neural or remote proposer); they fill in around validated spans, ahead of the patterns'.
    """
    want = {k.upper() for k in types} if types else None
    scan = _Scan(df, text, into, ENTITY)
    t = scan.t

    def wanted(kind: str) -> bool:
        return want is None or kind in want

    if wanted("ISBN"):
        raw = "regexp_replace(s.m, '^(?i)ISBN[-:\\\\\\\\s]*', '')"
        found = f"filter(transform({spans.matches(t, ISBN, f'{t} rlike r{chr(39)}[0-9][0-9 -]{{8}}{chr(39)}')}, s -> named_struct('start', s.start, 'end', s.end, 'm', s.m, 'b', {isbn_sql(raw.replace(chr(92) * 4, chr(92) * 2))})), s -> s.b.kind <> '')"
        scan.add(_entity(found, "ISBN", "0.95D", text="trim(s.m)", metadata="map('isbn_normalised', s.b.digits, 'isbn_type', s.b.kind)"))
    if wanted("PHONE"):
        scan.add(f"transform({detectors.phone_sql(t)}, d -> named_struct('text', d.text, 'entity_type', 'PHONE', 'confidence', 0.9D, 'start', d.start, 'end', d.end, 'source', 'african', 'metadata', cast(map('country', d.country, 'international', d.metadata['international']) as map<string,string>)))")
        scan.add(_entity(spans.matches(t, GENERIC_PHONE, f"{t} rlike '[0-9]{{3}}'"), "PHONE", "0.7D", text="trim(s.m)"))
    if wanted("EMAIL"):
        scan.add(_entity(spans.matches(t, EMAIL, f"contains({t}, '@')"), "EMAIL", "0.95D"), check=False)
    if wanted("NATIONAL_ID"):
        scan.add(f"transform({detectors.identifier_sql(t)}, d -> named_struct('text', d.text, 'entity_type', 'NATIONAL_ID', 'confidence', d.confidence, 'start', d.start, 'end', d.end, 'source', 'african', 'metadata', cast(map('country', d.country, 'id_type', substring(d.category, 7)) as map<string,string>)))", check=False, drops="PHONE")
    if wanted("MONEY"):
        scan.add(f"transform({detectors.money_sql(t)}, d -> named_struct('text', d.text, 'entity_type', 'MONEY', 'confidence', 0.85D, 'start', d.start, 'end', d.end, 'source', 'african', 'metadata', map_filter(d.metadata, (k, v) -> k in ('currency', 'amount'))))", check=False)
        scan.add(_entity(spans.matches(t, money.STANDARD, f"{t} rlike '[0-9]'"), "MONEY", "0.85D"))
    if wanted("DATE"):
        for pattern in DATES:
            scan.add(_entity(spans.matches(t, pattern, f"{t} rlike '[0-9]'"), "DATE", "0.8D"))
    if wanted("URL"):
        scan.add(_entity(spans.matches(t, URL, f"contains({t}, 'http') or contains({t}, 'www.')"), "URL", "0.95D"), check=False)
    df = scan.done()
    if model is not None:
        (proposed,) = fresh(df, "model")
        df = df.withColumn(proposed, model(F.expr(t)).cast(f"array<{ENTITY}>"))
        df = df.withColumn(into, F.expr(merge_sql(f"`{proposed}`", f"`{into}`"))).drop(proposed)
    return settled(df, into)


def merge_sql(primary: str, secondary: str, trusted: str = "african") -> str:
    """Validated spans of the second list, then the first list's, then the second's others, each where nothing overlaps."""
    step = lambda start, rest: f"aggregate({rest}, {start}, (a, s) -> case when exists(a, o -> {spans.overlap('o', 's')}) then a else concat(a, array(s)) end)"
    sure = f"filter({secondary}, e -> e.source = '{trusted}')"
    return step(step(sure, primary), f"filter({secondary}, e -> e.source <> '{trusted}')")


def pii_type_sql(category: str, country: str) -> str:
    """Label of a national identifier."""
    kind = f"substring({category}, 7)"
    return f"""case when contains({kind}, 'NIN') then if({country} = 'NG', 'NIGERIAN_NIN', concat({country}, '_NIN')) when contains({kind}, 'BVN') then 'NIGERIAN_BVN'
        when contains({kind}, 'GHANA_CARD') then 'GHANA_CARD' when contains({kind}, 'KENYA_ID') then 'KENYA_ID' when contains({kind}, 'SA_ID') then 'SOUTH_AFRICA_ID'
        else concat({country}, '_NATIONAL_ID') end"""


def personal_data(df: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """Identifiers, then phones where nothing is yet, then emails and cards."""
    scan = _Scan(df, text, into, PII)
    t = scan.t
    make = lambda found, kind, sure, raw="s.m": f"transform({found}, s -> named_struct('text', {raw}, 'pii_type', '{kind}', 'confidence', {sure}D, 'start', s.start, 'end', s.end, 'country', cast(null as string)))"
    scan.add(f"transform({detectors.identifier_sql(t)}, d -> named_struct('text', d.text, 'pii_type', {pii_type_sql('d.category', 'd.country')}, 'confidence', d.confidence, 'start', d.start, 'end', d.end, 'country', d.country))", check=False)
    scan.add(make(spans.matches(t, GENERIC_PHONE, f"{t} rlike '[0-9]{{3}}'"), "PHONE_NUMBER", 0.7, "trim(s.m)"))
    scan.add(make(spans.matches(t, EMAIL, f"contains({t}, '@')"), "EMAIL", 0.95), check=False)
    card = spans.matches(t, CARD, f"{t} rlike '[0-9]{{4}}[^A-Za-z]?[0-9]{{4}}'")
    scan.add(make(f"filter({card}, s -> luhn_check(regexp_replace(s.m, '[^0-9]', '')))", "CREDIT_CARD", 0.9), check=False)
    return scan.done()


# ---- evidence ------------------------------------------------------------------------------------


def _evidence(found: str, label: str, sure: str, status: str = "''", source: str = "'regex'", text: str = "trim(s.m)", metadata: str = "map()", country: str = "''") -> str:
    return f"""transform({found}, s -> named_struct('text', {text}, 'label', {label}, 'confidence', cast({sure} as double), 'start', s.start, 'end', s.end,
        'detector_source', {source}, 'country_hint', {country}, 'validator_status', {status}, 'metadata', cast({metadata} as map<string,string>)))"""


def _tail_group(found: str, pattern: str) -> str:
    """Spans cut to what ``pattern`` matches at their end."""
    return f"transform({found}, s -> transform(array(regexp_extract(s.m, r'({pattern})$', 1)), g -> named_struct('start', s.end - char_length(g), 'end', s.end, 'm', g))[0])"


def deterministic(df: DataFrame, text: str = "text", into: str = "evidence", groups: list[list[str]] | None = None) -> DataFrame:
    """Identifiers, phones, accounts, money, general patterns and names by context; earlier spans win."""
    from veldspar.data import names

    scan = _Scan(df, text, into, EVIDENCE)
    t = scan.t
    digits = f"{t} rlike '[0-9]{{3}}'"
    scan.add(f"""transform({detectors.identifier_sql(t)}, d -> named_struct('text', d.text, 'label', lower(substring(d.category, 7)), 'confidence', d.confidence, 'start', d.start, 'end', d.end,
        'detector_source', 'african', 'country_hint', d.country, 'validator_status', if(size(d.metadata) > 0, 'checksum_valid', 'format_valid'), 'metadata', d.metadata))""")
    scan.add(f"""transform({detectors.phone_sql(t)}, d -> named_struct('text', d.text, 'label', 'phone_number', 'confidence', 0.92D, 'start', d.start, 'end', d.end,
        'detector_source', 'african', 'country_hint', d.country, 'validator_status', 'format_valid', 'metadata', cast(map('international', d.metadata['international']) as map<string,string>)))""")
    scan.add(_evidence(_tail_group(spans.matches(t, ACCOUNT, digits), "[0-9]{6,12}"), "'account_number'", "0.85D", "'context_valid'"))
    scan.add(_evidence(spans.matches(t, GENERIC_PHONE, digits), "'phone_number'", "0.7D", "'unchecked'"))
    scan.add(f"""transform({detectors.money_sql(t)}, d -> named_struct('text', d.text, 'label', 'money', 'confidence', 0.85D, 'start', d.start, 'end', d.end,
        'detector_source', 'african', 'country_hint', '', 'validator_status', '', 'metadata', map_filter(d.metadata, (k, v) -> k in ('currency', 'amount'))))""")
    scan.add(_evidence(spans.matches(t, money.STANDARD, f"{t} rlike '[0-9]'"), "'money'", "0.85D", text="s.m"))
    for label, pattern, sure in GENERIC:
        found = spans.matches(t, pattern)
        scan.add(_evidence(_tail_group(found, "[0-9]{6,12}") if label == "account_number" else found, f"'{label}'", f"{sure}D"))
    first = f"transform({spans.matches(t, TITLED)}, s -> transform(array(regexp_replace(s.m, r'^[A-Za-z]+\\.?\\s+', '')), g -> named_struct('start', s.end - char_length(g), 'end', s.end - char_length(g) + char_length(trim(g)), 'm', trim(g)))[0])".replace("\\\\", "\\")
    scan.add(_evidence(f"filter({first}, s -> char_length(s.m) >= 3)", "'person'", "0.6D", source="'heuristic'", text="s.m"))
    second = f"transform({spans.matches(t, LABELLED)}, s -> transform(array(regexp_replace(s.m, r'^[A-Za-z]+\\s*[:=]\\s*', '')), g -> named_struct('start', s.end - char_length(g), 'end', s.end, 'm', g))[0])".replace("\\\\", "\\")
    scan.add(_evidence(f"filter({second}, s -> char_length(s.m) >= 3)", "'person'", "0.55D", source="'heuristic'", text="s.m"))
    scan.add(_dictionary(t, groups or names.GROUPS))
    return scan.done()


def _dictionary(t: str, groups: list[list[str]]) -> str:
    """Two or three capitalised words in a row of which one of the first two is a known name.

    A fold over the words: ``skip`` counts words that the last name has used.
    """
    known = ", ".join(sorted({spans.quoted(p.lower()) for g in groups for n in g for p in n.split()}))
    words = spans.matches(t, r"(?U)\b[A-Z][a-z]{2,}\b")
    near = "size(x) >= i + {0} and x[i + {0}].start - x[i + {1}].end <= 3"
    step = f"""case when a.skip > 0 then named_struct('skip', a.skip - 1, 's', a.s)
        when {near.format(1, 0).replace('>=', '>')} and (lower(x[i].m) in ({known}) or lower(x[i + 1].m) in ({known})) then
          transform(array(if({near.format(2, 1).replace('>=', '>')}, 2, 1)), n -> named_struct('skip', n, 's', concat(a.s, array(named_struct('start', x[i].start, 'end', x[i + n].end,
            'm', substring({t}, x[i].start + 1, x[i + n].end - x[i].start))))))[0]
        else a end"""
    folded = f"""transform(array({words}), x -> aggregate(if(size(x) > 1, sequence(0, size(x) - 1), cast(array() as array<int>)),
        named_struct('skip', 0, 's', cast(array() as array<{spans.MATCH}>)), (a, i) -> {step}, a -> a.s))[0]"""
    return _evidence(f"filter({folded}, s -> char_length(s.m) >= 4)", "'person'", "0.55D", source="'heuristic'", text="s.m", metadata="map('method', 'cultural_name_dictionary')")


def adjudicate_sql(a: str, b: str) -> str:
    """Two evidence lists merged: in order of start and confidence, each span meets the last one kept.

    Validated beats not validated, then structured labels beat others, then higher confidence; ties stay.
    """
    both = f"concat({a}, {b})"
    order = f"transform(array_sort(transform({both}, (s, i) -> named_struct('s', s, 'i', i)), (x, y) -> case when x.s.start <> y.s.start then x.s.start - y.s.start when x.s.confidence > y.s.confidence then -1 when x.s.confidence < y.s.confidence then 1 else x.i - y.i end), k -> k.s)"
    labels = ", ".join(map(repr, STRUCTURED_LABELS))
    rank = lambda s: f"(if({s}.validator_status in ('checksum_valid', 'format_valid'), 2, 0) + if({s}.label in ({labels}) or ({s}.label = 'phone_number' and {s}.detector_source = 'african'), 1, 0))"
    wins = f"({rank('s')} > {rank('p')} or ({rank('s')} = {rank('p')} and s.confidence > p.confidence))"
    return f"""aggregate({order}, cast(array() as array<{EVIDENCE}>), (kept, s) -> case when size(kept) = 0 then array(s)
        else transform(array(element_at(kept, -1)), p -> case when s.start >= p.end then concat(kept, array(s))
          when {wins} then concat(slice(kept, 1, size(kept) - 1), array(s)) else kept end)[0] end)"""


def split_names_sql(evidence: str) -> str:
    """Each person of two words or more is followed by first and last name, without titles."""
    titles = ", ".join(map(repr, TITLES))
    parts = f"filter(split(trim(e.text), r'\\s+'), w -> not lower(trim(trailing '.' from w)) in ({titles}))".replace("\\\\", "\\")
    one = lambda label, word, at: f"named_struct('text', {word}, 'label', '{label}', 'confidence', e.confidence * 0.95D, 'start', e.start + {at}, 'end', e.start + {at} + char_length({word}), 'detector_source', e.detector_source, 'country_hint', '', 'validator_status', '', 'metadata', cast(map('derived_from', 'person_split') as map<string,string>))"
    last_at = "(char_length(e.text) - locate(reverse(element_at(p, -1)), reverse(e.text)) - char_length(element_at(p, -1)) + 1)"
    return f"""flatten(transform({evidence}, e -> case when e.label <> 'person' or not contains(trim(e.text), ' ') then array(e) else transform(array({parts}), p ->
        case when size(p) < 2 then array(e) else array(e, {one('first_name', 'p[0]', '(locate(p[0], e.text) - 1)')}, {one('last_name', 'element_at(p, -1)', last_at)}) end)[0] end))"""


def stamp_sql(evidence: str, t: str, jurisdiction: str = "auto") -> str:
    """Country of the document (given, most hinted, else most words) put on evidence without one; its identifiers gain 0.05."""
    if jurisdiction == "auto":
        hints = f"filter(transform({evidence}, e -> e.country_hint), h -> h is not null and h <> '')"
        votes = f"transform(array_distinct({hints}), (h, i) -> named_struct('n', size(filter({hints}, x -> x = h)), 'i', -i, 'c', h))"
        home = f"coalesce(array_max({votes}).c, {_votes(t)})"
    else:
        home = spans.quoted(jurisdiction.upper())
    labels, ids = ", ".join(map(repr, STAMPED)), ", ".join(map(repr, ID_LABELS))
    hint = f"if(coalesce(e.country_hint, '') = '' and e.label in ({labels}), home, e.country_hint)"
    return f"""transform(array({home}), home -> if(home = '', {evidence}, transform({evidence}, e -> named_struct('text', e.text, 'label', e.label,
        'confidence', if({hint} = home and e.label in ({ids}), least(e.confidence + 0.05D, 1.0D), e.confidence), 'start', e.start, 'end', e.end, 'detector_source', e.detector_source,
        'country_hint', {hint}, 'validator_status', e.validator_status, 'metadata', e.metadata))))[0]"""


def _votes(t: str) -> str:
    from veldspar.operators import addresses

    return addresses.vote_sql(t)


def evidence(df: DataFrame, text: str = "text", into: str = "evidence", jurisdiction: str = "auto", split_names: bool = True, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """Patterns, a model's proposals if given, adjudicated, names split, country stamped, by start."""
    df = deterministic(df, text, into)
    steps = [f"`{into}`"]
    if model is not None:
        (proposed,) = fresh(df, "model")
        df = df.withColumn(proposed, model(F.expr(spans.text_of(text))).cast(f"array<{EVIDENCE}>"))
        df = df.withColumn(into, F.expr(adjudicate_sql(steps[0], f"`{proposed}`"))).drop(proposed)
    if split_names:
        df = df.withColumn(into, F.expr(split_names_sql(steps[0])))
    df = df.withColumn(into, F.expr(stamp_sql(steps[0], spans.text_of(text), jurisdiction)))
    return df.withColumn(into, F.expr(f"transform(array_sort(transform(`{into}`, (s, i) -> named_struct('s', s, 'i', i)), (a, b) -> case when a.s.start <> b.s.start then a.s.start - b.s.start else a.i - b.i end), k -> k.s)")).transform(settled, into)


def sensitive(df: DataFrame, text: str = "text", into: str = "sensitive", jurisdiction: str = "auto") -> DataFrame:
    """Evidence of sensitive labels and personal data not covered by it, one a span, with the advice to mask or to review."""
    found, pii = fresh(df, "evidence", "pii")
    df = personal_data(evidence(df, text, found, jurisdiction, split_names=False), text, pii)
    labels = ", ".join(map(repr, (*ID_LABELS, *CONTACT_LABELS, *FINANCIAL_LABELS, "first_name", "last_name", "date_of_birth", "street_address", "postcode")))
    plain = ", ".join(map(repr, PLAIN_LABELS))
    advice = "if(e.validator_status in ('checksum_valid', 'format_valid') or e.confidence >= 0.85, 'mask', 'review_required')"
    kind = "struct<text:string,label:string,confidence:double,start:int,end:int,country_hint:string,validator_status:string,detector_source:string,redaction:string>"
    a = f"transform(filter(`{found}`, e -> e.label in ({labels})), e -> named_struct('text', e.text, 'label', e.label, 'confidence', e.confidence, 'start', e.start, 'end', e.end, 'country_hint', e.country_hint, 'validator_status', e.validator_status, 'detector_source', e.detector_source, 'redaction', {advice}))"
    b = f"filter(transform(`{pii}`, e -> named_struct('text', e.text, 'label', lower(e.pii_type), 'confidence', e.confidence, 'start', e.start, 'end', e.end, 'country_hint', coalesce(e.country, ''), 'validator_status', '', 'detector_source', 'pii', 'redaction', if(e.confidence >= 0.85, 'mask', 'review_required'))), e -> not e.label in ({plain}))"
    once = f"aggregate(concat({a}, {b}), cast(array() as array<{kind}>), (x, s) -> case when exists(x, o -> o.start = s.start and o.end = s.end) then x else concat(x, array(s)) end)"
    return settled(df.withColumn(into, F.expr(spans.by_start(once))).drop(found, pii), into)


def detect(df: DataFrame, text: str = "text", into: str = "entities", types: list[str] | None = None, include_pii: bool = True, cities: list[tuple] | None = None, longest: int = 500_000, error: str | None = None) -> DataFrame:
    """Entities and personal data outside them, locations with coordinates, filtered, by start and end.

    A text over ``longest`` characters, which an interactive call would refuse, has no entities; the column
    ``error``, if named, says so. The other rows are not affected.
    """
    (pii,) = fresh(df, "pii")
    df = extract(df, text, into, types)
    if include_pii:
        df = personal_data(df, text, pii)
        extra = f"transform(filter(`{pii}`, p -> not exists(`{into}`, o -> {spans.overlap('o', 'p')})), p -> named_struct('text', p.text, 'entity_type', p.pii_type, 'confidence', p.confidence, 'start', p.start, 'end', p.end, 'source', 'pii', 'metadata', if(p.country is null, cast(map() as map<string,string>), cast(map('country', p.country) as map<string,string>))))"
        df = df.withColumn(into, F.expr(f"concat(`{into}`, {extra})")).drop(pii)
    there = "map_filter(map('lat', c.lat, 'lng', c.lng, 'country', c.country), (k, v) -> v is not null)"
    names = ["text", "entity_type", "confidence", "start", "end", "source"]
    placed = f"transform(array({detectors.city_sql('e.text', cities)}), c -> map_concat(map_filter(e.metadata, (k, v) -> c is null or not k in ('lat', 'lng', 'country')), {there}))[0]"
    df = df.withColumn(into, F.expr(f"transform(`{into}`, e -> named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, e.{n}' for n in names)}, 'metadata', if(e.entity_type = 'LOCATION', {placed}, e.metadata)))"))
    if types:
        df = df.withColumn(into, F.expr(f"filter(`{into}`, e -> e.entity_type in ({', '.join(map(spans.quoted, types))}))"))
    (refused,) = fresh(df, "refused")
    df = df.withColumn(refused, F.expr(f"char_length({spans.text_of(text)}) > {longest}"))
    df = df.withColumn(into, F.expr(spans.by_start(f"if(`{refused}`, slice(`{into}`, 1, 0), `{into}`)")))
    if error:
        df = df.withColumn(error, F.expr(f"if(`{refused}`, 'a text exceeds {longest} characters', cast(null as string))"))
    return settled(df.drop(refused), into)


# ---- proposals of a language model ----------------------------------------------------------------

_PROPOSED = {
    "PERSON": ("person", "name", "full_name"), "ORGANIZATION": ("organization", "organisation", "org", "company"), "LOCATION": ("location", "address", "place", "city"), "PHONE": ("phone", "phone_number"),
    "EMAIL": ("email",), "NATIONAL_ID": ("national_id", "nin", "bvn", "id"), "DATE": ("date", "date_of_birth"), "MONEY": ("money", "amount"), "URL": ("url",), "ISBN": ("isbn",),
}


def proposals_sql(t: str, answer: str) -> str:
    """Entities in a model's JSON answer, bare or fenced: unknown types and texts that the document lacks are dropped.

    Claimed offsets count only if the text is there; else its first place, with or without case. Confidence
    is kept within 0 and 1, 0.7 if it is no number.
    """
    kind = "struct<entities:array<struct<text:string,entity_type:string,label:string,type:string,start:double,end:double,confidence:string>>>"
    fenced = f"coalesce(nullif(regexp_extract({answer}, r'(?s)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1), ''), {answer})".replace("\\\\", "\\")
    cases = " ".join(f"when lower(r) in ({', '.join(repr(w) for w in (*words, name.lower()))}) then '{name}'" for name, words in _PROPOSED.items())
    typed = f"transform(array(trim(coalesce(e.entity_type, e.label, e.type, ''))), r -> case {cases} end)[0]"
    text = "trim(coalesce(e.text, ''))"
    claimed = f"e.start >= 0 and e.end > e.start and e.end <= char_length({t}) and substring({t}, int(e.start) + 1, int(e.end - e.start)) = {text}"
    start = f"case when {text} = '' then -1 when {claimed} then int(e.start) when locate({text}, {t}) > 0 then locate({text}, {t}) - 1 else locate(lower({text}), lower({t})) - 1 end"
    made = f"""transform(coalesce(from_json({fenced}, '{kind}').entities, array()), e -> transform(array({start}), s -> named_struct('text', {text}, 'entity_type', {typed},
        'confidence', if(try_cast(e.confidence as double) is null, 0.7D, greatest(0D, least(1D, try_cast(e.confidence as double)))), 'start', s, 'end', s + char_length({text}), 'source', 'llm', 'metadata', map('source_provider', 'llm')))[0])"""
    return spans.by_start(f"filter({made}, e -> e.start >= 0 and e.entity_type is not null)")
