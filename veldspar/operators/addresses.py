"""Street and box addresses, landmarks, countries.

The grammar (optional plot and number, capitalised street, typed tail) needs named groups and a look
back at the text before the match, so it runs as one Arrow function; scoring and jurisdiction ladders
that need neither are SQL.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veldspar.data import places
from veldspar.functions import spans

COMPONENTS = ("plot", "street_number", "street", "anchor", "anchor_type", "neighborhood", "area", "city", "region", "country", "postal_code")
ADDRESS = f"array<struct<raw:string,start:int,end:int,components:struct<{','.join(f'{c}:string' for c in COMPONENTS)}>,country_confidence:double,confidence:double>>"
#: Only texts that have one of these go to Python.
HINT = rf"(?i)\b(?:{'|'.join(places.STREETS)}|box)\b"

_PART = r"(?:[A-Z][\w'\-]{1,25}(?:\s+(?:[A-Z][\w'\-]{1,25}|es|of|the)){0,3}|\d{4,6}|[A-Z]{2}-\d{3}-\d{4})"
_STREET = re.compile(
    r"(?:(?P<plot>(?:Plot|Block|Unit|Suite|Flat|Apt|Apartment|No\.?)\s+\w+)[\s,]+)?(?:(?P<number>\d{1,4}[A-Za-z]?)\s+)?"
    rf"(?P<street>(?:[A-Z][\w'\-]+\s+){{1,4}}(?:{'|'.join(places.STREETS)})\b)(?P<tail>(?:\s*,\s*{_PART}){{0,4}})"
)
_BOX = re.compile(r"(?P<plot>(?:P\.?\s*O\.?\s*Box|Box)\s+\d+)(?P<tail>(?:\s*,\s*[\w'\-\s]+){0,6})", re.IGNORECASE)
_ANCHOR = re.compile(rf"\b(?:{'|'.join(places.PREPOSITIONS)})\s+(?:the\s+)?[A-Z][\w'\-]+(?:\s+[\w'\-]+){{0,5}}")
_POSTAL = re.compile(r"(?:\d{4,6}|[A-Z]{2}-\d{3}-\d{4})$")
#: Shape of a postal code -> (country, confidence)
_SHAPES = [(r"\d{6}", "NG", 0.65), (r"\d{5}", "KE", 0.65), (r"\d{4}", "ZA", 0.65), (r"[A-Z]{2}-\d{3}-\d{4}", "GH", 0.95), (r"[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}", "GB", 0.95)]
BEFORE = 80
BOX_LEAST = 0.55


@lru_cache(maxsize=1)
def _countries_of_cities() -> dict[str, str]:
    out: dict[str, str] = {}
    for name, code, *_, others in places.cities():
        for n in (name, *others):
            out.setdefault(n.lower(), code)
    return out


def tail(text: str, cities: dict[str, str]) -> dict[str, str]:
    """Country, postal code, then the rightmost known city with what stands around it."""
    parts = [p.strip() for p in text.split(",") if p.strip()]
    out: dict[str, str] = {}
    if parts and parts[-1].lower() in places.COUNTRIES:
        out["country"] = places.COUNTRIES[parts.pop().lower()]
    code = next((i for i, p in enumerate(parts) if _POSTAL.match(p)), None)
    if code is not None:
        out["postal_code"] = parts.pop(code)
    known = [i for i, p in enumerate(parts) if p.lower() in cities]
    at = known[-1] if known else min(1, len(parts) - 1)
    if not parts:
        return out
    out["city"] = parts[at]
    if at > 0:
        out["neighborhood"] = parts[0]
    if at > 1:
        out["area"] = ", ".join(parts[1:at])
    if at + 1 < len(parts):
        out["region"] = parts[at + 1]
    return out


def country_of(parts: dict[str, str], cities: dict[str, str]) -> tuple[str | None, float]:
    """Named country, else the city's, else what the postal code looks like."""
    if parts.get("country"):
        return parts["country"], 0.95
    if code := cities.get((parts.get("city") or "").lower()):
        return code, 0.85
    for shape, code, confidence in _SHAPES:
        if re.fullmatch(shape, parts.get("postal_code") or ""):
            return code, confidence
    return None, 0.0


def landmark_kind(anchor: str) -> str:
    return next((kind for kind, words in places.LANDMARKS.items() if any(w in anchor.lower() for w in words)), "other")


def score(parts: dict[str, str]) -> float:
    worth = {"street": 0.4, "city": 0.2, "country": 0.15, "postal_code": 0.1, "anchor": 0.05}
    total = sum(v for k, v in worth.items() if parts.get(k)) + (0.1 if parts.get("plot") or parts.get("street_number") else 0)
    return round(min(total, 1.0), 4)


def addresses(text: str | None, cities: dict[str, str] | None = None) -> list[dict]:
    """All addresses of a text by start; of overlapping ones the earliest, then the longest."""
    text, cities = text or "", cities or _countries_of_cities()
    found = []
    for pattern in (_STREET, _BOX):
        for m in pattern.finditer(text):
            groups = m.groupdict()
            parts = {k: " ".join(v.split()) for k, v in (("plot", groups.get("plot")), ("street_number", groups.get("number")), ("street", groups.get("street"))) if v}
            parts |= tail(groups.get("tail") or "", cities)
            start, end = m.span()
            raw = m[0].strip()
            if pattern is _STREET and (anchor := _ANCHOR.search(text[max(0, start - BEFORE) : start])):
                parts |= {"anchor": anchor[0], "anchor_type": landmark_kind(anchor[0])}
                start = max(0, start - BEFORE) + anchor.start()
                raw = text[start:end].strip()
            code, sure = country_of(parts, cities)
            if code:
                parts["country"] = code
            value = score(parts)
            found.append({"raw": raw, "start": start, "end": end, "components": {c: parts.get(c) for c in COMPONENTS}, "country_confidence": sure, "confidence": value if pattern is _STREET else max(value, BOX_LEAST)})
    out, last = [], -1
    for a in sorted(found, key=lambda a: (a["start"], a["start"] - a["end"])):
        if a["start"] >= last:
            out.append(a)
            last = a["end"]
    return out


def parse(text: Column) -> Column:
    """Array of addresses of a text column."""
    kind = pa.list_(pa.struct([("raw", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("components", pa.struct([(c, pa.string()) for c in COMPONENTS])), ("country_confidence", pa.float64()), ("confidence", pa.float64())]))

    @F.arrow_udf(ADDRESS)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else addresses(t) for t in texts.to_pylist()], kind)

    return run.asNondeterministic()(text)


def jurisdiction_sql(t: str) -> str:
    """Struct (code, confidence, trigger): country word, full postcode, outward code, bare digits."""
    levels = []
    for word, code in places.COUNTRIES.items():
        levels.append(f"when lower({t}) rlike {spans.quoted(chr(92) + 'b' + word + chr(92) + 'b')} then named_struct('code', '{code}', 'confidence', 0.99D, 'trigger', {spans.quoted(word)})")
    ladder = [("GB", 0.95, places.POSTCODES["GB"]), ("GH", 0.95, places.POSTCODES["GH"]), ("GB", 0.85, places.OUTWARD_GB)]
    ladder += [(c, 0.70, places.POSTCODES[c]) for c in ("NG", "KE", "ZA")]
    for code, sure, pattern in ladder:
        levels.append(f"when {t} rlike r'{pattern}' then named_struct('code', '{code}', 'confidence', {sure}D, 'trigger', regexp_extract({t}, r'({pattern})', 1))")
    return f"case {' '.join(levels)} else named_struct('code', 'XX', 'confidence', 0.0D, 'trigger', '') end"


def vote_sql(t: str) -> str:
    """Country with most of its words in the text, the first of equals; empty if none has any."""
    counts = ", ".join(f"named_struct('n', size(filter(array({', '.join(map(spans.quoted, words))}), w -> contains(lower({t}), w))), 'i', {-i}, 'c', '{code}')" for i, (code, words) in enumerate(places.VOTES.items()))
    return f"transform(array(array_max(array({counts}))), b -> if(b.n > 0, b.c, ''))[0]"
