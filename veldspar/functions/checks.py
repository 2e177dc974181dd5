"""Check digits, format validators and matching weights, all SQL over columns."""

from __future__ import annotations

from veldspar.data import names as data


def luhn_sql(digits: str) -> str:
    return f"coalesce({digits} rlike '^[0-9]+$' and luhn_check({digits}), false)"


def zaid_sql(value: str) -> str:
    """Struct (valid, date_of_birth, gender, citizenship) of a 13-digit South African number."""
    return f"""transform(array(regexp_replace({value}, '\\\\s', '')), m -> if(coalesce(m rlike '^[0-9]{{13}}$', false),
        transform(array(try_cast(substr(m, 3, 2) as int) between 1 and 12 and try_cast(substr(m, 5, 2) as int) between 1 and 31 and luhn_check(m)), ok -> named_struct('valid', ok,
          'date_of_birth', if(ok, concat(if(int(left(m, 2)) >= 30, '19', '20'), left(m, 2), '-', substr(m, 3, 2), '-', substr(m, 5, 2)), null),
          'gender', if(ok, if(int(substr(m, 7, 4)) < 5000, 'female', 'male'), null), 'citizenship', if(ok, if(substr(m, 11, 1) = '0', 'citizen', 'permanent_resident'), null)))[0],
        named_struct('valid', false, 'date_of_birth', cast(null as string), 'gender', cast(null as string), 'citizenship', cast(null as string))))[0]"""


def egypt_sql(value: str) -> str:
    """Struct (valid, date_of_birth, governorate_code) of a 14-digit Egyptian number."""
    return f"""transform(array(regexp_replace({value}, '\\\\s', '')), m -> transform(array(coalesce(m rlike '^[23][0-9]{{13}}$', false) and
          coalesce(try_cast(substr(m, 4, 2) as int) between 1 and 12 and try_cast(substr(m, 6, 2) as int) between 1 and 31 and try_cast(substr(m, 8, 2) as int) between 1 and 35, false)), ok -> named_struct('valid', ok,
          'date_of_birth', if(ok, concat(if(m like '2%', '19', '20'), substr(m, 2, 2), '-', substr(m, 4, 2), '-', substr(m, 6, 2)), null), 'governorate_code', if(ok, substr(m, 8, 2), null)))[0])[0]"""


def rwanda_sql(value: str) -> str:
    return f"coalesce(regexp_replace({value}, '\\\\s', '') rlike '^1[0-9]{{15}}$' and try_cast(substr(regexp_replace({value}, '\\\\s', ''), 2, 4) as int) between 1900 and 2030, false)"


#: Format tests of the detectors and of the stricter country packs, over a value m.
FORMATS = {
    "bvn": "regexp_replace(m, r'\\s', '') rlike '^22[0-9]{9}$'",
    "nin": "regexp_replace(m, r'\\s', '') rlike '^[0-9]{11}$'",
    "nin_strict": "regexp_replace(m, r'\\s', '') rlike '^(?!22)[0-9]{11}$'",
    "ng_tin": "regexp_replace(m, r'[\\s-]', '') rlike '^([0-9]{10}|[0-9]{14})$'",
    "ng_rc": "replace(upper(m), ' ', '') rlike '^(RC|BN)[0-9]{5,8}$'",
    "ng_drivers": "replace(upper(m), ' ', '') rlike '^[A-Z]{3}-[0-9]{10,12}$'",
    "kra_pin": "replace(upper(m), ' ', '') rlike '^[AP][0-9]{9}[A-Z]$'",
    "nhif": "regexp_replace(m, r'\\s', '') rlike '^[0-9]{8,9}$'",
    "ghana_card": "replace(upper(m), ' ', '') rlike '^GHA-[0-9]{9}-[0-9]$'",
    "ssnit": "replace(upper(m), ' ', '') rlike '^[A-Z][A-Z0-9]{12}$'",
    "gh_tin": "replace(upper(m), ' ', '') rlike '^([PCG][0-9]{10}|[0-9]{11})$'",
    "za_tax": "regexp_replace(m, r'\\s', '') rlike '^[01239][0-9]{9}$'",
    "za_passport": "replace(upper(m), ' ', '') rlike '^[A-Z][0-9]{8}$'",
}


def valid_sql(kind: str, value: str) -> str:
    return f"transform(array({value}), m -> coalesce({FORMATS[kind]}, false))[0]".replace("\\\\", "\\")


def log_odds_sql(agreement: str, m: str, u: str) -> str:
    """Weight of a field's agreement: log2 m/u, log2 (1-m)/(1-u), or between them in proportion."""
    m, u = (f"greatest(least({p}, 0.9999D), 0.0001D)" for p in (m, u))
    yes, no = f"log2({m} / {u})", f"log2((1D - {m}) / (1D - {u}))"
    return f"case when {agreement} >= 0.99 then {yes} when {agreement} <= 0.01 then {no} else {agreement} * {yes} + (1D - {agreement}) * {no} end"


def posterior_sql(weight: str) -> str:
    """Probability of a match at even prior odds."""
    return f"case when {weight} > 1000 then 1D when {weight} < -1000 then 0D else pow(2D, {weight}) / (1D + pow(2D, {weight})) end"


def decision_sql(score: str, match: float = data.MATCH, review: float = data.REVIEW) -> str:
    return f"case when {score} >= {match}D then 'match' when {score} >= {review}D then 'review' else 'no_match' end"


def plain_sql(value: str) -> str:
    return f"lower(regexp_replace({value}, '[^a-zA-Z0-9]', ''))"


def same_phone_sql(a: str, b: str, codes: tuple[str, ...] = ("234", "233", "254", "27", "225", "221")) -> str:
    """1 if equal without marks, or if one has a calling code where the other has a 0; else 0."""
    x, y = plain_sql(a), plain_sql(b)
    ways = " or ".join(f"({p} like '{c}%' and {q} like '0%' and substring({p}, {len(c) + 1}) = substring({q}, 2))" for c in codes for p, q in ((x, y), (y, x)))
    return f"case when coalesce({x}, '') = '' or coalesce({y}, '') = '' then 0D when {ways} or {x} = {y} then 1D else 0D end"


def same_id_sql(a: str, b: str) -> str:
    return f"if(coalesce({plain_sql(a)}, '') <> '' and {plain_sql(a)} = {plain_sql(b)}, 1D, 0D)"


def same_email_sql(a: str, b: str) -> str:
    return f"if(coalesce(trim(lower({a})), '') <> '' and trim(lower({a})) = trim(lower({b})), 1D, 0D)"


def same_date_sql(a: str, b: str) -> str:
    x, y = (f"regexp_replace({v}, '[^0-9]', '')" for v in (a, b))
    return f"if(coalesce({x}, '') <> '' and {x} = {y}, 1D, 0D)"


def same_isbn_sql(a: str, b: str) -> str:
    """1 if equal, or if an ISBN-10 and a 978 ISBN-13 have the same nine digits."""
    x, y = (f"upper(regexp_replace({v}, '[^0-9Xx]', ''))" for v in (a, b))
    core = lambda v: f"case when char_length({v}) = 13 and {v} like '978%' then substr({v}, 4, 9) when char_length({v}) = 10 then left({v}, 9) end"
    return f"if(coalesce({x}, '') <> '' and coalesce({y}, '') <> '' and ({x} = {y} or coalesce({core(x)} = {core(y)}, false)), 1D, 0D)"
