"""Statutes applied to detections: tiers, citations, actions and redacted text, without a join or shuffle.

A statute is a few dozen rows, so it is a map literal in the projection. Tokens need BLAKE2, which the
JVM side lacks: one Arrow function hashes the texts of the detections to tokenize, and only those.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.data import statutes as data
from veldspar.functions import spans
from veldspar.functions.shared import fresh, settled

OUTCOME = "detection_id:string,category:string,action:string,statute_reference:string,statute_id:string,statute_version:string,rationale:string,applied_value:string,start:int,end:int,superseded_by:string"


@dataclass(frozen=True)
class Statute:
    statute_id: str
    jurisdiction: str
    version: str
    default_reference: str
    #: category -> (action, tier, reference, rationale)
    mappings: dict[str, tuple[str, str, str | None, str | None]] = field(default_factory=dict)
    default_action: str = "mask"

    def __post_init__(self) -> None:
        for category, (action, tier, *_) in self.mappings.items():
            if action not in data.ACTIONS:
                raise ValueError(f"{self.statute_id} maps {category} to the unknown action {action!r}; one of {data.ACTIONS}")
            if tier not in data.TIERS:
                raise ValueError(f"{self.statute_id} maps {category} to the unknown tier {tier!r}; one of {data.TIERS}")


def available() -> list[str]:
    return sorted(data.STATUTES)


def load(statute_id: str) -> Statute:
    if statute_id not in data.STATUTES:
        raise FileNotFoundError(f"no statute {statute_id!r}; there are {', '.join(available())}")
    (jurisdiction, version, reference), lines = data.STATUTES[statute_id]
    mappings = {}
    for line in lines.strip().splitlines():
        category, action, tier, ref = line.split(None, 3)
        mappings[category] = (action, tier, ref, None)
    return Statute(statute_id, jurisdiction, version, reference, mappings)


def table(spark: SparkSession, *statute_ids: str) -> DataFrame:
    """The statutes as a dimension: statute_id, jurisdiction, version, category, action, tier, statute_reference."""
    rows = [(s.statute_id, s.jurisdiction, s.version, c, *m[:3]) for i in statute_ids or available() for s in [load(i)] for c, m in s.mappings.items()]
    return spark.createDataFrame(rows, "statute_id string, jurisdiction string, version string, category string, action string, tier string, statute_reference string")


def _look(statute: Statute, place: int, category: str, default: str | None) -> str:
    pairs = ", ".join(f"{spans.quoted(c)}, {spans.quoted(m[place])}" for c, m in statute.mappings.items() if m[place] is not None)
    fallback = spans.quoted(default) if default is not None else "cast(null as string)"
    return f"coalesce(map({pairs})[{category}], {fallback})" if pairs else fallback


def action_sql(statute: Statute, category: str) -> str:
    return _look(statute, 0, category, statute.default_action)


def tier_sql(statute: Statute, category: str) -> str:
    return _look(statute, 1, category, "moderate")


def reference_sql(statute: Statute, category: str) -> str:
    return _look(statute, 2, category, statute.default_reference or f"{statute.statute_id} (default)")


def enrich(df: DataFrame, statute: Statute, column: str = "detections", into: str = "detections") -> DataFrame:
    """Each detection gets id, sensitivity_tier and regulatory_citation; an unmapped category the defaults."""
    fields = [f"'{f}', s.{f}" for f in ("category", "text", "start", "end", "confidence", "detector", "identity_class", "country", "metadata")]
    return df.withColumn(into, F.expr(f"""transform(`{column}`, s -> named_struct('id', concat('det:', s.start, ':', s.end), {', '.join(fields)},
        'sensitivity_tier', {tier_sql(statute, 's.category')}, 'regulatory_citation', {reference_sql(statute, 's.category')}))"""))


def tokens(detections: Column, salt: str = "") -> Column:
    """Salted 4-byte BLAKE2b of each detection's text, as hex."""

    @F.arrow_udf("array<string>")
    def run(lists: pa.Array) -> pa.Array:
        made = [None if x is None else [hashlib.blake2b((salt + (d["text"] or "")).encode(), digest_size=4).hexdigest() for d in x] for x in lists.to_pylist()]
        return pa.array(made, pa.list_(pa.string()))

    # held to be nondeterministic, else the optimizer moves the call into the lambda that reads its result
    return run.asNondeterministic()(detections)


def label_sql(category: str) -> str:
    """The last part of a category between dashes."""
    return f"element_at(split({category}, '-'), -1)"


def generalize_sql(category: str, text: str) -> str:
    """Dates to their year, IPv4 addresses to their /24, anything else to its label."""
    return f"""case when trim({text}) rlike r'^[0-9]{{4}}[-/][0-9]{{2}}[-/][0-9]{{2}}$' then left(trim({text}), 4)
        when trim({text}) rlike r'^[0-9]{{1,3}}(\\.[0-9]{{1,3}}){{3}}$' then concat(regexp_extract(trim({text}), r'^(([0-9]{{1,3}}\\.){{3}})', 1), '0/24')
        else concat('[', {label_sql(category)}, ']') end""".replace("\\\\", "\\")


def apply(df: DataFrame, statute: Statute, text: str = "text", column: str = "detections", salt: str = "", overlap: str = "resolve",
          redacted: str = "redacted_text", outcomes: str = "policy_outcomes") -> DataFrame:
    """``df`` with the redacted text and one outcome for each detection, in the detections' order.

    overlap="resolve": of overlapping detections the higher tier, then the longer, then the earlier one is
    applied; the others' outcomes name it in superseded_by. overlap="splice": every detection is spliced
    with its original offsets from the last to the first, which garbles text under overlaps.
    """
    if overlap not in ("resolve", "splice"):
        raise ValueError(f"overlap is 'resolve' or 'splice', not {overlap!r}")
    t = spans.text_of(text)
    hashed, ranked, kept = fresh(df, "tokens", "outcomes", "kept")
    has = f"exists(`{column}`, s -> {action_sql(statute, 's.category')} = 'tokenize')"
    df = df.withColumn(hashed, F.when(F.expr(has), tokens(F.col(f"`{column}`"), salt)))
    value = f"""case action when 'mask' then concat('[', {label_sql('s.category')}, ']') when 'drop' then ''
        when 'tokenize' then concat({label_sql('s.category')}, '_', `{hashed}`[i]) when 'generalize' then {generalize_sql('s.category', 's.text')} else s.text end"""
    df = df.withColumn(ranked, F.expr(f"""transform(`{column}`, (s, i) -> transform(array({action_sql(statute, 's.category')}), action -> named_struct(
        'start', s.start, 'end', s.end, 'i', i, 'id', concat('det:', s.start, ':', s.end), 'category', s.category, 'action', action,
        'reference', {reference_sql(statute, 's.category')}, 'rationale', {_look(statute, 3, 's.category', None)}, 'value', {value},
        'tier', case {tier_sql(statute, 's.category')} when 'high' then 2 when 'moderate' then 1 else 0 end))[0])"""))
    inner = "struct<start:int,end:int,i:int,id:string,category:string,action:string,reference:string,rationale:string,value:string,tier:int>"
    if overlap == "resolve":
        df = df.withColumn(kept, F.expr(spans.by_start(spans.first_wins(spans.resolved(f"`{ranked}`", "s.tier"), inner))))
        done = spans.splice(t, f"`{kept}`", "s.value")
        over = f"if(exists(`{kept}`, k -> k.i = s.i), cast(null as string), filter(`{kept}`, k -> {spans.overlap('k', 's')})[0].id)"
    else:
        df = df.withColumn(kept, F.lit(None).cast("int"))
        done = spans.splice_backwards(t, f"`{ranked}`", "s.value")
        over = "cast(null as string)"
    result = f"""transform(`{ranked}`, s -> named_struct('detection_id', s.id, 'category', s.category, 'action', s.action, 'statute_reference', s.reference,
        'statute_id', {spans.quoted(statute.statute_id)}, 'statute_version', {spans.quoted(statute.version)}, 'rationale', s.rationale, 'applied_value', s.value,
        'start', s.start, 'end', s.end, 'superseded_by', {over}))"""
    return settled(df.withColumn(redacted, F.expr(done)).withColumn(outcomes, F.expr(result)).drop(hashed, ranked, kept), outcomes)


# ---- plain redaction -----------------------------------------------------------------------------

STRATEGIES = {
    "mask": "'****'",
    "hash": "left(sha2(s.text, 256), 8)",
    "remove": "''",
    "placeholder": "concat('<', s.pii_type, '>')",
}


def redact(df: DataFrame, text: str = "text", column: str = "pii", strategy: str = "mask", into: str = "redacted_text", overlap: str = "resolve") -> DataFrame:
    """Replace each span (text, pii_type, start, end) by a strategy's value; of overlapping ones the longer, then the earlier."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; one of {sorted(STRATEGIES)}")
    t = spans.text_of(text)
    if overlap == "splice":
        return df.withColumn(into, F.expr(spans.splice_backwards(t, f"`{column}`", STRATEGIES[strategy])))
    kind = df.schema[column].dataType.elementType.simpleString()
    kept = spans.by_start(spans.first_wins(spans.resolved(f"`{column}`"), kind))
    return df.withColumn(into, F.expr(spans.splice(t, kept, STRATEGIES[strategy])))


def tagged(df: DataFrame, text: str = "text", column: str = "evidence", into: str = "tagged_text") -> DataFrame:
    """Each span (text, label, start, end) between XML tags of its label."""
    t = spans.text_of(text)
    return df.withColumn(into, F.expr(spans.splice_backwards(t, f"`{column}`", "concat('<', s.label, '>', s.text, '</', s.label, '>')")))


def masked_sql(text: str) -> str:
    """First three characters and stars for logs; short texts are all stars."""
    return f"if(char_length({text}) > 3, concat(left({text}, 3), '***'), '***')"
