"""Secret scan with corpus-wide ownership frequency.

* Base: assign, access and hex spans (see BASE); these always stay.
* Wider patterns (WIDE) propose vendor tokens, signed web tokens, private-key blocks and passwords in
  addresses, as further kinds.
* The value of every candidate is hashed; for each hash the distinct repositories and owners it occurs
  in are counted over the whole corpus. A value known to ``WIDELY`` owners or more is a copied example
  (documentation, a licence checksum, a fixture); one that stays with few owners and looks random is
  owner-specific and live-looking. A wider span is added only if it is live-looking; base spans stay
  either way and the verdict is counted in n_live and n_example.

Which columns name the repository and the owner are parameters. ``documents`` has neither, so its query
takes source as owner and source with language as repository.

Scale. Values never leave a task, only their hashes. Counting is by (hash, owner, repository), then
(hash, owner), then hash, each step combined map-side, so an example that a third of all documents
copy is a handful of rows for each task. The counts are checkpointed before they are joined, so both
join inputs are plain scans and adaptive execution can split the hot hash. Rows without a candidate
are never shuffled.

Defined results: null text is an empty text; a very long text is scanned whole, in time in proportion to
its length and, for each span, the logarithm of their number; null repository or owner is one of its own; repeated rows
are judged one by one and count once for their owner; null doc_id stays null; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions.shared import checkpointed

KINDS = ("assign", "access", "hex")
WIDER = ("token", "web", "pem", "url")
#: Owners from which on a value is a copied example.
WIDELY = 3
#: Least bits a character and least length of a random-looking value.
ENTROPY, LENGTH = 3.0, 12

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of hex digits is one match, however long
#: Runs are possessive and of any length. A run that could begin a match but does not is one match without
#: a value: it is passed over whole, not tried again from its middle, so a text costs time in proportion to it.
_WIDE = {
    "token": (("gh", "xox", "sk_live", "rk_live", "glpat-", "npm_"), re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_|xox[abprs]-|[sr]k_live_|glpat-|npm_)([A-Za-z0-9_-]{16,}+)")),
    "web": (("eyJ",), re.compile(r"(?<![A-Za-z0-9])(?:(eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+)|eyJ[A-Za-z0-9_-]{8,}+)")),
    "pem": (("PRIVATE KEY-----",), re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----([A-Za-z0-9+/=\s]{32,}+)-----END [A-Z ]{0,20}PRIVATE KEY-----")),
    "url": (("://",), re.compile(r"(?<![A-Za-z])[a-z][a-z0-9+.-]++(?:://[^\s:/@]++:([^\s:/@]{6,}+)@)?")),
}
_FILLER = re.compile(r"(?i)example|sample|dummy|placeholder|changeme|your|xxxx|test|1234|abcd")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) by start, then kind."""
    out = []
    lower = text.lower()
    if any(w in lower for w in _ASSIGN_WORDS):
        out += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=_place)


def _place(span: tuple) -> tuple:
    return span[1], (KINDS + WIDER).index(span[0]), span[2]


def wide_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Further candidates that overlap no base span, nor those of an earlier kind; matches of one kind never overlap."""
    out: list[tuple[str, int, int, str]] = []
    for kind, (signs, pattern) in _WIDE.items():
        if any(s in text for s in signs):
            taken = _Taken([*base, *out])
            out += [(kind, m.start(), m.end(), m[1]) for m in pattern.finditer(text) if m[1] is not None and not taken.meets(m.start(), m.end())]
    return out


class _Taken:
    """Spans by start, with the furthest end so far: one binary search tells whether any of them meets another."""

    def __init__(self, spans: list[tuple[str, int, int, str]]) -> None:
        ordered = sorted((a, b) for _, a, b, _ in spans)
        self.starts = [a for a, _ in ordered]
        self.ends = list(accumulate((b for _, b in ordered), max))

    def meets(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start


def looks_live(value: str) -> bool:
    """Random-looking: long and even enough, no filler word, not one kind of character only."""
    if len(value) < LENGTH or _FILLER.search(value):
        return False
    counts = Counter(value)
    bits = -sum(c / len(value) * math.log2(c / len(value)) for c in counts.values())
    return bits >= ENTROPY


_SPANS = "array<struct<kind:string,start:int,end:int,hash:string,base:boolean,random:boolean>>"


def candidates(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """doc_id, repository, owner and the array of candidate spans of every row, in order."""
    fields = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string()), ("base", pa.bool_()), ("random", pa.bool_())]))

    def spans(text: str | None) -> list[dict]:
        base = base_spans(text or "")
        both = [(s, True) for s in base] + [(s, False) for s in wide_spans(text or "", base)]
        return [
            {"kind": s[0], "start": s[1], "end": s[2], "hash": hashlib.sha256(s[3].encode()).hexdigest(), "base": b, "random": looks_live(s[3])}
            for s, b in sorted(both, key=lambda x: _place(x[0]))
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([spans(t) for t in batch.column("text").to_pylist()], fields)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("repository"), batch.column("owner"), found], names=["doc_id", "repository", "owner", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), repository.cast("string").alias("repository"), owner.cast("string").alias("owner"))
    return rows.mapInArrow(run, f"doc_id long, repository string, owner string, spans {_SPANS}")


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories and owners: in how many distinct ones each value occurs."""
    each = found.select("repository", "owner", F.explode("spans.hash").alias("hash")).select(
        "hash", F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")).alias("owner"), F.coalesce(F.concat(F.lit("="), "repository"), F.lit("")).alias("repository")
    )
    by_owner = each.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one")).groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return by_owner.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count("*").alias("owners"))


def scan(docs: DataFrame, repository: str | Column = "source", owner: str | Column = "source", widely: int = WIDELY) -> DataFrame:
    """doc_id and its array of spans (kind, start, end, hash, base, verdict, repositories, owners), a row for each row."""
    repository = F.col(repository) if isinstance(repository, str) else repository
    owner = F.col(owner) if isinstance(owner, str) else owner
    found = checkpointed(candidates(docs, repository, owner).withColumn("row", F.monotonically_increasing_id()))
    some = found.where("size(spans) > 0")
    known = checkpointed(ownership(some))
    each = some.select("row", "doc_id", F.posexplode("spans").alias("at", "s")).select("row", "doc_id", "at", "s", F.col("s.hash").alias("hash"))
    verdict = F.when(F.col("owners") >= widely, "example").when(F.col("s.random"), "live").otherwise("weak")
    judged = each.join(known, "hash").withColumn("verdict", verdict).where("s.base or verdict = 'live'")
    span = F.struct("at", "s.kind", "s.start", "s.end", "hash", "s.base", "verdict", "repositories", "owners")
    lists = judged.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("spans"))
    rest = found.select("row", "doc_id").join(lists.select("row"), "row", "left_anti").select("doc_id", F.array().cast(lists.schema["spans"].dataType).alias("spans"))
    return lists.select("doc_id", "spans").unionByName(rest)


def report(docs: DataFrame, repository: str | Column = "source", owner: str | Column = "source", widely: int = WIDELY) -> DataFrame:
    """doc_id, the number of base spans of each kind, their digest, all spans, and the verdicts' numbers."""
    rows = scan(docs, repository, owner, widely)
    written = lambda a: f"array_join(transform({a}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    counts = [f"cast(size(filter(spans, s -> s.base and s.kind = '{k}')) as bigint) as n_{k}" for k in KINDS]
    verdicts = [f"cast(size(filter(spans, s -> s.verdict = '{v}')) as bigint) as n_{v}" for v in ("live", "example")]
    return rows.selectExpr("doc_id", *counts, f"sha2({written('filter(spans, s -> s.base)')}, 256) as base_sha256", f"{written('spans')} as spans", *verdicts)
