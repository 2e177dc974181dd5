"""Span algebra in SQL: matches with offsets, priority folds, splices. No Python on the executors.

A span array holds structs with at least ``start`` and ``end`` (code points, end exclusive).
"""

from __future__ import annotations

#: What detectors return.
DETECTION = "struct<category:string,text:string,start:int,end:int,confidence:double,detector:string,identity_class:string,country:string,metadata:map<string,string>>"
MATCH = "struct<start:int,end:int,m:string>"
CHUNK = 64


def text_of(column: str) -> str:
    return f"coalesce(cast(`{column}` as string), '')"


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches(t: str, pattern: str, when: str = "true") -> str:
    """Leftmost non-overlapping matches of a Java pattern in text expression ``t``.

    Offsets are sums over the pieces between matches, so no position function is needed; ``when``
    keeps the pattern away from texts that cannot match.
    """
    if "'" in pattern:
        q = quoted(pattern)
    else:
        q = f"r'{pattern}'"
    none = f"cast(array() as array<{MATCH}>)"
    # Appending copies the array, so matches are gathered in chunks: n matches cost n * CHUNK + (n / CHUNK) ** 2, not n ** 2.
    chunk = f"""aggregate(slice(z, k * {CHUNK} + 1, {CHUNK}), named_struct('at', a.at, 's', {none}), (b, e) ->
        named_struct('at', b.at + e.n + char_length(e.m), 's', concat(b.s, array(named_struct('start', b.at + e.n, 'end', b.at + e.n + char_length(e.m), 'm', e.m)))))"""
    # Pieces are only made where something matches: split compiles its pattern for every text.
    return f"""case when {when} then transform(array(regexp_extract_all({t}, {q}, 0)), _ms ->
        if(size(_ms) = 0, {none}, if(size(_ms) = 1, transform(array(char_length(split({t}, {q}, 2)[0])), n -> named_struct('start', n, 'end', n + char_length(_ms[0]), 'm', _ms[0])), transform(array(zip_with(_ms, slice(split({t}, {q}, -1), 1, size(_ms)), (m, p) -> named_struct('m', m, 'n', char_length(p)))), z ->
          flatten(aggregate(sequence(0, (size(z) - 1) div {CHUNK}), named_struct('at', 0, 's', cast(array() as array<array<{MATCH}>>)),
            (a, k) -> transform(array({chunk}), c -> named_struct('at', c.at, 's', concat(a.s, array(c.s))))[0], a -> a.s)))[0])))[0] else {none} end"""


def detections(spans: str, category: str, detector: str, confidence: str, identity: str = "inferred", country: str = "cast(null as string)", metadata: str = "map()") -> str:
    """Spans as DETECTION structs; ``category`` to ``metadata`` are SQL over a span s and its text m.

    ``category``, ``detector`` and ``identity`` are literals.
    """
    fields = f"""named_struct('category', {quoted(category)}, 'text', s.m, 'start', s.start, 'end', s.end, 'confidence', cast({confidence} as double),
        'detector', {quoted(detector)}, 'identity_class', {quoted(identity)}, 'country', {country}, 'metadata', cast({metadata} as map<string,string>))"""
    return f"transform({spans}, s -> transform(array(s.m), m -> {fields})[0])"


def overlap(a: str, b: str) -> str:
    return f"{a}.start < {b}.end and {b}.start < {a}.end"


def first_wins(spans: str, kind: str = DETECTION) -> str:
    """Of overlapping spans the earlier in the array stays."""
    return f"aggregate({spans}, cast(array() as array<{kind}>), (a, s) -> case when exists(a, o -> {overlap('o', 's')}) then a else concat(a, array(s)) end)"


def by_confidence(spans: str) -> str:
    """Highest confidence first, otherwise as they were."""
    return f"transform(array_sort(transform({spans}, (s, i) -> named_struct('s', s, 'i', i)), (a, b) -> case when a.s.confidence > b.s.confidence then -1 when a.s.confidence < b.s.confidence then 1 else a.i - b.i end), k -> k.s)"


def by_start(spans: str) -> str:
    """By start, then end, otherwise as they were."""
    return f"transform(array_sort(transform({spans}, (s, i) -> named_struct('s', s, 'i', i)), (a, b) -> case when a.s.start <> b.s.start then a.s.start - b.s.start when a.s.end <> b.s.end then a.s.end - b.s.end else a.i - b.i end), k -> k.s)"


def resolved(spans: str, tier: str = "0") -> str:
    """Overlaps resolved: higher tier, then longer, then earlier wins. ``tier`` is SQL over a span s."""
    rank = f"transform({spans}, s -> named_struct('s', s, 't', {tier}))"
    order = f"""transform(array_sort({rank}, (a, b) -> case when a.t <> b.t then b.t - a.t
        when a.s.end - a.s.start <> b.s.end - b.s.start then (b.s.end - b.s.start) - (a.s.end - a.s.start)
        else a.s.start - b.s.start end), k -> k.s)"""
    return order


def splice(t: str, spans: str, value: str) -> str:
    """``t`` with each span replaced by SQL ``value`` over a span s. Spans sorted by start, none overlapping."""
    return f"""aggregate({spans}, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, s) -> case when s.start < a.at then a else
          named_struct('at', s.end, 'out', concat(a.out, array(substring({t}, a.at + 1, s.start - a.at), {value}))) end,
        a -> concat(array_join(a.out, ''), substring({t}, a.at + 1)))"""


def splice_backwards(t: str, spans: str, value: str) -> str:
    """Replace from the last start to the first with the original offsets, overlapping spans included."""
    order = f"array_sort(transform({spans}, (s, i) -> named_struct('s', s, 'i', i)), (a, b) -> case when a.s.start <> b.s.start then b.s.start - a.s.start else a.i - b.i end)"
    return f"aggregate({order}, {t}, (a, k) -> transform(array(k.s), s -> concat(left(a, s.start), {value}, substring(a, s.end + 1)))[0])"


def window(t: str, size: int) -> str:
    """Lower-case text around a span s."""
    return f"lower(substring({t}, greatest(s.start - {size}, 0) + 1, s.end + {size} - greatest(s.start - {size}, 0)))"


def any_of(words: list[str], inside: str) -> str:
    return f"exists(array({', '.join(map(quoted, words))}), w -> contains({inside}, w))"
