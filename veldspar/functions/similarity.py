"""String similarity: what Spark has no built-in for, as Arrow functions over pairs of columns.

Plain Python definitions first, their column forms after. All take nulls as empty strings.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from veldspar.data import names as data


def strip_marks(text: str) -> str:
    """Without combining marks after compatibility decomposition."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) != "Mn")


def normal_text(text: str) -> str:
    return re.sub(r"\s+", " ", strip_marks(text.strip().lower()))


def normal_name(name: str) -> str:
    """"LAST, First" turned round, marks stripped, blanks collapsed, words capitalised."""
    text = name.strip()
    last, comma, first = (p.strip() for p in text.partition(","))
    if comma and last and first:
        text = f"{first} {last}"
    return " ".join(strip_marks(text).split()).title()


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    moved = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro with 0.1 a common leading character, four at most, where Jaro is over 0.7."""
    value = jaro(a, b)
    if value > 0.7:
        same = 0
        for x, y in zip(a[:4], b[:4]):
            if x != y:
                break
            same += 1
        value += same * 0.1 * (1 - value)
    return value


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit rows."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit) | (row - hit)
        row &= full
    return (~row & full).bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    """Indel ratio of the texts with their words sorted; letter case counts."""
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best Indel ratio among the common words and each text's words; 1 if one has no other words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 1.0
    one, other = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max(indel_ratio(one, other), *((indel_ratio(both, one), indel_ratio(both, other)) if both else (0.0,)))


def matching_blocks(a: str, b: str) -> float:
    """Twice the characters in recursively longest common blocks over both lengths."""
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


class Equivalence:
    """Groups of equivalent names: a name in several groups belongs to the last."""

    def __init__(self, groups: Iterable[Iterable[str]] | None = None) -> None:
        self.group: dict[str, frozenset[str]] = {}
        for members in groups or data.GROUPS:
            folded = frozenset(strip_marks(n.lower()) for n in members)
            for n in folded:
                self.group[n] = folded

    def known(self, name: str) -> bool:
        return any(w in self.group for n in [normal_name(name).lower()] for w in n.split())

    def score(self, a: str, b: str) -> float:
        """0.6 of the words' equivalence plus 0.4 of the best Jaro-Winkler; 1 for equal names."""
        a, b = normal_name(a or "").lower(), normal_name(b or "").lower()
        if not a or not b:
            return 0.0
        if a == b:
            return 1.0
        x, y = a.split(), b.split()
        free, met = list(y), 0
        for w in x:
            group = self.group.get(w, frozenset((w,)))
            hit = next((v for v in free if v in group), None)
            if hit is not None:
                free.remove(hit)
                met += 1
        near = max(jaro_winkler(a, b), max(jaro_winkler(v, w) for v in x for w in y))
        return round(min(0.6 * met / max(len(x), len(y)) + 0.4 * near, 1.0), 4)


def paired(function: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """The column form of a similarity of two strings; each distinct pair of a batch is computed once."""

    def over(a: Column, b: Column) -> Column:
        @F.arrow_udf("double")
        def run(x: pa.Array, y: pa.Array) -> pa.Array:
            seen: dict[tuple[str, str], float] = {}
            out = []
            for pair in zip(x.to_pylist(), y.to_pylist()):
                pair = (pair[0] or "", pair[1] or "")
                if pair not in seen:
                    seen[pair] = function(*pair)
                out.append(seen[pair])
            return pa.array(out, pa.float64())

        return run.asNondeterministic()(a.cast("string"), b.cast("string"))  # else filters on the result call it again

    return over


def mapped(function: Callable[[str], str]) -> Callable[[Column], Column]:
    """The column form of a text function; null stays null."""

    def over(a: Column) -> Column:
        @F.arrow_udf("string")
        def run(x: pa.Array) -> pa.Array:
            return pa.array([None if v is None else function(v) for v in x.to_pylist()], pa.string())

        return run.asNondeterministic()(a.cast("string"))

    return over


def whitespace_sql(t: str) -> str:
    """Line ends unified and trimmed, at most one empty line in a row, trimmed."""
    return f"trim(BOTH '\\n\\t ' FROM regexp_replace(regexp_replace(regexp_replace({t}, '\\\\r\\\\n?', '\\n'), '[ \\\\t]+(?=\\n|$)', ''), '\\n{{3,}}', '\\n\\n'))"
