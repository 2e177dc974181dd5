"""Text, HTML and DOT of small results: everything here takes a stated number of rows to the driver."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame

ROWS = 200


def table(df: DataFrame, columns: list[str] | None = None, rows: int = ROWS, width: int = 40) -> str:
    """A boxed table of the first rows; long values are cut."""
    names = columns or df.columns
    found = [[str("" if r[c] is None else r[c])[:width] for c in names] for r in df.limit(rows).collect()]
    sizes = [max(len(c), *(len(r[i]) for r in found)) if found else len(c) for i, c in enumerate(names)]
    line = "+" + "+".join("-" * (s + 2) for s in sizes) + "+"
    draw = lambda cells: "| " + " | ".join(c.ljust(s) for c, s in zip(cells, sizes)) + " |"
    return "\n".join([line, draw(names), line, *map(draw, found), line])


def highlighted(text: str, spans: list, label: str = "label") -> str:
    """The text as HTML with marked spans; of overlapping ones the first."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["start"] < at:
            continue
        out += [html.escape(text[at : s["start"]]), f'<mark title="{html.escape(str(s[label]))}">{html.escape(text[s["start"] : s["end"]])}</mark>']
        at = s["end"]
    return "<p>" + "".join(out) + html.escape(text[at:]) + "</p>"


def dot(nodes: DataFrame, edges: DataFrame, rows: int = ROWS) -> str:
    """Graphviz source of the first nodes and edges."""
    q = lambda v: '"' + str(v).replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = [f"  {q(n.node)} [label={q(n.label)}];" for n in nodes.limit(rows).collect()]
    lines += [f"  {q(e.a)} -- {q(e.b)} [label={q(e.relation)}];" for e in edges.limit(rows).collect()]
    return "graph {\n" + "\n".join(lines) + "\n}\n"


def graph_json(nodes: DataFrame, edges: DataFrame, rows: int = ROWS) -> dict:
    """Node-link form."""
    return {"nodes": [r.asDict() for r in nodes.limit(rows).collect()], "links": [r.asDict() for r in edges.limit(rows).collect()]}


def graphml(nodes: DataFrame, edges: DataFrame, rows: int = ROWS) -> str:
    made = [f'<node id="{html.escape(r.node)}"><data key="label">{html.escape(str(r.label))}</data></node>' for r in nodes.limit(rows).collect()]
    made += [f'<edge source="{html.escape(r.a)}" target="{html.escape(r.b)}"><data key="relation">{r.relation}</data></edge>' for r in edges.limit(rows).collect()]
    keys = '<key id="label" for="node" attr.name="label" attr.type="string"/><key id="relation" for="edge" attr.name="relation" attr.type="string"/>'
    return f'<graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="undirected">{"".join(made)}</graph></graphml>'


def summary(df: DataFrame, column: str = "entity_type") -> str:
    """Counts by kind on one line."""
    found = df.groupBy(column).count().orderBy(column).limit(ROWS).collect()
    return ", ".join(f"{r['count']} {r[column]}" for r in found) or "nothing found"
