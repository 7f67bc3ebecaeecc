"""Formats that every graph-shaped view shares: dot, an indented tree, layered boxes, SVG."""

from __future__ import annotations

from collections import defaultdict
from xml.sax.saxutils import escape

from graphdelta.emit.drawing import MARK, Drawing, flat_name

#: Stroke and fill of the four classes.
COLOURS = {"added": ("#22c55e", "#f0fdf4"), "removed": ("#ef4444", "#fef2f2"), "changed": ("#f59e0b", "#fffbeb"), "context": ("#d1d5db", "#ffffff")}


def _dot_style(css: str) -> str:
    stroke, fill = COLOURS[css]
    style = {"added": ",style=filled", "changed": ",style=filled", "removed": ',style="filled,dashed"'}.get(css, "")
    return f'color="{stroke}"{style}' + (f',fillcolor="{fill}"' if style else "")


def dot(d: Drawing) -> str:
    names, out = d.handles("n"), ["digraph {"]
    for x in d.items:
        label = x.label().replace("\\", "\\\\").replace('"', '\\"')
        out.append(f'    {names[x.id]} [label="{label}",{_dot_style(x.shown)}];')
    ways = {"added": f' [color="{COLOURS["added"][0]}"]', "removed": f' [style=dashed,color="{COLOURS["removed"][0]}"]'}
    out += [f"    {names[x.source]} -> {names[x.target]}{ways.get(x.css, '')};" for x in d.links]
    for i, x in enumerate(d.dynamic):
        out += [f'    dyn{i} [label="dyn",{_dot_style("context")}];', f'    {names[x.id]} -> dyn{i} [style=dashed,color="{COLOURS["context"][0]}"];']
    return "\n".join([*out, "}"]) + "\n"


def tree(d: Drawing) -> str:
    """A walk from the items that nothing points at (from all, if there is none), an edge back to the way here marked; then all
    edges, one a line."""
    if not d.items:
        return "%% no structural changes in this view\n"
    item = {x.id: x for x in d.items}
    below: dict[str, list[str]] = {}
    entered = {x.target for x in d.links}
    for x in d.links:
        below.setdefault(x.source, [])
        if x.target not in below[x.source]:
            below[x.source].append(x.target)
    roots = [x.id for x in d.items if x.id not in entered] or list(item)
    out, seen = [], set()
    for root in roots:
        if root in seen:
            continue
        stack = [(root, ())]
        while stack:
            at, way = stack.pop()
            again = at in way
            lead = "    " * len(way) + ("-> " if way else "")
            out.append(f"{MARK[item[at].shown] or ' '} {lead}{item[at].label()}" + (" (cycle)" if again else ""))
            if not again and at not in seen:
                seen.add(at)
                stack += [(c, (*way, at)) for c in reversed(below.get(at, []))]
    out += [f"{x.source} -> {x.target}" for x in d.links]
    out += [f"{x.id} : {x.unresolved} dynamic call(s) not shown" for x in d.dynamic]
    return "\n".join(out) + "\n"


# ---- layers --------------------------------------------------------------------------------------------------------------


def back_edges(n: int, edges: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """Edges to a vertex under way, in a depth-first walk from the vertices without entering edges, then from the rest."""
    out: dict[int, list[int]] = defaultdict(list)
    entered = {b for _, b in edges}
    for a, b in edges:
        out[a].append(b)
    order = [v for v in range(n) if v not in entered] + list(range(n))
    state, found = [0] * n, set()
    for root in order:
        if state[root]:
            continue
        state[root] = 1
        stack = [(root, iter(out[root]))]
        while stack:
            v, rest = stack[-1]
            w = next(rest, None)
            if w is None:
                state[v] = 2
                stack.pop()
            elif state[w] == 1:
                found.add((v, w))
            elif not state[w]:
                state[w] = 1
                stack.append((w, iter(out[w])))
    return found


def layers(n: int, edges: list[tuple[int, int]], back: set[tuple[int, int]]) -> list[int]:
    """Longest path to each vertex over the edges that don't go back."""
    ahead = [e for e in edges if e not in back]
    waits = [0] * n
    out: dict[int, list[int]] = defaultdict(list)
    for a, b in ahead:
        waits[b] += 1
        out[a].append(b)
    rank, ready = [0] * n, [v for v in range(n) if not waits[v]]
    while ready:
        v = ready.pop()
        for w in out[v]:
            rank[w] = max(rank[w], rank[v] + 1)
            waits[w] -= 1
            if not waits[w]:
                ready.append(w)
    return rank


def _flat(d: Drawing) -> tuple[list[tuple[str, str]], list[tuple[int, int]]]:
    """(css, name) of the items with a box per dynamic ceiling, and edges between their numbers without repeats."""
    number = {x.id: i for i, x in enumerate(d.items)}
    items = [(x.shown, flat_name(d, x)) for x in d.items]
    edges = {(number[x.source], number[x.target]) for x in d.links}
    for x in d.dynamic:
        edges.add((number[x.id], len(items)))
        items.append(("context", "dyn"))
    return items, sorted(edges)


class Canvas:
    """Characters by row and column."""

    def __init__(self):
        self.cells: dict[tuple[int, int], str] = {}

    def put(self, row: int, column: int, text: str) -> None:
        for k, c in enumerate(text):
            self.cells[row, column + k] = c

    def fill(self, row: int, column: int, c: str) -> None:
        self.cells.setdefault((row, column), c)

    def lines(self, height: int) -> list[str]:
        rows: dict[int, dict[int, str]] = defaultdict(dict)
        for (r, c), x in self.cells.items():
            rows[r][c] = x
        return ["".join(rows[r].get(c, " ") for c in range(max(rows[r], default=-1) + 1)).rstrip() for r in range(height)]


ROW = 4  # lines from one box to the next below


def boxes(d: Drawing) -> str:
    """Boxes in columns by rank, arrows between neighbouring columns, all other edges in a legend."""
    if not d.items:
        return "%% no structural changes in this view\n"
    items, edges = _flat(d)
    back = back_edges(len(items), edges)
    rank = layers(len(items), edges, back)
    labels = [(MARK[css] or " ") + name for css, name in items]
    columns: list[list[int]] = [[] for _ in range(max(rank) + 1)]
    for v, r in enumerate(rank):
        columns[r].append(v)
    line = {v: ROW * k + 1 for column in columns for k, v in enumerate(column)}
    drawn = [e for e in edges if e not in back and rank[e[1]] == rank[e[0]] + 1]
    width = [max(len(labels[v]) for v in column) + 4 for column in columns]
    bent = [sorted((e for e in drawn if rank[e[0]] == c and line[e[0]] != line[e[1]]), key=lambda e: (line[e[0]], line[e[1]], e[0])) for c in range(len(columns) - 1)]
    gap = [max(4, len(b) + 2) for b in bent]
    left = [sum(width[:c]) + sum(gap[:c]) for c in range(len(columns))]
    canvas = Canvas()
    for c, column in enumerate(columns):
        bar = "+" + "-" * (width[c] - 2) + "+"
        for v in column:
            canvas.put(line[v] - 1, left[c], bar)
            canvas.put(line[v], left[c], "| " + labels[v].ljust(width[c] - 4) + " |")
            canvas.put(line[v] + 1, left[c], bar)
    for c, jogs in enumerate(bent):
        start, end = left[c] + width[c], left[c + 1] - 1
        for a, b in drawn:
            if rank[a] == c and line[a] == line[b]:
                canvas.put(line[a], start, "-" * (end - start) + ">")
        for k, (a, b) in enumerate(jogs):
            bend = start + 1 + k
            canvas.put(line[a], start, "-" * (bend - start) + "+")
            for row in range(min(line[a], line[b]) + 1, max(line[a], line[b])):
                canvas.fill(row, bend, "|")
            canvas.put(line[b], bend, "+" + "-" * (end - bend - 1) + ">")
    out = canvas.lines(ROW * max(map(len, columns)) - 1)
    rest = [(e, "back" if e in back else "skip") for e in edges if e not in drawn]
    if rest:
        out += ["", "Legend:", *(f"  {items[a][1]} ---> {items[b][1]}  ({why})" for (a, b), why in rest)]
    return "\n".join(out) + "\n"


def svg(d: Drawing) -> str:
    """The same layers as rectangles and lines. Coordinates are this layout's own."""
    if not d.items:
        return "<!-- no structural changes in this view -->\n"
    items, edges = _flat(d)
    rank = layers(len(items), edges, back_edges(len(items), edges))
    high, wide, gap_x, gap_y, letter = 36, max(len(n) for _, n in items) * 8 + 24, 60, 24, 13
    place, used = [], defaultdict(int)
    for r in rank:
        place.append((r * (wide + gap_x) + 10, used[r] * (high + gap_y) + 10))
        used[r] += 1
    size = (max(x for x, _ in place) + wide + 10, max(y for _, y in place) + high + 10)
    out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{size[0]}" height="{size[1]}" font-family="monospace" font-size="{letter}">',
           '<defs><marker id="tip" markerWidth="8" markerHeight="8" refX="7" refY="4" orient="auto"><path d="M0,0 L8,4 L0,8 z"/></marker></defs>']
    for a, b in edges:
        (xa, ya), (xb, yb) = place[a], place[b]
        out.append(f'<line x1="{xa + wide}" y1="{ya + high // 2}" x2="{xb}" y2="{yb + high // 2}" stroke="#6b7280" marker-end="url(#tip)"/>')
    for (css, name), (x, y) in zip(items, place, strict=True):
        stroke, fill = COLOURS[css]
        out.append(f'<rect x="{x}" y="{y}" width="{wide}" height="{high}" rx="4" stroke="{stroke}" fill="{fill}"/>')
        out.append(f'<text x="{x + wide // 2}" y="{y + high // 2 + 5}" text-anchor="middle">{escape(name)}</text>')
    return "\n".join([*out, "</svg>"]) + "\n"


FORMATS = {"dot": dot, "ascii": tree, "boxes": boxes, "svg": svg}
REFUSED = {"dot": "// {} not supported for the sequence view; use mermaid\n", "ascii": "%% {} not supported for the sequence view; use mermaid\n", "boxes": "%% {} not supported for the sequence view; use mermaid\n", "svg": "<!-- {} not supported for the sequence view; use mermaid -->\n"}
