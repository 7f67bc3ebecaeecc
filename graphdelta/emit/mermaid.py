"""Mermaid text, one dialect per view."""

from __future__ import annotations

import re
from itertools import groupby

from graphdelta.emit.drawing import Drawing, Item, Link, owner, short

#: The colours of the four classes.
CLASS_DEFS = (
    "    classDef added fill:#f0fdf4,stroke:#22c55e,stroke-width:2px",
    "    classDef removed fill:#fef2f2,stroke:#ef4444,stroke-width:2px,stroke-dasharray:4 4",
    "    classDef changed fill:#fffbeb,stroke:#f59e0b,stroke-width:2px",
    "    classDef context fill:#ffffff,stroke:#d1d5db,color:#9ca3af",
)
#: Tints of added and removed messages.
TINTS = {"added": "240,253,244", "removed": "254,242,242"}
EMPTY = {
    "modules": "no structural changes in the module view", "states": "no state machines (no enum has transitions)", "types": "no structural changes in the type view",
    "callgraph": "no structural changes in the call graph", "overview": "no structural changes in the overview",
}
DEPTH = 32


def _joined(lines) -> str:
    return "".join(f"{x}\n" for x in lines)


def _arrow(link: Link, tag: str = "") -> str:
    """Arrow and label of a flowchart edge."""
    mark = {"added": "+", "removed": "-"}.get(link.css, "")
    label = " ".join(filter(None, [tag, mark]))
    return ("-.->" if link.css == "removed" else "-->") + (f"|{label}|" if label else "")


def _start(d: Drawing, head: str) -> tuple[list[str], bool]:
    out = [head, *CLASS_DEFS]
    if not d.items:
        out.append("    %% " + ("empty overview" if d.view == "overview" and d.full else EMPTY[d.view]))
    return out, bool(d.items)


def _dynamic(d: Drawing, names: dict[str, str]):
    for i, x in enumerate(d.dynamic):
        yield f'    dyn{i}["dyn"]:::context'
        yield f"    {names[x.id]} -.-> dyn{i}"


def modules(d: Drawing) -> str:
    out, some = _start(d, "flowchart LR")
    names = d.handles("n")
    out += [f'    {names[x.id]}["{x.label()}"]:::{x.shown}' for x in d.items]
    out += [f"    {names[x.source]} {_arrow(x)} {names[x.target]}" for x in d.links]
    return _joined(out)


def states(d: Drawing) -> str:
    out, some = _start(d, "stateDiagram-v2")
    names = d.handles("s")
    out += [f'    state "{x.label()}" as {names[x.id]}' for x in d.items]
    out += [f"    {names[x.id]}:::{x.shown}" for x in d.items]
    out += [f"    {names[x.source]} --> {names[x.target]}" + {"added": " : +", "removed": " : -"}.get(x.css, "") for x in d.links]
    return _joined(out)


def types(d: Drawing) -> str:
    out, some = _start(d, "classDiagram")
    names = d.handles("c")
    for x in d.items:
        body = [] if x.stub else (["<<trait>>"] if x.kind == "Trait" else []) + x.fields + x.methods
        head = f'    class {names[x.id]}["{x.label()}"]'
        out += [f"{head} {{", *(f"        {line}" for line in body), "    }"] if body else [head]
    out += [f"    class {names[x.id]}:::{x.shown}" for x in d.items]
    out += [f"    {names[x.source]} {'..|>' if x.kind == 'Implements' else '-->'} {names[x.target]}" for x in d.links]
    return _joined(out)


def _by_owner(items: list[Item]) -> list[tuple[str, list[Item]]]:
    return [(k, list(v)) for k, v in groupby(sorted(items, key=lambda x: (owner(x.id), x.id)), key=lambda x: owner(x.id))]


def callgraph(d: Drawing) -> str:
    out, some = _start(d, "flowchart LR")
    names = d.handles("f")
    for i, (name, items) in enumerate(_by_owner(d.items)):
        out += [f'    subgraph sg{i}["{name}"]', *(f'        {names[x.id]}["{x.label(short(x.id))}"]:::{x.shown}' for x in items), "    end"]
    out += [f"    {names[x.source]} {_arrow(x)} {names[x.target]}" for x in d.links]
    return _joined([*out, *_dynamic(d, names)])


def overview(d: Drawing) -> str:
    out, some = _start(d, "flowchart LR")
    names, boxes = d.handles("n"), {}
    for i, (name, items) in enumerate(_by_owner(d.items)):
        boxes[name] = f"sg{i}"
        title = name + {"added": " (added)", "removed": " (removed)"}.get(d.modules.get(name, ""), "")
        out.append(f'    subgraph sg{i}["{title}"]')
        for x in items:
            shape = '("%s")' if x.kind == "Fn" else '["%s"]'
            out.append(f"        {names[x.id]}{shape % x.label(short(x.id))}:::{x.shown}")
        out.append("    end")
    tags = {"Implements": "impl", "Associates": "assoc", "Calls": "calls"}
    out += [f"    {names[x.source]} {_arrow(x, tags.get(x.kind, 'calls'))} {names[x.target]}" for x in d.links]
    if some:
        between = sorted((x for x in d.module_links if x.source in boxes and x.target in boxes), key=lambda x: (x.source, x.target))
        out += [f"    {boxes[x.source]} {_arrow(x, 'uses')} {boxes[x.target]}" for x in between]
    return _joined([*out, *_dynamic(d, names)])


def _plain(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]", "_", name)


def schema(d: Drawing) -> str:
    """Entities can't be coloured: an added or removed table has a first row that says so, a key a word in its label."""
    out = ["erDiagram"]
    if not d.items:
        out.append("    %% no schema tables")
    for x in d.items:
        rows = []
        for part in (x.columns or "").split(","):
            name, found, kind = part.partition(":")
            if found and name.strip() and kind.strip():
                rows.append(f"        {_plain(kind.strip())} {_plain(name.strip())}")
        rows = [] if x.stub else rows
        if x.shown in ("added", "removed"):
            rows.insert(0, f"        delta {x.shown}")
        out += [f"    {_plain(x.id)} {{", *rows, "    }"] if rows else [f"    {_plain(x.id)}"]
    for x in d.links:
        label = "references" + {"added": " (added)", "removed": " (removed)"}.get(x.css, "")
        out.append(f'    {_plain(x.source)} }}o--|| {_plain(x.target)} : "{label}"')
    return _joined(out)


def sequence(entry: str | None, calls: list[Link], functions: set[str], unresolved: dict[str, int], outside: set[str], depth: int = DEPTH) -> str:
    """Calls from an entry, depth first in source order. A callee that is under way already, is out of scope, or lies `depth`
    calls deep is named and not entered. Written without recursion: a stack of (function, rest of its calls)."""
    if entry is None:
        return "sequenceDiagram\n    %% no entry fn specified\n"
    out: dict[str, list[Link]] = {}
    for x in sorted(calls, key=lambda x: (x.ordinal is not None, x.ordinal or 0, x.target)):
        out.setdefault(x.source, []).append(x)
    if entry not in functions or not out.get(entry):
        return f"sequenceDiagram\n    %% no calls from {entry}\n"
    alias: dict[str, str] = {}
    name = lambda id_: alias.setdefault(owner(id_), f"p{len(alias)}")
    lines, stack, under_way = [], [(entry, iter(out[entry]))], [entry]
    while stack:
        now, rest = stack[-1]
        x = next(rest, None)
        if x is None:
            if n := unresolved.get(now):
                lines.append(f"    note over {name(now)} : {n} dynamic call(s) not shown")
            stack.pop()
            under_way.pop()
            continue
        caller, callee = name(now), name(x.target)
        message = f"{caller} ->> {callee} : {short(x.target)}" + (" (removed)" if x.css == "removed" else "")
        lines += [f"    rect rgb({TINTS[x.css]})", f"        {message}", "    end"] if x.css in TINTS else [f"    {message}"]
        if len(stack) < depth and x.target not in under_way and x.target in out and x.target not in outside:
            stack.append((x.target, iter(out[x.target])))
            under_way.append(x.target)
    return _joined(["sequenceDiagram", *(f"    participant {p} as {who}" for who, p in alias.items()), *lines])


VIEWS = {"modules": modules, "states": states, "types": types, "callgraph": callgraph, "schema": schema, "overview": overview}
