"""Diagrams: the exact text that a given selection has to give."""

from graphdelta.emit import mermaid, text
from graphdelta.emit.drawing import Drawing, Item, Link, marked_members

HEAD = "\n".join(mermaid.CLASS_DEFS) + "\n"


def drawing(view, items, links=(), **more):
    return Drawing(view, list(items), list(links), **more)


def test_modules_and_states():
    d = drawing("modules", [Item("crate::b"), Item("crate::a", "added"), Item("x", stub=True)], [Link("crate::a", "crate::b", "Uses", "added"), Link("crate::b", "crate::a", "Uses", "removed"), Link("crate::b", "x", "Uses")])
    assert mermaid.modules(d) == "flowchart LR\n" + HEAD + '    n0["crate::a"]:::added\n    n1["crate::b"]:::context\n    n2["x (external)"]:::context\n    n0 -->|+| n1\n    n1 -.->|-| n0\n    n1 --> n2\n'
    d = drawing("states", [Item("crate::Status::Active"), Item("crate::Status::Closed")], [Link("crate::Status::Active", "crate::Status::Closed", "Transitions", "added")])
    assert mermaid.states(d) == "stateDiagram-v2\n" + HEAD + '    state "crate::Status::Active" as s0\n    state "crate::Status::Closed" as s1\n    s0:::context\n    s1:::context\n    s0 --> s1 : +\n'
    assert mermaid.modules(drawing("modules", [])).endswith("    %% no structural changes in the module view\n")
    assert mermaid.overview(drawing("overview", [], full=True)).endswith("    %% empty overview\n")


def test_types():
    lines = marked_members(["id: u64", "total: Money"], ["customer: CustomerId", "id: u64", "total: Cents"], True)
    assert lines == ["+customer", "id", "~total"]
    assert marked_members(["a", "b"], ["a", "c"], True) == ["~a", "-b", "+c"]
    assert marked_members(["a"], ["a"], False) == ["a"]
    d = drawing("types", [Item("crate::Order", "changed", kind="Struct", fields=lines, methods=["+foo()"]), Item("crate::Billable", kind="Trait")], [Link("crate::Order", "crate::Billable", "Implements", "added")])
    assert mermaid.types(d) == "classDiagram\n" + HEAD + '    class c0["crate::Billable"] {\n        <<trait>>\n    }\n    class c1["crate::Order"] {\n        +customer\n        id\n        ~total\n        +foo()\n    }\n    class c0:::context\n    class c1:::changed\n    c1 ..|> c0\n'


def test_call_graph_and_overview():
    d = drawing("callgraph", [Item("crate::a::f", kind="Fn", unresolved=2), Item("crate::b::g", kind="Fn")], [Link("crate::a::f", "crate::b::g", "Calls")])
    assert mermaid.callgraph(d) == "flowchart LR\n" + HEAD + '    subgraph sg0["crate::a"]\n        f0["f"]:::context\n    end\n    subgraph sg1["crate::b"]\n        f1["g"]:::context\n    end\n    f0 --> f1\n    dyn0["dyn"]:::context\n    f0 -.-> dyn0\n'
    d = drawing("overview", [Item("crate::a::f", kind="Fn"), Item("crate::b::T", "added", kind="Struct")], [Link("crate::a::f", "crate::b::T", "Calls", "added")], modules={"crate::b": "added"}, module_links=[Link("crate::a", "crate::b", "Uses", "removed"), Link("crate::a", "crate::z", "Uses")])
    assert mermaid.overview(d) == "flowchart LR\n" + HEAD + '    subgraph sg0["crate::a"]\n        n0("f"):::context\n    end\n    subgraph sg1["crate::b (added)"]\n        n1["T"]:::added\n    end\n    n0 -->|calls +| n1\n    sg0 -.->|uses -| sg1\n'


def test_schema():
    d = drawing("schema", [Item("users", columns="id: Int4, name: Varchar"), Item("posts", "added", columns="id: Int4")], [Link("posts", "users", "ForeignKey", "added")])
    assert mermaid.schema(d) == 'erDiagram\n    posts {\n        delta added\n        Int4 id\n    }\n    users {\n        Int4 id\n        Varchar name\n    }\n    posts }o--|| users : "references (added)"\n'
    assert mermaid.schema(drawing("schema", [])) == "erDiagram\n    %% no schema tables\n"


def call(a, b, n, css="context"):
    return Link(a, b, "Calls", css, n)


def test_sequence():
    fns = {"crate::Widget::run", "crate::A::f", "crate::A::start"}
    run = mermaid.sequence("crate::Widget::run", [call("crate::Widget::run", "crate::Widget::init", 0), call("crate::Widget::run", "crate::helper", 1, "added")], fns, {}, set())
    assert run == "sequenceDiagram\n    participant p0 as crate::Widget\n    participant p1 as crate\n    p0 ->> p0 : init\n    rect rgb(240,253,244)\n        p0 ->> p1 : helper\n    end\n"
    gone = mermaid.sequence("crate::A::f", [call("crate::A::f", "crate::A::g", 0, "removed")], fns, {}, set())
    assert "        p0 ->> p0 : g (removed)\n" in gone
    noted = mermaid.sequence("crate::A::f", [call("crate::A::f", "crate::A::g", 0)], fns, {"crate::A::f": 2}, set())
    assert noted.endswith("    p0 ->> p0 : g\n    note over p0 : 2 dynamic call(s) not shown\n")
    ring = mermaid.sequence("crate::A::start", [call("crate::A::start", "crate::B::step", 0), call("crate::B::step", "crate::A::start", 0)], fns, {}, set())
    assert ring.endswith("    p0 ->> p1 : step\n    p1 ->> p0 : start\n")
    assert mermaid.sequence("x", [], fns, {}, set()) == "sequenceDiagram\n    %% no calls from x\n"
    assert mermaid.sequence(None, [], fns, {}, set()) == "sequenceDiagram\n    %% no entry fn specified\n"
    deep = [call(f"m::f{i}", f"m::f{i + 1}", 0) for i in range(60)]
    assert mermaid.sequence("m::f0", deep, {"m::f0"}, {}, set()).count("->>") == 32


def test_dot_and_tree():
    d = drawing("modules", [Item("crate::a", "added"), Item("crate::b"), Item("crate::c", "removed")], [Link("crate::a", "crate::b", "Uses", "added")])
    assert text.dot(d) == 'digraph {\n    n0 [label="crate::a",color="#22c55e",style=filled,fillcolor="#f0fdf4"];\n    n1 [label="crate::b",color="#d1d5db"];\n    n2 [label="crate::c",color="#ef4444",style="filled,dashed",fillcolor="#fef2f2"];\n    n0 -> n1 [color="#22c55e"];\n}\n'
    ring = drawing("modules", [Item("crate::a", "added"), Item("crate::b", "removed")], [Link("crate::a", "crate::b", "Uses"), Link("crate::b", "crate::a", "Uses")])
    assert text.tree(ring) == "+ crate::a\n-     -> crate::b\n+         -> crate::a (cycle)\ncrate::a -> crate::b\ncrate::b -> crate::a\n"


def boxes(ids, pairs, added=()):
    return text.boxes(drawing("modules", [Item(f"crate::{x}", "added" if x in added else "context") for x in ids], [Link(f"crate::{a}", f"crate::{b}", "Uses") for a, b in pairs]))


def test_boxes():
    assert boxes("abc", ["ab", "bc"]) == "+----+    +----+    +----+\n|  a |--->|  b |--->|  c |\n+----+    +----+    +----+\n"
    assert boxes("abcd", ["ab", "ac", "bd", "cd"]) == "+----+    +----+    +----+\n|  a |-+->|  b |-+->|  d |\n+----+ |  +----+ |  +----+\n       |         |\n       |  +----+ |\n       +->|  c |-+\n          +----+\n"
    assert boxes("ab", ["ab", "ba"], "a") == "+----+    +----+\n| +a |--->|  b |\n+----+    +----+\n\nLegend:\n  b ---> a  (back)\n"
    assert "  a ---> c  (skip)\n" in boxes("abc", ["ab", "bc", "ac"])


def test_svg_is_well_formed():
    from xml.etree import ElementTree

    d = drawing("types", [Item("crate::A<T>", kind="Struct", unresolved=1), Item("crate::B")], [Link("crate::A<T>", "crate::B", "Associates")])
    root = ElementTree.fromstring(text.svg(d))
    assert len([x for x in root.iter() if x.tag.endswith("rect")]) == 3
    assert text.svg(drawing("types", [])).startswith("<!--")
