"""Items of one Rust file as raw facts: nodes, uses, calls, implementations, associations, transitions, submodules."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from hashlib import sha256

from graphdelta.sources.rustsrc.lexer import partners, tokens

#: Generic types that stand for what they hold, and constructors that wrap a next state.
WRAPPERS = {"Arc", "Box", "Rc", "Vec", "Option"}
STATE_WRAPPERS = {"Ok", "Some"}
KEYWORDS = set("as async await break const continue crate dyn else enum extern fn for if impl in let loop match mod move mut pub ref return static struct super trait type union unsafe use where while yield box".split()) - {"crate", "super", "union"}
PRIMITIVES = set("bool char str u8 u16 u32 u64 u128 usize i8 i16 i32 i64 i128 isize f32 f64".split())
MODIFIERS = {"pub", "unsafe", "async", "const", "extern", "default", "safe"}
OPEN, CLOSE = "([{", ")]}"


@dataclass
class Fingerprint:
    members: set[str] = field(default_factory=set)
    field_types: Counter = field(default_factory=Counter)
    member_types: dict[str, str] = field(default_factory=dict)
    doc_hash: str = "0"


@dataclass
class Facts:
    """Rows of one file; ids are absolute. Every row starts with its kind."""

    rows: list[dict] = field(default_factory=list)

    def add(self, fact: str, span: tuple[int, int], **values) -> None:
        self.rows.append({"fact": fact, "start": span[0], "end": span[1], "seq": len(self.rows), **values})


def doc_hash(text: str) -> str:
    text = text.strip()
    return sha256(text.encode()).hexdigest() if text else "0"


def normalize(path: str, module: str) -> str | None:
    """crate, self and super made absolute against a module; None for other paths."""
    parts, base = path.split("::"), module.split("::")
    if parts[0] == "crate":
        return "::".join(base[:1] + parts[1:])
    if parts[0] == "self":
        return "::".join(base + parts[1:])
    ups = next((i for i, p in enumerate(parts) if p != "super"), len(parts))
    if not ups or ups >= len(base):
        return None
    return "::".join(base[: len(base) - ups] + parts[ups:])


def resolve_local(path: str, module: str) -> str | None:
    """A bare name belongs to the module it is written in; a path from elsewhere is not known."""
    if path.split("::")[0] in ("crate", "self", "super"):
        return normalize(path, module)
    return None if not path or "::" in path else f"{module}::{path}"


class Parser:
    def __init__(self, source: bytes, module: str):
        self.source = source
        self.toks = tokens(source)
        self.pair = partners(self.toks)
        self.facts = Facts()
        self.module = module

    # ---- reading tokens ----------------------------------------------------------------------------------------------------

    def is_(self, i: int, *texts: str) -> bool:
        return i < len(self.toks) and self.toks[i].text in texts and self.toks[i].kind in ("ident", "punct")

    def ident(self, i: int) -> str | None:
        return self.toks[i].text if i < len(self.toks) and self.toks[i].kind == "ident" else None

    def text(self, lo: int, hi: int) -> str:
        return self.source[self.toks[lo].start : self.toks[hi - 1].end].decode("utf-8", "replace") if lo < hi else ""

    def span(self, lo: int, hi: int) -> tuple[int, int]:
        return self.toks[lo].start, self.toks[min(hi, len(self.toks)) - 1].end

    def after(self, i: int) -> int:
        """The token behind a bracketed group, or behind one token."""
        return self.pair[i] + 1 if self.pair[i] >= 0 else i + 1

    def find(self, lo: int, hi: int, *texts: str, angles: bool = False) -> int:
        """The first of some tokens outside brackets (and outside <>, in types), else hi."""
        i, depth = lo, 0
        while i < hi:
            t = self.toks[i]
            if t.kind in ("punct", "ident") and depth == 0 and t.text in texts:
                return i
            if angles and t.kind == "punct":
                depth = depth + 1 if t.text == "<" else max(0, depth - 1) if t.text == ">" else depth
            i = self.after(i)
        return hi

    def split(self, lo: int, hi: int, angles: bool = True, by: str = ",") -> list[tuple[int, int]]:
        out = []
        while lo < hi:
            end = self.find(lo, hi, by, angles=angles)
            if end > lo:
                out.append((lo, end))
            lo = end + 1
        return out

    def generics(self, i: int) -> int:
        """Behind <...>, if it starts here."""
        if not self.is_(i, "<"):
            return i
        depth = 0
        while i < len(self.toks):
            depth += {"<": 1, ">": -1}.get(self.toks[i].text, 0) if self.toks[i].kind == "punct" else 0
            i = self.after(i)
            if not depth:
                break
        return i

    def attributes(self, i: int, hi: int) -> int:
        """Behind attributes, docs and a visibility."""
        while i < hi:
            if self.toks[i].kind == "doc":
                i += 1
            elif self.is_(i, "#"):
                i = self.after(i + 2 if self.is_(i + 1, "!") else i + 1)
            elif self.is_(i, "pub"):
                i = self.after(i + 1) if self.is_(i + 1, "(") else i + 1
            else:
                break
        return i

    # ---- types -------------------------------------------------------------------------------------------------------------

    def path_at(self, i: int, hi: int) -> tuple[list[str], int]:
        """Segments of a path from here, without generic arguments, and the token behind it."""
        out = []
        i = i + 1 if self.is_(i, "::") else i
        while i < hi and self.toks[i].kind == "ident":
            out.append(self.toks[i].text)
            if self.is_(i + 1, "::") and i + 2 < hi and self.toks[i + 2].kind == "ident":
                i += 2
            else:
                i += 1
                break
        return out, i

    def type_paths(self, lo: int, hi: int) -> list[list[str]]:
        """Paths of what a type reaches: wrappers, references, tuples, arrays and dyn are looked through."""
        while lo < hi and (self.is_(lo, "&", "&&", "mut", "dyn") or self.toks[lo].kind == "life"):
            lo += 1
        if lo >= hi:
            return []
        if self.is_(lo, "("):
            return [p for a, b in self.split(lo + 1, self.pair[lo]) for p in self.type_paths(a, b)]
        if self.is_(lo, "["):
            return self.type_paths(lo + 1, self.find(lo + 1, self.pair[lo], ";"))
        if self.is_(lo, "*", "fn", "impl", "<", "!", "unsafe", "extern", "for"):
            return []
        path, i = self.path_at(lo, hi)
        if not path or self.is_(i, "("):
            return []
        i = i + 1 if self.is_(i, "::") else i
        if self.is_(i, "<") and path[-1] in WRAPPERS:
            end = self.generics(i) - 1
            return [p for a, b in self.split(i + 1, end) for p in self.type_paths(a, b)]
        return [path]

    def type_names(self, lo: int, hi: int) -> list[str]:
        return [p[-1] for p in self.type_paths(lo, hi)]

    def associate(self, owner: str, module: str, lo: int, hi: int) -> None:
        for p in self.type_paths(lo, hi):
            if not (len(p) == 1 and p[0] in PRIMITIVES) and (to := resolve_local("::".join(p), module)):
                self.facts.add("assoc", self.span(lo, hi), a=owner, b=to)

    # ---- items -------------------------------------------------------------------------------------------------------------

    def run(self) -> list[dict]:
        self.body(0, len(self.toks), self.module)
        return self.facts.rows

    def leading(self, i: int, hi: int) -> tuple[int, str, bool, str | None]:
        """Docs and attributes before an item: (the item's token, documentation, cfg(test), path)."""
        docs, test, path = [], False, None
        while i < hi:
            if self.toks[i].kind == "doc":
                docs.append(self.toks[i].text[3:] + "\n")
                i += 1
            elif self.is_(i, "#") and self.is_(i + 1, "["):
                end = self.pair[i + 1]
                if self.ident(i + 2) == "cfg" and "test" in self.text(i + 3, end):
                    test = True
                elif self.ident(i + 2) == "path" and end > i + 4 and self.toks[i + 4].kind == "string":
                    path = self.toks[i + 4].text.strip('"')
                i = end + 1
            elif self.is_(i, "#") and self.is_(i + 1, "!"):
                i, docs, test, path = self.after(i + 2), [], False, None
            else:
                break
        return i, "".join(docs), test, path

    def body(self, lo: int, hi: int, module: str) -> None:
        while lo < hi:
            i, doc, test, path = self.leading(lo, hi)
            if i >= hi:
                return
            lo = self.item(i, hi, module, doc, path, emit=not test)

    def item(self, start: int, hi: int, module: str, doc: str, path: str | None, emit: bool) -> int:
        """Reads one item; returns the token behind it."""
        i, public = start, False
        while i < hi and self.ident(i) in MODIFIERS:
            if self.is_(i, "pub"):
                public = True
                i = self.after(i + 1) if self.is_(i + 1, "(") else i + 1
            elif self.is_(i, "extern") and i + 1 < hi and self.toks[i + 1].kind == "string":
                i += 2
            elif self.is_(i, "const") and not self.is_(i + 1, "fn", "unsafe", "async", "extern"):
                break
            else:
                i += 1
        word = self.ident(i)
        end = self.item_end(i, hi)
        if not emit:
            return end
        name = self.ident(i + 1)
        if word == "use":
            self.uses(i + 1, end - 1 if self.is_(end - 1, ";") else end, "", module, public, self.span(start, end))
        elif word == "impl":
            self.implementation(i, end, module)
        elif word == "mod" and name:
            self.submodule(i, end, module, name, path, self.span(start, end))
        elif word in ("struct", "enum", "trait", "fn") and name:
            getattr(self, f"{word}_item")(i, end, f"{module}::{name}", module, doc, self.span(start, end))
        return end

    def item_end(self, i: int, hi: int) -> int:
        """Behind the ; or the braces that end an item."""
        ends_with_braces = self.ident(i) not in ("use", "const", "static", "type")
        while i < hi:
            if self.is_(i, ";"):
                return i + 1
            if ends_with_braces and self.is_(i, "{"):
                return min(self.pair[i] + 1, hi)
            i = self.after(i)
        return hi

    def node(self, kind: str, id_: str, span: tuple[int, int], fp: Fingerprint | None = None, sig: str | None = None) -> None:
        self.facts.add("node", span, a=id_, kind=kind, sig=sig, fp=fp)

    def fields(self, lo: int, hi: int) -> list[tuple[str | None, int, int]]:
        """(name, type) of named fields."""
        out = []
        for a, b in self.split(lo, hi):
            a = self.attributes(a, b)
            if a < b and self.is_(a + 1, ":"):
                out.append((self.ident(a), a + 2, b))
        return out

    def tuple_fields(self, lo: int, hi: int) -> list[tuple[int, int]]:
        return [(self.attributes(a, b), b) for a, b in self.split(lo, hi) if self.attributes(a, b) < b]

    def struct_item(self, i: int, end: int, id_: str, module: str, doc: str, span) -> None:
        fp = Fingerprint(doc_hash=doc_hash(doc))
        at = self.find(self.generics(i + 2), end, "{", "(", ";")
        if self.is_(at, "{"):
            for name, a, b in self.fields(at + 1, self.pair[at]):
                fp.members.add(name)
                fp.field_types.update(self.type_names(a, b))
                fp.member_types[name] = ",".join(self.type_names(a, b))
        elif self.is_(at, "("):
            for a, b in self.tuple_fields(at + 1, self.pair[at]):
                fp.field_types.update(self.type_names(a, b))
        self.node("Struct", id_, span, fp)
        if self.is_(at, "{"):
            for _, a, b in self.fields(at + 1, self.pair[at]):
                self.associate(id_, module, a, b)
        elif self.is_(at, "("):
            for a, b in self.tuple_fields(at + 1, self.pair[at]):
                self.associate(id_, module, a, b)

    def enum_item(self, i: int, end: int, id_: str, module: str, doc: str, span) -> None:
        fp = Fingerprint(doc_hash=doc_hash(doc))
        at = self.find(self.generics(i + 2), end, "{")
        variants, held = [], []
        if at < end:
            for a, b in self.split(at + 1, self.pair[at], angles=False):
                first = a
                a = self.attributes(a, b)
                name = self.ident(a) if a < b else None
                if not name:
                    continue
                types = []
                if self.is_(a + 1, "("):
                    types = self.tuple_fields(a + 2, self.pair[a + 1])
                elif self.is_(a + 1, "{"):
                    types = [(x, y) for _, x, y in self.fields(a + 2, self.pair[a + 1])]
                names = [n for x, y in types for n in self.type_names(x, y)]
                fp.members.add(name)
                fp.field_types.update(names)
                fp.member_types[name] = ",".join(names)
                variants.append((f"{id_}::{name}", self.span(first, b)))
                held += types
        self.node("Enum", id_, span, fp)
        for variant, where in variants:
            self.node("Variant", variant, where)
        for a, b in held:
            self.associate(id_, module, a, b)

    def trait_item(self, i: int, end: int, id_: str, module: str, doc: str, span) -> None:
        fp = Fingerprint(doc_hash=doc_hash(doc))
        at = self.find(self.generics(i + 2), end, "{")
        lo, hi = at + 1, self.pair[at] if at < end else at
        while lo < hi:
            lo = self.leading(lo, hi)[0]
            a = lo
            while a < hi and self.ident(a) in MODIFIERS and not (self.is_(a, "const") and not self.is_(a + 1, "fn", "unsafe", "async")):
                a += 2 if self.is_(a, "extern") and a + 1 < hi and self.toks[a + 1].kind == "string" else 1
            if a >= hi:
                break
            word, name, stop = self.ident(a), self.ident(a + 1), self.item_end(a, hi)
            if name and word in ("fn", "const", "type"):
                kinds: list[str] = []
                if word == "fn":
                    _, x, y = self.signature(a, stop)
                    kinds = self.type_names(x, y)
                elif word == "const" and self.is_(a + 2, ":"):
                    kinds = self.type_names(a + 3, self.find(a + 3, stop, "=", ";"))
                fp.members.add(name)
                fp.member_types[name] = ",".join(kinds)
            lo = max(stop, lo + 1)
        self.node("Trait", id_, span, fp)

    def signature(self, i: int, end: int) -> tuple[int, int, int]:
        """Of a function at its `fn`: the parameters' bracket, and where the returned type starts and ends."""
        at = self.generics(i + 2)
        stop = self.after(at) if self.is_(at, "(") else at
        if not self.is_(stop, "->"):
            return at, stop, stop
        return at, stop + 1, self.find(stop + 1, end, "where", "{", ";")

    def parameters(self, at: int) -> list[tuple[str | None, int, int, str]]:
        """(name, type, text) of each; a receiver has no type."""
        out = []
        for a, b in self.split(at + 1, self.pair[at]):
            a = self.attributes(a, b)
            colon = self.find(a, b, ":")
            if any(self.is_(k, "self") for k in range(a, min(colon, b))):
                out.append(("self", b, b, self.text(a, b)))
                continue
            own = a + 1 if self.is_(a, "mut") else a
            name = self.ident(own) if colon == own + 1 else None
            out.append((name, min(colon + 1, b), b, f"{self.text(own, min(colon, b))}: {self.text(colon + 1, b)}" if colon < b else self.text(a, b)))
        return out

    def function(self, i: int, end: int, id_: str, doc: str, span) -> int:
        """Emits a function; returns the brace of its body, or end."""
        at, lo, hi = self.signature(i, end)
        fp, given = Fingerprint(doc_hash=doc_hash(doc)), self.parameters(at) if self.is_(at, "(") else []
        for name, a, b, _ in given:
            if name == "self":
                continue
            fp.field_types.update(self.type_names(a, b))
            if name:
                fp.members.add(name)
                fp.member_types[name] = ",".join(self.type_names(a, b))
        fp.field_types.update(self.type_names(lo, hi))
        sig = "(" + ", ".join(t for *_, t in given) + ")" + (f" -> {self.text(lo, hi)}" if hi > lo else "")
        self.node("Fn", id_, span, fp, sig)
        return self.find(max(hi, at), end, "{")

    def fn_item(self, i: int, end: int, id_: str, module: str, doc: str, span) -> None:
        brace = self.function(i, end, id_, doc, span)
        if brace < end:
            self.calls(brace + 1, self.pair[brace], id_, module, None)

    def submodule(self, i: int, end: int, module: str, name: str, path: str | None, span) -> None:
        if name == "tests":
            return
        child = f"{module}::{name}"
        if self.is_(i + 2, "{"):
            self.node("Module", child, span)
            self.body(i + 3, self.pair[i + 2], child)
        else:
            self.facts.add("mod", span, a=child, b=name, sig=path)

    def uses(self, lo: int, hi: int, prefix: str, module: str, public: bool, span) -> None:
        join = lambda a, b: "::".join(filter(None, [a, b]))
        segments, i, glob, alias = [], lo, False, None
        while i < hi:
            if self.is_(i, "{"):
                for a, b in self.split(i + 1, self.pair[i], angles=False):
                    self.uses(a, b, join(prefix, "::".join(segments)), module, public, span)
                return
            if self.is_(i, "*"):
                glob = True
            elif self.is_(i, "as"):
                alias = self.ident(i + 1)
                break
            elif self.toks[i].kind == "ident":
                segments.append(self.toks[i].text)
            i += 1
        target = join(prefix, "::".join(segments))
        if target:
            self.facts.add("use", span, a=module, b=target, kind=alias or target.rpartition("::")[2], is_pub=public, is_glob=glob)

    def implementation(self, i: int, end: int, module: str) -> None:
        at = self.generics(i + 1)
        brace = self.find(at, end, "{", "where", ";", angles=True)
        middle = self.find(at, brace, "for", angles=True)
        lo = middle + 1 if middle < brace else at
        path, behind = self.path_at(lo, brace)
        plain = bool(path) and (behind >= brace or self.is_(behind, "<") or (self.is_(behind, "::") and self.is_(behind + 1, "<")))
        own = "::".join(path) if plain else ""
        if middle < brace:
            trait, _ = self.path_at(at + 1 if self.is_(at, "!") else at, middle)
            a, b = resolve_local(own, module), resolve_local("::".join(trait), module)
            if a and b:
                self.facts.add("impl", self.span(i, end), a=a, b=b)
        name = path[-1] if plain else self.text(lo, brace)
        body = self.find(brace, end, "{")
        if not name or body >= end:
            return
        enum_id = f"{module}::{name}"
        self_type = resolve_local(own, module) or enum_id
        lo, hi = body + 1, self.pair[body]
        while lo < hi:
            first, doc, test, _ = self.leading(lo, hi)
            if first >= hi:
                break
            k = first
            while k < hi and self.ident(k) in MODIFIERS and not (self.is_(k, "const") and not self.is_(k + 1, "fn", "unsafe", "async")):
                k = self.after(k + 1) if self.is_(k, "pub") and self.is_(k + 1, "(") else k + (2 if self.is_(k, "extern") and self.toks[k + 1].kind == "string" else 1)
            stop = self.item_end(k, hi)
            if self.ident(k) == "fn" and self.ident(k + 1) and not test:
                id_ = f"{self_type}::{self.ident(k + 1)}"
                inner = self.function(k, stop, id_, doc, self.span(first, stop))
                if inner < stop:
                    self.calls(inner + 1, self.pair[inner], id_, module, self_type)
                    self.transitions(k, inner, enum_id, name)
            lo = max(stop, lo + 1)

    # ---- bodies ------------------------------------------------------------------------------------------------------------

    def skipped(self, lo: int, hi: int) -> dict[int, int]:
        """Ranges of a body that hold no calls, by their start: patterns, macros, attributes, items of their own."""
        out: dict[int, int] = {}
        i = lo
        while i < hi:
            t = self.toks[i]
            if t.kind == "ident":
                if self.is_(i + 1, "!") and i + 2 < hi and self.is_(i + 2, *OPEN) or (self.is_(i + 1, "!") and self.ident(i + 2) and self.is_(i + 3, *OPEN)):
                    out[i] = self.after(i + 2 if self.is_(i + 2, *OPEN) else i + 3)
                elif t.text == "let":
                    out[i] = self.find(i + 1, hi, "=", ";", angles=False)
                elif t.text == "for" and not self.is_(i + 1, "<"):
                    out[i] = self.find(i + 1, hi, "in")
                elif t.text in ("fn", "struct", "enum", "trait", "impl", "mod", "use") and self.starts_statement(i):
                    out[i] = self.item_end(i, hi)
                elif t.text == "match":
                    body = self.find(i + 1, hi, "{")
                    for a, b, _, _ in self.arms(body):
                        out[a] = b
            elif self.is_(i, "#") and self.is_(i + 1, "[", "!"):
                out[i] = self.after(i + 2 if self.is_(i + 1, "!") else i + 1)
            i += 1
        return out

    def starts_statement(self, i: int) -> bool:
        """Whether an item's word stands where an item can; `impl` and `fn` also occur in types."""
        before = self.toks[i - 1].text if i else ";"
        return before in (";", "{", "}", "]") or before in MODIFIERS or before == ")"

    def calls(self, lo: int, hi: int, caller: str, module: str, self_type: str | None) -> None:
        skip = self.skipped(lo, hi)
        found, i = [], lo
        while i < hi:
            if i in skip and skip[i] > i:
                i = skip[i]
                continue
            if self.is_(i, "(") and i > lo:
                if (call := self.call_before(i, lo, module, self_type)) is not None:
                    found.append((call[0], call[1], i))
            i += 1
        for start, callee, bracket in sorted(found, key=lambda x: (self.toks[x[0]].start, -self.toks[min(self.pair[x[2]], len(self.toks) - 1)].end)):
            self.facts.add("call", (self.toks[start].start, self.toks[min(self.pair[bracket], len(self.toks) - 1)].end), a=caller, b=callee)

    def call_before(self, i: int, lo: int, module: str, self_type: str | None) -> tuple[int, str | None] | None:
        """(first token, callee or None) of the call whose arguments open at i; None if it is no call."""
        k = i - 1
        last = self.toks[k]
        if last.kind == "ident" and last.text not in KEYWORDS:
            first = k
            while first - 2 >= lo and self.is_(first - 1, "::") and self.toks[first - 2].kind == "ident":
                first -= 2
            segments = [self.toks[x].text for x in range(first, i, 2)]
            if self.is_(first - 1, "fn") and first - 1 >= lo:
                return None
            if self.is_(first - 1, "."):
                if len(segments) == 1 and self.is_(first - 2, "self") and not self.is_(first - 3, "."):
                    return first - 2, f"{self_type}::{segments[0]}" if self_type else None
                return first, None
            if self.is_(first - 1, "::"):
                return first, None
            if segments[0] == "Self" and len(segments) > 1:
                return first, f"{self_type}::{segments[-1]}" if self_type else None
            return first, resolve_local("::".join(segments), module)
        if last.kind == "punct" and last.text in (")", "]", "?") or (last.text == ">" and self.turbofish(k, lo)):
            return k, None
        return None

    def turbofish(self, k: int, lo: int) -> bool:
        depth = 0
        while k >= lo:
            depth += {">": 1, "<": -1}.get(self.toks[k].text, 0) if self.toks[k].kind == "punct" else 0
            if not depth:
                return self.is_(k - 1, "::")
            k -= 1
        return False

    # ---- transitions -------------------------------------------------------------------------------------------------------

    def arms(self, body: int) -> list[tuple[int, int, int, int]]:
        """(pattern start, pattern end without guard, value start, value end) of a match's arms."""
        if body >= len(self.toks) or self.pair[body] < 0:
            return []
        out, i, hi = [], body + 1, self.pair[body]
        while i < hi:
            i = self.attributes(i, hi)
            arrow = self.find(i, hi, "=>")
            if arrow >= hi:
                break
            guard = self.find(i, arrow, "if")
            lo = arrow + 1
            if self.is_(lo, "{"):
                end = behind = self.pair[lo] + 1
                behind = behind + 1 if self.is_(behind, ",") else behind
            else:
                end = self.find(lo, hi, ",")
                behind = end + 1
            out.append((i, guard, lo, end))
            i = behind
        return out

    def transitions(self, fn: int, brace: int, enum_id: str, enum: str) -> None:
        at, _, _ = self.signature(fn, brace)
        given = self.parameters(at) if self.is_(at, "(") else []
        has_self = any(name == "self" for name, *_ in given)
        typed = set()
        for name, a, b, _ in given:
            path, behind = self.path_at(a, b)
            if name and name != "self" and path and path[-1] == enum and (behind >= b or self.is_(behind, "<")):
                typed.add(name)
        for i in range(brace + 1, self.pair[brace]):
            if not self.is_(i, "match") or self.toks[i].kind != "ident":
                continue
            body = self.find(i + 1, self.pair[brace], "{")
            if self.reads_state(i + 1, body, has_self, typed):
                for a, b, lo, hi in self.arms(body):
                    if (was := self.variant(a, b, enum, pattern=True)) is not None:
                        for now in self.next_states(lo, hi, enum):
                            self.facts.add("transition", self.span(a, hi), a=f"{enum_id}::{was}", b=f"{enum_id}::{now}")

    def reads_state(self, lo: int, hi: int, has_self: bool, typed: set[str]) -> bool:
        if hi == lo + 1:
            return (self.is_(lo, "self") and has_self) or self.ident(lo) in typed
        inside = any(self.is_(k, "self") for k in range(lo, hi))
        if self.is_(lo, "("):
            return has_self and inside and self.after(lo) == hi and self.find(lo + 1, self.pair[lo], ",") == self.pair[lo]
        return has_self and inside and self.is_(lo, "*", "&", "-", "!")

    def variant(self, lo: int, hi: int, enum: str, pattern: bool = False) -> str | None:
        """The variant that a path, a constructor or a pattern of one names, if it can be one of the enum."""
        path, i = self.path_at(lo, hi)
        if not path or path[0] in KEYWORDS or path[-1] in KEYWORDS or (path[0] == "self" and len(path) == 1) or path[-1] == "_":
            return None
        if i < hi and not (self.is_(i, "(", "{") and self.after(i) == hi):
            return None
        if len(path) > 1 and path[-2] not in (enum, "Self"):
            return None
        return path[-1]

    def next_states(self, lo: int, hi: int, enum: str) -> list[str]:
        """Variants that an arm's value, or a statement directly in its block, results in."""
        if self.is_(lo, "{") and self.after(lo) >= hi:
            return [v for a, b in self.statements(lo + 1, self.pair[lo]) for v in self.next_states(a, b, enum)]
        if self.is_(lo, "return"):
            return self.wrapped(lo + 1, hi, enum)
        equals = self.find(lo, hi, "=")
        if equals < hi:
            field = self.is_(lo, "self") and self.is_(lo + 1, ".") and equals == lo + 3
            whole = self.is_(lo, "*") and any(self.is_(k, "self") for k in range(lo, equals))
            return self.wrapped(equals + 1, hi, enum) if field or whole else []
        return self.wrapped(lo, hi, enum)

    def wrapped(self, lo: int, hi: int, enum: str) -> list[str]:
        out = [v] if (v := self.variant(lo, hi, enum)) is not None else []
        if self.ident(lo) in STATE_WRAPPERS and self.is_(lo + 1, "(") and self.after(lo + 1) == hi:
            out += [v for a, b in self.split(lo + 2, self.pair[lo + 1], angles=False) for v in self.wrapped(a, b, enum)]
        return out

    def statements(self, lo: int, hi: int) -> list[tuple[int, int]]:
        out = []
        while lo < hi:
            if self.is_(lo, "{"):
                out.append((lo, self.pair[lo] + 1))
                lo = self.pair[lo] + 1
            elif self.ident(lo) in ("if", "match", "loop", "while", "for", "unsafe"):
                while True:  # an if may go on with else
                    lo = self.after(self.find(lo, hi, "{"))
                    if not self.is_(lo, "else"):
                        break
                lo = lo + 1 if self.is_(lo, ";") else lo
            else:
                end = self.find(lo, hi, ";")
                if not self.is_(lo, "let") and end > lo:
                    out.append((lo, end))
                lo = end + 1
        return [(a, b) for a, b in out if a < len(self.toks)]


def parse(source: bytes, module: str) -> list[dict]:
    return Parser(source, module).run()


# ---- schema macros -----------------------------------------------------------------------------------------------------------


def parse_schema(source: bytes, module: str = "") -> list[dict]:
    """Rows of `table!` (a: name, b: sorted columns) and `joinable!` (a: child, b: parent) macros."""
    p = Parser(source, module)
    out = Facts()
    for i in range(len(p.toks) - 2):
        if p.toks[i].kind != "ident" or not p.is_(i + 1, "!") or not p.is_(i + 2, *OPEN):
            continue
        lo, hi = i + 3, p.pair[i + 2]
        if p.toks[i].text == "table":
            lo = p.attributes(lo, hi)
            names, behind = p.path_at(lo, hi)
            while p.is_(behind, ".") and p.ident(behind + 1):
                names.append(p.ident(behind + 1))
                behind += 2
            brace = p.find(behind, hi, "{")
            columns = []
            for a, b in p.split(brace + 1, p.pair[brace] if brace < hi else brace):
                arrow = p.find(a, b, "->")
                if arrow < b and arrow > a:
                    columns.append((p.toks[arrow - 1].text, re.sub(r"\s+", " ", p.text(arrow + 1, b)).strip()))
            if names:
                out.add("table", p.span(i, hi + 1), a=names[0], b=", ".join(f"{n}: {t}" for n, t in sorted(columns)))
        elif p.toks[i].text == "joinable" and p.ident(lo) and p.is_(lo + 1, "->") and p.ident(lo + 2):
            out.add("join", p.span(i, hi + 1), a=p.ident(lo), b=p.ident(lo + 2))
    return out.rows
