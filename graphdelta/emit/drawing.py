"""What a view shows of one version pair, and what all formats share."""

from __future__ import annotations

from dataclasses import dataclass, field

SEP = "::"


@dataclass
class Item:
    """A node: css is added, removed, changed or context; a stub stands for something out of scope."""

    id: str
    css: str = "context"
    stub: bool = False
    kind: str = ""
    columns: str | None = None  # of a table: "name: Type, ..."
    fields: list[str] = field(default_factory=list)  # marked member lines of a modified type
    methods: list[str] = field(default_factory=list)  # marked method lines
    unresolved: int = 0  # calls without a static callee

    @property
    def shown(self) -> str:
        return "context" if self.stub else self.css

    def label(self, name: str | None = None) -> str:
        return (self.id if name is None else name) + (" (external)" if self.stub else "")


@dataclass
class Link:
    source: str
    target: str
    kind: str = ""
    css: str = "context"
    ordinal: int | None = None


@dataclass
class Drawing:
    """items by id; links by ends, with both ends among the items."""

    view: str
    items: list[Item]
    links: list[Link]
    full: bool = False
    modules: dict[str, str] = field(default_factory=dict)  # css of Module nodes, for the overview
    module_links: list[Link] = field(default_factory=list)

    def __post_init__(self):
        self.items.sort(key=lambda x: x.id)
        own = {x.id for x in self.items}
        order = {k: i for i, k in enumerate(("Uses", "Implements", "Associates", "Calls", "Transitions", "ForeignKey"))}
        self.links = sorted((x for x in self.links if x.source in own and x.target in own), key=lambda x: (x.source, x.target, order.get(x.kind, 9)))

    def handles(self, letter: str) -> dict[str, str]:
        return {x.id: f"{letter}{i}" for i, x in enumerate(self.items)}

    @property
    def dynamic(self) -> list[Item]:
        return [x for x in self.items if x.unresolved > 0 and not x.stub]


def owner(id_: str) -> str:
    return id_.rpartition(SEP)[0] or id_


def short(id_: str) -> str:
    return id_.rpartition(SEP)[2]


def flat_name(drawing: Drawing, x: Item) -> str:
    """The name in formats without nesting: the overview puts the owner's name before it."""
    return x.label(f"{short(owner(x.id))}::{short(x.id)}" if drawing.view == "overview" else short(x.id))


def marked_members(before: list[str], after: list[str], types_differ: bool) -> list[str]:
    """Member lines by name: + added, - removed, ~ changed. A bare name carries no type of its own, so it counts as changed
    when any of the types do; an entry ``name: Type`` when it differs itself."""
    by_name = lambda entries: {e.split(":", 1)[0].strip(): e for e in sorted(entries)}
    old, new = by_name(before), by_name(after)
    out = []
    for name in sorted({*old, *new}):
        if name not in old:
            mark = "+"
        elif name not in new:
            mark = "-"
        elif ":" in old[name] + new[name]:
            mark = "~" if old[name] != new[name] else ""
        else:
            mark = "~" if types_differ else ""
        out.append(mark + name)
    return out


MARK = {"added": "+", "removed": "-", "changed": "~", "context": ""}
