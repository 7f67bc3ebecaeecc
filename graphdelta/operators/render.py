"""Diagrams of all pairs at once: selection in Spark, then one row per pair with what its diagram shows, then text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdelta.emit import mermaid, text
from graphdelta.emit.drawing import MARK, Drawing, Item, Link, marked_members, short
from graphdelta.functions.ids import matches_any, owner
from graphdelta.operators import select
from graphdelta.operators.scratch import materialize

VIEWS = ("modules", "states", "types", "calls", "callgraph", "schema", "overview")
FORMATS = ("mermaid", *text.FORMATS)


def _details(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """pair_id, id, kind, columns: of head's nodes, else of removed ones."""
    columns = lambda attrs: F.get(F.filter(attrs, lambda a: a["k"] == "columns"), F.lit(0))["v"]
    head = nodes.select("pair_id", "id", "kind", columns(F.col("attrs")).alias("columns"), F.lit(1).alias("p"))
    gone = changes.where("change = 'Removed'").select("pair_id", "id", "kind", columns(F.col("before.attrs")).alias("columns"), F.lit(0).alias("p"))
    return head.unionByName(gone).groupBy("pair_id", "id").agg(F.max_by(F.struct("kind", "columns"), "p").alias("d")).select("pair_id", "id", "d.kind", "d.columns")


def _methods(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """pair_id, id (the owner), methods: (id, class) of the functions below it."""
    how = select.method_status(changes)
    every = nodes.where("kind = 'Fn'").select("pair_id", "id").unionByName(how.where("class = 'removed'").select("pair_id", "id")).distinct()
    marked = every.join(how, ["pair_id", "id"], "left").select("pair_id", owner("id").alias("owner"), F.struct("id", F.coalesce("class", F.lit("context")).alias("class")).alias("m"))
    return marked.groupBy("pair_id", F.col("owner").alias("id")).agg(F.sort_array(F.collect_list("m")).alias("methods"))


def _members(changes: DataFrame) -> DataFrame:
    own = changes.where("change = 'Modified' AND before.fp IS NOT NULL AND after.fp IS NOT NULL")
    return own.select("pair_id", "id", F.struct(F.col("before.fp.members").alias("before"), F.col("after.fp.members").alias("after"), (~F.col("before.fp.field_types").eqNullSafe(F.col("after.fp.field_types"))).alias("differ")).alias("members"))


def _links(edges: DataFrame, name: str) -> DataFrame:
    row = F.struct(F.col("from").alias("source"), F.col("to").alias("target"), "kind", F.col("class").alias("css"))
    return edges.groupBy("pair_id").agg(F.collect_list(row).alias(name))


def render(view: str, pairs: DataFrame, nodes: DataFrame, edges: DataFrame, changes: DataFrame, fmt: str = "mermaid", full: bool = False, scope: list[str] | None = None, entry: str | None = None) -> DataFrame:
    """pair_id, text of a view of each pair (pair_id). nodes and edges are head's, changes the delta. A diagram is one row: what
    is selected for it has to be readable, and so is small."""
    if view == "calls":
        return _sequences(pairs, nodes, edges, changes, fmt, scope or [], entry)
    ids, ways = select.select_view(view, nodes, edges, changes, full, scope)
    more = ids.join(_details(nodes, changes), ["pair_id", "id"], "left").join(select.unresolved(nodes), ["pair_id", "id"], "left")
    if view == "types":
        more = more.join(_members(changes), ["pair_id", "id"], "left").join(_methods(nodes, changes), ["pair_id", "id"], "left")
    extra = [c for c in ("members", "methods") if c in more.columns]
    item = F.struct("id", F.col("class").alias("css"), "stub", "kind", "columns", F.coalesce("n", F.lit(0)).alias("unresolved"), *extra)
    rows = pairs.select("pair_id").join(more.groupBy("pair_id").agg(F.collect_list(item).alias("items")), "pair_id", "left").join(_links(ways, "links"), "pair_id", "left")
    if view == "overview":
        modules = select.classified(nodes, changes, ["Module"])
        rows = rows.join(modules.where("class IN ('added', 'removed')").groupBy("pair_id").agg(F.collect_list(F.struct("id", "class")).alias("modules")), "pair_id", "left")
        rows = rows.join(_links(select.classified_edges(edges, changes, modules, ["Uses"]), "module_links"), "pair_id", "left")

    def drawn(*columns: pd.Series) -> pd.Series:
        out = []
        for row in zip(*columns, strict=True):
            own = dict(zip(names, row, strict=True))
            listed = lambda k: [] if own.get(k) is None else list(own[k])
            items = []
            for x in listed("items"):
                m = x.get("members")
                items.append(Item(
                    x["id"], x["css"], bool(x["stub"]), x["kind"] or "", x["columns"], marked_members(list(m["before"]), list(m["after"]), bool(m["differ"])) if m else [],
                    [f"{MARK[f['class']]}{short(f['id'])}()" for f in (x["methods"] if x.get("methods") is not None else [])], int(x["unresolved"]),
                ))
            d = Drawing(view, items, [Link(**x) for x in listed("links")], full, {m["id"]: m["class"] for m in listed("modules")}, [Link(**x) for x in listed("module_links")])
            out.append(mermaid.VIEWS[view](d) if fmt == "mermaid" else text.FORMATS[fmt](d))
        return pd.Series(out, dtype="object")

    names = rows.columns[1:]
    emit = F.pandas_udf(drawn, "string")
    return rows.select("pair_id", emit(*names).alias("text"))


def _sequences(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, changes: DataFrame, fmt: str, scope: list[str], entry: str | None) -> DataFrame:
    """The calls that an entry reaches, each edge once: paths are followed when the text is written."""
    if fmt != "mermaid":
        return pairs.select("pair_id", F.lit(text.REFUSED[fmt].format(fmt)).alias("text"))
    added = changes.where("change = 'EdgeAdded' AND kind = 'Calls'").select("pair_id", F.col("from_id").alias("from"), F.col("to_id").alias("to"), "ordinal", F.lit(True).alias("new"))
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("pair_id", "from", "to", "ordinal")]
    head = edges.where("kind = 'Calls'").alias("x").join(added.distinct().alias("y"), same, "left").select("x.pair_id", "x.from", "x.to", "x.ordinal", F.when(F.col("y.new"), "added").otherwise("context").alias("class"))
    gone = changes.where("change = 'EdgeRemoved' AND kind = 'Calls'").select("pair_id", F.col("from_id").alias("from"), F.col("to_id").alias("to"), "ordinal", F.lit("removed").alias("class"))
    calls = materialize(head.unionByName(gone))
    entries = pairs.select("pair_id", F.lit(entry).alias("entry")) if entry else pairs.select("pair_id").join(calls.groupBy("pair_id").agg(F.min("from").alias("entry")), "pair_id", "left")
    steps = calls.select("pair_id", F.col("from").alias("id"), "to").distinct()
    reached = front = materialize(entries.where("entry IS NOT NULL").select("pair_id", F.col("entry").alias("id")))
    for _ in range(mermaid.DEPTH):
        front = materialize(front.join(steps, ["pair_id", "id"]).select("pair_id", F.col("to").alias("id")).distinct().join(reached, ["pair_id", "id"], "left_anti"))
        if front.isEmpty():
            break
        reached = reached.unionByName(front)
    own = calls.join(reached.withColumnRenamed("id", "from"), ["pair_id", "from"], "left_semi")
    links = own.groupBy("pair_id").agg(F.collect_list(F.struct(F.col("from").alias("source"), F.col("to").alias("target"), F.lit("Calls").alias("kind"), F.col("class").alias("css"), "ordinal")).alias("links"))
    files = select.file_index(nodes, changes)
    outside = reached.join(files, ["pair_id", "id"], "left").where(~F.coalesce(matches_any("file", scope), F.lit(False))) if scope else reached.limit(0)
    outside = outside.groupBy("pair_id").agg(F.collect_list("id").alias("outside"))
    functions = nodes.where("kind = 'Fn'").select("pair_id", "id").join(reached, ["pair_id", "id"], "left_semi").groupBy("pair_id").agg(F.collect_set("id").alias("functions"))
    noted = select.unresolved(nodes).join(reached, ["pair_id", "id"], "left_semi").groupBy("pair_id").agg(F.collect_list(F.struct("id", "n")).alias("noted"))
    rows = entries
    for part in (links, outside, functions, noted):
        rows = rows.join(part, "pair_id", "left")

    @F.pandas_udf("string")
    def emit(entry: pd.Series, links: pd.Series, outside: pd.Series, functions: pd.Series, noted: pd.Series) -> pd.Series:
        listed = lambda x: [] if x is None else list(x)
        number = lambda x: None if x is None or pd.isna(x) else int(x)
        out = []
        for e, a, b, c, d in zip(entry, links, outside, functions, noted, strict=True):
            known = [Link(x["source"], x["target"], x["kind"], x["css"], number(x["ordinal"])) for x in listed(a)]
            out.append(mermaid.sequence(e, known, set(listed(c)), {x["id"]: int(x["n"]) for x in listed(d)}, set(listed(b))))
        return pd.Series(out, dtype="object")

    return rows.select("pair_id", emit("entry", "links", "outside", "functions", "noted").alias("text"))
