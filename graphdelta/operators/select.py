"""What a view shows: the changed part of a head graph and its surroundings, keyed by pair_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphdelta.functions.ids import matches_any, owner
from graphdelta.operators.graphops import k_hops

HOPS, TYPE_HOPS = 2, 1


def file_index(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """pair_id, id, file: from head, else from what was removed."""
    head = nodes.select("pair_id", "id", "file", F.lit(1).alias("p"))
    gone = changes.where("change = 'Removed'").select("pair_id", "id", F.col("before.file").alias("file"), F.lit(0).alias("p"))
    return head.unionByName(gone).groupBy("pair_id", "id").agg(F.max_by("file", "p").alias("file"))


def classified(nodes: DataFrame, changes: DataFrame, kinds: list[str]) -> DataFrame:
    """pair_id, id, class (added, removed, changed, context) of the nodes of some kinds, removed ones included."""
    gone = changes.where((F.col("change") == "Removed") & F.col("kind").isin(kinds))
    every = nodes.where(F.col("kind").isin(kinds)).select("pair_id", "id").unionByName(gone.select("pair_id", "id")).distinct()
    word = F.when(F.col("change") == "Added", "added").when(F.col("change") == "Removed", "removed").otherwise("changed")
    how = changes.where("change IN ('Added', 'Removed', 'Modified', 'Moved')").select("pair_id", "id", word.alias("class")).groupBy("pair_id", "id").agg(F.max("class").alias("class"))
    return every.join(how, ["pair_id", "id"], "left").select("pair_id", "id", F.coalesce("class", F.lit("context")).alias("class"))


def classified_edges(edges: DataFrame, changes: DataFrame, ids: DataFrame, kinds: list[str]) -> DataFrame:
    """pair_id, from, to, kind, class (added, removed, context): head's edges, every one, and removed ones, with both ends
    among ids. An edge counts as added if any of its ordinals was."""
    own = edges.where(F.col("kind").isin(kinds)).select("pair_id", "from", "to", "kind")
    of = lambda c: changes.where((F.col("change") == c) & F.col("kind").isin(kinds)).select("pair_id", F.col("from_id").alias("from"), F.col("to_id").alias("to"), "kind")
    added = of("EdgeAdded").distinct().withColumn("new", F.lit(True))
    own = own.join(added, ["pair_id", "from", "to", "kind"], "left").select("pair_id", "from", "to", "kind", F.when(F.col("new"), "added").otherwise("context").alias("class"))
    every = own.unionByName(of("EdgeRemoved").withColumn("class", F.lit("removed")))
    for end in ("from", "to"):
        every = every.join(ids.select("pair_id", F.col("id").alias(end)), ["pair_id", end], "left_semi")
    return every


def only_machines(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Variants of enums that have a transition."""
    live = edges.select("pair_id", F.explode(F.array(owner("from"), owner("to"))).alias("enum")).distinct()
    return ids.withColumn("enum", owner("id")).join(live, ["pair_id", "enum"], "left_semi").drop("enum")


def pruned(ids: DataFrame, edges: DataFrame, hops: int = HOPS, full: bool = False) -> DataFrame:
    """pair_id, id: changed nodes, ends of changed edges, and what lies up to `hops` away; all under `full`."""
    if full:
        return ids.select("pair_id", "id")
    ends = edges.where("class != 'context'").select("pair_id", F.explode(F.array("from", "to")).alias("id"))
    seeds = ids.where("class != 'context'").select("pair_id", "id").unionByName(ends).distinct()
    return k_hops(seeds, edges, hops).join(ids.select("pair_id", "id"), ["pair_id", "id"], "left_semi")


def scoped(shown: DataFrame, edges: DataFrame, files: DataFrame, scope: list[str]) -> DataFrame:
    """pair_id, id, stub: shown nodes in scope, and out-of-scope ends of edges that touch one of these as stubs."""
    if not scope:
        return shown.select("pair_id", "id", F.lit(False).alias("stub"))
    inside = shown.join(files, ["pair_id", "id"]).where(matches_any("file", scope)).select("pair_id", "id")
    ways = edges.select("pair_id", F.col("from").alias("id"), F.col("to").alias("other")).unionByName(edges.select("pair_id", F.col("to").alias("id"), F.col("from").alias("other")))
    far = ways.join(inside, ["pair_id", "id"], "left_semi").select("pair_id", F.col("other").alias("id")).distinct().join(inside, ["pair_id", "id"], "left_anti")
    return inside.withColumn("stub", F.lit(False)).unionByName(far.withColumn("stub", F.lit(True)))


VIEWS = {
    "modules": (["Module"], ["Uses"], HOPS),
    "states": (["Variant"], ["Transitions"], HOPS),
    "types": (["Struct", "Enum", "Trait"], ["Implements", "Associates"], TYPE_HOPS),
    "callgraph": (["Fn"], ["Calls"], HOPS),
    "schema": (["Table"], ["ForeignKey"], HOPS),
    "overview": (["Struct", "Enum", "Trait", "Fn"], ["Implements", "Associates", "Calls"], HOPS),
}


def select_view(view: str, nodes: DataFrame, edges: DataFrame, changes: DataFrame, full: bool = False, scope: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(pair_id, id, class, stub) and (pair_id, from, to, kind, class) of a view; both ends of each edge are shown."""
    node_kinds, edge_kinds, hops = VIEWS[view]
    ids = classified(nodes, changes, node_kinds)
    ways = classified_edges(edges, changes, ids, edge_kinds)
    if view == "states":
        ids = only_machines(ids, ways)
    shown = scoped(pruned(ids, ways, hops, full), ways, file_index(nodes, changes), scope or [])
    out = shown.join(ids, ["pair_id", "id"], "left").select("pair_id", "id", F.when(F.col("stub"), "context").otherwise(F.coalesce("class", F.lit("context"))).alias("class"), "stub")
    for end in ("from", "to"):
        ways = ways.join(out.select("pair_id", F.col("id").alias(end)), ["pair_id", end], "left_semi")
    return out, ways


def unresolved(nodes: DataFrame) -> DataFrame:
    """pair_id, id, n: functions with calls that have no static callee."""
    text = F.get(F.filter("attrs", lambda a: a["k"] == "unresolved_calls"), F.lit(0))["v"]
    return nodes.where("kind = 'Fn'").select("pair_id", "id", text.cast("long").alias("n")).where("n > 0")


def method_status(changes: DataFrame) -> DataFrame:
    """pair_id, id, class of functions; a modified one counts only if its parameters' types did change."""
    real = (F.col("change") != "Modified") | ~F.col("before.fp.member_types").eqNullSafe(F.col("after.fp.member_types"))
    word: Column = F.when(F.col("change") == "Added", "added").when(F.col("change") == "Removed", "removed").otherwise("changed")
    return changes.where((F.col("kind") == "Fn") & F.col("change").isin("Added", "Removed", "Modified") & real).select("pair_id", "id", word.alias("class"))
