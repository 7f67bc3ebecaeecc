"""Deltas of many version pairs at once: every operator takes tables keyed by pair_id.

A side is a node or edge table with `pair_id` in place of graph_id (`sides` makes both from a table of pairs). The delta is
one wide table: change, pair_id, before and after (nodes), from_id and to_id (moves), edge columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdelta.functions.ids import parent
from graphdelta.operators.ranks import numbered
from graphdelta.plans.schema import CHANGES, EDGE_KINDS, rank

NODE = ("id", "kind", "file", "start", "end", "attrs", "fp")
EDGE = ("from", "to", "kind", "ordinal")


def sides(table: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base, head) of nodes or edges for pairs (pair_id, base_id, head_id)."""
    base = table.join(pairs.select("pair_id", F.col("base_id").alias("graph_id")), "graph_id").drop("graph_id")
    head = table.join(pairs.select("pair_id", F.col("head_id").alias("graph_id")), "graph_id").drop("graph_id")
    return base, head


def last_by_id(nodes: DataFrame) -> DataFrame:
    """One node per id: the last in (seq) order wins, as a struct `node`. Partial aggregation, no window."""
    own = F.struct(*(F.col(f"`{c}`") for c in NODE))
    order = F.struct(F.coalesce("seq", F.lit(0)), F.coalesce("file", F.lit("")), F.coalesce("start", F.lit(0)))
    return nodes.groupBy("pair_id", "id").agg(F.max_by(own, order).alias("node"))


def node_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """pair_id, change (Added, Removed, Modified), before, after. Spans are no change."""
    b, h = last_by_id(base).withColumnRenamed("node", "before"), last_by_id(head).withColumnRenamed("node", "after")
    both = b.join(h, ["pair_id", "id"], "full_outer")
    before, after = F.col("before"), F.col("after")
    differs = ~(before["kind"].eqNullSafe(after["kind"]) & before["attrs"].eqNullSafe(after["attrs"]) & before["fp"].eqNullSafe(after["fp"]))
    change = F.when(before.isNull(), "Added").when(after.isNull(), "Removed").when(differs, "Modified")
    return both.select("pair_id", change.alias("change"), "before", "after").where("change IS NOT NULL")


def edge_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """pair_id, change (EdgeAdded, EdgeRemoved), from, to, kind, ordinal: sets keyed by all four, null ordinals equal."""
    marked = lambda df, side: df.select("pair_id", *(F.col(f"`{c}`") for c in EDGE), F.lit(side).alias("side"))
    sides_ = marked(base, 1).unionByName(marked(head, 2))
    # one shuffle: a key of one side alone is the difference, and nulls group together
    once = sides_.groupBy("pair_id", *EDGE).agg(F.bit_or("side").alias("side"))
    return once.where("side != 3").select("pair_id", F.when(F.col("side") == 2, "EdgeAdded").otherwise("EdgeRemoved").alias("change"), *EDGE)


def module_moves(delta: DataFrame, renames: DataFrame) -> DataFrame:
    """Pairs (pair_id, rid, aid) of a removed and an added Module that a file rename links, if each file has exactly one
    and the ids differ."""
    def alone(change: str, side: str, name: str, path: str) -> DataFrame:
        own = delta.where((F.col("change") == change) & (F.col(side)["kind"] == "Module")).select("pair_id", F.col(side)["file"].alias(path), F.col(side)["id"].alias(name))
        return own.groupBy("pair_id", path).agg(F.count("*").alias("n"), F.min(name).alias(name)).where("n = 1").drop("n")

    firsts = renames.select("pair_id", "old_path", "new_path").distinct()
    met = firsts.join(alone("Removed", "before", "rid", "old_path"), ["pair_id", "old_path"]).join(alone("Added", "after", "aid", "new_path"), ["pair_id", "new_path"])
    return met.where("rid != aid").select("pair_id", "rid", "aid")


def apply_matches(delta: DataFrame, matches: DataFrame) -> DataFrame:
    """Replace matched Removed and Added rows by Moved (the parents differ) or Modified."""
    removed = delta.where("change = 'Removed'").select("pair_id", F.col("before.id").alias("rid"), "before")
    added = delta.where("change = 'Added'").select("pair_id", F.col("after.id").alias("aid"), "after")
    both = matches.select("pair_id", "rid", "aid").join(removed, ["pair_id", "rid"]).join(added, ["pair_id", "aid"])
    moved = F.when(parent("rid") != parent("aid"), "Moved").otherwise("Modified")
    joined = both.select("pair_id", moved.alias("change"), "before", "after")
    rest_r = delta.where("change = 'Removed'").join(matches.select("pair_id", F.col("rid")), (delta["pair_id"] == matches["pair_id"]) & (F.col("before.id") == F.col("rid")), "left_anti")
    rest_a = delta.where("change = 'Added'").join(matches.select("pair_id", F.col("aid")), (delta["pair_id"] == matches["pair_id"]) & (F.col("after.id") == F.col("aid")), "left_anti")
    return delta.where("change NOT IN ('Removed', 'Added')").unionByName(rest_r).unionByName(rest_a).unionByName(joined)


def unify(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One table of changes: pair_id, change, id, before_id, after_id, kind, from_id, to_id, ordinal, before, after. For a
    move, from_id and to_id are the parents; for an edge, its ends."""
    none = F.lit(None)
    moved = F.col("change") == "Moved"
    n = nodes.select(
        "pair_id", "change", F.coalesce("after.id", "before.id").alias("id"), F.col("before.id").alias("before_id"), F.col("after.id").alias("after_id"), F.coalesce("after.kind", "before.kind").alias("kind"),
        F.when(moved, parent("before.id")).alias("from_id"), F.when(moved, parent("after.id")).alias("to_id"), none.cast("int").alias("ordinal"), "before", "after",
    )
    kinds = {f.name: f.dataType for f in n.schema.fields}
    text = none.cast("string")
    e = edges.select(
        "pair_id", "change", text.alias("id"), text.alias("before_id"), text.alias("after_id"), "kind", F.col("from").alias("from_id"), F.col("to").alias("to_id"), F.col("ordinal").cast("int"),
        none.cast(kinds["before"]).alias("before"), none.cast(kinds["after"]).alias("after"),
    )
    return n.unionByName(e)


def diff(base: tuple[DataFrame, DataFrame], head: tuple[DataFrame, DataFrame], threshold: float | None = 0.7, renames: DataFrame | None = None) -> DataFrame:
    """The whole delta. base and head: (nodes, edges) keyed by pair_id. Without a threshold a plain set difference, still with
    the moves that renames name. Edges keep the ids they have: a renamed node's edges come and go."""
    from graphdelta.operators.match import match

    nodes = node_delta(base[0], head[0])
    if renames is not None:
        nodes = apply_matches(nodes, module_moves(nodes, renames))
    if threshold is not None:
        nodes = apply_matches(nodes, match(nodes, threshold))
    return unify(nodes, edge_delta(base[1], head[1]))


def in_order(changes: DataFrame) -> DataFrame:
    """pos: position of each change within its pair, in the canonical order. A pair's changes are not sorted in one task."""
    return numbered(changes, ["pair_id"], order_keys(), "pos")


def order_keys() -> list:
    edge = F.col("change").startswith("Edge")
    first = F.when(edge, F.col("from_id")).when(F.col("change") == "Modified", F.col("before_id")).otherwise(F.col("id"))
    return [rank("change", CHANGES), first, F.when(edge | (F.col("change") == "Moved"), F.coalesce(F.when(edge, F.col("to_id")), F.col("from_id"))), F.when(edge, rank("kind", EDGE_KINDS)), F.col("ordinal"), F.col("id")]


def member_delta(nodes: DataFrame) -> DataFrame:
    """For rows with before and after: members added, removed and retyped, by name, each sorted. Without fingerprints none."""
    none = F.array().cast("array<struct<m:string,t:string>>")
    b, a = F.coalesce(F.col("before.fp.member_types"), none), F.coalesce(F.col("after.fp.member_types"), none)
    names = lambda x: F.transform(x, lambda e: e["m"])
    has = F.col("before.fp").isNotNull() & F.col("after.fp").isNotNull()
    of = lambda x: F.when(has, F.sort_array(x)).otherwise(F.array().cast("array<string>"))
    old = F.map_from_entries(b)
    retyped = F.filter(a, lambda e: F.map_contains_key(old, e["m"]) & (F.element_at(old, e["m"]) != e["t"]))
    return nodes.withColumns({"added": of(F.array_except(names(a), names(b))), "removed": of(F.array_except(names(b), names(a))), "changed": of(names(retyped))})


def block_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """Text blocks (pair_id, pos, block): those of head that base lacks and the reverse; order and repeats of a side stay."""
    plus = head.join(base.select("pair_id", "block").distinct(), ["pair_id", "block"], "left_anti").select("pair_id", F.lit("+").alias("side"), "pos", "block")
    minus = base.join(head.select("pair_id", "block").distinct(), ["pair_id", "block"], "left_anti").select("pair_id", F.lit("-").alias("side"), "pos", "block")
    return plus.unionByName(minus)


def rename_splits(changes: DataFrame, renames: DataFrame) -> DataFrame:
    """pair_id, n: renames of .rs files whose old file has a removed Module and whose new file an added one."""
    rs = renames.where(F.col("old_path").endswith(".rs") & F.col("new_path").endswith(".rs"))
    gone = changes.where("change = 'Removed' AND kind = 'Module'").select("pair_id", F.col("before.file").alias("old_path")).distinct()
    new = changes.where("change = 'Added' AND kind = 'Module'").select("pair_id", F.col("after.file").alias("new_path")).distinct()
    return rs.join(gone, ["pair_id", "old_path"], "left_semi").join(new, ["pair_id", "new_path"], "left_semi").groupBy("pair_id").agg(F.count("*").alias("n"))
