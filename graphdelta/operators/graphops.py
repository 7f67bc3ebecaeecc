"""Graph algorithms over edge tables keyed by `keys`: components, hops, tiers, call slices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdelta.functions.ids import crate_of
from graphdelta.operators.scratch import apart, materialize

#: Edges of one group that one task takes; larger groups are coloured in Spark.
GROUP_EDGES = 200_000


def tarjan(edges: list[tuple[str, str]]) -> dict[str, str]:
    """Vertex to the least vertex of its strongly connected component; iterative."""
    out: dict[str, list[str]] = {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
        out.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    on, stack, found = set(), [], {}
    for root in out:
        if root in index:
            continue
        work = [(root, iter(out[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            v, rest = work[-1]
            for w in rest:
                if w not in index:
                    index[w] = low[w] = len(index)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(out[w])))
                    break
                if w in on:
                    low[v] = min(low[v], index[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    least = min(members)
                    found |= dict.fromkeys(members, least)
    return found


def strong_components(edges: DataFrame, keys: tuple[str, ...] = ("pair_id",), group_edges: int = GROUP_EDGES) -> DataFrame:
    """*keys, id, component (the least id of it) for every vertex of edges (*keys, from, to)."""
    own = materialize(edges.select(*keys, "from", "to").distinct())
    sizes = own.groupBy(*keys).agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > group_edges).select(*keys)
    some_large = not large.isEmpty()
    small = own.join(large, list(keys), "left_anti") if some_large else own
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.select(*keys).schema.fields) + ", id string, component string"

    def run(pdf):
        import pandas as pd

        found = tarjan(list(zip(pdf["from"], pdf["to"], strict=True)))
        out = pd.DataFrame({"id": list(found), "component": list(found.values())})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    done = small.groupBy(*keys).applyInPandas(run, schema)
    if not some_large:
        return done
    rest = own.join(large, list(keys), "left_semi")
    core = materialize(_trimmed(rest, list(keys)))
    inner = colour_components(core, keys)
    alone = rest.select(*keys, F.explode(F.array("from", "to")).alias("id")).distinct().join(apart(inner.select(*keys, "id")), [*keys, "id"], "left_anti")
    return done.unionByName(inner).unionByName(alone.select(*keys, "id", F.col("id").alias("component")))


def _trimmed(edges: DataFrame, k: list[str]) -> DataFrame:
    """Edges without those of vertices that nothing enters or nothing leaves: these are components of their own."""
    ends = lambda c, name: apart(edges.select(*k, F.col(c).alias(name)).distinct())
    return edges.join(ends("to", "from"), [*k, "from"], "left_semi").join(ends("from", "to"), [*k, "to"], "left_semi")


def colour_components(edges: DataFrame, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """The same without a task per group: the least id that reaches a vertex is its colour; what reaches the colour's vertex
    backwards, within the colour, is its component. Repeat on the rest."""
    k = list(keys)
    left = materialize(edges.select(*k, "from", "to").distinct())
    everyone = materialize(left.select(*k, F.explode(F.array("from", "to")).alias("id")).distinct())
    out = None
    while not left.isEmpty():
        vertices = materialize(left.select(*k, F.explode(F.array("from", "to")).alias("id")).distinct())
        colour = _spread(vertices.withColumn("c", F.col("id")), left, k)
        same = left.join(apart(colour.withColumnsRenamed({"id": "from", "c": "cf"})), [*k, "from"]).join(apart(colour.withColumnsRenamed({"id": "to", "c": "ct"})), [*k, "to"]).where("cf = ct").select(*k, F.col("to").alias("from"), F.col("from").alias("to"), F.col("cf").alias("c"))
        front = found = materialize(colour.where("id = c").select(*k, "id", "c"))
        same = materialize(same)
        while not front.isEmpty():
            step = front.join(apart(same.withColumnRenamed("from", "id")), [*k, "id", "c"]).select(*k, F.col("to").alias("id"), "c").distinct()
            front = materialize(step.join(apart(found), [*k, "id", "c"], "left_anti"))
            found = materialize(found.unionByName(front))
        settled = found.select(*k, "id", F.col("c").alias("component"))
        out = settled if out is None else out.unionByName(settled)
        for end in ("from", "to"):
            left = left.join(apart(found.select(*k, F.col("id").alias(end))), [*k, end], "left_anti")
        left = materialize(left)
    if out is None:
        return everyone.select(*k, "id", F.col("id").alias("component"))
    alone = everyone.join(apart(out.select(*k, "id")), [*k, "id"], "left_anti").select(*k, "id", F.col("id").alias("component"))
    return out.unionByName(alone)


def _spread(colour: DataFrame, edges: DataFrame, k: list[str]) -> DataFrame:
    """The least colour along the edges, to the fixpoint."""
    while True:
        came = edges.join(apart(colour.withColumnRenamed("id", "from")), [*k, "from"]).select(*k, F.col("to").alias("id"), "c")
        after = materialize(colour.unionByName(came).groupBy(*k, "id").agg(F.min("c").alias("c")))
        if after.exceptAll(colour).isEmpty():
            return after
        colour = after


def k_hops(seeds: DataFrame, edges: DataFrame, hops: int, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """*keys, id: seeds and what lies up to `hops` undirected edges away."""
    k = list(keys)
    ways = edges.select(*k, F.col("from").alias("id"), F.col("to").alias("other")).unionByName(edges.select(*k, F.col("to").alias("id"), F.col("from").alias("other")))
    reached = seeds.select(*k, "id").distinct()
    for _ in range(hops):
        reached = reached.unionByName(reached.join(ways, [*k, "id"]).select(*k, F.col("other").alias("id"))).distinct()
    return reached


def crate_edges(edges: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """*keys, from, to: distinct crate dependencies of Uses edges that cross crates."""
    own = edges.where("kind = 'Uses'").select(*keys, crate_of("from").alias("from"), crate_of("to").alias("to"))
    return own.where(F.col("from") != F.col("to")).distinct()


def crate_tiers(crates: DataFrame, deps: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """*keys, id, tier: longest chain of dependencies below each crate (0: none), however long. The crates of a cycle are one link of
    a chain and share a tier."""
    k = list(keys)
    of = materialize(strong_components(deps, keys))
    ends = deps.select(*k, "from", "to").join(apart(of.withColumnsRenamed({"id": "from", "component": "cf"})), [*k, "from"]).join(apart(of.withColumnsRenamed({"id": "to", "component": "ct"})), [*k, "to"])
    links = materialize(ends.where("cf != ct").select(*k, F.col("cf").alias("id"), F.col("ct").alias("to")).distinct())
    own = materialize(crates.select(*k, "id").distinct().join(apart(of), [*k, "id"], "left").withColumn("component", F.coalesce("component", "id")))
    tier = materialize(own.select(*k, F.col("component").alias("id")).unionByName(links.select(*k, F.col("to").alias("id"))).distinct().withColumn("tier", F.lit(0)))
    while True:  # links have no cycle, so it ends
        above = links.join(apart(tier.withColumnRenamed("id", "to")), [*k, "to"]).groupBy(*k, "id").agg((F.max("tier") + 1).alias("t"))
        after = materialize(tier.join(apart(above), [*k, "id"], "left").select(*k, "id", F.greatest("tier", F.coalesce("t", F.lit(0))).alias("tier"), (F.coalesce("t", F.lit(0)) > F.col("tier")).alias("grew")))
        tier = after.drop("grew")
        if after.where("grew").isEmpty():
            return own.join(apart(tier.withColumnRenamed("id", "component")), [*k, "component"]).select(*k, "id", "tier")


def call_slice(calls: DataFrame, entries: DataFrame, depth: int = 32, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """Depth-first slice of Calls edges from an entry per key: *keys, depth, caller, callee, path (ordinals from the entry).
    Callees go in ordinal order, an ancestor is not entered again, and nothing below `depth` is. Order by path."""
    k = list(keys)
    own = calls.select(*k, F.col("from").alias("caller"), F.col("to").alias("callee"), F.coalesce("ordinal", F.lit(0)).alias("ordinal"))
    front = entries.select(*k, F.col("id").alias("at"), F.array("id").alias("seen"), F.array().cast("array<int>").alias("path"), F.lit(0).alias("depth"))
    out = None
    front = materialize(front)
    while True:
        met = front.join(own.withColumnRenamed("caller", "at"), [*k, "at"])
        met = met.select(*k, F.col("depth"), F.col("at").alias("caller"), "callee", F.concat("path", F.array("ordinal")).alias("path"), "seen")
        met = materialize(met)
        if met.isEmpty():
            break
        rows = met.drop("seen")
        out = rows if out is None else out.unionByName(rows)
        # an edge to an ancestor is listed but not entered
        down = met.where(~F.array_contains("seen", F.col("callee")) & (F.col("depth") + 1 < depth))
        front = materialize(down.select(*k, F.col("callee").alias("at"), F.concat("seen", F.array("callee")).alias("seen"), "path", (F.col("depth") + 1).alias("depth")))
    return out if out is not None else met.drop("seen")


def default_entries(calls: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    return calls.groupBy(*keys).agg(F.min("from").alias("id"))
