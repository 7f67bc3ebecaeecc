"""Rename and move detection: a blocked similarity join, then greedy one-to-one assignment without a serial loop.

Candidates are removed and added nodes of one pair and kind. A score of T needs, with J(members) and MJ(types) of weights wm and wt,
wm J + wt MJ >= c with c = T * (sum of weights) - (what neighbours and documentation can add), so J is at least (c - wt) / wm, or
at least c / (wm + wt), or MJ is at least that: two nodes meet if they share one of the rarest members, or types, that a prefix
filter for that share keeps, at places that leave enough to share (the positions bound the overlap). A side that is empty on both
nodes counts as 1 and leaves (c - its weight) / (the other's) for the other, so nodes with an empty side also meet by a prefix of the
other one. Neighbours count only for nodes that have some: the bound for a node without any takes them as alike. No pair is lost; a
pair of nodes that meets at all is scored exactly. Only where c <= 0, so that pairs without anything in common reach T, all
pairs of a kind are the answer's size and the kind is the block.

Tokens and nodes are numbers here (64 bits of hash; a tile and a row, see tiles.py). Pairs that meet are scored in the tiles' files, so
what is sent and written grows with the nodes and with the numbers of the pairs, not with the pairs' fingerprints.
Equal fingerprints are paired by rank before candidates are made: a block of them would be quadratic.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphdelta.functions.similarity import DEFAULT, Weights, similarity
from graphdelta.operators import tiles
from graphdelta.operators.ranks import numbered
from graphdelta.operators.scratch import materialize, shared_dir

ROUNDS, FEW_ROUNDS, GROUP_ROWS = 10_000, 5, 200_000
#: Tokens whose pairs are counted for the order of prefixes; all others come first, whatever they make.
OFTEN, OFTEN_PAIRS = 1 << 19, 64


def _side(nodes: DataFrame, change: str, side: str, name: str) -> DataFrame:
    return nodes.where((F.col("change") == change) & F.col(side)["fp"].isNotNull()).select("pair_id", F.col(side)["kind"].alias("kind"), F.col(side)["id"].alias(name), F.struct(*(F.col(side)["fp"][c].alias(c) for c in ("members", "field_types", "neighbors", "doc_hash"))).alias("fp"))


def exact_matches(removed: DataFrame, added: DataFrame) -> DataFrame:
    """Pairs of equal fingerprints (member types and their names aside, which aren't scored), by rank within the class: what
    greedy would do with scores of 1.0. Classes are keyed by 128 bits of hash; only those of both sides are ranked, a hot one (of
    empty or boilerplate nodes) in many tasks."""
    scored = lambda fp: F.struct(fp["members"], fp["field_types"], fp["neighbors"], fp["doc_hash"])

    def keyed(df: DataFrame, name: str) -> DataFrame:
        own = scored(F.col("fp"))
        return df.select("pair_id", "kind", F.xxhash64(own).alias("h1"), F.xxhash64(F.lit(1), own).alias("h2"), name)

    keys = ["pair_id", "kind", "h1", "h2"]
    r, a = keyed(removed, "rid"), keyed(added, "aid")
    both = r.groupBy(*keys).agg(F.count("*").alias("rn")).join(a.groupBy(*keys).agg(F.count("*").alias("an")), keys)

    def ranked(df: DataFrame, name: str) -> DataFrame:
        return numbered(df.join(both.select(*keys), keys, "left_semi"), keys, [name], "n")

    return ranked(r, "rid").join(ranked(a, "aid"), [*keys, "n"]).select("pair_id", "rid", "aid", F.lit(1.0).alias("score"))


def _needs(threshold: float, w: Weights) -> tuple[float, float, float]:
    """What J and MJ must add up to, weighted (c); the share that one of both must reach; and c relative to the sum of both weights."""
    c = threshold * w.total - w.neighbors - w.doc
    both = w.members + w.field_types
    return c, (c / both if both > 0 else 0.0), both


def _hashed(nodes: DataFrame, name: str) -> DataFrame:
    """pair_id, kind, id, and tokens of members (km), types (kt, with counts tn) and neighbours (kn)."""
    k = lambda side, x: F.xxhash64("pair_id", "kind", F.lit(side), x)
    listed = lambda x, kind: F.coalesce(x, F.array().cast(f"array<{kind}>"))
    return nodes.select(
        "pair_id", "kind", F.col(name).alias("id"), listed(F.transform("fp.members", lambda m: k("m", m)), "bigint").alias("km"), listed(F.transform("fp.field_types", lambda e: k("t", e["t"])), "bigint").alias("kt"),
        listed(F.transform("fp.field_types", lambda e: e["n"].cast("int")), "int").alias("tn"), listed(F.transform("fp.neighbors", lambda x: k("n", x)), "bigint").alias("kn"),
        F.xxhash64("fp.doc_hash").alias("doc"), F.col("fp.doc_hash").isNotNull().alias("known"),
    )


def _often(r: DataFrame, a: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that make the most pairs, in order, and how many: at most OFTEN of them. Any order of tokens finds all pairs, this one
    meets few in vain."""
    one = lambda df, x, y: df.select(F.explode(F.concat("km", "kt")).alias("k"), F.lit(x).alias("r"), F.lit(y).alias("a"))
    made = one(r, 1, 0).unionByName(one(a, 0, 1)).groupBy("k").agg((F.sum("r") * F.sum("a")).alias("df")).where(F.col("df") > OFTEN_PAIRS)
    top = made.orderBy(F.col("df").desc(), "k").limit(OFTEN).toPandas().sort_values("k")
    return top["k"].to_numpy(np.int64), top["df"].to_numpy(np.int64)


def _tiled(nodes: DataFrame, folder: str, often, c: float, share: float, w: Weights) -> DataFrame:
    """pair_id, kind, id, node, m, t (sizes of both sides), and the prefix of each node as k, before (how much weight comes before the
    token) and is_m; the nodes themselves are in tiles in the folder."""
    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().taskAttemptId() << tiles.TILE_BITS
        for batch in batches:
            for part in tiles.slices(batch):
                tile = tiles.tile_of(part)
                tile.write(folder, str(number))
                n, found = part.num_rows, tiles.prefix(tile, often.value, c, share, w)
                owner, k, before = (np.concatenate([found[0][x], found[1][x]]) for x in range(3))
                is_m = np.arange(len(owner)) < len(found[0][0])
                order = np.argsort(owner, kind="stable")
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), pa.int32())
                held = lambda x, kind: pa.ListArray.from_arrays(offsets, pa.array(x[order], kind))  # noqa: E731, B023
                sizes = np.diff(tile.mo), np.diff(np.concatenate([[0], np.cumsum(tile.tn)])[tile.to])
                yield pa.RecordBatch.from_arrays(
                    [part.column("pair_id"), part.column("kind"), part.column("id"), pa.array((number << tiles.ROW_BITS) + np.arange(n), pa.int64()), pa.array(sizes[0], pa.int32()), pa.array(sizes[1], pa.int32()), held(k, pa.int64()), held(before, pa.int32()), held(is_m, pa.bool_())],
                    names=["pair_id", "kind", "id", "node", "m", "t", "k", "before", "is_m"],
                )
                number += 1

    return materialize(nodes.mapInArrow(run, "pair_id string, kind string, id string, node long, m int, t int, k array<long>, before array<int>, is_m array<boolean>"))


def _prefix(nodes: DataFrame) -> DataFrame:
    """A row per token of a prefix: k, node, m, t, before, is_m."""
    return nodes.select("node", "m", "t", F.explode(F.arrays_zip("k", "before", "is_m")).alias("x")).select("node", "m", "t", "x.k", "x.before", "x.is_m")


def _own(n: str):
    """Of a prefix row: the size of the token's side."""
    return F.when(F.col("is_m"), F.col(f"m{n}")).otherwise(F.col(f"t{n}"))


def _least(n: str, c: float, share: float, w: Weights):
    """Of a prefix row: the share that the partner must have of the token's side."""
    alone = lambda own, other: F.lit(max((c - other) / own, 0.0) if own > 0 else 0.0)
    members = F.when(F.col(f"t{n}") == 0, alone(w.members, w.field_types)).otherwise(F.lit(share))
    return F.when(F.col("is_m"), members).otherwise(F.when(F.col(f"m{n}") == 0, alone(w.field_types, w.members)).otherwise(F.lit(share)))


def _ratio(x: str, y: str):
    return F.when(F.greatest(x, y) == 0, 1.0).otherwise(F.least(x, y) / F.greatest(x, y, F.lit(1)))


def candidates(removed: DataFrame, added: DataFrame, threshold: float, weights: Weights = DEFAULT) -> DataFrame:
    """pair_id, rid, aid, score of all pairs of one kind with a score of at least the threshold."""
    c, share, both = _needs(threshold, weights)
    if c <= 1e-9 or both <= 0:
        met = removed.select("pair_id", "kind", "rid").join(added.select("pair_id", "kind", "aid"), ["pair_id", "kind"]).select("pair_id", "rid", "aid")
        full = met.join(removed.select("pair_id", "rid", F.col("fp").alias("rfp")), ["pair_id", "rid"]).join(added.select("pair_id", "aid", F.col("fp").alias("afp")), ["pair_id", "aid"])
        return full.select("pair_id", "rid", "aid", similarity(F.col("rfp"), F.col("afp"), weights).alias("score")).where(F.col("score") >= threshold)
    folder = f"{shared_dir(removed.sparkSession)}/graphdelta/tiles-{uuid.uuid4().hex}"
    rh, ah = _hashed(removed, "rid"), _hashed(added, "aid")
    often = removed.sparkSession.sparkContext.broadcast(_often(rh, ah))
    r, a = _tiled(rh, folder, often, c, share, weights), _tiled(ah, folder, often, c, share, weights)
    x, y = _prefix(r), _prefix(a).select("k", *(F.col(n).alias(f"{n}2") for n in ("node", "m", "t", "before")))
    enough = weights.members * _ratio("m", "m2") + weights.field_types * _ratio("t", "t2") >= c - 1e-9
    own, own2, least = _own(""), _own("2"), F.least(_least("", c, share, weights), _least("2", c, share, weights)) - 1e-9
    left = F.least(own - F.col("before"), own2 - F.col("before2"))
    # at the first token that a pair shares, all they share is still to come
    room = left * (1 + least) >= least * (own + own2)
    met = x.join(y, "k").where(enough & room & (F.least(own, own2) >= F.greatest(own, own2) * least)).select("node", "node2")
    met = met.unionByName(_lacking(r, weights, c).join(_lacking(a, weights, c).withColumnRenamed("node", "node2"), "token").select("node", "node2")).distinct()
    scored = _scored(met, folder, threshold, weights)
    return scored.join(r.select("node", "pair_id", F.col("id").alias("rid")), "node").join(a.select(F.col("node").alias("node2"), F.col("id").alias("aid")), "node2").select("pair_id", "rid", "aid", "score")


def _scored(met: DataFrame, folder: str, threshold: float, w: Weights) -> DataFrame:
    """node, node2, score of the pairs that reach the threshold. A pair of tiles is a task's work."""
    def run(group: pa.Table) -> pa.Table:
        node, node2 = (group.column(c).to_numpy() for c in ("node", "node2"))
        order = np.lexsort((node2, node))
        node, node2 = node[order], node2[order]
        one, two = (tiles.Tile.read(folder, str(x[0] >> tiles.ROW_BITS)) for x in (node, node2))
        last = (1 << tiles.ROW_BITS) - 1
        score = tiles.scores(one, two, node & last, node2 & last, w)
        keep = score >= threshold
        return pa.table({"node": node[keep], "node2": node2[keep], "score": score[keep]})

    tile = lambda c: F.shiftright(c, tiles.ROW_BITS)
    return materialize(met.groupBy(tile("node").alias("x"), tile("node2").alias("y")).applyInArrow(run, "node long, node2 long, score double"))


def _lacking(nodes: DataFrame, w: Weights, c: float) -> DataFrame:
    """Nodes that can meet by what they lack: both sides empty, or one where that alone is enough."""
    m, t = F.col("m") == 0, F.col("t") == 0
    lacks = [F.when(m & t, F.lit("mt")), *([F.when(m, F.lit("m"))] if w.members >= c - 1e-9 else []), *([F.when(t, F.lit("t"))] if w.field_types >= c - 1e-9 else [])]
    return nodes.select("node", F.explode(F.array_compact(F.array(*lacks))).alias("x"), "pair_id", "kind").select("node", F.struct("pair_id", "kind", "x").alias("token"))


def greedy(cands: DataFrame, keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """The assignment of taking candidates by (score desc, rid, aid), each id once: the order is total, so it equals taking,
    round by round, all pairs that are best for both their ids. Each round writes one table. Chains of ties may need many
    rounds: what a few rounds leave is finished pair by pair once its largest group is small."""
    order = [F.col("score").desc(), F.col("rid"), F.col("aid")]
    by = lambda c: F.row_number().over(Window.partitionBy(*keys, c).orderBy(*order))
    columns = [*keys, "rid", "aid", "score"]
    left, out = materialize(cands.select(*columns)), None
    for k in range(ROUNDS):
        if left.isEmpty():
            break
        if k >= FEW_ROUNDS and left.groupBy(*keys).count().agg(F.max("count")).first()[0] <= GROUP_ROWS:
            out = out.unionByName(_one_by_one(left, keys))
            break
        ranked = materialize(left.withColumn("best", (by("rid") == 1) & (by("aid") == 1)))
        best = ranked.where("best").select(*columns)
        out = best if out is None else out.unionByName(best)
        left = ranked.where("NOT best").select(*columns)
        for c in ("rid", "aid"):
            left = left.join(best.select(*keys, c), [*keys, c], "left_anti")
        left = materialize(left)
    else:
        raise RuntimeError(f"matching did not settle in {ROUNDS} rounds")
    return out if out is not None else left


def _one_by_one(left: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The serial loop, one group of keys a task."""
    def run(pdf):
        used_r, used_a, keep = set(), set(), []
        pdf = pdf.sort_values(["score", "rid", "aid"], ascending=[False, True, True])
        for i, (rid, aid) in enumerate(zip(pdf["rid"].to_numpy(), pdf["aid"].to_numpy(), strict=True)):
            if rid not in used_r and aid not in used_a:
                used_r.add(rid)
                used_a.add(aid)
                keep.append(i)
        return pdf.iloc[keep]

    return left.groupBy(*keys).applyInPandas(run, left.schema)


def sides(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _side(nodes, "Removed", "before", "rid"), _side(nodes, "Added", "after", "aid")


def match(nodes: DataFrame, threshold: float, weights: Weights = DEFAULT) -> DataFrame:
    """pair_id, rid, aid, score: the accepted matches of a node delta."""
    removed, added = (materialize(x) for x in sides(nodes))
    if threshold > 1 or weights.total <= 0:
        return removed.limit(0).select("pair_id", "rid", F.col("rid").alias("aid"), F.lit(1.0).alias("score"))
    exact = materialize(exact_matches(removed, added))
    rest_r = removed.join(exact.select("pair_id", "rid"), ["pair_id", "rid"], "left_anti")
    rest_a = added.join(exact.select("pair_id", "aid"), ["pair_id", "aid"], "left_anti")
    return exact.unionByName(greedy(candidates(rest_r, rest_a, threshold, weights)))
