"""Links between members of crowded buckets, found in tiles: exact on full shingle sets, without a row per pair.

In a bucket most members already belong to one component, the main one. Its other members (the rest) are cut into tiles, and
so are all members; every tile of the rest meets every tile of all. A pair of tiles is one task's work: it counts common
shingles with one matrix product, and gives a link only where it joins two components that are still apart there. What is
dealt out grows with the members times the tiles of the rest, what comes back with the number of components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tile holds at most about so many shingles and so many members.
TILE_SHINGLES, TILE_MEMBERS, COLUMNS = 200_000, 1024, 4096
LINKS = "a long, b long"


def placed(members: DataFrame) -> DataFrame:
    """key, ti, tj, doc_id, component, rest (on the side of the rest) for members (key, doc_id, component, size)."""
    parts = members.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    main = parts.groupBy("key").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.sum("weight").alias("weight"),
        (F.sum("n") - F.max("n")).alias("rest_n"), (F.sum("weight") - F.max_by("weight", F.struct("n", "component"))).alias("rest_weight"),
    ).where("rest_n > 0")
    tiles = lambda n, w: F.greatest(F.ceil(F.col(n) / TILE_MEMBERS), F.ceil(F.col(w) / TILE_SHINGLES)).cast("int")
    plan = main.select("key", "main", tiles("n", "weight").alias("all_tiles"), tiles("rest_n", "rest_weight").alias("rest_tiles"))
    own = members.join(plan, "key")
    h = F.xxhash64("doc_id", "key")
    every = own.select("key", "doc_id", "component", F.lit(False).alias("rest"), F.explode(F.sequence(F.lit(0), F.col("rest_tiles") - 1)).alias("ti"), F.pmod(h, F.col("all_tiles")).cast("int").alias("tj"))
    rest = own.where(F.col("component") != F.col("main")).select("key", "doc_id", "component", F.lit(True).alias("rest"), F.pmod(h, F.col("rest_tiles")).cast("int").alias("ti"), F.explode(F.sequence(F.lit(0), F.col("all_tiles") - 1)).alias("tj"))
    return every.unionByName(rest)


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of each left with each right set."""
    flat = np.concatenate([*left, *right])
    values, at, times = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    keep = times[at] > 1  # what one set alone has is common to none
    order = np.cumsum(times > 1) - 1
    at, owner = order[at[keep]], owner[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, int((times > 1).sum()), COLUMNS):
        inside = (at >= lo) & (at < lo + COLUMNS)
        bits = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        bits[owner[inside], at[inside] - lo] = 1
        out += bits[: len(left)] @ bits[len(left) :].T
    return out.astype(np.int64)


class Union:
    """Components by a representative each."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def tile_links(ids: list[list[int]], components: list[list[int]], sets: list[list[np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between the sides of a tile that join two components; [0] is the rest's side."""
    if not ids[0] or not ids[1]:
        return []
    common = common_counts(*sets)
    sizes = [np.array([len(s) for s in x], np.int64) for x in sets]
    linked = 100 * common >= percent * (sizes[0][:, None] + sizes[1][None, :] - common)
    linked &= np.array(components[0])[:, None] != np.array(components[1])[None, :]
    known, out = Union(), []
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(linked)), strict=True):
        if ids[0][i] != ids[1][j] and known.join(components[0][i], components[1][j]):
            out.append((ids[0][i], ids[1][j]))
    return out


def tile_join(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links that join components of members (key, doc_id, component, size). sets: doc_id and shingles (binary: the sorted
    64-bit hashes of the whole text)."""
    dealt = placed(members).join(sets, "doc_id")

    def met(group: pa.Table) -> pa.Table:
        ids, components, held = [[], []], [[], []], [[], []]
        columns = (group.column(c).to_pylist() for c in ("rest", "doc_id", "component", "shingles"))
        for rest, doc, component, data in zip(*columns, strict=True):
            side = 0 if rest else 1
            ids[side].append(doc)
            components[side].append(component)
            held[side].append(np.frombuffer(data, np.uint64))
        found = tile_links(ids, components, held, percent)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return dealt.groupBy("key", "ti", "tj").applyInArrow(met, LINKS)
