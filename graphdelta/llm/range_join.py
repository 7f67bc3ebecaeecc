"""Near duplicates among embeddings: an exact metric range join on the angle between vectors.

1. Vectors are scaled to length 1 in double precision; equal ones (by 128 bits of hash) collapse to a representative with a count.
2. Pivots, a bounded sample by hash, partition the sphere: a vector's home is the cell of its nearest pivot. Let t be the angle
   of the wanted cosine. For a vector x with home p, a partner whose home is q lies at most t away, so by the triangle
   inequality d(x,q) <= d(x,p) + 2t, and d(x,q) <= t + R(q) with R(q) the cell's radius; on the sphere the distance to the
   half-space nearer to q gives the sharper bound x.(p-q) <= sin(t) |p-q|. These bounds say to which cells x is replicated.
3. Cells are stored in tiles of about TILE vectors, one file each in the shared folder. A tile is replicated to those cells q > p that
   the bounds leave to one of its members, so each pair of two cells meets in one of them, and what is dealt out is a row of names per
   pair of tiles. Cells join on their own: a task reads the two tiles, leaves out members that the bounds keep
   from the other cell, and compares the rest by one matrix product. It counts each vector's links and gives, of its links, a
   spanning forest: enough for components, and never all pairs. BLOCK by BLOCK pairs of tiles stand together in a task, which keeps the
   last tiles it read.

Counts of links add up over tiles; a representative's count also has its own copies, and those of its partners. Where the bounds
can't prune (isotropic vectors in many dimensions lie almost at right angles to every pivot), pairs of tiles grow with the square
of their number; memory stays that of two tiles, and nothing is shuffled but names.

Cases: null, zero and non-finite vectors link with nothing, as do vectors whose number of components differs; repeated rows
and equal vectors are linked; a repeated vec_id gets its rows, each counted; a null vec_id links like others, but its
component is the least non-null id, or null; an empty table gives no rows; columns beyond vec_id and embedding are ignored.
"""

from __future__ import annotations

import io
import math
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphdelta.llm._common import discard, fresh_path, hub_join, materialize, ship, table
from graphdelta.llm.components import components
from graphdelta.llm.files import read_file, write_file

COSINE, PER_CELL, LEAST_PIVOTS, MOST_PIVOTS, BLOCK = 0.9, 2048, 8, 2048, 8
#: Vectors in a tile, at most; and numbers in a tile, about (64 vectors at least).
TILE, TILE_NUMBERS = 2048, 1 << 17
SLACK = 1e-9


def unit_rows(embeddings: DataFrame) -> DataFrame:
    """vec_id, unit (array of double, null if the vector can't link), and h1, h2, the unit's hash."""
    ship(embeddings.sparkSession, 2000)

    def run(batches):
        for batch in batches:
            units, h = [], np.zeros((batch.num_rows, 2), np.uint64)
            for i, v in enumerate(batch.column(1).to_pylist()):
                x = None if v is None or any(c is None for c in v) else np.asarray(v, np.float64)
                if x is None or not len(x) or not np.isfinite(x).all() or not (top := np.abs(x).max()):
                    units.append(None)
                    continue
                x = x / top
                x = x / math.sqrt(float(x @ x)) + 0.0  # no negative zeros
                units.append(x)
                h[i] = np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), "<u8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(units, pa.list_(pa.float64())), *(pa.array(h[:, k].view(np.int64)) for k in (0, 1))], names=["vec_id", "unit", "h1", "h2"])

    own = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.mapInArrow(run, "vec_id long, unit array<double>, h1 long, h2 long")


def _matrix(column, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def assign(reps: DataFrame, pivots: np.ndarray) -> DataFrame:
    """rep, cell (the home) and angle to its pivot."""
    shared = reps.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        p = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            dots = _matrix(batch.column(1), p.shape[1]) @ p.T
            home = dots.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(home.astype(np.int32)), pa.array(np.arccos(np.clip(dots[np.arange(len(home)), home], -1, 1)))], names=["rep", "cell", "angle"])

    return reps.select("rep", "unit").mapInArrow(run, "rep long, cell int, angle double")


def reaches(x: np.ndarray, home: int, cells: np.ndarray, pivots: np.ndarray, radius: np.ndarray, t: float) -> np.ndarray:
    """Which vectors x (rows, all of one home) may have a partner in which of the cells, by the bounds of the module."""
    near = x @ pivots[home]
    dots = x @ pivots[cells].T
    gap = np.sqrt(np.maximum(2 - 2 * (pivots[cells] @ pivots[home]), 0))
    angles = np.arccos(np.clip(dots, -1, 1))
    goes = angles <= np.arccos(np.clip(near, -1, 1))[:, None] + 2 * t + SLACK
    return goes & (angles <= t + radius[cells] + SLACK) & (near[:, None] - dots <= math.sin(t) * gap + SLACK)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix, breadth first; each row is read once."""
    left = np.ones(len(linked), bool)
    out = []
    for root in np.flatnonzero(linked.any(axis=1)):
        if not left[root]:
            continue
        left[root] = False
        front = [int(root)]
        while front:
            v = front.pop()
            new = np.flatnonzero(linked[v] & left)
            left[new] = False
            out += [(v, int(w)) for w in new]
            front += new.tolist()
    return out


Tile = tuple[np.ndarray, np.ndarray, np.ndarray]  # numbers of representatives, their copies, their vectors


def join_tiles(a: Tile, b: Tile | None, cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Of two tiles, or one with itself: numbers of linked representatives, added partners (weighed by copies), and forest edges."""
    if b is None:
        linked = a[2] @ a[2].T >= cosine
        np.fill_diagonal(linked, False)
        some = np.flatnonzero(linked.any(axis=1))
        rep, weight, linked = a[0][some], a[1][some], linked[np.ix_(some, some)]
    else:
        found = a[2] @ b[2].T >= cosine
        left, right = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
        rep, weight = np.concatenate([a[0][left], b[0][right]]), np.concatenate([a[1][left], b[1][right]])
        linked = np.zeros((len(rep), len(rep)), bool)
        linked[: len(left), len(left) :] = found[np.ix_(left, right)]
        linked |= linked.T
    return rep, linked @ weight, [(int(rep[i]), int(rep[j])) for i, j in forest(linked)]


def _tile_name(cell: int, tile: int) -> str:
    return f"tile-{cell}-{tile}.npz"


def _load(folder: str, cell: int, tile: int) -> Tile:
    with np.load(io.BytesIO(read_file(folder, _tile_name(cell, tile)))) as f:
        return f["rep"], f["copies"], f["unit"]


def tiles_of(reps: DataFrame, pivots: np.ndarray, t: float, tile: int, folder: str) -> tuple[DataFrame, np.ndarray]:
    """Writes the tiles; gives cell, tile, n and reach (the cells q > cell that it is replicated to), and the cells' radii."""
    d = pivots.shape[1]
    spark = reps.sparkSession
    homes = materialize(assign(reps, pivots), "cells")
    radius = np.full(len(pivots), -9.0)
    sizes = homes.groupBy("cell").agg(F.max("angle").alias("radius"), F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    for cell, angle in sizes.select("cell", "radius").collect():  # a row a pivot
        radius[cell] = angle
    shared = spark.sparkContext.broadcast((pivots, radius))
    dealt = homes.join(F.broadcast(sizes.select("cell", "tiles")), "cell").select("rep", "cell", F.pmod(F.xxhash64("rep"), "tiles").cast("int").alias("tile"))
    full = dealt.join(reps.select("rep", "unit", "copies"), "rep")

    def put(group: pa.Table) -> pa.Table:
        p, r = shared.value
        cell, number = group.column("cell")[0].as_py(), group.column("tile")[0].as_py()
        x = _matrix(group.column("unit"), d)
        out = io.BytesIO()
        np.savez(out, rep=group.column("rep").to_numpy(), copies=group.column("copies").to_numpy(), unit=x)
        write_file(folder, _tile_name(cell, number), lambda f: f.write(out.getvalue()))
        cells = np.arange(cell + 1, len(p))
        reach = [int(q) for q in cells[reaches(x, cell, cells, p, r, t).any(axis=0)]] if len(cells) else []
        return pa.table({"cell": pa.array([cell], pa.int32()), "tile": pa.array([number], pa.int32()), "n": pa.array([len(x)], pa.int64()), "reach": pa.array([reach], pa.list_(pa.int32()))})

    written = materialize(full.groupBy("cell", "tile").applyInArrow(put, "cell int, tile int, n long, reach array<int>"), "tiles")
    discard(homes)
    return written, radius


def pairs_of(tiles: DataFrame) -> DataFrame:
    """p, i, q, j: pairs of tiles that meet, each once: tiles of one cell, and tiles of two cells that one may reach from the other."""
    own = tiles.select(F.col("cell").alias("p"), F.col("tile").alias("i"))
    within = own.join(own.select("p", F.col("i").alias("j")), "p").where("i <= j").select("p", "i", F.col("p").alias("q"), "j")
    across = tiles.select(F.col("cell").alias("p"), F.col("tile").alias("i"), F.explode("reach").alias("q")).join(own.select(F.col("p").alias("q"), F.col("i").alias("j")), "q")
    return within.unionByName(across)


def _meet(pairs: DataFrame, folder: str, pivots: np.ndarray, radius: np.ndarray, cosine: float) -> DataFrame:
    """a, b, n: with b null, n partners of a; else a link of the forest."""
    shared = pairs.sparkSession.sparkContext.broadcast((pivots, radius))
    t = math.acos(cosine)

    def run(batches):
        p, r = shared.value
        load = lru_cache(2 * BLOCK)(lambda cell, tile: _load(folder, cell, tile))
        some = lambda x, home, other: tuple(c[reaches(x[2], home, np.array([other]), p, r, t)[:, 0]] for c in x)
        for batch in batches:
            for cell, i, other, j in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if cell == other:
                    a, b = load(cell, i), load(cell, j) if i != j else None
                else:
                    a, b = some(load(cell, i), cell, other), some(load(other, j), other, cell)
                rep, n, found = join_tiles(a, b, cosine)
                left, right = np.array([e[0] for e in found], np.int64), np.array([e[1] for e in found], np.int64)
                ends = pa.array(np.concatenate([np.zeros(len(rep), np.int64), right]), mask=np.arange(len(rep) + len(right)) < len(rep))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep, left])), ends, pa.array(np.concatenate([n, np.zeros(len(left), np.int64)]))], names=["a", "b", "n"])

    block = [F.col("p"), F.floor(F.col("i") / BLOCK), F.col("q"), F.floor(F.col("j") / BLOCK)]
    tasks = max(1, 4 * pairs.sparkSession.sparkContext.defaultParallelism)  # rows are small: left to their bytes, they would all go to one task
    return pairs.repartition(tasks, *block).sortWithinPartitions("p", "q", "i", "j").mapInArrow(run, "a long, b long, n long")


def link(embeddings: DataFrame, cosine: float = COSINE, per_cell: int = PER_CELL, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id."""
    spark = embeddings.sparkSession
    rows = materialize(unit_rows(embeddings), "units")
    able = rows.where("unit IS NOT NULL")
    # representatives: a number per distinct vector; a hot vector is counted and taken once by partial aggregation
    classes = able.groupBy("h1", "h2").agg(F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    reps = materialize(classes.select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "unit", "copies", "least", F.size("unit").alias("d")), "reps")
    met = []
    for d, n in sorted(map(tuple, reps.groupBy("d").count().collect())):  # one row per length of vectors
        own = reps.where(F.col("d") == d)
        k = min(MOST_PIVOTS, n, max(LEAST_PIVOTS, n // per_cell))
        pivots = np.array([r.unit for r in own.select("unit").orderBy(F.xxhash64("h1", "h2"), "h1", "h2").limit(k).collect()])
        folder = fresh_path(spark, f"tiles-{uuid.uuid4().hex[:8]}")
        tiles, radius = tiles_of(own, pivots, math.acos(cosine), min(tile, max(64, TILE_NUMBERS // d)), folder)
        met.append(materialize(_meet(pairs_of(tiles), folder, pivots, radius, cosine), "met"))
        discard(tiles)
        tiles._scratch = folder
        discard(tiles)
    alone = rows.where("unit IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    if not met:
        return alone
    every = met[0]
    for more in met[1:]:
        every = every.unionByName(more)
    partners = every.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    found = components(every.where("b IS NOT NULL").select("a", "b"))
    per = reps.select("rep", "h1", "h2", "copies", "least").join(partners, "rep", "left").join(found.withColumnRenamed("id", "rep"), "rep", "left")
    per = materialize(per.withColumn("component", F.coalesce("component", "rep")), "classes")
    least = per.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("times"))
    total = per.count()
    per = hub_join(per, least, ["component"], "times", total).select("h1", "h2", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    linked = hub_join(able.select("vec_id", "h1", "h2"), per, ["h1", "h2"], "copies", rows.count()).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone)


def op7_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link(table(spark, sf_dir, "embeddings"))
    return linked.withColumn("kept", F.col("vec_id") == F.col("component_id"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.9
), reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r),
least AS (SELECT id, min(r) AS c FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN least ON id = vec_id LEFT JOIN n ON a = vec_id
"""
