"""Best-fit packing of documents into fixed windows, under conflicts.

A document of n tokens becomes whole windows of `capacity` and one rest. A bin takes a rest only if it holds no other piece
of the same source and none of the same cluster of duplicates; among the bins that may take it the one with the least room
left wins (of equals the one opened first), else a new bin opens. Rests come longest first, then by doc_id and piece.

Rests are dealt into groups of about GROUP by a hash of doc_id and piece (and of a row number, where a doc_id, or null, has many
rows), so that each group mixes all sources; a group is a partition of its own, packed in one task, and its bins are its own: best
fit is within a group, which costs each group's last open bins. All rows are packed; more rows make more groups, not larger ones. Bins with one
room left form a level; each carries bitmaps of its sources and clusters, each level the intersection of its bins' bitmaps.
The search goes from the tightest level up, over a bit set of levels in use, passes levels whose intersection already
conflicts, and ends at the first compatible bin.

Cases: a null or empty text has no tokens and gets no window; a null source or cluster conflicts with nothing; repeated rows
are packed each on its own (with the same source they can't meet in a bin); an empty table gives no rows; columns beyond
those named are ignored. Clusters of op2_packing are components of near copies (with_near_clusters); the pipeline's stage,
whose input has lost its near copies, takes exact ones (with_lengths). A hot source or cluster needs a bin for each of its rests: that is the constraint, not a loss.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphdelta.llm import minhash
from graphdelta.llm._common import BROADCAST_ROWS, HOT_ROWS, binary_values, extended, materialize, ship, table
from graphdelta.llm.token_files import encoder

CAPACITY, GROUP = 2048, 8192
SCHEMA = "doc_id long, piece long, start long, n_tokens long, bin_id string, bin_offset long"


class _Level:
    """Bins of one free room, by number, in the order of opening; common bitmaps of all of them."""

    __slots__ = ("bins", "sources", "clusters")

    def __init__(self):
        self.bins, self.sources, self.clusters = [], -1, -1


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[int]:
    """Bin numbers of pieces in the given order. sources, clusters: small numbers, -1 for none."""
    levels: dict[int, _Level] = {}
    used = 0  # bit r: some bin has room r
    held: list[list[int]] = []  # per bin: bitmaps of sources and of clusters
    out = []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        source, cluster = (1 << s if s >= 0 else 0), (1 << c if c >= 0 else 0)
        found, room, rest = -1, 0, used >> size << size
        while rest:
            room = (rest & -rest).bit_length() - 1
            level = levels[room]
            if not (level.sources & source or level.clusters & cluster):
                found = next((b for b in level.bins if not (held[b][0] & source or held[b][1] & cluster)), -1)
                if found >= 0:
                    break
            rest &= rest - 1
        if found < 0:
            found, room = len(held), capacity
            held.append([0, 0])
        else:
            level.bins.remove(found)
            if level.bins:
                level.sources = level.clusters = -1
                for b in level.bins:
                    level.sources &= held[b][0]
                    level.clusters &= held[b][1]
            else:
                used &= ~(1 << room)
                del levels[room]
        held[found][0] |= source
        held[found][1] |= cluster
        out.append(found)
        if room > size:
            level = levels.setdefault(room - size, _Level())
            used |= 1 << (room - size)
            level.bins.append(found)
            level.bins.sort() if len(level.bins) > 1 and level.bins[-2] > found else None
            level.sources &= held[found][0]
            level.clusters &= held[found][1]
    return out


def _numbers(values: list) -> list[int]:
    """Small numbers for values, -1 for null; a value that occurs once can't conflict and gets -1 too."""
    counts: dict = {}
    for v in values:
        counts[v] = counts.get(v, 0) + 1
    known: dict = {}
    return [-1 if v is None or counts[v] < 2 else known.setdefault(v, len(known)) for v in values]


def pack(docs: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Pieces of docs (doc_id, n_tokens, source, cluster): doc_id, piece, start (token offset in the document), n_tokens,
    bin_id and bin_offset (tokens before it in the bin). A whole window is a bin of its own, named by doc_id, piece and a
    row number that tells repeated rows apart."""
    ship(docs.sparkSession, 10_000)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_tokens").cast("long").alias("n"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
    own = materialize(own.where("n > 0").withColumn("_row", F.monotonically_increasing_id()), "lengths")
    full = F.floor(F.col("n") / capacity)
    whole = own.where(F.col("n") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece"))
    whole = whole.select("doc_id", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n_tokens"), F.concat_ws("-", F.lit("w"), "doc_id", "piece", F.monotonically_increasing_id()).alias("bin_id"), F.lit(0).cast("long").alias("bin_offset"))
    rests = own.where(F.col("n") % capacity > 0).select("doc_id", full.alias("piece"), (F.col("n") % capacity).alias("size"), "source", "cluster", "_row")
    total = rests.count()
    groups = max(1, -(-total // group))
    many = rests.groupBy("doc_id").agg(F.count("*").alias("_n")).where(F.col("_n") > max(HOT_ROWS, total // BROADCAST_ROWS)).select(F.col("doc_id").alias("_hot"), F.lit(True).alias("_is"))  # BROADCAST_ROWS ids at most
    marked = rests.join(F.broadcast(many), F.col("doc_id").eqNullSafe(F.col("_hot")), "left")
    part = F.pmod(F.xxhash64("doc_id", "piece", F.when(F.col("_is"), F.col("_row"))), F.lit(groups)).cast("int")
    dealt = marked.withColumn("part", part).repartitionById(groups, "part").select("doc_id", "piece", "size", "source", "cluster", "part")

    def packed(part: pa.Table) -> pa.Table:
        rows = part.sort_by([("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("source", "ascending"), ("cluster", "ascending")])
        size = rows.column("size").to_pylist()
        bins = best_fit(size, _numbers(rows.column("source").to_pylist()), _numbers(rows.column("cluster").to_pylist()), capacity)
        filled: dict[int, int] = {}
        offsets = []
        for b, n in zip(bins, size, strict=True):
            offsets.append(filled.get(b, 0))
            filled[b] = offsets[-1] + n
        name = part.column("part")[0].as_py()
        piece = rows.column("piece").to_numpy()
        return pa.table({
            "doc_id": rows.column("doc_id"), "piece": rows.column("piece"), "start": pa.array(piece * np.int64(capacity)), "n_tokens": rows.column("size"),
            "bin_id": pa.array([f"b-{name}-{b}" for b in bins]), "bin_offset": pa.array(offsets, pa.int64()),
        })

    def run(batches):
        rows = [b for b in batches if b.num_rows]  # a partition is one group
        if rows:
            yield from packed(pa.Table.from_batches(rows)).to_batches()

    return dealt.mapInArrow(run, SCHEMA).unionByName(whole)


def assemble(docs: DataFrame, packed: DataFrame, words: str = "words") -> DataFrame:
    """bin_id and tokens (array) of the bins; docs: doc_id (distinct) and `words`, an array of tokens. A bin has at most the
    capacity's tokens."""
    piece = F.struct("bin_offset", F.slice(F.col(words), (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int")).alias("tokens"))
    return packed.join(docs.select("doc_id", words), "doc_id").groupBy("bin_id").agg(F.flatten(F.array_sort(F.collect_list(piece))["tokens"]).alias("tokens"))


def with_lengths(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, source, and cluster: a hash of the text's words in ASCII lower case, so that copies of one text share it; null
    for texts without words. Tokens are those of a tokenizer's file (as in token_files), or, without one, words between ASCII white
    space: windows are then of words, and encoding costs nothing."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            n, cluster = [], []
            for text in binary_values(batch.column(2)):
                words = text.lower().split()
                n.append(len(words))
                cluster.append(xxhash.xxh3_128_hexdigest(b" ".join(words)) if words else None)
            if tokenizer:
                enc = encoder(tokenizer, 0)
                n = [len(enc.encode(t or "")) // enc.width - 1 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), batch.column(1), pa.array(cluster, pa.string())], names=["doc_id", "n_tokens", "source", "cluster"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    return own.mapInArrow(run, "doc_id long, n_tokens long, source string, cluster string")


def word_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`keep` columns of docs with n_tokens (words between ASCII white space)."""

    def run(batches):
        for batch in batches:
            n = [len(t.split()) for t in binary_values(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return docs.select(*keep, "text").mapInArrow(run, extended(docs, keep, "n_tokens long"))


def with_near_clusters(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens (words), source and cluster: the component of near copies, by shingles of five words and a similarity of 0.8.
    Where a doc_id is null or repeated, rows are written with a number of their own and linked by that, so that each is compared by
    its text."""
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text")
    if own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        rows = own.withColumn("_row", F.col("doc_id"))
    else:
        rows = materialize(own.withColumn("_row", F.monotonically_increasing_id()), "rows")
    linked = minhash.link(rows.select(F.col("_row").alias("doc_id"), "text"), 5, 80).select(F.col("doc_id").alias("_row"), F.col("component_id").cast("string").alias("cluster"))
    return word_counts(rows, ["_row", "doc_id", "source"]).join(linked, "_row").select("doc_id", "n_tokens", "source", "cluster")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(with_near_clusters(table(spark, sf_dir, "documents")))
