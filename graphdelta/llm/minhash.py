"""Near duplicates by b-bit MinHash, with every link confirmed on full shingle sets.

1. One pass hashes each text's words (ASCII lower case) to its set of shingles. Equal sets have equal fingerprints (count
   and two 64-bit sums) and collapse to one representative before anything is compared; these links too are confirmed on whole texts.
2. K = bands * ROWS minima per set give band keys; of each minimum only BITS low bits are kept, packed. Pairs within a
   band's bucket are compared by counting equal groups of bits, corrected for chance:
   (share - 2^-BITS) / (1 - 2^-BITS); those within MARGIN of the wanted similarity are candidates.
3. Buckets of at most SMALL members give all their pairs. Only components matter, so a larger bucket need not: it compares
   its members with one of them, and what is then still apart within it is compared in tiles (tiles.py), exactly and
   without a row per pair, so that no link that decides a component is lost, whatever a bucket's size.
4. A candidate is confirmed on both whole texts: 100 * |intersection| >= percent * |union|. Texts meet by leader, split
   into bundles of at most BUNDLE members.

The number of bands makes the chance that a pair at exactly the wanted similarity shares no band at most MISS.

Cases: a text with fewer words than a shingle is one shingle of them all; without words (or null) the set is empty and
links with nothing, not even with other empty ones; repeated doc_ids are one document whose first text in text order
counts for the links, and each keeps its row; a null doc_id stands alone with a null component and is kept; an empty table
gives no rows; columns beyond doc_id and text pass through drop_duplicates and are ignored else.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphdelta.llm._common import binary_values, checked, discard, hashed_words, hub_join, in_slices, materialize, mix, ngram_hashes, ship, table, word_hashes
from graphdelta.llm.components import components
from graphdelta.llm.tiles import tile_join

ROWS, BITS, MISS, MARGIN, BUNDLE, SMALL = 4, 2, 1e-7, 0.27, 256, 8
KEYS_SCHEMA = "doc_id long, n_shingles long, s1 long, s2 long, sig array<long>, bands array<long>"


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (percent / 100) ** rows))


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    """Distinct 64-bit hashes of a text's shingles, sorted."""
    h = word_hashes(text.lower().split())
    return np.unique(ngram_hashes(h, min(n, len(h)))) if len(h) else h


def shingle_set(text: bytes, n: int) -> set[bytes]:
    words = text.lower().split()
    k = min(n, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def _multipliers(k: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (seeds[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (seeds[k:] >> np.uint64(32)).astype(np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per hash function the least value over the shingles, in blocks that fit the cache."""
    x = (mix(shingles) >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(x), 2048):
            y = x[None, i : i + 2048] * a[:, None]
            y += b[:, None]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            np.minimum(out, y.min(axis=1), out=out)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """BITS low bits of each minimum of some rows of minima, as 64-bit numbers: first the lowest bit of all, then the next of all, each
    padded to whole numbers."""
    m = mix(low.astype(np.uint64))
    planes = []
    for bit in range(BITS):
        plane = np.packbits(((m >> np.uint64(bit)) & np.uint64(1)).astype(np.uint8), axis=1)
        planes.append(np.pad(plane, ((0, 0), (0, -plane.shape[1] % 8))))
    return np.ascontiguousarray(np.concatenate(planes, axis=1)).view(np.int64)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Per text what shingle_hashes gives."""
    h, size = hashed_words([t.lower() for t in texts])
    grams, ends = ngram_hashes(h, n), np.cumsum(size)
    out = []
    for start, end in zip((ends - size).tolist(), ends.tolist(), strict=True):
        own = grams[start : end - n + 1] if end - start >= n else ngram_hashes(h[start:end], end - start) if end > start else h[:0]
        own = np.sort(own)
        out.append(own[np.r_[True, own[1:] != own[:-1]]] if len(own) > 1 else own)
    return out


def keys(docs: DataFrame, shingle: int, bands: int) -> DataFrame:
    ship(docs.sparkSession)
    a, b = _multipliers(bands * ROWS)

    def run(batches):
        names = ["doc_id", "n_shingles", "s1", "s2", "sig", "bands"]
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            texts = binary_values(batch.column(1))
            sets = [s for lo, hi in in_slices([len(t) for t in texts], 4 << 20) for s in shingle_sets(texts[lo:hi], shingle)]
            some = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
            low = np.stack([minima(sets[i], a, b) for i in some]) if len(some) else np.zeros((0, bands * ROWS), np.uint32)
            band = np.repeat(salt[None, :], len(some), axis=0)
            for r in range(ROWS):
                with np.errstate(over="ignore"):
                    band = mix(band * np.uint64(0x9E3779B97F4A7C15) + low[:, r::ROWS].astype(np.uint64))
            sums = np.zeros((len(sets), 2), np.uint64)
            for i in some:
                sums[i] = sets[i].sum(), mix(sets[i] ^ np.uint64(0x5851F42D4C957F2D)).sum()
            place = np.full(len(sets), -1, np.int64)
            place[some] = np.arange(len(some))
            at = pa.array(place, mask=place < 0)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel())).take(at) for x in (packed(low), band.view(np.int64))]
            columns = [pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.ascontiguousarray(sums[:, k]).view(np.int64)) for k in (0, 1)), *lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, KEYS_SCHEMA)


def estimate(x: Column, y: Column, n: int) -> Column:
    """Similarity of two packed signatures of n minima: those whose bits all agree, corrected for agreement by chance."""
    words = -(-n // 64)
    number = lambda c, i: F.get(c, F.lit(i))
    differ = None
    for w in range(words):
        miss = None
        for bit in range(BITS):
            d = number(x, bit * words + w).bitwiseXOR(number(y, bit * words + w))
            miss = d if miss is None else miss.bitwiseOR(d)
        count = F.bit_count(miss)
        differ = count if differ is None else differ + count
    chance = 2.0**-BITS
    return ((1 - differ / n) - chance) / (1 - chance)


def confirm(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are linked by their whole texts. docs: doc_id, text, one row per id."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    docs = materialize(docs.join(checked(ids), "doc_id", "left_semi"), "texts")  # so that other texts aren't shuffled
    per = pairs.groupBy("a").agg(F.ceil(F.count("*") / BUNDLE).cast("int").alias("bundles"))
    dealt = pairs.join(per, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("bundles")).cast("int").alias("part"))
    heads = dealt.select("a", "part").distinct().join(docs.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    tails = dealt.join(docs.withColumnRenamed("doc_id", "b"), "b").select("a", "part", "b", "text")
    met = heads.unionByName(tails).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    words = lambda text: text.lower().split()

    def run(batches):
        now, own, head, whole = None, None, b"", []
        for batch in batches:
            found = []
            a, part, b = (batch.column(i).to_pylist() for i in range(3))
            for i, text in enumerate(binary_values(batch.column(3))):
                if b[i] is None:
                    now, own, head, whole = (a[i], part[i]), None, text, words(text)
                    continue
                if now != (a[i], part[i]):
                    raise ValueError("a pair came before its head")
                if words(text) == whole:  # copies have equal sets
                    found += [(a[i], b[i])] * bool(whole)
                    continue
                own = shingle_set(head, shingle) if own is None else own
                other = shingle_set(text, shingle)
                common = len(own & other)
                if own and other and 100 * common >= percent * (len(own) + len(other) - common):
                    found.append((a[i], b[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def _apart(members: DataFrame) -> DataFrame:
    """Keys of buckets with members of two components or more."""
    return members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")


def shingle_table(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id and shingles (binary: the sorted 64-bit hashes of the whole text)."""
    def run(batches):
        for batch in batches:
            texts = binary_values(batch.column(1))
            data = [s.tobytes() for lo, hi in in_slices([len(t) for t in texts], 4 << 20) for s in shingle_sets(texts[lo:hi], shingle)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def class_members(firsts: DataFrame) -> DataFrame:
    """doc_id and rep, the least doc_id with an equal set, of sets that occur twice or more. A set may be that of a third of all rows."""
    sets = ["n_shingles", "s1", "s2"]
    classes = materialize(firsts.groupBy(*sets).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "classes")
    total = classes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return hub_join(firsts.select("doc_id", *sets), classes, sets, "n", total).select("doc_id", "rep")


def link(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text). The result reads written tables only."""
    bands = bands_for(percent)
    n = bands * ROWS
    every = materialize(keys(docs, shingle, bands), "keys")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("text").alias("text"))
    ids = every.where("doc_id IS NOT NULL AND n_shingles > 0")
    repeated = every.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() > 0
    if repeated:  # one text per id decides its links
        firsts = materialize(keys(texts, shingle, bands), "keys").where("n_shingles > 0")
    else:
        firsts, texts = ids, docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    member = materialize(class_members(firsts), "member")
    copies = member.where("doc_id != rep")
    others = copies.select("doc_id")
    reps = materialize(firsts.select("doc_id", "n_shingles", "sig", "bands").join(checked(others), "doc_id", "left_anti"), "reps")
    rows = reps.select(F.explode("bands").alias("key"), "doc_id")
    shared = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    own = reps.select("doc_id", F.col("n_shingles").alias("size"), "sig")
    members = materialize(rows.join(shared, "key").join(own, "doc_id").select("key", "doc_id", "size", "sig"), "members")
    discard(reps)

    floor = percent / 100 - MARGIN
    sizes_fit = 100 * F.least("size", "size2") >= percent * F.greatest("size", "size2")
    other = lambda df: df.select("key", *(F.col(c).alias(f"{c}2") for c in ("doc_id", "size", "sig")))
    large = materialize(members.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SMALL).select("key"), "large")
    small, crowded = members.join(checked(large), "key", "left_anti"), members.join(checked(large), "key", "left_semi")
    heads = crowded.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id", "size", "sig")).alias("h")).select("key", "h.doc_id", "h.size", "h.sig")
    met = small.join(other(small), "key").where(F.col("doc_id") < F.col("doc_id2")).unionByName(crowded.join(other(heads), "key").where(F.col("doc_id") != F.col("doc_id2")))
    met = met.where(sizes_fit & (estimate(F.col("sig"), F.col("sig2"), n) >= floor))
    # the head of a bucket comes as doc_id2: its text then serves all its members
    pairs = materialize(met.select(F.col("doc_id2").alias("a"), F.col("doc_id").alias("b")).distinct(), "pairs")
    links = materialize(confirm(pairs, texts, shingle, percent), "links")
    discard(pairs)
    if not large.isEmpty():
        found = materialize(components(links), "components")
        now = crowded.select("key", "doc_id", "size").join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        now = materialize(now.select("key", "doc_id", "component", "size"), "members")
        open_ = materialize(_apart(now), "open")
        apart = now.join(checked(open_), "key", "left_semi")
        wanted = materialize(apart.select("doc_id").distinct(), "ids")
        sets = materialize(shingle_table(texts.join(checked(wanted), "doc_id", "left_semi"), shingle), "shingles")
        more = materialize(tile_join(apart, sets, percent).distinct(), "tiles")
        discard(sets, wanted, now, open_, found)
        links = links.unionByName(materialize(confirm(more, texts, shingle, percent), "links"))
    discard(members, large)
    equal = confirm(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), texts, shingle, percent)
    edges = equal.unionByName(links)
    found = materialize(components(edges), "components")
    return every.select("doc_id", "n_shingles").join(found, F.col("doc_id") == F.col("id"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def drop_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs, all columns, without those whose component has a smaller doc_id; repeated rows of a kept id stay one."""
    gone_id, rank = (f"_{name}_{uuid.uuid4().hex}" for name in ("gone", "rank"))  # no column of docs can have these names
    linked = link(docs.select("doc_id", "text"), shingle, percent)
    gone = materialize(linked.where("doc_id != component_id").select(F.col("doc_id").alias(gone_id)).distinct(), "gone")
    kept = docs.join(checked(gone), F.col("doc_id") == F.col(gone_id), "left_anti")
    # a repeated id is one document
    if kept.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return kept
    ranked = kept.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), F.xxhash64("text"))).orderBy("text")))
    return ranked.where((F.col(rank) == 1) | F.col("doc_id").isNull()).drop(rank)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link(table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 85)
    return linked.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common.n >= 85 * (p.n + q.n - common.n)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r),
least AS (SELECT id, min(r) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c AS component_id, d.doc_id = c AS kept
FROM documents d JOIN least ON id = d.doc_id LEFT JOIN sizes ON sizes.doc_id = d.doc_id
"""
