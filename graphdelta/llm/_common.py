"""Shared plumbing of the training-data operators: scratch tables, batches, word hashes."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words of the contracts: runs of characters other than ASCII white space. bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = r"[\x20\x09-\x0D]+"
_REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local one if the master is local
    (tests), else an error: executors of a cluster would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), f"graphdelta-shared-{os.getpid()}")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/graphdelta/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage ends there, and a lost
    executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of materialize() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            jvm = df.sparkSession.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ship(spark: SparkSession, rows: int = 1000) -> None:
    """Let Python workers import this package from the checkout, and bound Arrow batches: texts may be long."""
    env = spark.sparkContext.environment
    parts = env.get("PYTHONPATH", "").split(os.pathsep)
    if _REPO not in parts:
        env["PYTHONPATH"] = os.pathsep.join([_REPO, *filter(None, parts)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: Column | str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as empty text."""
    text = F.coalesce((F.col(col) if isinstance(col, str) else col).cast("string"), F.lit(""))  # cast first: '' is no number
    return F.pmod(F.crc32(text.cast("binary")), F.lit(folds)).cast("int")


def label_rows(labels: DataFrame, value: str) -> DataFrame:
    """One label per document: rows without id or label go; if a document has both labels, the greater counts."""
    return labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull()).groupBy("doc_id").agg(F.max(value).cast("int").alias("_label"))


#: Tables of an id and a number up to so many rows are broadcast (about 100 bytes each in a hash map); larger ones are
#: joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def checked(ids: DataFrame) -> DataFrame:
    """A narrow table, marked for broadcast if it has few rows: their number is counted first, in partial sums (a limit would
    gather rows of every partition in one task)."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


#: A key is hot beyond so many rows, or beyond more where that many keys could be too many to broadcast.
HOT_ROWS = 1000


def hub_join(rows: DataFrame, side: DataFrame, keys: list[str], times: str, total: int) -> DataFrame:
    """rows joined with side (inner) on keys, of which some may have a large share of the rows. side: one row per key; `times`: how
    many rows have it; total: of all rows, or more. Keys of more than HOT_ROWS rows and of more than total / BROADCAST_ROWS are
    BROADCAST_ROWS at most, so these are broadcast; the others are joined by a shuffle, in which no key has more rows."""
    hot = max(HOT_ROWS, total // BROADCAST_ROWS)
    if total <= hot or side.where(F.col(times) > hot).isEmpty():
        return rows.join(side.drop(times), keys)
    few = F.broadcast(side.where(F.col(times) > hot).drop(times).withColumn("_hot", F.lit(True)))
    values = [c for c in side.columns if c not in (*keys, times)]
    marked = rows.join(few, keys, "left")
    rest = marked.where("_hot IS NULL").drop("_hot", *values).join(side.where(F.col(times) <= hot).drop(times), keys)
    return marked.where("_hot").drop("_hot").unionByName(rest)


def join_labels(docs: DataFrame, known: DataFrame, how: str = "inner") -> DataFrame:
    """docs with the _label of label_rows()."""
    return docs.join(checked(known), "doc_id", how)


class Cache(dict):
    """A dict that computes what it lacks and starts afresh beyond a number of entries, so that its memory is bounded."""

    def __init__(self, make, limit: int = 400_000):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


WORD_HASH = Cache(xxhash.xxh3_64_intdigest)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(WORD_HASH.__getitem__, words), np.uint64, len(words))


def hashed_words(texts: list[bytes], table: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, one text after another, and how many each text has: what word_hashes gives of
    t.split(), or of t.translate(table).split(). Words are split and told apart in Arrow; only distinct ones are hashed. The texts
    must be UTF-8, and of less than 2 GB in all."""
    raw = pa.array(texts, pa.binary())
    _, offsets, data = raw.buffers()
    if table is not None and data is not None:
        data = pa.py_buffer(data.to_pybytes().translate(table))
    lists = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, data]))
    coded = pc.dictionary_encode(lists.values)
    words = coded.dictionary.cast(pa.binary()).to_pylist()
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    codes, ends = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    if b"" in words:  # at the edges of a text
        keep = codes != words.index(b"")
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        codes = codes[keep]
    return own[codes], np.diff(ends)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), so that all bits of the result depend on all bits of x."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n-grams of a word-hash sequence; order matters."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    with np.errstate(over="ignore"):
        for i in range(1, n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def binary_values(column) -> list[bytes]:
    """A string column of a record batch as bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()] if column.type not in (pa.binary(), pa.large_binary()) else [x or b"" for x in column.to_pylist()]


def extended(df: DataFrame, columns: list[str], added: str) -> StructType:
    """The schema of some columns of df, of whatever types and field names, followed by the added ones (DDL)."""
    return StructType([*(df.schema[c] for c in columns), *StructType.fromDDL(added).fields])


def text_keys(texts: list[bytes]) -> list[bytes]:
    return [xxhash.xxh3_128_digest(t) for t in texts]


def joined_sums(texts: DataFrame, split, weights: DataFrame, default: float) -> DataFrame:
    """_key (of text_keys) and _rest: per text the sum of weights (b long, w) of those features that split(texts) names, as
    arrays of text numbers and of features b; a feature without a weight has the default. For weights too many to broadcast:
    each text gives a row per distinct feature. Copies of a text meet under one key: a row of each with n = 0 counts them, its b
    taken from the key so that these rows are dealt out too."""

    def run(batches):
        for batch in batches:
            own = binary_values(batch.column(0))
            for lo, hi in in_slices([len(t) for t in own], 4 << 20):
                keys, (where, at) = text_keys(own[lo:hi]), split(own[lo:hi])
                order = np.lexsort((at, where))
                where, at = where[order], at[order]
                first = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (at[1:] != at[:-1])]) if len(at) else np.zeros(0, np.int64)
                all_keys = pa.array(keys, pa.binary())
                yield pa.RecordBatch.from_arrays([all_keys.take(pa.array(where[first])), pa.array(at[first]), pa.array(np.diff(np.r_[first, len(at)]))], names=["_key", "b", "n"])
                marks = np.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], np.int64)
                yield pa.RecordBatch.from_arrays([all_keys, pa.array(marks), pa.array(np.zeros(len(keys), np.int64))], names=["_key", "b", "n"])

    rows = texts.select("text").mapInArrow(run, "_key binary, b long, n long").join(weights, "b", "left")
    value = F.col("n") * F.coalesce(F.col("w").cast("double"), F.lit(float(default)))
    return rows.groupBy("_key").agg((F.sum(value) / F.count_if(F.col("n") == 0)).alias("_rest"))


def in_slices(sizes: list[int], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to about `most`; a longer row stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
