"""Token-id shards in a binary format, with a minimal perfect hash index for keyed access.

Documents are dealt out by ranges of doc_id (of equal ones by hash of text, then row) and sorted, so shard files hold them in
ascending order. Shards are cut by size: SHARD_BYTES of text each on average, fewer where more tasks can work.

    shard-00000.ids    "GDTOK1\\0\\0", the ids (2 or 4 bytes each, little-endian), per document doc_id (i64) and number of ids
                       (u64, top bit: the doc_id is null), footer "<QQIIQ": documents, ids, width, crc32 of the ids, magic
    index-00000.mph    keys of one hash partition: a displacement per bucket and, per slot, a fingerprint (u32), shard (u32),
                       offset and number of ids (u64)
    manifest.json      width, shards with their counts, number of index partitions

A lookup hashes the key to a partition, the partition's displacement gives the slot, the fingerprint rejects keys that are
not there (all but one in 2^32), and shard and offset give the bytes: two reads whatever the number of documents.

Reading goes through the index: the shards' directories name the documents, one task per index partition looks its keys up, and
the places found are read in ranges of about RANGE_BYTES of a shard, never a whole one. A key that the index denies, or leads
elsewhere than the directory, is an error.

A task writes to a name of its own and renames it when complete, so a repeated task puts the same file in place (files.py).

Cases: a null text counts as empty and has the end id alone; documents of one doc_id stand next to each other, ordered by
hash of text, the index leads to the first, and the others are read from the directory's place, as are those of a null doc_id, which
come first and are not indexed; an empty table gives no rows; columns beyond doc_id and text are ignored; whole texts are encoded.
"""

from __future__ import annotations

import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphdelta.llm._common import Cache, discard, fresh_path, in_slices, materialize, mix, ship, table
from graphdelta.llm.files import place, read_file, write_file

MAGIC, INDEX_MAGIC = b"GDTOK1\0\0", b"GDMPH1\0\0"
FOOTER = "<QQIIQ"
NULL_BIT = 1 << 63
KEYS_PER_PARTITION, BUCKET = 65_536, 3
SHARD_BYTES, LEAST_SHARD_BYTES, RANGE_BYTES = 128 << 20, 4 << 20, 16 << 20
SLOT = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8")])


# ---- files -------------------------------------------------------------------------------------------------------------


def shard_name(k: int) -> str:
    return f"shard-{k:05d}.ids"


def index_name(k: int) -> str:
    return f"index-{k:05d}.mph"


# ---- encoding ----------------------------------------------------------------------------------------------------------

_LETTERS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:$%&*#]*)")


class WordEncoder:
    """The tokenizers library's ids of a text, as packed bytes. The vocabulary's tokenizer drops white space, so a text's ids
    are those of its pieces between spaces, and recent pieces are remembered. A plain run of letters with punctuation behind
    goes to the library's merges at once, since its normaliser only lower-cases such a run and its pattern cuts it there."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.end = np.array([end_id], self.kind).tobytes()
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        rest = iter(range(256, 512))
        self.chars = [chr(b) if b in own else chr(next(rest)) for b in range(256)]
        spec = json.loads(self.tokenizer.to_str())
        self.by_pieces = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0].get("behavior") == "Removed" and spec["post_processor"] is None
        self.plain = self.by_pieces and self._trusted()
        self.pieces = Cache(self._piece, 400_000)
        self.pieces[""] = b""

    def _trusted(self) -> bool:
        """Whether the short way agrees with the library on a probe of letters and marks."""
        probe = ["Abc", "straße,", "ÉTÉ!!", "ñandú.", "the&&&", "çà:;", "x", "Ÿ"[:0] + "ÀÿØ#"]
        return all((got := self._short(w)) is not None and got == self._long(w) for w in probe)

    def _long(self, piece: str) -> list[int]:
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def _short(self, piece: str) -> list[int] | None:
        if not (m := _LETTERS.fullmatch(piece)):
            return None
        letters, marks = m.group(1).lower(), m.group(2)
        ids = [t.id for t in self.model.tokenize(letters if letters.isascii() else "".join([self.chars[b] for b in letters.encode()]))]
        return ids + [t.id for t in self.model.tokenize(marks)] if marks else ids

    def _piece(self, piece: str) -> bytes:
        ids = self._short(piece) if self.plain else None
        return np.array(self._long(piece) if ids is None else ids, self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        if not self.by_pieces:
            return np.array(self._long(text), self.kind).tobytes() + self.end
        return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" "))) + self.end

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts (null: empty), one after another, each with the end id; and how many each has. Pieces are told apart
        in Arrow, and only distinct ones are looked up."""
        texts = pc.fill_null(texts, "")
        if not self.by_pieces:
            data = [self.encode(t) for t in texts.to_pylist()]
            return np.frombuffer(b"".join(data), self.kind), np.array([len(x) // self.width for x in data], np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = pc.dictionary_encode(lists.flatten())
        own = [self.pieces[x] for x in coded.dictionary.to_pylist()]
        sizes = np.array([len(x) for x in own], np.int64) // self.width
        values, at = np.frombuffer(b"".join(own), self.kind), coded.indices.to_numpy().astype(np.int64)
        n = sizes[at]
        ends = np.cumsum(n)
        body = values[np.repeat((np.cumsum(sizes) - sizes)[at] - (ends - n), n) + np.arange(int(n.sum()))]
        cuts = np.cumsum(lists.value_lengths().to_numpy())  # every text has a piece at least
        stops = np.concatenate([[0], ends])[cuts] if len(cuts) else cuts
        counts = np.diff(stops, prepend=0) + 1
        out = np.empty(len(body) + len(cuts), self.kind)
        closing = np.zeros(len(out), bool)
        closing[np.cumsum(counts) - 1] = True
        out[closing] = np.frombuffer(self.end, self.kind)[0]
        out[~closing] = body
        return out, counts


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, end_id: int) -> WordEncoder:
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = WordEncoder(path, end_id)
    return _ENCODERS[path, end_id]


# ---- minimal perfect hash ----------------------------------------------------------------------------------------------


def key_hash(keys: np.ndarray) -> np.ndarray:
    return mix(keys.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(h + d * np.uint64(0xD1342543DE82EF95)) % np.uint64(n)).astype(np.int64)


def build_index(keys: np.ndarray) -> np.ndarray:
    """Displacements of buckets for distinct keys: d >= 0 hashes a bucket's keys to free slots, -1 - slot names the slot of a
    lone key. Buckets are settled from the largest down."""
    n = len(keys)
    h = key_hash(keys)
    buckets = max(1, n // BUCKET)
    at = (mix(h) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    sizes = np.bincount(at, minlength=buckets)
    starts = np.cumsum(sizes) - sizes
    shift = np.zeros(buckets, np.int64)
    free = np.ones(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        k = sizes[b]
        if k < 2:
            break
        own = h[order[starts[b] : starts[b] + k]]
        d, tries = 0, 32
        while True:
            ds = np.arange(d, d + tries, dtype=np.uint64)
            slots = _slots(own[None, :], ds[:, None], n)
            fits = free[slots].all(axis=1)
            if fits.any():
                for i in np.flatnonzero(fits):
                    if len(set(slots[i].tolist())) == k:
                        break
                else:
                    i = -1
                if i >= 0:
                    shift[b] = d + i
                    free[slots[i]] = False
                    break
            d, tries = d + tries, min(tries * 4, 2048)
    lone = np.flatnonzero(sizes == 1)
    shift[lone] = -1 - np.flatnonzero(free)
    return shift


def find_slots(keys: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    h = key_hash(keys)
    d = shift[(mix(h) % np.uint64(len(shift))).astype(np.int64)]
    return np.where(d < 0, -1 - d, _slots(h, np.maximum(d, 0).astype(np.uint64), n))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(key_hash(keys) ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def partition_of(key: int, partitions: int) -> int:
    """Spark's pmod(xxhash64(key), partitions)."""
    h = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    return (h - (1 << 64) if h >> 63 else h) % partitions


def _pack_index(keys: np.ndarray, rows: np.ndarray) -> bytes:
    shift = build_index(keys)
    slots = np.empty(len(keys), SLOT)
    at = find_slots(keys, shift, len(keys))
    slots[at] = rows
    if not (slots[at]["print"] == rows["print"]).all() or len(np.unique(at)) != len(keys):
        raise ValueError("two keys share a slot")
    return INDEX_MAGIC + struct.pack("<QQ", len(keys), len(shift)) + shift.astype("<i8").tobytes() + slots.tobytes()


def _unpack_index(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if data[:8] != INDEX_MAGIC:
        raise ValueError("not an index file")
    n, m = struct.unpack_from("<QQ", data, 8)
    return np.frombuffer(data, "<i8", m, 24), np.frombuffer(data, SLOT, n, 24 + 8 * m)


# ---- writing -----------------------------------------------------------------------------------------------------------


def write(docs: DataFrame, path: str, end_id: int = 2, folder: str | None = None) -> str:
    """Encode docs (doc_id, text) into shards and index; returns the folder."""
    spark = docs.sparkSession
    ship(spark)
    folder = folder or fresh_path(spark, "tokens")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // SHARD_BYTES), min(4 * spark.sparkContext.defaultParallelism, size // LEAST_SHARD_BYTES))
    keyed = own.select("doc_id", "text", F.xxhash64("text").alias("_h"), F.monotonically_increasing_id().alias("_row"))
    dealt = keyed.repartitionByRange(parts, "doc_id", "_h", "_row").sortWithinPartitions("doc_id", "_h").select("doc_id", "text")

    def put(batches):
        enc = encoder(path, end_id)
        shard = TaskContext.get().partitionId()
        ids, ns = [], [np.zeros(0, np.int64)]
        done = 0

        def stream(out):
            nonlocal done
            crc = 0
            out.write(MAGIC)
            for batch in batches:
                ids.append(batch.column(0))
                for lo, hi in in_slices(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), 16 << 20):
                    data, n = enc.encode_many(batch.column(1).slice(lo, hi - lo))
                    ns.append(n)
                    crc = zlib.crc32(data.data, crc)
                    done += len(data)
                    out.write(data.data)
            keys = pa.chunked_array(ids, pa.int64())
            n = np.concatenate(ns)
            directory = np.empty((len(n), 2), "<u8")
            directory[:, 0] = keys.fill_null(0).to_numpy().view(np.uint64)
            directory[:, 1] = n.astype(np.uint64) | (keys.is_null().to_numpy().astype(np.uint64) << np.uint64(63))
            out.write(directory.tobytes())
            out.write(struct.pack(FOOTER, len(n), done, enc.width, crc, int.from_bytes(MAGIC, "little")))

        first = next(batches, None)
        if first is None:
            return
        batches = _chain(first, batches)
        write_file(folder, shard_name(shard), stream)
        n = np.concatenate(ns)
        keys = pa.chunked_array(ids, pa.int64()).combine_chunks()
        yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(n), shard, np.int32)), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(np.full(len(n), enc.width, np.int32))], names=["doc_id", "shard", "offset", "n", "width"])

    entries = materialize(dealt.mapInArrow(put, "doc_id long, shard int, offset long, n long, width int"), "entries")
    shards = sorted(map(tuple, entries.groupBy("shard").agg(F.count("*"), F.sum("n"), F.max("width"), F.max("doc_id")).collect()))  # one row a file
    partitions = max(1, -(-sum(s[1] for s in shards) // KEYS_PER_PARTITION))
    first = entries.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("shard", "offset", "n")).alias("at"))
    keyed = first.select(F.pmod(F.xxhash64("doc_id"), F.lit(partitions)).cast("int").alias("part"), "doc_id", "at.shard", "at.offset", "at.n")

    def index(group: pa.Table) -> pa.Table:
        keys = group.column("doc_id").to_numpy()
        rows = np.empty(len(keys), SLOT)
        rows["print"] = fingerprints(keys)
        for name in ("shard", "offset", "n"):
            rows[name] = group.column(name).to_numpy()
        part = group.column("part")[0].as_py()
        write_file(folder, index_name(part), lambda out: out.write(_pack_index(keys, rows)))
        return pa.table({"part": pa.array([part], pa.int32()), "keys": pa.array([len(keys)], pa.int64())})

    built = keyed.groupBy("part").applyInArrow(index, "part int, keys long").collect()  # one row an index file
    manifest = {
        "width": shards[0][3] if shards else 2,
        "shards": [{"shard": s, "docs": d, "ids": n, "last": last} for s, d, n, _, last in shards],
        "partitions": partitions,
        "indexed": sorted(r.part for r in built),
    }
    write_file(folder, "manifest.json", lambda out: out.write(json.dumps(manifest).encode()))
    discard(entries)
    return folder


def _chain(first, rest):
    yield first
    yield from rest


# ---- reading -----------------------------------------------------------------------------------------------------------


def _parse(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, which of them are null, numbers of ids, and all ids of a shard's bytes."""
    docs, n, width, crc, magic = struct.unpack_from(FOOTER, data, len(data) - struct.calcsize(FOOTER))
    end = 8 + n * width
    if data[:8] != MAGIC or magic != int.from_bytes(MAGIC, "little") or zlib.crc32(memoryview(data)[8:end]) != crc:
        raise ValueError("not a whole shard file")
    return *_entries(data[end : end + 16 * docs]), np.frombuffer(data, f"<u{width}", n, 8)


def _entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    directory = np.frombuffer(data, "<u8").reshape(-1, 2)
    return directory[:, 0].view(np.int64), directory[:, 1] >> np.uint64(63) == 1, (directory[:, 1] & np.uint64(NULL_BIT - 1)).astype(np.int64)


def _directory(folder: str, shard: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, which of them are null, and numbers of ids, by two reads at the end of the file."""
    fs, path = place(folder)
    foot = struct.calcsize(FOOTER)
    with fs.open_input_file(f"{path}/{shard_name(shard)}") as f:
        f.seek(f.size() - foot)
        docs, n, width, _, magic = struct.unpack(FOOTER, f.read(foot))
        if magic != int.from_bytes(MAGIC, "little"):
            raise ValueError("not a whole shard file")
        f.seek(8 + n * width)
        return _entries(f.read(16 * docs))


def directory(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, shard, offset, n, and whether it is the first of its (non-null) doc_id, of every document in the shards."""
    manifest = json.loads(read_file(folder, "manifest.json"))
    names, shards, last = ["doc_id", "shard", "offset", "n", "first"], [], None
    for s in manifest["shards"]:
        shards.append((s["shard"], last))
        last = s["last"] if s["last"] is not None else last

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                shard, before = shards[k]
                keys, null, n = _directory(folder, shard)
                first = ~null
                first[1:] &= (keys[1:] != keys[:-1]) | null[:-1]
                if len(keys) and before is not None and keys[0] == before:
                    first[0] = False
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null), pa.array(np.full(len(n), shard, np.int32)), pa.array(np.cumsum(n) - n), pa.array(n), pa.array(first)], names=names)

    return spark.range(0, len(shards), 1, max(1, len(shards))).mapInArrow(run, "doc_id long, shard int, offset long, n long, first boolean")


def looked_up(keyed: DataFrame, folder: str, partitions: int) -> DataFrame:
    """doc_id, shard, offset, n of keys (doc_id, and where the directory has them) as the index says; one task an index partition."""

    def run(group: pa.Table) -> pa.Table:
        keys = group.column("doc_id").to_numpy()
        shift, slots = _unpack_index(read_file(folder, index_name(group.column("part")[0].as_py())))
        rows = slots[find_slots(keys, shift, len(slots))]
        if (rows["print"] != fingerprints(keys)).any():
            raise ValueError("the index does not know a key of the shards")
        if any((rows[name] != group.column(name).to_numpy()).any() for name in ("shard", "offset", "n")):
            raise ValueError("the index leads elsewhere than the shards' directory")
        return pa.table({"doc_id": keys, "shard": rows["shard"].astype(np.int32), "offset": rows["offset"].astype(np.int64), "n": rows["n"].astype(np.int64)})

    dealt = keyed.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(partitions)).cast("int"))
    return dealt.groupBy("part").applyInArrow(run, "doc_id long, shard int, offset long, n long")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, through the index: doc_id, start (ids before it in all shards), n_tokens, ids_crc32."""
    ship(spark)
    manifest = json.loads(read_file(folder, "manifest.json"))
    width, base, start = manifest["width"], {}, 0
    for s in manifest["shards"]:
        base[s["shard"]] = start
        start += s["ids"]
    rows = directory(spark, folder)
    places = looked_up(rows.where("first").drop("first"), folder, manifest["partitions"]).unionByName(rows.where("NOT first").drop("first"))
    block = F.floor(F.col("offset") * width / RANGE_BYTES)
    tasks = max(1, -(-start * width // (2 * RANGE_BYTES)))  # rows are narrow: their bytes say nothing of what is read
    dealt = places.withColumn("block", block).repartition(tasks, "shard", "block").sortWithinPartitions("shard", "offset")
    shared = spark.sparkContext.broadcast(base)
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches):
        fs, path = place(folder)
        for batch in batches:
            if not batch.num_rows:
                continue
            shard, offset, n, own = (batch.column(k).to_numpy() for k in (1, 2, 3, 4))
            crc = np.empty(len(n), np.int64)
            cuts = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (own[1:] != own[:-1]), True]).tolist()
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                with fs.open_input_file(f"{path}/{shard_name(int(shard[lo]))}") as f:
                    f.seek(8 + int(offset[lo]) * width)
                    ids = np.frombuffer(f.read(int(offset[hi - 1] + n[hi - 1] - offset[lo]) * width), f"<u{width}")
                for i, a in zip(range(lo, hi), (offset[lo:hi] - offset[lo]).tolist(), strict=True):
                    crc[i] = zlib.crc32(ids[a : a + int(n[i])].astype("<u4").data)
            starts = np.array([shared.value[int(k)] for k in shard], np.int64) + offset
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts), batch.column(3), pa.array(crc)], names=names)

    return dealt.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


class Reader:
    """Keyed access: reader[doc_id] gives the ids as an array, or KeyError. Index partitions are read once and kept."""

    def __init__(self, folder: str):
        self.folder, self.manifest = folder, json.loads(read_file(folder, "manifest.json"))
        self.fs, self.path = place(folder)
        self.parts: dict[int, tuple] = {}
        self.indexed = set(self.manifest["indexed"])

    def __getitem__(self, key: int) -> np.ndarray:
        part = partition_of(key, self.manifest["partitions"])
        if part not in self.indexed:
            raise KeyError(key)
        if part not in self.parts:
            self.parts[part] = _unpack_index(read_file(self.folder, index_name(part)))
        shift, slots = self.parts[part]
        own = np.array([key], np.int64)
        row = slots[find_slots(own, shift, len(slots))[0]]
        if row["print"] != fingerprints(own)[0]:
            raise KeyError(key)
        width = self.manifest["width"]
        with self.fs.open_input_file(f"{self.path}/{shard_name(int(row['shard']))}") as f:
            f.seek(8 + int(row["offset"]) * width)
            return np.frombuffer(f.read(int(row["n"]) * width), f"<u{width}")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read(spark, write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))
