"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Each byte gets a printable character; every token of the vocabulary becomes a BPE piece of such characters with score
minus its rank, and nothing is normalised. sentencepiece then merges, of all neighbours, the pair of highest score, the
leftmost of equals: the pair of least rank, as the rank file means it. A pre-token that is itself a token is looked up
first, as tiktoken does, since merges need not reach it. Pre-tokens are cut by the public pattern and encoded apart;
decoding maps ids back to bytes.

Cases: a null text counts as empty and has no ids; repeated rows each get their row; an empty table gives no rows; columns
beyond doc_id and text are ignored; special tokens' strings are ordinary text; whole texts are encoded, whatever their
length. If a single byte has no rank the vocabulary is refused.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from graphdelta.llm._common import Cache, ship, table


def byte_characters() -> list[str]:
    """A printable character for each byte: its own where Latin-1 prints it, else one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_proto(ranks: dict[bytes, int]) -> bytes:
    """The serialised model: piece k is the token of the k-th rank, the last piece stands for the unknown."""
    import struct

    chars = byte_characters()
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"no rank for bytes {missing[:5]}")
    out = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        piece = "".join(chars[b] for b in token)
        out.append(_field(1, _field(1, piece.encode()) + b"\x15" + struct.pack("<f", -float(rank))))
    out.append(_field(1, _field(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + b"".join(_field(k, (1 << 64) - 1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encoder and decoder of one vocabulary; `numbers` keeps the ids of recent pre-tokens."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model_proto(self.ranks))
        order = sorted(self.ranks.values())
        self.rank_of = order if order != list(range(len(order))) else None
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.chars = byte_characters()
        self.numbers = Cache(self._encode_word, 300_000)

    def _encode_word(self, word: str) -> tuple[int, ...]:
        data = word.encode()
        if (rank := self.ranks.get(data)) is not None:
            return (rank,)
        ids = self.processor.encode("".join([self.chars[b] for b in data]), num_threads=1)
        return tuple(self.rank_of[i] for i in ids) if self.rank_of else tuple(ids)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.numbers.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode_column(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int)."""
    ship(docs.sparkSession)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            ids = pa.array([c.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_column(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and data (binary) of doc_id and ids."""
    ship(encoded.sparkSession)

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            data = pa.array([c.decode(ids or []) for ids in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256; ids are encoded and decoded in one pass, and don't leave it."""
    ship(docs.sparkSession)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        c = codec(path, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        decimal = Cache(str, 1 << 20).__getitem__
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = c.encode(text.as_py() or "")
                rows.append((len(ids), sha(",".join(map(decimal, ids)).encode()), sha(c.decode(ids))))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
