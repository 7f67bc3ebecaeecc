import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tables import documents, odd

from graphdelta.llm import byte_bpe, packing, token_files

SF = "/root/testdata/sf0.001"
WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", "Hello, World!", "l'été's 12345 naïve\t\n  x", "<|endoftext|> <|startoftext|>", "日本語テキスト 😀👍🏽", "İß ﬁ \x00\x7f", "a" * 3000, "\r\n  　", "ÀÉÎÕÜ ñ... &&&%%% don't I'll", "퟿�", "x " * 20_000]


# ---- byte BPE ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_ids_are_those_of_the_library(reference):
    c = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    for t in TEXTS:
        ids = c.encode(t or "")
        assert ids == reference.encode_ordinary(t or ""), t
        assert c.decode(ids) == (t or "").encode()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_ids_of_any_text(reference, text):
    c = byte_bpe.codec(RANKS, public_tokenizers.PATTERN)
    assert c.encode(text) == reference.encode_ordinary(text)
    assert c.decode(c.encode(text)) == text.encode()


def test_bpe_tables(spark, reference):
    docs = odd(spark, TEXTS)
    got = {r.doc_id: r for r in byte_bpe.digests(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        ids = reference.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    encoded = byte_bpe.encode_column(docs, RANKS, public_tokenizers.PATTERN)
    assert {r.doc_id: bytes(r.data) for r in byte_bpe.decode_column(encoded, RANKS, public_tokenizers.PATTERN).collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert byte_bpe.digests(docs.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError, match="no rank"):
        byte_bpe.model_proto({b"a": 0})


# ---- token files -----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def words():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcDEÉßñ'.,!?&%$#* \n\t0123456789<|>_-😀日 İ")), max_size=40))
def test_short_ways_give_the_library_s_ids(words, text):
    enc = token_files.encoder(WORDS, 2)
    got = np.frombuffer(enc.encode(text), enc.kind).tolist()
    assert got == [*words.encode(text, add_special_tokens=False).ids, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("abÉß'.,!# \n\t09😀日")), max_size=30)), max_size=8))
def test_many_texts_encode_like_each_of_them(texts):
    enc = token_files.encoder(WORDS, 2)
    ids, n = enc.encode_many(pa.array(texts, pa.string()))
    assert ids.tobytes() == b"".join(enc.encode(t or "") for t in texts)
    assert n.tolist() == [len(enc.encode(t or "")) // enc.width for t in texts]


@pytest.mark.parametrize("shard_bytes", [1 << 20, 8])
def test_files_round_trip(spark, words, monkeypatch, shard_bytes):
    monkeypatch.setattr(token_files, "LEAST_SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(token_files, "RANGE_BYTES", 64)
    texts = [(i * 3, t) for i, t in enumerate(TEXTS)] + [(-5, "first"), (None, "null id"), (None, None), *((7, f"again {k}") for k in "abcdefghij")]
    folder = token_files.write(odd(spark, texts), WORDS)
    assert (len(json.loads(token_files.read_file(folder, "manifest.json"))["shards"]) > 1) == (shard_bytes == 8)
    rows = token_files.read(spark, folder).collect()
    want, start = [], 0
    h = {r.text: r.h for r in odd(spark, texts).select("text", F.xxhash64("text").alias("h")).collect()}
    texts.sort(key=lambda x: (x[0] is not None, x[0] or 0, h[x[1]]))
    for i, t in texts:
        ids = [*words.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows), key=lambda r: r[1]) == want
    reader = token_files.Reader(folder)
    for i, t in texts:
        if i is not None and i != 7:
            assert reader[i].tolist() == [*words.encode(t or "", add_special_tokens=False).ids, 2]
    assert reader[7].tolist()[:-1] == words.encode(next(t for i, t in texts if i == 7), add_special_tokens=False).ids
    with pytest.raises(KeyError):
        reader[123456]


def test_a_broken_index_breaks_the_query(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(50)])
    for what in ("print", "offset"):
        folder = token_files.write(docs, WORDS)
        assert token_files.read(spark, folder).count() == 50
        data = bytearray(token_files.read_file(folder, token_files.index_name(0)))
        slots = np.frombuffer(data, token_files.SLOT, 50, len(data) - 50 * token_files.SLOT.itemsize)
        slots[what][17] += 1
        token_files.write_file(folder, token_files.index_name(0), lambda out: out.write(bytes(data)))  # noqa: B023
        with pytest.raises(Exception, match="the index"):
            token_files.read(spark, folder).count()


def test_empty_token_table(spark):
    folder = token_files.write(documents(spark, []), WORDS)
    assert token_files.read(spark, folder).count() == 0
    with pytest.raises(KeyError):
        token_files.Reader(folder)[1]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=400))
def test_the_hash_is_perfect_and_minimal(keys):
    own = np.array(sorted(keys), np.int64)
    slots = token_files.find_slots(own, token_files.build_index(own), len(own))
    assert sorted(slots.tolist()) == list(range(len(own)))


def test_partitions_agree_with_spark(spark):
    got = spark.range(-50, 50).select("id", F.pmod(F.xxhash64("id"), F.lit(7)).alias("p")).collect()
    assert all(token_files.partition_of(r.id, 7) == r.p for r in got)


# ---- packing ---------------------------------------------------------------------------------------------------------------------


def brute_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(b["room"], k) for k, b in enumerate(bins) if b["room"] >= size and (s < 0 or s not in b["s"]) and (c < 0 or c not in b["c"])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"room": capacity, "s": set(), "c": set()})
        bins[k]["room"] -= size
        bins[k]["s"].add(s)
        bins[k]["c"].add(c)
        out.append(k)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.integers(-1, 4), st.integers(-1, 3)), max_size=60))
def test_best_fit(pieces):
    pieces = sorted(pieces, key=lambda x: -x[0])
    columns = [list(x) for x in zip(*pieces, strict=True)] or [[], [], []]
    assert packing.best_fit(*columns, 20) == brute_fit(*columns, 20)


def test_packed_bins_hold_what_they_may(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, 1, 7, 40, 100, 101, 250, 399]), f"s{rng.choice([0, 0, 0, 1, 2, 3])}", f"c{rng.randrange(9)}" if i % 3 else None) for i in range(300)] + [(5, 40, None, None), (None, 30, "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster string")
    got = packing.pack(docs, capacity=100, group=64).collect()
    assert sum(r.n_tokens for r in got) == sum(r[1] for r in rows)
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
    of = {}
    for i, _, s, c in rows:
        of.setdefault(i, []).append((s, c))
    for members in bins.values():
        members.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in members] == [sum(x.n_tokens for x in members[:k]) for k in range(len(members))]
        assert sum(r.n_tokens for r in members) <= 100
        known = [of[r.doc_id][0] for r in members if len(of[r.doc_id]) == 1]
        for side in (0, 1):
            values = [k[side] for k in known if k[side] is not None]
            assert len(values) == len(set(values))
    assert all(r.start == r.piece * 100 for r in got)


def test_a_hot_id_is_dealt_out(spark, monkeypatch):
    """A third of all rows have one doc_id, or none: no group grows with them."""
    monkeypatch.setattr(packing, "HOT_ROWS", 20)
    rows = [(7, 5, f"s{i}", None) for i in range(300)] + [(None, 5, None, None)] * 300 + [(100 + i, 5, None, None) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens long, source string, cluster string")
    got = packing.pack(docs, capacity=100, group=50).collect()
    assert len(got) == 900
    groups = {}
    for r in got:
        name = r.bin_id.split("-")[1]
        groups[name] = groups.get(name, 0) + 1
    assert max(groups.values()) < 110
    assert len({r.bin_id for r in got}) < 900 * 5 / 100 + 18 * 2


def test_lengths_in_tokens(spark, words):
    docs = odd(spark, [(i, t) for i, t in enumerate(TEXTS)])
    got = {r.doc_id: r.n_tokens for r in packing.with_lengths(docs, WORDS).collect()}
    assert got == {i: len(words.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}


def test_packing_cases(spark):
    docs = odd(spark, [(0, None), (1, ""), (2, "A b"), (3, "a  B"), (4, "w " * 5000)])
    lengths = {r.doc_id: r for r in packing.with_lengths(docs).collect()}
    assert [lengths[i].n_tokens for i in range(5)] == [0, 0, 2, 2, 5000]
    assert lengths[2].cluster == lengths[3].cluster
    assert lengths[0].cluster is None
    rows = packing.pack(packing.with_lengths(docs)).collect()
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in rows) == [(2, 0, 2), (3, 0, 2), (4, 0, 2048), (4, 1, 2048), (4, 2, 904)]
    assert packing.pack(packing.with_lengths(docs.limit(0))).count() == 0
    tokens = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), r"\s+").alias("words"))
    whole = packing.assemble(tokens, packing.pack(packing.with_lengths(docs)))
    assert sum(len(r.tokens) for r in whole.collect()) == 5004


def test_packing_query_holds_every_word(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = {}
    for r in packing.op2_packing(spark, SF).collect():
        held.setdefault(r.doc_id, []).append((r.start, r.n_tokens))
    for i, t in texts.items():
        n = len(t.encode().split())
        assert sum(k for _, k in held.get(i, [])) == n
        assert all(b[0] == a[0] + a[1] for a, b in zip(sorted(held.get(i, [])), sorted(held.get(i, []))[1:], strict=False))


def test_near_copies_of_different_sources_share_no_bin(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(0, text, "a"), (1, text + " tail", "b"), (2, "Head " + text, "c"), (3, " ".join(f"other{i}" for i in range(60)), "d"), (None, text + " end", "e"), (5, "one two three four five six", "f"), (5, text + " last", "g")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op2_packing(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    lengths = {61, 60}
    near = [r.bin_id for r in got if r.n_tokens in lengths and r.doc_id != 3]
    assert len(near) == 5
    assert len(set(near)) == 5
    assert len({r.bin_id for r in got}) == 5  # what is no near copy is packed with the others
