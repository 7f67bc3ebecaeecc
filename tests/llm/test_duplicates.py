import math
import random

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tables import documents, odd, union

from graphdelta.llm import _common, components, minhash, range_join, tiles

SF = "/root/testdata/sf0.001"


def brute_links(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        words = (t or "").encode().lower().split()
        k = min(n, len(words))
        sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    ids = sorted(sets)
    return sets, [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def near_copies(seed, groups=6, size=14, words=80):
    rng = random.Random(seed)
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(9)):
                own[rng.randrange(words)] = f"e{rng.randrange(10_000)}"
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


def linked(frame):
    return {r.doc_id: r.component_id for r in frame.collect()}


def test_components_of_near_copies(spark):
    for n, percent in ((3, 85), (5, 80)):
        texts = dict(enumerate(near_copies(n)))
        sets, pairs = brute_links(texts, n, percent)
        rows = minhash.link(documents(spark, list(texts.values())).select("doc_id", "text"), n, percent).collect()
        assert {r.doc_id: r.component_id for r in rows} == union(pairs, texts)
        assert all(r.n_shingles == len(sets[r.doc_id]) for r in rows)


def test_crowded_buckets_lose_no_link(spark, monkeypatch):
    """One family of texts that share most of their words, in tiles of a few members."""
    monkeypatch.setattr(tiles, "TILE_MEMBERS", 7)
    monkeypatch.setattr(minhash, "SMALL", 2)
    texts = dict(enumerate(near_copies(11, groups=2, size=60, words=60)))
    _, pairs = brute_links(texts, 3, 85)
    assert linked(minhash.link(documents(spark, list(texts.values())).select("doc_id", "text"), 3, 85)) == union(pairs, texts)


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    sets, pairs = brute_links(texts, 3, 85)
    want = union(pairs, texts)
    for r in minhash.op5_minhash(spark, SF).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_copies_are_confirmed_on_whole_texts(spark, monkeypatch):
    """Two sets of equal fingerprints and different members (a made-up collision) are not linked."""
    docs = documents(spark, ["a b c d", "A b  c d", "x y z w", "p q"]).select("doc_id", "text")
    monkeypatch.setattr(minhash, "class_members", lambda firsts: firsts.where("doc_id IN (0, 1, 2)").select("doc_id", F.lit(0).cast("long").alias("rep")))
    assert linked(minhash.link(docs, 3, 85)) == {0: 0, 1: 0, 2: 2, 3: 3}


words_of = st.lists(st.text(alphabet=st.sampled_from(list("aBé \t\n\x0b\x0c\r\x1c\x1f\u3000.!")), max_size=25), max_size=6)


@settings(max_examples=200, deadline=None)
@given(words_of, st.sampled_from([1, 3, 5]))
def test_batches_of_texts_hash_like_each_of_them(texts, n):
    own = [t.encode() for t in texts]
    h, size = _common.hashed_words(own)
    assert size.tolist() == [len(t.split()) for t in own]
    assert (h == _common.word_hashes([w for t in own for w in t.split()])).all()
    for got, t in zip(minhash.shingle_sets(own, n), own, strict=True):
        assert np.array_equal(got, minhash.shingle_hashes(t, n))


def test_minhash_cases(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = odd(spark, [(5, None), (4, ""), (3, " \n"), (9, "A b"), (8, "a  B"), (7, "a b c"), (None, "a b c"), (6, "x y z"), (6, "x y z"), (2, long), (1, long + " end")])
    rows = minhash.link(docs.select("doc_id", "text"), 3, 85).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == 11
    assert got == {5: (0, 5), 4: (0, 4), 3: (0, 3), 9: (1, 8), 8: (1, 8), 7: (1, 7), None: (1, None), 6: (1, 6), 2: (29_998, 1), 1: (29_999, 1)}
    kept = minhash.drop_duplicates(docs, 3, 85)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.select("doc_id").collect()) == [(False, x) for x in (1, 3, 4, 5, 6, 7, 8)] + [(True, 0)]
    assert minhash.drop_duplicates(docs.limit(0)).count() == 0


def test_estimate_follows_similarity(spark):
    a, b = minhash._multipliers(124)
    rng = random.Random(3)
    for share in (0.5, 0.8, 0.95):
        x = np.array([rng.getrandbits(64) for _ in range(2000)], np.uint64)
        cut = int(2000 * 2 * share / (1 + share))
        y = np.concatenate([x[:cut], np.array([rng.getrandbits(64) for _ in range(2000 - cut)], np.uint64)])
        row = spark.createDataFrame([tuple(minhash.packed(np.stack([minhash.minima(x, a, b), minhash.minima(y, a, b)])).tolist())], "x array<long>, y array<long>")
        got = row.select(minhash.estimate(F.col("x"), F.col("y"), 124)).first()[0]
        assert abs(got - share) < 0.17


def test_common_counts():
    rng = random.Random(1)
    sets = [np.array(sorted(rng.sample(range(300), rng.randrange(1, 90))), np.uint64) for _ in range(30)]
    got = tiles.common_counts(sets[:12], sets[12:])
    assert all(got[i, j] == len({*sets[i].tolist()} & {*sets[12 + j].tolist()}) for i in range(12) for j in range(18))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=40))
def test_components(spark, pairs):
    ids = {x for p in pairs for x in p if p[0] != p[1]}
    frame = spark.createDataFrame([*pairs, (None, 3)], "a long, b long")
    got = {r.id: r.component for r in components.components(frame).collect()}
    assert got == union([p for p in pairs if p[0] != p[1]], ids)


# ---- embeddings ----------------------------------------------------------------------------------------------------------------


def brute_cosine(rows, least):
    able = [(i, np.array(v, np.float64)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    n, pairs = {i: 0 for i, _ in rows}, []
    for x in range(len(able)):
        for y in range(x + 1, len(able)):
            (i, a), (j, b) = able[x], able[y]
            if len(a) == len(b) and a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= least:
                n[i] += 1
                n[j] += 1
                pairs.append((i, j))
    return n, union(pairs, [i for i, _ in rows])


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("unit", F.lit(1)).withColumn("rep", F.lit(2))


def test_range_join_in_many_cells_and_tiles(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(14, 6))
    rows = [(i, (centres[rng.integers(14)] + rng.normal(size=6) * rng.choice([0.05, 0.35])).astype(np.float32).tolist()) for i in range(160)]
    n, want = brute_cosine(rows, 0.9)
    got = {r.vec_id: (r.n_links, r.component_id) for r in range_join.link(vectors(spark, rows), per_cell=12, tile=9).collect()}
    assert got == {i: (n[i], want[i]) for i, _ in rows}


def test_range_join_prunes_pairs_of_tiles(spark, tmp_path):
    """Where vectors have near pivots, most pairs of tiles are not dealt out, and none that holds a link is missing."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 24))
    x = centres[rng.integers(40, size=1200)] + 0.1 * rng.normal(size=(1200, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    reps = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "rep long, unit array<double>, copies long")
    found, _ = range_join.tiles_of(reps, x[:60], math.acos(0.9), 10, f"{tmp_path}/tiles")
    n, pairs = found.count(), range_join.pairs_of(found)
    assert pairs.count() < 0.15 * n * (n + 1) / 2
    home = (x @ x[:60].T).argmax(axis=1)
    cells = {frozenset((r.p, r.q)) for r in pairs.collect()}
    a, b = np.nonzero(x @ x.T >= 0.9)
    assert all(frozenset((int(home[i]), int(home[j]))) in cells for i, j in zip(a, b, strict=True))


def test_a_hub_and_a_hot_vector(spark, monkeypatch):
    """Hot keys go by the broadcast side of hub_join."""
    monkeypatch.setattr(_common, "HOT_ROWS", 5)
    rng = np.random.default_rng(5)
    rows = [(i, [1.0, 0.0, 0.1]) for i in range(40)] + [(i, rng.normal(size=3).tolist()) for i in range(40, 60)]
    n, want = brute_cosine(rows, 0.9)
    assert {r.vec_id: (r.n_links, r.component_id) for r in range_join.link(vectors(spark, rows)).collect()} == {i: (n[i], want[i]) for i, _ in rows}
    edges = [(0, i) for i in range(1, 60)] + [(100 + i, 101 + i) for i in range(20)] + [(59, 200), (200, 201)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == union(edges, {x for e in edges for x in e})


def test_range_join_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, None]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.0]), (12, [1e-30, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in range_join.link(vectors(spark, rows)).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 11: (3, 1), 12: (3, 1)} | {i: (0, i) for i in (3, 4, 5, 6, 7, 8, 9, 10)}
    assert range_join.link(vectors(spark, rows).limit(0)).count() == 0


def test_range_join_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    n, want = brute_cosine(rows, 0.9)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in range_join.op7_range_join(spark, SF).collect()} == {i: (n[i], want[i], want[i] == i) for i, _ in rows}
