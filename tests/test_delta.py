from itertools import product

from helpers import edges, fp, nodes
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphdelta.functions.similarity import Weights, doc_hash, jaccard, multiset_jaccard, similarity
from graphdelta.operators import diff, match, reports
from graphdelta.operators.ranks import numbered


def delta(spark, base, head, base_edges=(), head_edges=(), threshold=None, renames=None):
    return diff.diff((nodes(spark, base), edges(spark, base_edges)), (nodes(spark, head), edges(spark, head_edges)), threshold, renames)


def kinds(changes):
    return sorted((r.change, r.before_id, r.after_id, r.from_id, r.to_id) for r in changes.collect())


def test_node_changes(spark):
    base = [{"id": "a"}, {"id": "b", "attrs": {"k": "1"}}, {"id": "c", "kind": "Struct"}, {"id": "same", "start": 1}, {"id": "gone"}]
    head = [{"id": "b", "attrs": {"k": "2"}}, {"id": "c", "kind": "Enum"}, {"id": "same", "start": 9}, {"id": "a"}, {"id": "new"}]
    got = {(r.change, r.id) for r in delta(spark, base, head).collect()}
    assert got == {("Modified", "b"), ("Modified", "c"), ("Removed", "gone"), ("Added", "new")}


def test_empty_sides(spark):
    assert {r.change for r in delta(spark, [], [{"id": "a"}], threshold=0.7).collect()} == {"Added"}
    assert {r.change for r in delta(spark, [{"id": "a"}], [], threshold=0.7).collect()} == {"Removed"}
    assert delta(spark, [], [], threshold=0.7).count() == 0


def test_last_of_a_repeated_id_counts(spark):
    base = [{"id": "a", "kind": "Struct", "seq": 1}, {"id": "a", "kind": "Enum", "seq": 2}]
    assert delta(spark, base, [{"id": "a", "kind": "Enum"}]).count() == 0


def test_edges_are_sets_with_null_safe_ordinals(spark):
    got = delta(spark, [], [], [("a", "b", "Calls", None), ("a", "b", "Calls", 0), ("c", "d"), ("x", "y"), ("x", "y")], [("a", "b", "Calls", None), ("c", "d"), ("e", "f"), ("a", "b", "Calls", 1)])
    assert sorted((r.change, r.from_id, r.to_id, r.ordinal) for r in got.collect()) == [("EdgeAdded", "a", "b", 1), ("EdgeAdded", "e", "f", None), ("EdgeRemoved", "a", "b", 0), ("EdgeRemoved", "x", "y", None)]


def test_order(spark):
    got = diff.in_order(delta(spark, [{"id": "m", "attrs": {"k": "1"}}, {"id": "r"}], [{"id": "m"}, {"id": "z"}, {"id": "b"}], [("c", "d")], [("a", "b")]))
    assert [(r.change, r.id or r.from_id) for r in got.orderBy("pos").collect()] == [("Added", "b"), ("Added", "z"), ("Removed", "r"), ("Modified", "m"), ("EdgeAdded", "a"), ("EdgeRemoved", "c")]


S = {"kind": "Struct"}
ONE, TWO = fp(["id", "total"], [("u64", 1), ("Money", 1)]), fp(["x", "y"], [("f32", 2)])


def test_rename_and_move(spark):
    base = [{"id": "m::Old", "fp": ONE, **S}, {"id": "billing::Order", "fp": TWO, **S}]
    head = [{"id": "m::New", "fp": ONE, **S}, {"id": "payments::Order", "fp": TWO, **S}]
    assert kinds(delta(spark, base, head, threshold=0.7)) == [("Modified", "m::Old", "m::New", None, None), ("Moved", "billing::Order", "payments::Order", "billing", "payments")]
    assert {r.change for r in delta(spark, base, head).collect()} == {"Added", "Removed"}


def test_guards(spark):
    far = delta(spark, [{"id": "m::A", "fp": ONE, **S}], [{"id": "m::B", "fp": TWO, **S}], threshold=0.7)
    assert {r.change for r in far.collect()} == {"Added", "Removed"}
    other = delta(spark, [{"id": "m::A", "fp": ONE, **S}], [{"id": "m::B", "fp": ONE, "kind": "Enum"}], threshold=0.7)
    assert {r.change for r in other.collect()} == {"Added", "Removed"}


def test_score_of_exactly_the_threshold_counts(spark):
    # members 1/2, types 1, documentation equal: 0.2 + 0.4 + 0.1 + 0.1 = 0.8; types 3/4: 0.7
    a, b = fp(["a", "b"], [("t", 3)]), fp(["a"], [("t", 4)])
    got = delta(spark, [{"id": "m::A", "fp": a, **S}], [{"id": "m::B", "fp": b, **S}], threshold=0.7)
    assert [r.change for r in got.collect()] == ["Modified"]


def test_module_moves_by_file(spark):
    renames = spark.createDataFrame([("p", "old.rs", "new.rs"), ("p", "two.rs", "three.rs"), ("p", "x.rs", "y.rs")], "pair_id string, old_path string, new_path string")
    base = [{"id": "crate::a", "file": "old.rs"}, {"id": "crate::t", "file": "two.rs"}, {"id": "crate::u", "file": "two.rs"}, {"id": "crate::x", "file": "x.rs"}]
    head = [{"id": "crate::b", "file": "new.rs"}, {"id": "crate::v", "file": "three.rs"}, {"id": "crate::q::x", "file": "y.rs"}]
    got = kinds(delta(spark, base, head, renames=renames))
    assert ("Modified", "crate::a", "crate::b", None, None) in got
    assert ("Moved", "crate::x", "crate::q::x", "crate", "crate::q") in got
    assert sum(x[0] in ("Removed", "Added") for x in got) == 3  # an ambiguous file stays as it is


def test_member_delta(spark):
    a = fp(["a", "b", "c"], (), [("a", "u8"), ("b", "u8"), ("c", "u8")])
    b = fp(["a", "c", "d"], (), [("a", "u16"), ("c", "u8"), ("d", "u8")])
    row = diff.member_delta(delta(spark, [{"id": "m::A", "fp": a, **S}], [{"id": "m::A", "fp": b, **S}])).first()
    assert (row.added, row.removed, row.changed) == (["d"], ["b"], ["a"])
    assert reports.change_list(delta(spark, [{"id": "m::A", "fp": a, **S}], [{"id": "m::A", "fp": b, **S}])).first().line == "~ struct m::A (+d ~a -b)"


def test_scores(spark):
    rows = spark.createDataFrame([(ONE, ONE), (ONE, TWO), (fp(), fp())], "a struct<members:array<string>,field_types:array<struct<t:string,n:int>>,member_types:array<struct<m:string,t:string>>,neighbors:array<string>,doc_hash:string>, b struct<members:array<string>,field_types:array<struct<t:string,n:int>>,member_types:array<struct<m:string,t:string>>,neighbors:array<string>,doc_hash:string>")
    got = [r[0] for r in rows.select(similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 1.0
    assert abs(got[1] - 0.2) < 1e-12
    assert got[2] == 1.0
    assert rows.select(similarity(F.col("a"), F.col("b"), Weights(0, 0, 0, 0))).first()[0] == 0.0
    assert [r[0] for r in spark.createDataFrame([("",), ("  ",), (" a",), ("a",)], "d string").select(doc_hash(F.col("d"))).collect()][:2] == ["0", "0"]


def py_jaccard(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def py_multi(a, b):
    top = sum(max(a.get(k, 0), b.get(k, 0)) for k in {*a, *b})
    return 1.0 if not top else sum(min(a.get(k, 0), b.get(k, 0)) for k in {*a, *b}) / top


def py_score(x, y, w=(0.4, 0.4, 0.1, 0.1)):
    m = py_jaccard(set(x["members"]), set(y["members"]))
    t = py_multi({e["t"]: e["n"] for e in x["field_types"]}, {e["t"]: e["n"] for e in y["field_types"]})
    n = py_jaccard(set(x["neighbors"]), set(y["neighbors"]))
    return (m * w[0] + t * w[1] + n * w[2] + (1.0 if x["doc_hash"] == y["doc_hash"] else 0.0) * w[3]) / sum(w)


def py_greedy(cands):
    used_r, used_a, out = set(), set(), []
    for score, r, a in sorted(cands, key=lambda x: (-x[0], x[1], x[2])):
        if r not in used_r and a not in used_a:
            used_r.add(r)
            used_a.add(a)
            out.append((r, a))
    return sorted(out)


prints = st.builds(lambda m, t, d: fp(m, t.items(), (), str(d)), st.sets(st.sampled_from("abcdef"), max_size=4), st.dictionaries(st.sampled_from("xyz"), st.integers(1, 3), max_size=3), st.integers(0, 1))


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(prints, max_size=12), st.lists(prints, max_size=12), st.sampled_from([0.5, 0.6, 0.7, 0.9]))
def test_blocking_loses_nothing_and_rounds_are_greedy(spark, old, new, threshold):
    base = [{"id": f"r{i:02}", "fp": x, **S} for i, x in enumerate(old)]
    head = [{"id": f"a{i:02}", "fp": x, **S} for i, x in enumerate(new)]
    removed, added = match.sides(diff.node_delta(nodes(spark, base), nodes(spark, head)))
    got = {(r.rid, r.aid) for r in match.candidates(removed, added, threshold).collect()}
    scored = [(py_score(x["fp"], y["fp"]), x["id"], y["id"]) for x, y in product(base, head)]
    assert got == {(r, a) for s, r, a in scored if s >= threshold}
    taken = sorted((r.rid, r.aid) for r in match.match(diff.node_delta(nodes(spark, base), nodes(spark, head)), threshold).collect())
    assert taken == py_greedy([x for x in scored if x[0] >= threshold])


named = st.builds(lambda x, n: {**x, "neighbors": sorted(n)}, prints, st.sets(st.sampled_from("pqr"), max_size=2))


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(named, max_size=12), st.lists(named, max_size=12), st.sampled_from([0.4, 0.7, 0.9]), st.sampled_from([(0.4, 0.4, 0.1, 0.1), (3, 1, 1, 0), (1, 0, 0, 1), (0, 2, 1, 0), (0, 0, 1, 1)]))
def test_blocking_loses_nothing_with_any_weights(spark, old, new, threshold, w):
    base = [{"id": f"r{i:02}", "fp": x, **S} for i, x in enumerate(old)]
    head = [{"id": f"a{i:02}", "fp": x, **S} for i, x in enumerate(new)]
    removed, added = match.sides(diff.node_delta(nodes(spark, base), nodes(spark, head)))
    got = {(r.rid, r.aid) for r in match.candidates(removed, added, threshold, Weights(*map(float, w))).collect()}
    scored = {(x["id"], y["id"]): py_score(x["fp"], y["fp"], w) for x, y in product(base, head)}
    assert {k for k, s in scored.items() if s >= threshold + 1e-9} <= got <= {k for k, s in scored.items() if s >= threshold - 1e-9}


def test_a_class_of_many_equal_nodes(spark):
    """Boilerplate: ranks within one hot class, over several ranges."""
    base = [{"id": f"r{i:03}", "fp": ONE, **S} for i in range(70)]
    head = [{"id": f"a{i:03}", "fp": ONE, **S} for i in range(50)]
    got = match.match(diff.node_delta(nodes(spark, base), nodes(spark, head)), 0.7)
    assert sorted((r.rid, r.aid) for r in got.collect()) == [(f"r{i:03}", f"a{i:03}") for i in range(50)]


def test_numbers_within_a_hot_key(spark):
    rows = [("p", i % 7, i) for i in range(500)] + [(None, 1, 1), (None, 0, 2), ("q", None, 3)]
    got = numbered(spark.createDataFrame(rows, "k string, a int, b int"), ["k"], ["a", F.col("b")], "n").collect()
    for key in ("p", "q", None):
        own = sorted((r for r in got if r.k == key), key=lambda r: r.n)
        assert [r.n for r in own] == list(range(1, len(own) + 1))
        assert [(r.a, r.b) for r in own] == sorted(((a, b) for k, a, b in rows if k == key), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_long_chains_of_ties(spark):
    rows = [("p", f"r{i:03}", f"a{j:03}", 0.9) for i in range(14) for j in range(14)]
    got = match.greedy(spark.createDataFrame(rows, "pair_id string, rid string, aid string, score double"))
    assert sorted((r.rid, r.aid) for r in got.collect()) == [(f"r{i:03}", f"a{i:03}") for i in range(14)]


def test_set_measures_with_empty_sides(spark):
    row = spark.createDataFrame([([], [], ["a"], [])], "a array<string>, b array<string>, c array<string>, d array<string>").select(jaccard(F.col("a"), F.col("b")), jaccard(F.col("c"), F.col("d"))).first()
    assert list(row) == [1.0, 0.0]
    bag = "array<struct<t:string,n:int>>"
    row = spark.createDataFrame([([], [], [("a", 2), ("b", 1)], [("a", 1)])], f"a {bag}, b {bag}, c {bag}, d {bag}").select(multiset_jaccard(F.col("a"), F.col("b")), multiset_jaccard(F.col("c"), F.col("d"))).first()
    assert row[0] == 1.0
    assert abs(row[1] - 1 / 3) < 1e-12


def test_blocks_keep_order_and_repeats(spark):
    base = spark.createDataFrame([("p", 0, "x"), ("p", 1, "x"), ("p", 2, "y")], "pair_id string, pos long, block string")
    head = spark.createDataFrame([("p", 0, "y"), ("p", 1, "z")], "pair_id string, pos long, block string")
    assert sorted((r.side, r.pos, r.block) for r in diff.block_delta(base, head).collect()) == [("+", 1, "z"), ("-", 0, "x"), ("-", 1, "x")]


def test_rename_splits(spark):
    renames = spark.createDataFrame([("p", "old.rs", "new.rs"), ("p", "a.txt", "b.txt"), ("p", "k.rs", "l.rs")], "pair_id string, old_path string, new_path string")
    changes = delta(spark, [{"id": "crate::a", "file": "old.rs"}], [{"id": "crate::b", "file": "new.rs"}])
    assert [(r.pair_id, r.n) for r in diff.rename_splits(changes, renames).collect()] == [("p", 1)]
