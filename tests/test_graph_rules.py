import random

from helpers import edges, nodes
from pyspark.sql import functions as F

from graphdelta.operators import diff, graphops, lint, resolve, select
from graphdelta.plans.config import Config


def version(spark, head, base_edges, head_edges, base=None, **config):
    sides = (nodes(spark, base if base is not None else head), edges(spark, base_edges)), (nodes(spark, head), edges(spark, head_edges))
    return lint.Version(*sides[1], diff.diff(*sides, None), Config(**config).check())


def messages(findings):
    return sorted((r.rule, r.severity, r.message) for r in findings.collect())


LAYERS = {"order": ["app", "infra"], "layers": [("src/app/*", "app"), ("src/infra/*", "infra")], "forbid": [("app", "infra")], "deny": ["layering"]}
MODULES = [{"id": "crate::a", "file": "src/app/a.rs"}, {"id": "crate::b", "file": "src/infra/b.rs"}]


def test_layering(spark):
    new = version(spark, MODULES, [], [("crate::a", "crate::b")], **LAYERS)
    assert messages(lint.lint(new)) == [("layering", "deny", "crate::a (app) must not depend on crate::b (infra)")]
    old = version(spark, MODULES, [("crate::a", "crate::b")], [("crate::a", "crate::b")], **LAYERS)
    assert messages(lint.lint(old)) == []
    every = version(spark, MODULES, [("crate::a", "crate::b")], [("crate::a", "crate::b")], new_only=False, **LAYERS)
    assert len(messages(lint.lint(every))) == 1
    row = lint.verdicts(every.nodes.select("pair_id").distinct(), lint.lint(every)).first()
    assert (row.denied, row.exit_code, row.denials, row.warnings) == (True, 1, 1, 0)


def test_unused_layer_is_a_warning(spark):
    v = version(spark, MODULES[:1], [], [], **LAYERS)
    assert messages(lint.lint(v)) == [("config_sanity", "warn", 'layer "infra" is declared but matches no module; check its glob')]
    assert messages(lint.lint(version(spark, MODULES, [], []))) == []


def test_cycles(spark):
    ids = [{"id": f"crate::{x}"} for x in "abc"] + [{"id": "crate"}]
    ring = [("crate::a", "crate::b"), ("crate::b", "crate::a")]
    found = lambda **k: messages(lint.lint(version(spark, ids, **k, warn=["cycles"])))
    assert found(base_edges=ring[:1], head_edges=ring) == [("cycles", "warn", "module cycle: crate::a -> crate::b")]
    assert found(base_edges=ring, head_edges=ring) == []
    assert found(base_edges=ring, head_edges=ring, new_only=False) == [("cycles", "warn", "module cycle: crate::a -> crate::b")]
    assert found(base_edges=[], head_edges=[("crate", "crate::a"), ("crate::a", "crate")]) == []  # containment
    assert found(base_edges=[], head_edges=[("crate::a", "crate::a")]) == [("cycles", "warn", "module cycle: crate::a")]


STATES = [{"id": f"S::{x}", "kind": "Variant"} for x in "abc"]


def test_states(spark):
    t = lambda *pairs: [(f"S::{a}", f"S::{b}", "Transitions") for a, b in pairs]
    rules = {"warn": ["unreachable_state", "terminal_state_without_exit"], "deny": ["new_state_cycle"]}
    got = messages(lint.lint(version(spark, STATES, t(("a", "c")), t(("a", "b")), **rules)))
    assert got == [("terminal_state_without_exit", "warn", "terminal state without exit: S::b"), ("unreachable_state", "warn", "unreachable state: S::c")]
    assert messages(lint.lint(version(spark, STATES, t(("a", "b")), t(("a", "b")), **rules))) == []
    every = messages(lint.lint(version(spark, STATES, t(("a", "b")), t(("a", "b")), new_only=False, **rules)))
    assert [m[2] for m in every] == ["terminal state without exit: S::b", "unreachable state: S::c"]
    assert ("new_state_cycle", "deny", "state cycle: S::a -> S::b") in messages(lint.lint(version(spark, STATES, t(("a", "b")), t(("a", "b"), ("b", "a")), **rules)))


def test_io_in_hot_path(spark):
    fns = [{"id": x, "kind": "Fn"} for x in ("hot::f", "cold::f", "io::File::read")]
    calls = [("hot::f", "io::File::read", "Calls", 0), ("hot::f", "io::File::read", "Calls", 1), ("cold::f", "io::File::read", "Calls", 0)]
    got = messages(lint.lint(version(spark, fns, [], calls, warn=["io_in_hot_path"], hot=["hot::*"], io=["io::*"])))
    assert got == [("io_in_hot_path", "warn", "hot::f (hot) calls into io::File (io)")] * 2
    assert messages(lint.lint(version(spark, fns, calls, calls, warn=["io_in_hot_path"], hot=["hot::*"], io=["io::*"]))) == []


def test_destructive_migration(spark):
    table = lambda id_, columns: {"id": id_, "kind": "Table", "attrs": {"columns": columns}}
    v = version(spark, [table("t", "a: Int8, c: Text")], [("t", "u", "ForeignKey")], [], base=[table("t", "a: Int4, b: Text, c: Text"), table("u", "x: Int4")], deny=["destructive_migration"])
    assert [m[2] for m in messages(lint.lint(v))] == ["column `t.a` type changed `Int4` -> `Int8`", "column `t.b` dropped", "foreign key `t -> u` removed", "table `u` dropped"]
    grown = version(spark, [table("t", "a: Int4, b: Text")], [], [], base=[table("t", "a: Int4")], deny=["destructive_migration"])
    assert messages(lint.lint(grown)) == []


def brute_components(pairs):
    reach = {}
    ids = {x for p in pairs for x in p}
    for v in ids:
        seen, todo = set(), [v]
        while todo:
            w = todo.pop()
            for a, b in pairs:
                if a == w and b not in seen:
                    seen.add(b)
                    todo.append(b)
        reach[v] = seen
    return {v: min([w for w in reach[v] if v in reach[w]] + [v]) for v in ids}


def test_components_both_ways(spark):
    rng = random.Random(5)
    pairs = [(f"v{rng.randrange(14):02}", f"v{rng.randrange(14):02}") for _ in range(24)]
    table = edges(spark, pairs)
    want = brute_components(pairs)
    assert {r.id: r.component for r in graphops.strong_components(table).collect()} == want
    assert {r.id: r.component for r in graphops.colour_components(table).collect()} == want
    assert {r.id: r.component for r in graphops.strong_components(table, group_edges=3).collect()} == want


def test_hops_and_slice(spark):
    table = edges(spark, [("a", "b"), ("c", "b"), ("c", "d"), ("e", "d")])
    seeds = spark.createDataFrame([("p", "a")], "pair_id string, id string")
    assert sorted(r.id for r in graphops.k_hops(seeds, table, 2).collect()) == ["a", "b", "c"]
    calls = edges(spark, [("m", "x", "Calls", 1), ("m", "y", "Calls", 0), ("y", "m", "Calls", 0), ("y", "z", "Calls", 1)])
    rows = graphops.call_slice(calls, graphops.default_entries(calls, ("pair_id",)), keys=("pair_id",)).collect()
    assert [(r.caller, r.callee) for r in sorted(rows, key=lambda r: r.path)] == [("m", "y"), ("y", "m"), ("y", "z"), ("m", "x")]
    assert len(graphops.call_slice(calls, graphops.default_entries(calls, ("pair_id",)), depth=1, keys=("pair_id",)).collect()) == 2


def test_selection(spark):
    head = [{"id": f"crate::{x}", "file": f"src/{x}.rs"} for x in "abcde"]
    chain = [(f"crate::{x}", f"crate::{y}") for x, y in zip("abcd", "bcde", strict=True)]
    sides = (nodes(spark, head), edges(spark, chain[1:])), (nodes(spark, head), edges(spark, chain))
    changes = diff.diff(*sides, None)
    ids, ways = select.select_view("modules", *sides[1], changes)
    assert sorted(r.id for r in ids.collect()) == [f"crate::{x}" for x in "abcd"]
    assert sorted((r["from"], r["class"]) for r in ways.collect()) == [("crate::a", "added"), ("crate::b", "context"), ("crate::c", "context")]
    assert select.select_view("modules", *sides[1], changes, full=True)[0].count() == 5
    ids, _ = select.select_view("modules", *sides[1], changes, scope=["src/b.rs"])
    assert sorted((r.id, r.stub) for r in ids.collect()) == [("crate::a", True), ("crate::b", False), ("crate::c", True)]


def test_ordinals_are_dense_over_what_resolves(spark):
    calls = spark.createDataFrame([("g", "f", "a", 0), ("g", "f", "x", 1), ("g", "f", None, 2), ("g", "f", "a", 3)], "graph_id string, caller string, callee string, seq long")
    found, lost = resolve.call_edges(calls, spark.createDataFrame([("g", "a")], "graph_id string, id string"))
    assert sorted((r["to"], r.ordinal) for r in found.collect()) == [("a", 0), ("a", 1)]
    assert [(r.id, r.n) for r in lost.collect()] == [("f", 2)]


def test_chase_stops(spark):
    exports = spark.createDataFrame([("g", f"n{i}", f"n{i + 1}") for i in range(30)] + [("g", "s", "s")], "graph_id string, name string, target string")
    paths = spark.createDataFrame([("g", "n0"), ("g", "n20"), ("g", "s"), ("g", "z")], "graph_id string, path string")
    assert {r.path: r.resolved for r in resolve.chase(paths, exports).collect()} == {"n0": "n16", "n20": "n30", "s": "s", "z": "z"}


def test_tiers(spark):
    crates = spark.createDataFrame([("g", x) for x in ("app", "core", "util")], "graph_id string, id string")
    deps = spark.createDataFrame([("g", "app", "util"), ("g", "util", "core"), ("g", "app", "core")], "graph_id string, `from` string, `to` string")
    assert {r.id: r.tier for r in graphops.crate_tiers(crates, deps).collect()} == {"app": 2, "util": 1, "core": 0}
    ring = spark.createDataFrame([("g", "app", "util"), ("g", "util", "app")], "graph_id string, `from` string, `to` string")
    assert {r.id: r.tier for r in graphops.crate_tiers(crates, ring).collect()} == {"app": 0, "util": 0, "core": 0}
    below = ring.unionByName(spark.createDataFrame([("g", "util", "core")], ring.schema))
    assert {r.id: r.tier for r in graphops.crate_tiers(crates, below).collect()} == {"app": 1, "util": 1, "core": 0}
    chain = spark.createDataFrame([("g", f"c{i:03}", f"c{i + 1:03}") for i in range(70)], ring.schema)
    assert graphops.crate_tiers(chain.select("graph_id", F.col("from").alias("id")), chain).where("id = 'c000'").first().tier == 70
