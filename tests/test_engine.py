import io
import json
import random

import duckdb
import pytest
from helpers import edges, nodes
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import graphdelta.__main__ as cli
from graphdelta.engine import Engine, gate_comment
from graphdelta.operators import diff, replay, reports, tree
from graphdelta.plans.config import Config
from graphdelta.plans.schema import as_edges, as_nodes
from graphdelta.queries import QUERIES
from graphdelta.queries_sql import SQL
from graphdelta.sources import files
from graphdelta.streaming.walk import walk as stream_walk

# ---- reports -----------------------------------------------------------------------------------------------------------------


def changes(spark):
    base = [{"id": "crate::a::gone", "kind": "Fn"}, {"id": "crate::m", "kind": "Module"}]
    head = [{"id": "crate::a::f", "kind": "Fn"}, {"id": "crate::a", "kind": "Module"}]
    return diff.diff((nodes(spark, base), edges(spark, [])), (nodes(spark, head), edges(spark, [("crate::a", "crate::m")])), None)


def test_changelog_and_drift(spark):
    got = reports.changelog_text(reports.changelog(changes(spark)).collect(), "main")
    assert got == "# Structure changelog vs main\n\n## crate::a (added)\n\n### Added\n- fn `f`\n\n### Removed\n- fn `gone`\n\n## crate::m (removed)\n\n## Dependencies\n- + `crate::a` -> `crate::m` (uses)\n"
    assert reports.changelog_text([], "main") == "# Structure changelog vs main\n\nNo structural changes.\n"
    row = reports.drift(changes(spark)).first()
    assert reports.drift_text(row).endswith("Total: 5 structural change(s) (4 node, 1 edge).\n")
    assert [r.line for r in reports.change_list(changes(spark)).orderBy("pos").collect()] == ["+ module crate::a", "+ fn crate::a::f", "- fn crate::a::gone", "- module crate::m", "+ edge crate::a -> crate::m (uses)"]


def test_fences(spark):
    text = "x\n```mermaid\n\nsequenceDiagram  \n  a ->> b : c   \n```\n```mermaid\nflowchart LR\n```\n```mermaid\nsequenceDiagram\n  open"
    got = [r.block for r in reports.fenced_sequences(spark.createDataFrame([("p", text)], "pair_id string, text string")).orderBy("pos").collect()]
    assert [b.strip("\n") for b in got] == ["sequenceDiagram\n  a ->> b : c", "sequenceDiagram\n  open"]


def test_findings_hash(spark):
    empty = spark.createDataFrame([], "pair_id string, rule string, severity string, message string")
    assert replay.findings_hash(empty).count() == 0
    assert f"{replay.fnv1a(b''):016x}" == "cbf29ce484222325"
    one = spark.createDataFrame([("p", "b", "deny", "m"), ("p", "a", "warn", "n")], empty.schema)
    assert replay.findings_hash(one).first().hash == f"{replay.fnv1a(b'a' + bytes([31]) + b'warn' + bytes([31]) + b'n' + b'\n' + b'b' + bytes([31]) + b'deny' + bytes([31]) + b'm' + b'\n'):016x}"


def test_refactor_pairs(spark):
    pairs = spark.createDataFrame([("r", 1, "a", "Move x"), ("r", 2, "b", "fix"), ("r", 3, "c", "other"), ("r", 4, "d", "RENAME")], "repo string, pos long, commit string, subject string")
    renames = spark.createDataFrame([("c", "a.rs", "b.rs"), ("b", "a.txt", "b.txt")], "commit string, old_path string, new_path string")
    assert [r.commit for r in replay.refactor_pairs(pairs, renames, 2).orderBy("pos").collect()] == ["a", "c"]


# ---- trees -------------------------------------------------------------------------------------------------------------------


def flat(labels):
    return [(0, None, 0, "root"), *((i + 1, 0, i, x) for i, x in enumerate(labels))]


def cost(a, b):
    return tree.edit_script(tree.postorder(a), tree.postorder(b))


def test_tree_scripts():
    nest = [(0, None, 0, "r"), (1, 0, 0, "a"), (2, 1, 0, "b")]
    assert cost(nest, nest)[0] == 0
    assert cost(nest, nest[:2])[0] == 1
    assert cost(nest[:2], nest)[0] == 1
    assert cost(nest, [*nest[:2], (2, 1, 0, "c")]) == (1, [("relabel", "b", "c"), ("match", "a", None), ("match", "r", None)])
    n, ops = cost(flat("ab"), flat("ba"))
    moved = tree.with_moves(ops)
    assert n == 2
    assert sum(o[0] == "moved" for o in moved) == 1
    assert not any(o[0] in ("insert", "delete") for o in moved)
    assert cost([], flat("ab"))[0] == 3


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=60, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_flat_trees_are_sequences(a, b):
    n, ops = cost(flat(a), flat(b))
    assert n == levenshtein(a, b)
    assert sum(o[0] != "match" for o in ops) == n
    assert n == cost(flat(b), flat(a))[0]


# ---- engine ------------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    rows = [("v1", "crate::a"), ("v1", "crate::b"), ("v2", "crate::a"), ("v2", "crate::b"), ("v2", "crate::c"), ("v3", "crate::a")]
    n = as_nodes(spark.createDataFrame(rows, "graph_id string, id string").withColumn("kind", F.lit("Module")).withColumn("file", F.concat(F.lit("src/"), F.substring_index("id", "::", -1), F.lit(".rs"))))
    e = as_edges(spark.createDataFrame([("v1", "crate::a", "crate::b"), ("v2", "crate::a", "crate::b"), ("v2", "crate::b", "crate::a")], "graph_id string, `from` string, `to` string").withColumn("kind", F.lit("Uses")))
    files.write_graph(n, e, path)
    return path


def test_engine(spark, store, tmp_path):
    engine = Engine(spark, *files.read_graph(spark, store))
    seen = engine.diff("v1", "v2", Config(deny=["cycles"], enabled=["modules"]))
    assert [(r.rule, r.message) for r in seen.findings.collect()] == [("cycles", "module cycle: crate::a -> crate::b")]
    assert seen.verdicts().first().exit_code == 1
    assert "-->|+|" in seen.diagram("modules").first().text
    for fmt in ("dot", "ascii", "boxes", "svg"):
        assert seen.diagram("modules", fmt).first().text
        assert "not supported" in seen.diagram("calls", fmt).first().text
    assert "denied" in gate_comment(seen, "v1")
    assert "too long" in gate_comment(seen, "v1", most_bytes=100)
    log = spark.createDataFrame([("r", i, v) for i, v in enumerate(("v1", "v2", "v3"))], "repo string, pos long, sha string")
    walked = {r.pair_id: r.total for r in engine.walk(log).drift().collect()}
    assert walked == {"v2": 2, "v3": 4}
    assert "## Modules" in engine.doc("v2", ("modules",))
    assert engine.init("v2").startswith("[views]")
    seen.register()
    assert spark.sql("SELECT count(*) FROM changes WHERE change = 'EdgeAdded'").first()[0] == 1
    files.write_snapshot(*files.read_graph(spark, store, ["v2"]), str(tmp_path / "snap"))
    n, e = files.read_snapshot(spark, str(tmp_path / "snap"))
    assert (n.count(), e.count()) == (3, 2)
    wanted = spark.createDataFrame([("v1",), ("v9",)], "graph_id string")
    assert [r.graph_id for r in files.missing(spark, store, wanted).collect()] == ["v9"]


def test_command_line(spark, store, tmp_path):
    def call(*argv):
        out = io.StringIO()
        return cli.run(spark, cli.arguments([*argv]), out), out.getvalue()

    config = tmp_path / "rules.toml"
    config.write_text('[lint]\ndeny = ["cycles"]\n')
    code, out = call("diff", "--store", store, "--base", "v1", "--head", "v2", "--config", str(config), "--list")
    assert code == 1
    assert "+ module crate::c" in out
    assert out.endswith("2 change(s) vs v1, 1 denial(s), 0 warning(s)\n")
    assert call("diff", "--store", store, "--base", "v1", "--head", "v2")[0] == 0
    # a snapshot stands in for a version of the store
    old = str(tmp_path / "v1.json")
    assert call("snapshot", "--store", store, "--head", "v1", "--out", old) == (0, "")
    assert call("snapshot", "--store", store, "--head", "v1")[1] == (tmp_path / "v1.json").read_text()
    same = call("diff", "--store", store, "--baseline", old, "--head", "v2", "--config", str(config), "--list", "--quiet")
    quiet = call("diff", "--store", store, "--base", "v1", "--head", "v2", "--config", str(config), "--list", "--quiet")
    assert same[0] == quiet[0] == code
    assert same[1].replace(old, "v1") == quiet[1]
    assert set(quiet[1].splitlines()) < set(out.splitlines())
    assert call("diff", "--store", store, "--base", "v1", "--head", "v2", "--config", str(config), "--list", "--show") == (code, out)
    # traces
    block = lambda who: f"```mermaid\nsequenceDiagram\n  {who}->>b: x\n```\n"
    (tmp_path / "old.txt").write_text("out\n" + block("a") + block("c"))
    (tmp_path / "new.txt").write_text(block("c") + "more\n" + block("d"))
    got = call("trace", "--base", str(tmp_path / "old.txt"), "--head", str(tmp_path / "new.txt"))
    assert got == (0, f"trace: 2 base trace(s), 2 head trace(s), 1 added, 1 removed vs {tmp_path / 'old.txt'}\n\n+ added trace:\nsequenceDiagram\n  d->>b: x\n\n- removed trace:\nsequenceDiagram\n  a->>b: x\n")
    assert "Total: 2" in call("drift", "--store", store, "--base", "v1", "--head", "v2")[1]
    assert "## Dependencies" in call("changelog", "--store", store, "--base", "v1", "--head", "v2")[1]
    assert "`src/a.rs`" in call("files", "--store", store, "--head", "v2")[1]
    log = tmp_path / "log.tsv"
    log.write_text("v1\tfirst\nv2\tsecond\nv3\tthird\n")
    assert [(r.pos, r.sha) for r in files.read_log(spark, str(log)).orderBy("pos").collect()] == [(0, "v1"), (1, "v2"), (2, "v3")]
    out = call("walk", "--store", store, "--log", str(log))[1]
    assert out.index("=== v2 second ===") < out.index("=== v3 third ===")
    source = tmp_path / "code" / "src"
    source.mkdir(parents=True)
    (source / "lib.rs").write_text("mod a; pub struct S;")
    (source / "a.rs").write_text("use crate::S;")
    new = str(tmp_path / "new")
    assert call("extract", str(tmp_path / "code"), "--store", new, "--id", "x")[0] == 0
    assert {r.id for r in files.read_graph(spark, new)[0].collect()} == {"crate", "crate::a", "crate::S"}
    renames = tmp_path / "renames.tsv"
    renames.write_text("R090\told.rs\tnew.rs\nM\tx.rs\nA\ty.rs\n")
    assert [tuple(r) for r in files.read_renames(spark, str(renames)).collect()] == [("p", "old.rs", "new.rs")]
    assert cli.main(["diff", "--store", store, "--base", "v1", "--head", "v2", "--config", str(tmp_path / "log.tsv")]) == 2


def test_streaming_walk_is_the_batch_walk(spark, tmp_path):
    schema = "repo string, pos long, `table` string, id string, kind string, file string, start long, `end` long, attrs array<struct<k:string,v:string>>, fp struct<members:array<string>,field_types:array<struct<t:string,n:int>>,member_types:array<struct<m:string,t:string>>,neighbors:array<string>,doc_hash:string>, `from` string, `to` string, ordinal int, seq long"
    versions = [["a"], ["a", "b"], ["b", "c"], ["c"]]
    for k, ids in enumerate(versions):
        rows = [("r", k, "node", x, "Module", "f", 0, 0, [], None, None, None, None, 0) for x in ids] + [("r", k, "edge", None, "Uses", "f", 0, 0, None, None, ids[0], ids[-1], None, 0)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(spark.createDataFrame(rows, schema).schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
        stream_walk(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = sorted((r.pos, r.added, r.removed, r.edges_added, r.edges_removed) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, 1, 0, 1, 1), (2, 1, 1, 1, 1), (3, 0, 1, 1, 1)]


# ---- queries against DuckDB ----------------------------------------------------------------------------------------------------

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    frame = QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in SQL:
        assert got
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert json.loads(json.dumps(got, default=str)) == json.loads(json.dumps(want, default=str))


def test_results_don_t_depend_on_partitions(spark):
    random.seed(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append({name: sorted(map(repr, QUERIES[name](spark, SF).collect())) for name in ("q_changelog", "q_cycles", "q_rename_matches")})
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
