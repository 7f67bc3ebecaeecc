"""One query per operator over the relational test tables; queries_sql has their twins in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphdelta.functions.ids import normalize_path
from graphdelta.functions.similarity import jaccard, multiset_jaccard, similarity
from graphdelta.operators import diff, graphops, lint, match, replay, reports, resolve, select, tree
from graphdelta.operators.scratch import materialize
from graphdelta.plans.config import Config
from graphdelta.plans.schema import as_edges, as_nodes
from graphdelta.sources import tablegraph as tg

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


# ---- versions ------------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str):
    """((base nodes, edges), (head nodes, edges)) of the event graph, keyed by pair_id."""
    nodes, edges = tg.event_graph(spark, sf_dir)
    pairs = tg.one_pair(spark)
    (bn, hn), (be, he) = diff.sides(nodes, pairs), diff.sides(edges, pairs)
    return (bn, be), (hn, he)


def _event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, head = _events(spark, sf_dir)
    return diff.diff(base, head, None)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = tg.document_graph(spark, sf_dir)
    base, head = diff.sides(nodes, tg.one_pair(spark))
    return materialize(diff.node_delta(base, head))


CONFIG = Config(
    order=["low", "high", "unused"], layers=[("src/r[01]/*", "low"), ("src/**", "high"), ("lib/**", "unused")], forbid=[("low", "high")],
    deny=["layering", "new_state_cycle", "destructive_migration"], warn=["cycles", "unreachable_state", "terminal_state_without_exit", "io_in_hot_path"],
    hot=["crate::O*[05]"], io=["crate::B[1-3]*"],
).check()


def _nations(spark: SparkSession, sf_dir: str, config: Config = CONFIG) -> lint.Version:
    nodes, edges = (materialize(x) for x in tg.nation_graph(spark, sf_dir))
    pairs = tg.quarter_pairs(nodes)
    (bn, hn), (be, he) = diff.sides(nodes, pairs), diff.sides(edges, pairs)
    return lint.Version(hn, he, materialize(diff.diff((bn, be), (hn, he), None)), config)


def _states(spark: SparkSession, sf_dir: str) -> lint.Version:
    base, head = _events(spark, sf_dir)
    return lint.Version(*head, materialize(diff.diff(base, head, None)), CONFIG)


def _schemas(spark: SparkSession) -> lint.Version:
    nodes, edges = tg.schema_graph(spark)
    pairs = tg.one_pair(spark)
    (bn, hn), (be, he) = diff.sides(nodes, pairs), diff.sides(edges, pairs)
    return lint.Version(hn, he, materialize(diff.diff((bn, be), (hn, he), None)), CONFIG)


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Calls edges per version and the unresolved ones: parts whose key is divisible by 7 are no functions."""
    raw = tg.raw_calls(spark, sf_dir)
    known = raw.where("l_partkey % 7 != 0").select("graph_id", F.col("callee").alias("id")).distinct()
    return resolve.call_edges(raw, known)


# ---- delta ---------------------------------------------------------------------------------------------------------------


@query
def q_edge_set_diff(spark, sf_dir):
    base, head = _events(spark, sf_dir)
    return diff.edge_delta(base[1], head[1]).select("change", F.col("from").alias("from_id"), F.col("to").alias("to_id"), "kind")


@query
def q_node_set_diff(spark, sf_dir):
    base, head = diff.sides(tg.supplier_profiles(spark, sf_dir), tg.one_pair(spark))
    return diff.node_delta(base, head).select("change", F.coalesce("after.id", "before.id").alias("id"))


@query
def q_member_diff(spark, sf_dir):
    base, head = diff.sides(tg.supplier_profiles(spark, sf_dir), tg.one_pair(spark))
    own = diff.member_delta(diff.node_delta(base, head).where("change = 'Modified'"))
    return own.select(F.col("after.id").alias("id"), *(F.array_join(c, ",").alias(c) for c in ("added", "removed", "changed")))


@query
def q_file_rename_seed(spark, sf_dir):
    base, head, renames = tg.renamed_nations(spark, sf_dir)
    b, h = diff.sides(base.unionByName(head), tg.one_pair(spark))
    nodes = diff.node_delta(b, h)
    found = diff.apply_matches(nodes, diff.module_moves(nodes, renames))
    return found.select("change", F.col("before.id").alias("before_id"), F.col("after.id").alias("after_id"))


@query
def q_change_order(spark, sf_dir):
    return diff.in_order(_event_changes(spark, sf_dir)).select("pos", "change", F.coalesce("id", "from_id").alias("key"), "to_id")


@query
def q_change_list(spark, sf_dir):
    return reports.change_list(_event_changes(spark, sf_dir)).select("pos", "line")


@query
def q_drift(spark, sf_dir):
    return reports.drift(_event_changes(spark, sf_dir)).drop("pair_id")


@query
def q_changelog(spark, sf_dir):
    rows = reports.changelog(_event_changes(spark, sf_dir))
    return rows.select("owner", "section", F.size("lines").cast("long").alias("n"), F.array_join("lines", "\n").alias("lines"))


# ---- similarity and matching -----------------------------------------------------------------------------------------------


def _neighbours(spark: SparkSession, sf_dir: str, measure, name: str) -> DataFrame:
    """A measure of the fingerprints of each document with an even id and of the one after it. Texts are paired and their words
    counted after that: a pair's fingerprints are never shuffled or sorted."""
    docs = tg.documents(spark, sf_dir)
    side = lambda rest, text: docs.where(F.col("seq") % 2 == rest).select((F.col("seq") - rest).alias("doc_id"), F.col("text").alias(text))
    both = side(0, "ta").join(side(1, "tb"), "doc_id")
    prints = F.array(F.struct(tg.text_fingerprint(F.col("ta")).alias("a"), tg.text_fingerprint(F.col("tb")).alias("b")))
    return both.select("doc_id", F.round(F.transform(prints, lambda x: measure(x["a"], x["b"]))[0], 9).alias(name))


@query
def q_jaccard(spark, sf_dir):
    return _neighbours(spark, sf_dir, lambda a, b: jaccard(a["members"], b["members"]), "j")


@query
def q_multiset_jaccard(spark, sf_dir):
    return _neighbours(spark, sf_dir, lambda a, b: multiset_jaccard(a["field_types"], b["field_types"]), "j")


@query
def q_similarity(spark, sf_dir):
    return _neighbours(spark, sf_dir, similarity, "score")


@query
def q_rename_candidates(spark, sf_dir):
    removed, added = match.sides(_documents(spark, sf_dir))
    return match.candidates(removed, added, 0.7).select("rid", "aid", F.round("score", 9).alias("score"))


@query
def q_rename_matches(spark, sf_dir):
    return match.match(_documents(spark, sf_dir), 0.7).select("rid", "aid", F.round("score", 9).alias("score"))


@query
def q_renamed_delta(spark, sf_dir):
    """The whole delta with renames and moves found."""
    nodes = _documents(spark, sf_dir)
    return reports.drift(diff.unify(diff.apply_matches(nodes, materialize(match.match(nodes, 0.7))), _no_edges(spark))).drop("pair_id")


def _no_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "pair_id string, change string, `from` string, `to` string, kind string, ordinal int")


@query
def q_threshold_sweep(spark, sf_dir):
    return replay.sweep_totals(_documents(spark, sf_dir)).drop("pair_id")


@query
def q_module_reconciliations(spark, sf_dir):
    """Modules that file renames alone carry over to another id."""
    base, head, renames = tg.renamed_nations(spark, sf_dir)
    b, h = diff.sides(base.unionByName(head), tg.one_pair(spark))
    none = _no_edges(spark).drop("change")
    return replay.module_reconciliations(diff.diff((b, none), (h, none), None, renames)).select("pair_id", "n")


@query
def q_near_miss(spark, sf_dir):
    """The best 20 pairs that stay apart at 0.7, and how many there are."""
    return replay.near_misses(_documents(spark, sf_dir), 0.7).select("rid", "aid", F.round("score", 9).alias("score"), "n_left")


@query
def q_false_merge_audit(spark, sf_dir):
    """The 20 accepted matches of least score."""
    return replay.audit(match.match(_documents(spark, sf_dir), 0.7)).select("rid", "aid", F.round("score", 9).alias("score"))


# ---- resolution ------------------------------------------------------------------------------------------------------------


@query
def q_calls_dense_ordinal(spark, sf_dir):
    edges, _ = _calls(spark, sf_dir)
    return edges.select("graph_id", F.col("from").alias("caller"), F.col("to").alias("callee"), F.col("ordinal").cast("long").alias("ordinal"))


@query
def q_unresolved_count(spark, sf_dir):
    _, lost = _calls(spark, sf_dir)
    return lost.select("graph_id", "id", "n")


@query
def q_first_wins_edges(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = tg.table(spark, sf_dir, "events").withColumn("prev", F.lag("event_type").over(order)).where("prev IS NOT NULL")
    rows = rows.select(F.lit("g").alias("graph_id"), F.concat(F.lit("crate::"), "prev").alias("from"), F.concat(F.lit("crate::"), "event_type").alias("to"), F.lit("e").alias("file"), F.col("event_id").alias("start"), F.col("event_id").alias("end"), F.col("event_id").alias("seq"))
    states = tg.table(spark, sf_dir, "events").select(F.lit("g").alias("graph_id"), F.concat(F.lit("crate::"), "event_type").alias("id")).distinct()
    return resolve.edges_between(rows, (states, states), "Transitions").select(F.col("from").alias("from_id"), F.col("to").alias("to_id"), "start")


PATHS = (("crate::a::b", "crate::a::b::c::D"), ("crate::a", "crate::a::b"), ("crate::a", "crate::x::Y"), ("crate::a", "beta::inner::deep::Z"), ("crate::a", "beta::W"), ("crate::a", "crate::a::T"))
MODULES = ("crate", "crate::a", "crate::a::b", "beta", "beta::inner")


@query
def q_prefix_resolve(spark, sf_dir):
    paths = spark.createDataFrame([("g", m, p) for m, p in PATHS], "graph_id string, module string, path string")
    modules = spark.createDataFrame([("g", m) for m in MODULES], "graph_id string, id string")
    return resolve.owning_modules(paths, modules).select("module", "path", "target")


EXPORTS = (("crate::f::A", "crate::g::B"), ("crate::g::B", "crate::h::C"), ("crate::s::S", "crate::s::S"), ("crate::h::C", "crate::h::D"))


@query
def q_reexport_chase(spark, sf_dir):
    exports = spark.createDataFrame([("g", *e) for e in EXPORTS], "graph_id string, name string, target string")
    paths = spark.createDataFrame([("g", p) for p in ("crate::f::A", "crate::g::B", "crate::s::S", "crate::z::Z")], "graph_id string, path string")
    return resolve.chase(paths, exports).select("path", "resolved")


@query
def q_path_normalise(spark, sf_dir):
    given = spark.createDataFrame([("crate::a::b", p) for p in ("crate::x::Y", "self::T", "super::T", "super::super::T", "super::super::super::T", "std::fmt", "self")], "module string, path string")
    return given.select("module", "path", normalize_path("path", "module").alias("absolute"))


# ---- rules -----------------------------------------------------------------------------------------------------------------


def _messages(findings: DataFrame) -> DataFrame:
    return findings.select("pair_id", "rule", "severity", "message")


@query
def q_layering(spark, sf_dir):
    return _messages(lint.layering(_nations(spark, sf_dir), "deny"))


@query
def q_config_sanity(spark, sf_dir):
    return _messages(lint.config_sanity(_nations(spark, sf_dir)))


@query
def q_cycles(spark, sf_dir):
    return _messages(lint.cycles(_nations(spark, sf_dir), "warn"))


@query
def q_state_cycles(spark, sf_dir):
    return lint.new_state_cycle(_states(spark, sf_dir), "deny").select("message")


@query
def q_unreachable_state(spark, sf_dir):
    return lint.unreachable_state(_states(spark, sf_dir), "warn").select("message")


@query
def q_terminal_state(spark, sf_dir):
    return lint.terminal_state_without_exit(_states(spark, sf_dir), "warn").select("message")


@query
def q_io_hot_path(spark, sf_dir):
    calls, _ = _calls(spark, sf_dir)
    (base, head) = diff.sides(as_edges(calls), tg.one_pair(spark))
    changes = diff.unify(diff.node_delta(*_no_nodes(spark)), diff.edge_delta(base, head))
    v = lint.Version(_no_nodes(spark)[1], head, changes, CONFIG)
    return lint.io_in_hot_path(v, "warn").select("message")


def _no_nodes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    none = as_nodes(spark.range(0).select(F.lit("").alias("id"), F.lit("").alias("kind"))).withColumnRenamed("graph_id", "pair_id")
    return none, none


@query
def q_destructive_migration(spark, sf_dir):
    return lint.destructive_migration(_schemas(spark), "deny").select("message")


@query
def q_verdict(spark, sf_dir):
    v = _nations(spark, sf_dir)
    return lint.verdicts(v.nodes.select("pair_id").distinct(), lint.lint(v))


# ---- selection -------------------------------------------------------------------------------------------------------------


@query
def q_classify(spark, sf_dir):
    v = _states(spark, sf_dir)
    return select.classified(v.nodes, v.changes, ["Variant"]).select("id", "class")


@query
def q_classify_edges(spark, sf_dir):
    v = _states(spark, sf_dir)
    ids = select.classified(v.nodes, v.changes, ["Variant"])
    return select.classified_edges(v.edges, v.changes, ids, ["Transitions"]).select(F.col("from").alias("from_id"), F.col("to").alias("to_id"), "class")


@query
def q_khop_prune(spark, sf_dir):
    """What lies up to two hops from region 0's first nation, per quarter, over the edges that are not containment."""
    v = _nations(spark, sf_dir)
    seeds = v.nodes.where("id = 'crate::R0::N0'").select("pair_id", "id")
    ways = v.edges.where(F.col("from").contains("::N") & F.col("to").contains("::N"))
    return graphops.k_hops(seeds, ways, 2)


@query
def q_scope_stubs(spark, sf_dir):
    v = _nations(spark, sf_dir)
    ids, _ = select.select_view("modules", v.nodes, v.edges, v.changes, full=True, scope=["src/r0/*"])
    return ids.select("pair_id", "id", "stub")


@query
def q_call_slice(spark, sf_dir):
    """Depth-first slices over the region tree: a root calls regions, regions nations, nations their suppliers."""
    calls, entries = _tree_calls(spark, sf_dir)
    rows = graphops.call_slice(calls, entries)
    return rows.select("depth", "caller", "callee", F.array_join(F.transform("path", lambda x: F.lpad(x.cast("string"), 4, "0")), ".").alias("path"))


def _tree_calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    regions, nations, suppliers = (tg.table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = regions.select(F.lit("root").alias("from"), text("r", "r_regionkey").alias("to"), F.col("r_regionkey").cast("int").alias("ordinal"))
    b = nations.select(text("r", "n_regionkey").alias("from"), text("n", "n_nationkey").alias("to"), F.col("n_nationkey").cast("int").alias("ordinal"))
    c = suppliers.select(text("n", "s_nationkey").alias("from"), text("s", "s_suppkey").alias("to"), F.col("s_suppkey").cast("int").alias("ordinal"))
    back = nations.select(text("n", "n_nationkey").alias("from"), F.lit("root").alias("to"), F.lit(-1).alias("ordinal"))  # a cycle, listed and not entered
    calls = a.unionByName(b).unionByName(c).unionByName(back).withColumn("graph_id", F.lit("g"))
    return calls, resolve_entry(spark)


def resolve_entry(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("g").alias("graph_id"), F.lit("root").alias("id"))


@query
def q_crate_deps(spark, sf_dir):
    nodes, edges = tg.nation_graph(spark, sf_dir)
    own = edges.select("graph_id", "kind", F.regexp_replace("from", "^crate::", "").alias("from"), F.regexp_replace("to", "^crate::", "").alias("to"))
    return graphops.crate_edges(own).select("graph_id", F.col("from").alias("from_id"), F.col("to").alias("to_id"))


def _cyclic_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers depend on their nation, nations on their region, and the nations of a region on one another in a ring."""
    nations, customers = tg.table(spark, sf_dir, "nation"), tg.table(spark, sf_dir, "customer")
    text = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    ring = nations.select("n_regionkey", "n_nationkey", F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("next"), F.min("n_nationkey").over(Window.partitionBy("n_regionkey")).alias("first"))
    rows = [
        customers.select(text("c", "c_custkey").alias("from"), text("n", "c_nationkey").alias("to")),
        nations.select(text("n", "n_nationkey").alias("from"), text("r", "n_regionkey").alias("to")),
        ring.select(text("n", "n_nationkey").alias("from"), F.concat(F.lit("n"), F.coalesce("next", "first").cast("string")).alias("to")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("graph_id", F.lit("g"))


@query
def q_crate_tiers_cyclic(spark, sf_dir):
    deps = _cyclic_deps(spark, sf_dir)
    crates = deps.select("graph_id", F.explode(F.array("from", "to")).alias("id"))
    return graphops.crate_tiers(crates, deps).select("id", F.col("tier").cast("long").alias("tier"))


def _tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, _ = _tree_calls(spark, sf_dir)
    deps = calls.where("ordinal >= 0").select("graph_id", "from", "to")
    crates = deps.select("graph_id", F.explode(F.array("from", "to")).alias("id"))
    return graphops.crate_tiers(crates, deps)


@query
def q_crate_tiers(spark, sf_dir):
    return _tiers(spark, sf_dir).select("id", F.col("tier").cast("long").alias("tier"))


@query
def q_layer_forbid_pairs(spark, sf_dir):
    return reports.layer_pairs(_tiers(spark, sf_dir)).select(F.col("from").alias("from_layer"), F.col("to").alias("to_layer"))


# ---- reports over many versions ----------------------------------------------------------------------------------------------


@query
def q_file_index(spark, sf_dir):
    """Pages as modules of the file that host and first path segment name."""
    pages = tg.table(spark, sf_dir, "pages").where("url LIKE '%://%'")
    rest = F.substring_index("url", "://", -1)
    file = F.concat(F.substring_index(rest, "/", 1), F.lit("/"), F.substring_index(F.substring_index(F.substring_index(rest, "/", 2), "/", -1), "?", 1))
    nodes = as_nodes(pages.select(F.lit("g").alias("graph_id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.lit("Module").alias("kind"), file.alias("file")))
    edges = as_edges(nodes.limit(0).select("graph_id", F.col("id").alias("from"), F.col("id").alias("to"), F.lit("Implements").alias("kind")))
    rows = reports.file_index(nodes, edges)
    return rows.select("file", "section", F.array_join("lines", ",").alias("lines"))


def _days(spark: SparkSession, sf_dir: str):
    nodes, edges = (materialize(x) for x in tg.event_graph(spark, sf_dir, F.date_format("ts", "yyyy-MM-dd")))
    log = nodes.select("graph_id").distinct().select(F.concat(F.lit("w"), (F.weekofyear(F.to_date("graph_id"))).cast("string")).alias("repo"), F.col("graph_id").alias("sha"), F.col("graph_id").alias("pos"))
    return nodes, edges, log


@query
def q_commit_pairs(spark, sf_dir):
    _, _, log = _days(spark, sf_dir)
    return replay.commit_pairs(log).select("repo", "parent", F.col("commit").alias("commit_id"))


def _walk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(changes of every pair of adjacent days, their pairs), all in one plan."""
    nodes, edges, log = _days(spark, sf_dir)
    pairs = replay.commit_pairs(log).select("repo", F.col("commit").alias("pair_id"), F.col("parent").alias("base_id"), F.col("commit").alias("head_id"))
    (bn, hn), (be, he) = diff.sides(nodes, pairs), diff.sides(edges, pairs)
    return diff.diff((bn, be), (hn, he), None), pairs


@query
def q_walk(spark, sf_dir):
    changes, _ = _walk(spark, sf_dir)
    return reports.drift(changes)


@query
def q_replay_totals(spark, sf_dir):
    changes, pairs = _walk(spark, sf_dir)
    return replay.totals(reports.drift(changes), pairs.select("pair_id", "repo"))


@query
def q_findings_hash(spark, sf_dir):
    """FNV-1a of each quarter's findings."""
    return replay.findings_hash(lint.lint(_nations(spark, sf_dir)))


def _fenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per conversation and side with a fenced block per turn, of its whole text; every third turn's block is no
    sequence. Rows without a conv_id belong to no conversation."""
    turns = tg.table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL")
    head = F.when(F.col("turn") % 3 == 2, "flowchart LR").otherwise("sequenceDiagram")
    line = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z ]", "x")
    block = F.concat(F.lit("text\n```mermaid\n"), head, F.lit("\n  "), "role", F.lit(": "), line, F.lit("\n```\nmore\n"))
    own = turns.select("conv_id", (F.col("conv_id") % 2).alias("side"), F.struct("turn", block.alias("b")).alias("x"))
    return own.groupBy("conv_id", "side").agg(F.array_join(F.sort_array(F.collect_list("x"))["b"], "").alias("text"))


@query
def q_extract_fences(spark, sf_dir):
    docs = _fenced(spark, sf_dir).select(F.col("conv_id").cast("string").alias("pair_id"), "text")
    return reports.fenced_sequences(docs)


@query
def q_trace_delta(spark, sf_dir):
    """Blocks of a conversation against those of the one after it."""
    docs = _fenced(spark, sf_dir)
    side = lambda rest: reports.fenced_sequences(docs.where(F.col("side") == rest).select((F.col("conv_id") - rest).cast("string").alias("pair_id"), "text"))
    return diff.block_delta(side(0), side(1))


@query
def q_tree_edit_distance(spark, sf_dir):
    """Flat trees of the types of parts in an order and in the next one."""
    lines = tg.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    parts = tg.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring("p_type", 1, 1).alias("label"))
    own = lines.join(parts, "l_partkey")
    leaf = own.select((F.floor(F.col("l_orderkey") / 2)).alias("pair_id"), F.when(F.col("l_orderkey") % 2 == 0, "base").otherwise("head").alias("side"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "label").alias("x"))
    seqs = leaf.groupBy("pair_id", "side").agg(F.sort_array(F.collect_list("x"))["label"].alias("labels"))
    leaves = seqs.select("pair_id", "side", F.posexplode("labels").alias("pos", "label")).select("pair_id", "side", (F.col("pos") + 1).alias("node"), F.lit(0).alias("parent"), "pos", "label")
    roots = seqs.select("pair_id").distinct().select("pair_id", F.explode(F.array(F.lit("base"), F.lit("head"))).alias("side"), F.lit(0).alias("node"), F.lit(None).cast("int").alias("parent"), F.lit(0).alias("pos"), F.lit("root").alias("label"))
    return tree.tree_diff(leaves.unionByName(roots)).select("pair_id", F.col("cost").cast("long").alias("cost"))


# ---- source trees ----------------------------------------------------------------------------------------------------------


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A version per shipping half with a Rust file per nation, written from the tables: a struct per supplier with a field per
    brand, an enum of the order states, and functions that call one another."""
    profiles = tg.supplier_profiles(spark, sf_dir)
    fields = F.array_join(F.transform("fp.member_types", lambda m: F.concat(F.lit("    pub b"), F.regexp_replace(m["m"], r"\D", ""), F.lit(": Vec<"), F.initcap(m["t"]), F.lit(">,\n"))), "")
    name = F.substring_index("id", "::", -1)
    struct = F.concat(F.lit("/// Supplies.\npub struct "), name, F.lit(" {\n"), fields, F.lit("}\nimpl "), name, F.lit(" { pub fn run(&self) -> u64 { helper(1); self.run2(); other() } fn run2(&self) {} }\n"))
    module = F.regexp_extract("id", r"N(\d+)::", 1)
    code = profiles.select("graph_id", F.concat(F.lit("src/n"), module, F.lit(".rs")).alias("path"), F.struct("id", struct.alias("s")).alias("s"))
    files = code.groupBy("graph_id", "path").agg(F.concat(F.lit("use crate::shared::Order;\nfn helper(x: u64) -> u64 { x }\n"), F.array_join(F.sort_array(F.collect_list("s"))["s"], "")).alias("content"))
    mods = files.groupBy("graph_id").agg(F.concat(F.lit("pub mod shared;\n"), F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("mod "), F.regexp_extract("path", r"(n\d+)", 1), F.lit(";\n")))), "")).alias("content"))
    states = tg.table(spark, sf_dir, "orders").select("o_orderstatus").distinct().agg(F.sort_array(F.collect_list("o_orderstatus")).alias("s"))
    enum = states.select(F.concat(F.lit("pub enum Order { "), F.array_join("s", ", "), F.lit(" }\nimpl Order { pub fn next(self) -> Order { match self { "), F.array_join(F.transform("s", lambda x, i: F.concat(F.lit("Order::"), x, F.lit(" => Self::"), F.element_at("s", (i + 1) % F.size("s") + 1), F.lit(", "))), ""), F.lit("} } }\n")).alias("content"))
    graphs = mods.select("graph_id")
    every = files.unionByName(mods.select("graph_id", F.lit("src/lib.rs").alias("path"), "content")).unionByName(graphs.crossJoin(enum).select("graph_id", F.lit("src/shared.rs").alias("path"), "content"))
    return every.select("graph_id", "path", F.encode("content", "UTF-8").alias("content"))


def _extracted(spark: SparkSession, sf_dir: str):
    from graphdelta.sources.rustsrc.scan import rust_graph

    return rust_graph(materialize(_sources(spark, sf_dir)))


@query
def q_extract_nodes(spark, sf_dir):
    nodes, _ = _extracted(spark, sf_dir)
    return nodes.select("graph_id", "id", "kind", F.size("fp.members").cast("long").alias("n_members"))


@query
def q_extract_edges(spark, sf_dir):
    _, edges = _extracted(spark, sf_dir)
    return edges.select("graph_id", "kind", F.col("from").alias("from_id"), F.col("to").alias("to_id"), F.col("ordinal").cast("long").alias("ordinal"))


FACTS_SOURCE = """
use crate::shared::{{Lane as Track, deep::Lock}};
/// Number {k}.
pub struct Keel {{ pub span: u64 }}
pub struct Hull {{ pub keel: Option<Box<Keel>>, rows: Vec<Arc<Track>>, n: u16 }}
pub trait Sail {{ const MOST: u8; fn set(&self, at: u8) -> Keel; }}
impl Sail for Hull {{ fn set(&self, at: u8) -> Keel {{ make(at) }} }}
pub fn make<T: Into<u8>>(at: T, wide: &Keel) -> Option<Keel> {{ None }}
"""


def _facts(spark: SparkSession, sf_dir: str):
    """A version per region with a module per nation, written from a fixed source: uses, wrapped types, a trait and its
    implementation, signatures."""
    from graphdelta.sources.rustsrc.scan import rust_graph

    before, after = FACTS_SOURCE.format(k="\0").split("\0")
    nations = tg.table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("graph_id"), F.col("n_nationkey").cast("string").alias("k"))
    own = nations.select("graph_id", F.concat(F.lit("src/n"), "k", F.lit(".rs")).alias("path"), F.concat(F.lit(before), "k", F.lit(after)).alias("content"))
    mods = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("mod n"), "k", F.lit(";\n")))), "")
    roots = nations.groupBy("graph_id").agg(F.concat(F.lit("pub mod shared;\n"), mods).alias("content")).withColumn("path", F.lit("src/lib.rs"))
    shared = nations.select("graph_id").distinct().withColumns({"path": F.lit("src/shared.rs"), "content": F.lit("pub struct Lane { }\npub mod deep { pub struct Lock; }\n")})
    every = own.unionByName(roots).unionByName(shared)
    return rust_graph(materialize(every.select("graph_id", "path", F.encode("content", "UTF-8").alias("content"))))


@query
def q_extract_facts(spark, sf_dir):
    """Nodes with kind, members, types, member types and signature, and all edges, as text."""
    nodes, edges = _facts(spark, sf_dir)
    join = lambda x: F.array_join(x, ",")
    fp = F.when(F.col("fp").isNull(), "").otherwise(F.concat_ws("|", join(F.transform("fp.members", lambda m: m)), join(F.transform("fp.field_types", lambda e: F.concat(e["t"], F.lit("*"), e["n"].cast("string")))), join(F.transform("fp.member_types", lambda e: F.concat(e["m"], F.lit(":"), e["t"])))))
    sig = join(F.transform("attrs", lambda e: F.concat(e["k"], F.lit("="), e["v"])))
    rows = nodes.select("graph_id", F.col("kind").alias("kind"), "id", F.concat_ws("|", fp, sig).alias("value"))
    return rows.unionByName(edges.select("graph_id", "kind", F.col("from").alias("id"), F.col("to").alias("value")))


SCHEMA_SOURCE = """
table! {{ nations (key) {{ key -> Int4, {columns} }} }}
diesel::table! {{ regions (key) {{ key -> Int4, name -> Varchar, }} }}
joinable!(nations -> regions (region));
joinable!(nations -> ghosts (ghost));
"""


@query
def q_extract_schema(spark, sf_dir):
    """A schema file per region, with a column per nation of it."""
    from graphdelta.sources.rustsrc.scan import schema_files_graph

    columns = F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"), F.lit(" -> Nullable<Text>")))), ", ")
    before, after = SCHEMA_SOURCE.format(columns="\0").split("\0")
    files = tg.table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("string").alias("graph_id")).agg(F.encode(F.concat(F.lit(before), columns, F.lit(after)), "UTF-8").alias("content"))
    nodes, edges = schema_files_graph(files.withColumn("path", F.lit("src/schema.rs")))
    t = nodes.select("graph_id", F.lit("Table").alias("kind"), "id", F.element_at("attrs", 1)["v"].alias("value"))
    return t.unionByName(edges.select("graph_id", "kind", F.col("from").alias("id"), F.col("to").alias("value")))


# ---- diagrams --------------------------------------------------------------------------------------------------------------


def _render(view: str, fmt: str = "mermaid", **options) -> Query:
    def run(spark, sf_dir):
        from graphdelta.operators.render import render

        nodes, edges = (materialize(x) for x in _extracted(spark, sf_dir))
        pairs = tg.one_pair(spark)
        (bn, hn), (be, he) = diff.sides(nodes, pairs), diff.sides(edges, pairs)
        changes = materialize(diff.diff((bn, be), (hn, he)))
        return render(view, pairs, hn, he, changes, fmt, **options)

    return run


for _view in ("modules", "states", "types", "calls", "callgraph", "overview"):
    QUERIES[f"q_render_{_view}"] = _render(_view, full=_view != "calls")
for _fmt in ("dot", "ascii", "boxes", "svg"):
    QUERIES[f"q_render_types_{_fmt}"] = _render("types", _fmt)


@query
def q_render_schema(spark, sf_dir):
    from graphdelta.operators.render import render

    v = _schemas(spark)
    return render("schema", tg.one_pair(spark), v.nodes, v.edges, v.changes)


@query
def q_render_nations(spark, sf_dir):
    """The module diagram of every quarter against the one before."""
    from graphdelta.operators.render import render

    v = _nations(spark, sf_dir)
    return render("modules", v.nodes.select("pair_id").distinct(), v.nodes, v.edges, v.changes)
