"""Source trees to graphs. Files are a table (graph_id, path, content); parsing is one pass per file, resolution is joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphdelta.operators.resolve import call_edges, edges_between, first_wins, uses_edges, with_attr
from graphdelta.operators.scratch import materialize
from graphdelta.plans.schema import FP, as_edges, as_nodes
from graphdelta.sources.rustsrc.parser import parse, parse_schema

FACTS = f"graph_id string, file string, fact string, start long, `end` long, seq long, a string, b string, kind string, sig string, is_pub boolean, is_glob boolean, fp {FP}"
NAMES = ["fact", "start", "end", "seq", "a", "b", "kind", "sig", "is_pub", "is_glob"]
SKIPPED = r"(^|/)(target|\.git)/"


def read_files(spark: SparkSession, root: str, graph_id: str = "", glob: str = "*.rs") -> DataFrame:
    """graph_id, path (relative to root, without what is under target and .git), content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/").rpartition("://")[2].removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", r"^\w+:/+", "/"), F.lit("^\\Q" + base.rstrip("/") + "\\E/"), F.lit(""))
    return raw.select(F.lit(graph_id).alias("graph_id"), path.alias("path"), "content").where(~F.col("path").rlike(SKIPPED))


def _fp_value(fp) -> dict | None:
    if fp is None:
        return None
    return {
        "members": sorted(fp.members), "field_types": [{"t": t, "n": n} for t, n in sorted(fp.field_types.items())],
        "member_types": [{"m": m, "t": t} for m, t in sorted(fp.member_types.items())], "neighbors": [], "doc_hash": fp.doc_hash,
    }


def _parsed(files: DataFrame, read) -> DataFrame:
    """files: graph_id, path, content, module."""
    def run(frames):
        for frame in frames:
            out = []
            for graph_id, path, content, module in frame.itertuples(index=False):
                for row in read(bytes(content), module or ""):
                    out.append((graph_id, path, *(row.get(n) for n in NAMES), _fp_value(row.get("fp"))))
            yield pd.DataFrame(out, columns=["graph_id", "file", *NAMES, "fp"])

    return files.select("graph_id", "path", "content", "module").mapInPandas(run, FACTS)


def crate_roots(files: DataFrame) -> DataFrame:
    """graph_id, path, dir of every src/lib.rs and src/main.rs."""
    parts = F.split("path", "/")
    own = files.where(F.col("path").rlike(r"(^|/)src/(lib|main)\.rs$")).select("graph_id", "path", parts.alias("p"))
    return own.select("graph_id", "path", F.array_join(F.slice("p", 1, F.size("p") - 2), "/").alias("dir"))


def crate_names(roots: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """roots with `module`: ``crate`` if a graph has one crate folder, else the package's name, or the folder's, with hyphens as
    underscores. manifests: graph_id, path, content of Cargo.toml files."""
    many = roots.select("graph_id", "dir").distinct().groupBy("graph_id").agg(F.count("*").alias("n"))
    named = roots.join(many, "graph_id")
    if manifests is not None:
        text = F.decode("content", "UTF-8")
        name = F.regexp_extract(text, r"(?ms)^\[package\](?:(?!^\[).)*?^\s*name\s*=\s*\"([^\"]*)\"", 1)
        known = manifests.select("graph_id", F.regexp_replace("path", r"/?Cargo\.toml$", "").alias("dir"), F.when(name != "", name).alias("package"))
        named = named.join(known, ["graph_id", "dir"], "left")
    else:
        named = named.withColumn("package", F.lit(None).cast("string"))
    folder = F.element_at(F.split("dir", "/"), -1)
    module = F.when(F.col("n") == 1, "crate").otherwise(F.translate(F.coalesce("package", folder), "-", "_"))
    return named.select("graph_id", "path", module.alias("module"))


def _module_files(path: Column, name: Column, attr: Column) -> list[Column]:
    """Where a submodule's file can be, first choice first."""
    folder = F.regexp_replace(path, r"[^/]*$", "")
    stem = F.regexp_extract(path, r"([^/]*)\.rs$", 1)
    below = F.when(stem.isin("mod", "lib", "main"), folder).otherwise(F.concat(folder, stem, F.lit("/")))
    flat, nested = F.concat(below, name, F.lit(".rs")), F.concat(below, name, F.lit("/mod.rs"))
    return [F.when(attr.isNotNull(), F.concat(folder, attr)), F.when(attr.isNull(), flat), F.when(attr.isNull(), nested)]


def module_tree(files: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts of every file that the roots reach, graph_id, id, file, span of modules declared without a file). Frontier by
    frontier: what is declared and not yet read is parsed next, each file once per graph."""
    front = materialize(roots.select("graph_id", "path", "module"))
    seen, facts, lost = front, None, None
    paths = files.select("graph_id", F.col("path").alias("found"))
    while not front.isEmpty():
        rows = materialize(_parsed(front.join(files, ["graph_id", "path"]), parse))
        own = front.select("graph_id", "module", F.col("path").alias("file"), F.lit("node").alias("fact"), F.lit(0).cast("long").alias("start"))
        homes = own.select("graph_id", "file", "fact", "start", F.lit(0).cast("long").alias("end"), F.lit(-1).cast("long").alias("seq"), F.col("module").alias("a"), F.lit("Module").alias("kind"))
        facts = rows.unionByName(homes, allowMissingColumns=True) if facts is None else facts.unionByName(rows).unionByName(homes, allowMissingColumns=True)
        declared = rows.where("fact = 'mod'").select("graph_id", "file", "start", "end", "seq", F.col("a").alias("id"), F.explode(F.array_compact(F.array(*(F.struct(F.lit(k).alias("k"), c.alias("found")) for k, c in enumerate(_module_files(F.col("file"), F.col("b"), F.col("sig"))))))).alias("t"))
        tried = declared.where("t.found IS NOT NULL").select("graph_id", "file", "start", "end", "seq", "id", "t.k", "t.found")
        met = materialize(tried.join(paths, ["graph_id", "found"], "left_semi").groupBy("graph_id", "file", "seq", "id").agg(F.min_by("found", "k").alias("path")))
        none = rows.where("fact = 'mod'").select("graph_id", "file", "start", "end", "seq", F.col("a").alias("id")).join(met, ["graph_id", "file", "seq", "id"], "left_anti")
        lost = none if lost is None else lost.unionByName(none)
        after = first_wins(met.select("graph_id", "path", F.col("id").alias("module")), ["graph_id", "path"], "module")
        front = materialize(after.join(seen, ["graph_id", "path"], "left_anti").select("graph_id", "path", "module"))
        seen = seen.unionByName(front)
    return facts, lost


def graph_of(facts: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) from raw facts."""
    facts = materialize(facts)
    rows = facts.where("fact = 'node'")
    attrs = F.when(F.col("sig").isNotNull(), F.array(F.struct(F.lit("sig").alias("k"), F.col("sig").alias("v")))).otherwise(F.array().cast("array<struct<k:string,v:string>>"))
    nodes = as_nodes(rows.select("graph_id", F.col("a").alias("id"), "kind", "file", "start", "end", attrs.alias("attrs"), "fp", "seq"))
    nodes = materialize(nodes.unionByName(as_nodes(lost.select("graph_id", "id", F.lit("Module").alias("kind"), "file", "start", "end", "seq"))))
    of = lambda *kinds: nodes.where(F.col("kind").isin(*kinds)).select("graph_id", "id").distinct()
    # places in one order over all files of a graph: by file, then by place in the file
    pos = F.struct("file", "seq")
    rank = facts.select("graph_id", "file", "fact", "start", "end", "a", "b", "kind", "is_pub", "is_glob", pos.alias("seq"))
    use = rank.where("fact = 'use'").select("graph_id", F.col("a").alias("module"), F.col("b").alias("path"), F.col("kind").alias("local"), "is_pub", "is_glob", "file", "start", "end", "seq")
    uses, unresolved = uses_edges(use, of("Module"))
    ends = lambda fact: rank.where(F.col("fact") == fact).select("graph_id", F.col("a").alias("from"), F.col("b").alias("to"), "file", "start", "end", "seq")
    types = of("Struct", "Enum", "Trait")
    calls, dynamic = call_edges(rank.where("fact = 'call'").select("graph_id", F.col("a").alias("caller"), F.col("b").alias("callee"), "file", "start", "end", "seq"), of("Fn"))
    kinds = [
        uses, edges_between(ends("impl"), (of("Struct", "Enum"), of("Trait")), "Implements"), edges_between(ends("assoc"), (types, types), "Associates"),
        edges_between(ends("transition"), (of("Variant"), of("Variant")), "Transitions"), calls,
    ]
    edges = None
    for k in kinds:
        own = as_edges(k.withColumn("seq", F.col("seq.seq")))
        edges = own if edges is None else edges.unionByName(own)
    nodes = with_attr(with_attr(nodes, unresolved, "uses"), dynamic, "unresolved_calls")
    return nodes, edges


def rust_graph(files: DataFrame, manifests: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of Rust source trees: files (graph_id, path, content)."""
    return graph_of(*module_tree(files, crate_names(crate_roots(files), manifests)))


def schema_files_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Table nodes, ForeignKey edges) of the files named schema.rs: the first table of a name wins; keys between known tables."""
    own = files.where(F.col("path").rlike(r"(^|/)schema\.rs$")).withColumn("module", F.lit(""))
    rows = materialize(_parsed(own, parse_schema))
    place = F.struct("file", "seq")
    tables = first_wins(rows.where("fact = 'table'").select("graph_id", F.col("a").alias("id"), F.col("b").alias("columns"), "file", "start", "end", place.alias("seq")), ["graph_id", "id"])
    nodes = as_nodes(tables.select("graph_id", "id", F.lit("Table").alias("kind"), "file", "start", "end", F.array(F.struct(F.lit("columns").alias("k"), F.col("columns").alias("v"))).alias("attrs"), F.col("seq.seq").alias("seq")))
    joins = rows.where("fact = 'join'").select("graph_id", F.col("a").alias("from"), F.col("b").alias("to"), "file", "start", "end", place.alias("seq"))
    known = nodes.select("graph_id", "id")
    edges = edges_between(joins, (known, known), "ForeignKey", loops=True)
    return nodes, as_edges(edges.withColumn("seq", F.col("seq.seq")))
