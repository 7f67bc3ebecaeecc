"""Command line over a graph store in Parquet or over source trees.

    python -m graphdelta extract ROOT --store DIR --id NAME
    python -m graphdelta diff|changelog|drift --store DIR (--base A | --baseline FILE) --head B [--config FILE] [--quiet | --show] [--view V] [--format F] [--full] [--scope GLOB ...] [--list]
    python -m graphdelta snapshot --store DIR --head B [--out FILE]
    python -m graphdelta trace --base FILE --head FILE
    python -m graphdelta files|doc|init --store DIR --head B
    python -m graphdelta walk --store DIR --log FILE [--view V]
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphdelta.engine import DENIED, ERROR, OK, Engine, gate_comment, load_config
from graphdelta.operators import diff, render, reports
from graphdelta.plans.config import ConfigError
from graphdelta.plans.schema import union_graphs
from graphdelta.sources import files


def arguments(argv: list[str]) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="graphdelta")
    commands = top.add_subparsers(dest="command", required=True)
    trace = commands.add_parser("trace")  # texts in which a command's output of either version stands
    trace.add_argument("--base", required=True)
    trace.add_argument("--head", required=True)
    for name in ("extract", "diff", "changelog", "drift", "files", "doc", "init", "walk", "comment", "snapshot"):
        own = commands.add_parser(name)
        own.add_argument("--store", required=True)
        if name == "extract":
            own.add_argument("root")
            own.add_argument("--id", required=True)
            continue
        own.add_argument("--config")
        own.add_argument("--view", choices=render.VIEWS)
        own.add_argument("--format", default="mermaid", choices=render.FORMATS)
        own.add_argument("--full", action="store_true")
        own.add_argument("--list", action="store_true")
        own.add_argument("--scope", action="append", default=[])
        own.add_argument("--entry")
        own.add_argument("--renames")
        if name == "walk":
            own.add_argument("--log", required=True)
        else:
            own.add_argument("--head", required=True)
            if name in ("diff", "changelog", "drift", "comment"):
                side = own.add_mutually_exclusive_group(required=True)
                side.add_argument("--base")
                side.add_argument("--baseline", help="a file that snapshot wrote, in place of a version of the store")
            if name == "diff":
                drawn = own.add_mutually_exclusive_group()
                drawn.add_argument("--show", action="store_true", help="draw the views (the default)")
                drawn.add_argument("--quiet", action="store_true", help="findings and summary alone")
            if name == "snapshot":
                own.add_argument("--out", default="-")
    return top.parse_args(argv)


def extract(spark: SparkSession, root: str, store: str, graph_id: str) -> None:
    from graphdelta.sources.rustsrc import scan

    sources = scan.read_files(spark, root, graph_id)
    nodes, edges = scan.rust_graph(sources, scan.read_files(spark, root, graph_id, "Cargo.toml"))
    tables, keys = scan.schema_files_graph(sources)
    files.write_graph(nodes.unionByName(tables), edges.unionByName(keys), store)


def trace(spark: SparkSession, a: argparse.Namespace, out) -> int:
    """Sequence blocks in two texts, and how they differ. It reports and never denies."""
    side = lambda path: reports.fenced_sequences(spark.read.text(path, wholetext=True).select(F.lit("p").alias("pair_id"), F.col("value").alias("text")))
    base, head = side(a.base), side(a.head)
    found = diff.block_delta(base, head).orderBy("pos").collect()
    added, removed = ([r.block for r in found if r.side == s] for s in "+-")
    out.write(f"trace: {base.count()} base trace(s), {head.count()} head trace(s), {len(added)} added, {len(removed)} removed vs {a.base}\n")
    out.write("".join(f"\n+ added trace:\n{x}\n" for x in added) + "".join(f"\n- removed trace:\n{x}\n" for x in removed))
    return OK


def run(spark: SparkSession, a: argparse.Namespace, out=sys.stdout) -> int:
    if a.command == "trace":
        return trace(spark, a, out)
    if a.command == "extract":
        extract(spark, a.root, a.store, a.id)
        return OK
    config = load_config(a.config)
    wanted = None if a.command == "walk" else [x for x in (getattr(a, "base", None), a.head) if x]
    graph = files.read_graph(spark, a.store, wanted)
    if getattr(a, "baseline", None):
        a.base = a.baseline
        graph = union_graphs(graph, files.read_snapshot_text(spark, a.baseline, a.baseline))
    engine = Engine(spark, *graph)
    if a.command == "snapshot":
        text = files.snapshot_text(*graph)
        if a.out == "-":
            out.write(text)
        else:
            Path(a.out).write_text(text)
        return OK
    if a.command == "files":
        out.write(reports.file_index_text(engine.files().collect()))
        return OK
    if a.command in ("doc", "init"):
        out.write(getattr(engine, a.command)(a.head))
        return OK
    if a.command == "walk":
        log = files.read_log(spark, a.log)
        seen = engine.walk(log, config)
        texts = {r.pair_id: r.text for r in seen.diagram(a.view or seen.views()[0], a.format).collect()}
        for r in log.orderBy("pos").collect():
            if r.sha in texts:
                out.write(f"=== {r.sha[:7]} {r.subject} ===\n{texts[r.sha]}\n")
        return OK
    seen = engine.diff(a.base, a.head, config, files.read_renames(spark, a.renames, a.head) if a.renames else None)
    if a.command == "changelog":
        out.write(reports.changelog_text(seen.changelog().collect(), a.base))
        return OK
    if a.command == "drift":
        row = seen.drift().first()
        out.write(reports.drift_text(row) if row else "Total: 0 structural change(s) (0 node, 0 edge).\n")
        return OK
    if a.command == "comment":
        out.write(gate_comment(seen, a.base))
    else:
        if a.list:
            out.write("".join(f"{r.line}\n" for r in seen.change_list().orderBy("pos").collect()))
        for view in [] if a.quiet else [a.view] if a.view else seen.views():
            for r in seen.diagram(view, a.format, a.full, a.scope, a.entry).collect():
                out.write(r.text)
        for f in seen.findings.orderBy("rule", "message").collect():
            out.write(f"{f.severity} {f.rule}: {f.message}\n")
        v = seen.verdicts().first()
        out.write(reports.summary_line(seen.changes.count(), a.base, v.denials, v.warnings) + "\n")
    return DENIED if seen.verdicts().first().denied else OK


def main(argv: list[str] | None = None) -> int:
    a = arguments(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("graphdelta").getOrCreate()
    try:
        return run(spark, a)
    except (ConfigError, FileNotFoundError) as e:
        sys.stderr.write(f"{e}\n")
        return ERROR


if __name__ == "__main__":
    sys.exit(main())
