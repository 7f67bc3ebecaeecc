"""The engine over version pairs: what to compute is declared here, in one place, and nothing runs until a sink asks."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphdelta.operators import diff, graphops, lint, render, reports
from graphdelta.operators.scratch import materialize
from graphdelta.plans.config import DEFAULT, Config, parse

THRESHOLD = 0.7
OK, DENIED, ERROR = 0, 1, 2
DOC_VIEWS = ("overview", "modules", "types", "states", "calls", "callgraph", "schema")


@dataclass
class Analysis:
    """Delta, findings and verdicts of all pairs; each a table keyed by pair_id."""

    pairs: DataFrame
    nodes: DataFrame
    edges: DataFrame
    changes: DataFrame
    findings: DataFrame
    config: Config

    def verdicts(self) -> DataFrame:
        return lint.verdicts(self.pairs, self.findings)

    def drift(self) -> DataFrame:
        return reports.drift(self.changes)

    def change_list(self) -> DataFrame:
        return reports.change_list(self.changes)

    def changelog(self) -> DataFrame:
        return reports.changelog(self.changes)

    def diagram(self, view: str, fmt: str = "mermaid", full: bool = False, scope: list[str] | None = None, entry: str | None = None) -> DataFrame:
        return render.render(view, self.pairs, self.nodes, self.edges, self.changes, fmt, full, scope, entry or self.config.entry)

    def views(self) -> list[str]:
        return self.config.enabled or list(DEFAULT.enabled)

    def register(self) -> None:
        """Temporary SQL views: nodes, edges, changes, findings."""
        for name in ("nodes", "edges", "changes", "findings"):
            getattr(self, name).createOrReplaceTempView(name)


class Engine:
    """Over a graph store: nodes and edges keyed by graph_id."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame):
        self.spark, self.nodes, self.edges = spark, nodes, edges

    def analyze(self, pairs: DataFrame, config: Config = DEFAULT, threshold: float | None = THRESHOLD, renames: DataFrame | None = None) -> Analysis:
        """pairs: pair_id, base_id, head_id. renames (pair_id, old_path, new_path) seed moves of modules."""
        base_nodes, head_nodes = diff.sides(self.nodes, pairs)
        base_edges, head_edges = diff.sides(self.edges, pairs)
        changes = materialize(diff.diff((base_nodes, base_edges), (head_nodes, head_edges), threshold, renames))
        version = lint.Version(head_nodes, head_edges, changes, config)
        return Analysis(pairs.select("pair_id"), head_nodes, head_edges, changes, lint.lint(version), config)

    def diff(self, base_id: str, head_id: str, config: Config = DEFAULT, renames: DataFrame | None = None) -> Analysis:
        pair = self.spark.range(1).select(F.lit(head_id).alias("pair_id"), F.lit(base_id).alias("base_id"), F.lit(head_id).alias("head_id"))
        return self.analyze(pair, config, renames=renames)

    def walk(self, log: DataFrame, config: Config = DEFAULT) -> Analysis:
        """Every version of a log (repo, pos, sha) against the one before, in one plan; without rename seeds."""
        from graphdelta.sources.files import version_pairs

        return self.analyze(version_pairs(log).select("pair_id", "base_id", "head_id"), config)

    def files(self) -> DataFrame:
        return reports.file_index(self.nodes, self.edges)

    def tiers(self) -> DataFrame:
        crates = self.nodes.where("kind = 'Module'").select("graph_id", F.substring_index("id", "::", 1).alias("id"))
        return graphops.crate_tiers(crates, graphops.crate_edges(self.edges))

    def init(self, graph_id: str) -> str:
        """TOML of layers inferred from one version's crates, of which there are few."""
        tiers = [(r.id, r.tier) for r in self.tiers().where(F.col("graph_id") == graph_id).collect()]
        globs = [(r.crate, r.glob) for r in reports.crate_globs(self.nodes.where(F.col("graph_id") == graph_id)).collect()]
        return reports.init_config(tiers, globs)

    def doc(self, graph_id: str, views: tuple[str, ...] = DOC_VIEWS) -> str:
        """Markdown of one version: its modules, then a whole diagram per view."""
        nodes, edges = (t.where(F.col("graph_id") == graph_id) for t in (self.nodes, self.edges))
        out = ["# Structure", "", "## Modules", ""]
        out += [f"- `{r.id}` ({r.file})" for r in reports.module_index(nodes).orderBy("id", "file").collect()]
        same = Engine(self.spark, nodes, edges).diff(graph_id, graph_id)
        for view in views:
            text = same.diagram(view, full=True).first()
            out += ["", f"## {view}", "", "```mermaid", text.text.rstrip("\n") if text else "", "```"]
        return "\n".join(out) + "\n"


def load_config(path: str | None) -> Config:
    """Without a file: the module view, and a warning on module cycles."""
    return parse(Path(path).read_text()) if path and Path(path).exists() else DEFAULT


def gate_comment(analysis: Analysis, base: str, most_edges: int = 490, most_bytes: int = 60_000) -> str:
    """Markdown of one pair: verdict, findings, changelog, diagrams; shortened where a reader's limits are."""
    v = analysis.verdicts().first()
    findings = analysis.findings.orderBy("rule", "message").collect()
    n = analysis.changes.count()
    out = ["## Structure " + ("denied" if v.denied else "ok"), "", reports.summary_line(n, base, v.denials, v.warnings), ""]
    out += [f"- {f.severity} {f.rule}: {f.message}" for f in findings]
    log = reports.changelog_text(analysis.changelog().collect(), base)
    diagrams = []
    for view in analysis.views():
        text = analysis.diagram(view).first()
        lines = text.text.split("\n") if text else []
        many = sum(" -->" in x or " -.->" in x for x in lines) > most_edges
        diagrams += ["", f"### {view}", "", *(["The diagram has too many edges to be drawn here."] if many else ["```mermaid", *lines, "```"])]
    whole = "\n".join([*out, "", log, *diagrams])
    return whole if len(whole.encode()) <= most_bytes else "\n".join([*out, "", "The changelog is too long to be shown here."])
