"""Architectural rules over a head graph and its delta, keyed by pair_id. A finding is (pair_id, rule, severity, message).

Under the ratchet (new_only) a violation counts if the delta takes part: an added edge, whatever its ordinal, or a state that
an added or removed transition touches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphdelta.functions.ids import is_containment, layer_of, matches_any, owning_module
from graphdelta.operators.graphops import strong_components
from graphdelta.operators.scratch import apart, materialize
from graphdelta.plans.config import Config

ENDS = ["pair_id", "from", "to"]


@dataclass
class Version:
    """nodes and edges of head, and the changes from base (see diff.unify), all keyed by pair_id."""

    nodes: DataFrame
    edges: DataFrame
    changes: DataFrame
    config: Config

    def edges_of(self, kind: str) -> DataFrame:
        return self.edges.where(F.col("kind") == kind)

    def ids_of(self, kind: str) -> DataFrame:
        return self.nodes.where(F.col("kind") == kind).select("pair_id", "id").distinct()

    def changed(self, change: str, kind: str) -> DataFrame:
        """Ends of added or removed edges."""
        return self.changes.where((F.col("change") == change) & (F.col("kind") == kind)).select("pair_id", F.col("from_id").alias("from"), F.col("to_id").alias("to")).distinct()

    def touched(self) -> DataFrame:
        both = self.changed("EdgeAdded", "Transitions").unionByName(self.changed("EdgeRemoved", "Transitions"))
        return both.select("pair_id", F.explode(F.array("from", "to")).alias("id")).distinct()


def _found(df: DataFrame, rule: str, severity: str, message: Column) -> DataFrame:
    return df.select("pair_id", F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), message.alias("message"))


def layering(v: Version, severity: str) -> DataFrame:
    uses = v.edges_of("Uses")
    if v.config.new_only:
        uses = uses.join(v.changed("EdgeAdded", "Uses"), ENDS, "left_semi")
    layer = v.nodes.where("kind = 'Module'").groupBy("pair_id", "id").agg(F.max_by(layer_of("file", v.config.layers), "seq").alias("layer")).where("layer IS NOT NULL")
    met = uses.join(layer.withColumnsRenamed({"id": "from", "layer": "fl"}), ["pair_id", "from"]).join(layer.withColumnsRenamed({"id": "to", "layer": "tl"}), ["pair_id", "to"])
    wrong = F.lit(False)
    for a, b in v.config.forbid:
        wrong = wrong | ((F.col("fl") == a) & (F.col("tl") == b))
    return _found(met.where(wrong), "layering", severity, F.format_string("%s (%s) must not depend on %s (%s)", "from", "fl", "to", "tl"))


def config_sanity(v: Version) -> DataFrame:
    """A declared layer without a module: always a warning, whatever is selected."""
    declared = v.nodes.select("pair_id").distinct().select("pair_id", F.explode(F.array(*map(F.lit, v.config.order)) if v.config.order else F.array().cast("array<string>")).alias("layer"))
    held = v.nodes.where("kind = 'Module'").select("pair_id", layer_of("file", v.config.layers).alias("layer")).where("layer IS NOT NULL").distinct()
    return _found(declared.join(held, ["pair_id", "layer"], "left_anti"), "config_sanity", "warn", F.format_string('layer "%s" is declared but matches no module; check its glob', "layer"))


def _cycles(v: Version, rule: str, severity: str, kind: str, node_kind: str, noun: str, contain: bool) -> DataFrame:
    known = v.ids_of(node_kind)
    edges = v.edges_of(kind).select(*ENDS).distinct()
    for end in ("from", "to"):
        edges = edges.join(apart(known.withColumnRenamed("id", end)), ["pair_id", end], "left_semi")
    outside = ~is_containment("from", "to") if contain else F.lit(True)
    edges = edges.where(outside)
    edges = materialize(edges)
    parts = materialize(strong_components(edges))
    loops = edges.where(F.col("from") == F.col("to")).select("pair_id", F.col("from").alias("component")).distinct()
    members = parts.groupBy("pair_id", "component").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    members = members.join(apart(loops.withColumn("loop", F.lit(True))), ["pair_id", "component"], "left").where((F.size("ids") > 1) | F.col("loop"))
    if v.config.new_only:
        c = parts.withColumnRenamed("id", "from").withColumnRenamed("component", "cf")
        d = parts.withColumnRenamed("id", "to").withColumnRenamed("component", "ct")
        new = v.changed("EdgeAdded", kind).where(outside).join(apart(c), ["pair_id", "from"]).join(apart(d), ["pair_id", "to"]).where("cf = ct").select("pair_id", F.col("cf").alias("component")).distinct()
        members = members.join(apart(new), ["pair_id", "component"], "left_semi")
    return _found(members, rule, severity, F.concat(F.lit(f"{noun}: "), F.array_join("ids", " -> ")))


def cycles(v: Version, severity: str) -> DataFrame:
    return _cycles(v, "cycles", severity, "Uses", "Module", "module cycle", True)


def new_state_cycle(v: Version, severity: str) -> DataFrame:
    return _cycles(v, "new_state_cycle", severity, "Transitions", "Variant", "state cycle", False)


def _states(v: Version) -> tuple[DataFrame, DataFrame, DataFrame]:
    states = v.ids_of("Variant")
    if v.config.new_only:
        states = states.join(apart(v.touched()), ["pair_id", "id"], "left_semi")
    ends = v.edges_of("Transitions")
    return states, ends.select("pair_id", F.col("to").alias("id")).distinct(), ends.select("pair_id", F.col("from").alias("id")).distinct()


def unreachable_state(v: Version, severity: str) -> DataFrame:
    states, entered, left = _states(v)
    alone = states.join(apart(entered.unionByName(left).distinct()), ["pair_id", "id"], "left_anti")
    return _found(alone, "unreachable_state", severity, F.concat(F.lit("unreachable state: "), "id"))


def terminal_state_without_exit(v: Version, severity: str) -> DataFrame:
    states, entered, left = _states(v)
    stuck = states.join(apart(entered), ["pair_id", "id"], "left_semi").join(apart(left), ["pair_id", "id"], "left_anti")
    return _found(stuck, "terminal_state_without_exit", severity, F.concat(F.lit("terminal state without exit: "), "id"))


def io_in_hot_path(v: Version, severity: str) -> DataFrame:
    """One finding per edge: a repeated call counts each time."""
    calls = v.edges_of("Calls").withColumn("owner", owning_module("to"))
    calls = calls.where(matches_any("from", v.config.hot) & F.col("owner").isNotNull() & matches_any("owner", v.config.io))
    if v.config.new_only:
        calls = calls.join(v.changed("EdgeAdded", "Calls"), ENDS, "left_semi")
    return _found(calls, "io_in_hot_path", severity, F.format_string("%s (hot) calls into %s (io)", "from", "owner"))


def columns_of(node: str) -> Column:
    """name and type of each entry of a Table's `columns` attribute."""
    text = F.get(F.filter(F.col(node)["attrs"], lambda a: a["k"] == "columns"), F.lit(0))["v"]
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ", "), lambda p: F.contains(p, F.lit(": ")))
    return F.transform(parts, lambda p: F.struct(F.trim(F.split(p, ": ", 2)[0]).alias("name"), F.trim(F.split(p, ": ", 2)[1]).alias("type")))


def destructive_migration(v: Version, severity: str) -> DataFrame:
    """Tables dropped, columns dropped or retyped, foreign keys removed; of the delta alone, ratchet or not."""
    tables = v.changes.where("kind = 'Table'")
    dropped = tables.where("change = 'Removed'").select("pair_id", F.format_string("table `%s` dropped", "id").alias("m"))
    both = tables.where("change = 'Modified'")
    old = both.select("pair_id", "id", F.explode(columns_of("before")).alias("c")).select("pair_id", "id", "c.name", F.col("c.type").alias("was"))
    new = both.select("pair_id", "id", F.explode(columns_of("after")).alias("c")).select("pair_id", "id", "c.name", F.col("c.type").alias("now"))
    met = old.join(new, ["pair_id", "id", "name"], "left").where("now IS NULL OR now != was")
    lost = F.format_string("column `%s.%s` dropped", "id", "name")
    retyped = F.format_string("column `%s.%s` type changed `%s` -> `%s`", "id", "name", "was", "now")
    columns = met.select("pair_id", F.when(F.col("now").isNull(), lost).otherwise(retyped).alias("m"))
    keys = v.changes.where("change = 'EdgeRemoved' AND kind = 'ForeignKey'").select("pair_id", F.format_string("foreign key `%s -> %s` removed", "from_id", "to_id").alias("m"))
    return _found(dropped.unionByName(columns).unionByName(keys), "destructive_migration", severity, F.col("m"))


RULES = {
    "layering": layering, "cycles": cycles, "unreachable_state": unreachable_state, "terminal_state_without_exit": terminal_state_without_exit,
    "new_state_cycle": new_state_cycle, "io_in_hot_path": io_in_hot_path, "destructive_migration": destructive_migration,
}


def lint(v: Version) -> DataFrame:
    """All selected rules; unselected ones are not even planned. Sort by rule and message at a sink."""
    out = config_sanity(v)
    for name, rule in RULES.items():
        if severity := v.config.severity(name):
            out = out.unionByName(rule(v, severity))
    return out


def verdicts(pairs: DataFrame, findings: DataFrame) -> DataFrame:
    """pair_id, denied, exit_code (1 if denied), denials, warnings."""
    count = lambda s: F.count_if(F.col("severity") == s)
    per = findings.groupBy("pair_id").agg(count("deny").alias("denials"), count("warn").alias("warnings"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return pairs.select("pair_id").join(per, "pair_id", "left").select("pair_id", n("denials"), n("warnings")).withColumn("denied", F.col("denials") > 0).withColumn("exit_code", F.col("denied").cast("int"))
