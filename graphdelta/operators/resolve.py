"""Resolution of raw facts into edges: re-exports, owning modules, uses, calls with dense ordinals, first-wins edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphdelta.functions.ids import SEP, crate_of, has_parent, normalize_path
from graphdelta.operators.scratch import materialize

#: 16 hops through re-exports: the map composed with itself four times.
DOUBLINGS = 4


def first_wins(rows: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """One row per key, the first by order. A partial aggregation, not a window: repeats go before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    firsts = rows.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in rest)), order).alias("_row"))
    return firsts.select(*keys, *(F.col(f"_row.`{c}`").alias(c) for c in rest))


def reexport_map(uses: DataFrame) -> DataFrame:
    """graph_id, name (module::local), target of public uses that are no globs; the last one of a name wins. uses: graph_id,
    module, path, local, is_pub, is_glob, seq."""
    own = uses.where("is_pub AND NOT is_glob").withColumn("target", normalize_path("path", "module")).where("target IS NOT NULL")
    named = own.select("graph_id", F.concat("module", F.lit(SEP), "local").alias("name"), "target", "seq")
    return named.groupBy("graph_id", "name").agg(F.max_by("target", "seq").alias("target"))


def chase(paths: DataFrame, exports: DataFrame, doublings: int = DOUBLINGS) -> DataFrame:
    """Adds `resolved`: `path` followed through re-exports, at most 2^doublings times; a name that stands for itself stops. The
    map is composed with itself first, so that the paths, which may be many, are joined once."""
    step = exports.select("graph_id", "name", "target").where(F.col("name") != F.col("target"))
    for _ in range(doublings):
        on = step.select("graph_id", F.col("name").alias("target"), F.col("target").alias("_next"))
        step = step.join(on, ["graph_id", "target"], "left").select("graph_id", "name", F.coalesce("_next", "target").alias("target"))
    known = materialize(step).select("graph_id", F.col("name").alias("path"), F.col("target").alias("_to"))
    return paths.join(known, ["graph_id", "path"], "left").select(*(F.col(f"`{c}`") for c in paths.columns), F.coalesce("_to", "path").alias("resolved"))


def prefixes(path: str):
    """(prefix, k) of an id's leading segments, longest last."""
    parts = F.split(path, SEP)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), SEP).alias("prefix"), k.alias("k")))


def owning_modules(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """Adds `target` (null: unresolved): within a crate the path or its parent has to be a module; a path into a sibling crate,
    whose first segment is a module of one segment, goes to its longest prefix that is one. paths: graph_id, module, path;
    modules: graph_id, id."""
    keyed = paths.withColumn("_n", F.monotonically_increasing_id())
    tried = keyed.select("graph_id", "_n", F.col("path").alias("_p"), (crate_of("path") == crate_of("module")).alias("own"), F.explode(prefixes("path")).alias("x"))
    tried = tried.where(~F.col("own") | (F.col("x.k") >= F.size(F.split("_p", SEP)) - 1)).select("graph_id", "_n", F.col("x.prefix").alias("id"), F.col("x.k").alias("k"))
    found = tried.join(modules.select("graph_id", "id").distinct(), ["graph_id", "id"], "left_semi").groupBy("graph_id", "_n").agg(F.max_by("id", "k").alias("target"))
    return keyed.join(found, ["graph_id", "_n"], "left").drop("_n")


def uses_edges(uses: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Uses edges, first span of each; graph_id, id, uses: sorted unresolved targets of a module). uses: graph_id, module, path,
    local, is_pub, is_glob, file, start, end, seq. A path within the crate is made absolute; one that names no sibling crate stays
    unresolved."""
    absolute = F.coalesce(normalize_path("path", "module"), F.col("path"))
    rows = uses.withColumn("written", F.col("path")).withColumn("path", absolute)
    followed = chase(rows, reexport_map(uses)).drop("path").withColumnRenamed("resolved", "path")
    roots = modules.where(~has_parent("id")).select("graph_id", F.col("id").alias("_root")).distinct()
    local = followed.join(roots, (followed["graph_id"] == roots["graph_id"]) & (crate_of(followed["path"]) == F.col("_root")), "left").drop(roots["graph_id"])
    known = owning_modules(local.where("_root IS NOT NULL").drop("_root"), modules)
    edges = known.where("target IS NOT NULL AND target != module").select("graph_id", F.col("module").alias("from"), F.col("target").alias("to"), "file", "start", "end", "seq")
    edges = first_wins(edges, ["graph_id", "from", "to"]).withColumn("kind", F.lit("Uses"))
    lost = local.where("_root IS NULL").select("graph_id", "module", "written").unionByName(known.where("target IS NULL").select("graph_id", "module", "written"))
    attrs = lost.groupBy("graph_id", F.col("module").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("written")), ", ").alias("uses"))
    return edges, attrs


def call_edges(calls: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(Calls edges with ordinals 0.. per caller over the calls that resolve, in source order; graph_id, id, n of those that
    don't). calls: graph_id, caller, callee (may be null), seq; functions: graph_id, id."""
    known = functions.select("graph_id", F.col("id").alias("callee")).distinct()
    found = calls.join(known, ["graph_id", "callee"], "left_semi")
    place = Window.partitionBy("graph_id", "caller").orderBy("seq")
    edges = found.select("graph_id", F.col("caller").alias("from"), F.col("callee").alias("to"), F.lit("Calls").alias("kind"), (F.row_number().over(place) - 1).cast("int").alias("ordinal"), "seq", *(c for c in ("file", "start", "end") if c in calls.columns))
    lost = calls.join(known, ["graph_id", "callee"], "left_anti").groupBy("graph_id", F.col("caller").alias("id")).agg(F.count("*").alias("n"))
    return edges, lost


def edges_between(rows: DataFrame, ends: tuple[DataFrame, DataFrame], kind: str, loops: bool = False) -> DataFrame:
    """First-wins edges whose ends are both known ids. rows: graph_id, from, to, file, start, end, seq; ends: (graph_id, id) of
    each end."""
    for end, known in zip(("from", "to"), ends, strict=True):
        rows = rows.join(known.select("graph_id", F.col("id").alias(end)).distinct(), ["graph_id", end], "left_semi")
    rows = rows if loops else rows.where(F.col("from") != F.col("to"))
    return first_wins(rows, ["graph_id", "from", "to"]).withColumn("kind", F.lit(kind))


def with_attr(nodes: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """nodes with attribute `key` from values (graph_id, id, and the value), attributes sorted."""
    value = next(c for c in values.columns if c not in ("graph_id", "id"))
    joined = nodes.join(values.select("graph_id", "id", F.col(value).cast("string").alias("_v")), ["graph_id", "id"], "left")
    more = F.when(F.col("_v").isNotNull(), F.sort_array(F.concat("attrs", F.array(F.struct(F.lit(key).alias("k"), F.col("_v").alias("v")))))).otherwise(F.col("attrs"))
    return joined.withColumn("attrs", more).select(*nodes.columns)
