"""Snapshots, renames and logs as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphdelta.plans.schema import EDGES, NODES



def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The store: Parquet by graph_id, one folder a version, so that a pair of versions reads two folders."""
    for name, table in (("nodes", nodes), ("edges", edges)):
        table.repartition("graph_id").write.mode("append").partitionBy("graph_id").parquet(f"{path}/{name}")


def read_graph(spark: SparkSession, path: str, graph_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    out = []
    for name, schema in (("nodes", NODES), ("edges", EDGES)):
        table = spark.read.schema(schema).parquet(f"{path}/{name}")
        out.append(table.where(F.col("graph_id").isin(graph_ids)) if graph_ids is not None else table)
    return out[0], out[1]


def missing(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Versions (graph_id) of `wanted` that the store lacks; only these are extracted."""
    return wanted.select("graph_id").distinct().join(spark.read.schema(NODES).parquet(f"{path}/nodes").select("graph_id").distinct(), "graph_id", "left_anti")


def write_snapshot(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """JSON lines: one folder of nodes, one of edges, in a stable order within each file."""
    nodes.sortWithinPartitions("graph_id", "id", "seq").write.mode("overwrite").json(f"{path}/nodes")
    edges.sortWithinPartitions("graph_id", "from", "to", "kind", "ordinal").write.mode("overwrite").json(f"{path}/edges")


def read_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.schema(NODES).json(f"{path}/nodes"), spark.read.schema(EDGES).json(f"{path}/edges")


def snapshot_text(nodes: DataFrame, edges: DataFrame) -> str:
    """One version as a JSON document, for a file or a pipe: nodes and edges in the order of a sink."""
    import json

    from graphdelta.plans.schema import normalize_edges, normalize_nodes

    rows = lambda df: [json.loads(x) for x in df.select(F.to_json(F.struct("*")).alias("j")).toPandas()["j"]]
    return json.dumps({"nodes": rows(normalize_nodes(nodes)), "edges": rows(normalize_edges(edges))}, ensure_ascii=False, indent=1) + "\n"


def read_snapshot_text(spark: SparkSession, path: str, graph_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of snapshot_text(), under a graph_id of their own."""
    whole = spark.read.option("multiLine", True).schema(f"nodes array<struct<{_fields(NODES)}>>, edges array<struct<{_fields(EDGES)}>>").json(path)
    return tuple(whole.select(F.explode(c).alias("x")).select("x.*").withColumn("graph_id", F.lit(graph_id)) for c in ("nodes", "edges"))


def _fields(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in StructType.fromDDL(ddl))


def read_renames(spark: SparkSession, path: str, pair_id: str = "p") -> DataFrame:
    """pair_id, old_path, new_path of the R rows of tab-separated name-status text."""
    cells = F.split("value", "\t")
    rows = spark.read.text(path).where(F.col("value").startswith("R")).where(F.size(cells) >= 3)
    return rows.select(F.lit(pair_id).alias("pair_id"), F.get(cells, F.lit(1)).alias("old_path"), F.get(cells, F.lit(2)).alias("new_path"))


def read_log(spark: SparkSession, path: str, repo: str = "repo") -> DataFrame:
    """repo, pos, sha, subject of lines ``sha<TAB>subject``, oldest first. The order is the file's: positions come from line
    offsets within one file, which a log is."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("pos", "line")).where("line != ''")
    return rows.select(F.lit(repo).alias("repo"), F.col("pos").cast("long"), F.split("line", "\t")[0].alias("sha"), F.coalesce(F.get(F.split("line", "\t"), F.lit(1)), F.lit("")).alias("subject"))


def version_pairs(log: DataFrame) -> DataFrame:
    """pair_id (the later version), repo, base_id, head_id of neighbours."""
    order = Window.partitionBy("repo").orderBy("pos")
    return log.select("repo", F.col("sha").alias("pair_id"), F.lag("sha").over(order).alias("base_id"), F.col("sha").alias("head_id")).where("base_id IS NOT NULL")
