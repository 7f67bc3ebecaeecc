"""Versions that arrive as a stream: each micro-batch of graphs is compared with the last version of its repository.

An extension: batch `walk` has the same result for versions that are all there. The state is a table of the last graph per
repository in the shared folder, replaced at the end of a batch, so a batch that is repeated finds what it found before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphdelta.operators import diff, reports
from graphdelta.operators.scratch import materialize

#: A row is a node or an edge of one version: repo, pos, and the columns of both tables, `table` telling them apart.
NODE = ("id", "kind", "file", "start", "end", "attrs", "fp", "seq")
EDGE = ("from", "to", "kind", "file", "start", "end", "ordinal", "seq")


def last_versions(rows: DataFrame) -> DataFrame:
    top = rows.groupBy("repo").agg(F.max("pos").alias("pos"))
    return rows.join(top, ["repo", "pos"], "left_semi")


def drifts(rows: DataFrame) -> DataFrame:
    """repo, pos and counters of every version that has an earlier one among the rows."""
    versions = rows.select("repo", "pos").distinct()
    order = Window.partitionBy("repo").orderBy("pos")
    name = lambda p: F.concat_ws("@", "repo", p)
    pairs = versions.withColumn("before", F.lag("pos").over(order)).where("before IS NOT NULL").select("repo", "pos", name("pos").alias("pair_id"), name("before").alias("base_id"), name("pos").alias("head_id"))
    keyed = rows.withColumn("graph_id", name("pos"))
    nodes = keyed.where("table = 'node'").select("graph_id", *NODE)
    edges = keyed.where("table = 'edge'").select("graph_id", *(F.col(f"`{c}`") for c in EDGE))
    (bn, hn), (be, he) = diff.sides(nodes, pairs), diff.sides(edges, pairs)
    counted = reports.drift(diff.diff((bn, be), (hn, he), None))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counted.columns if c != "pair_id"]
    return pairs.select("repo", "pos", "pair_id").join(counted, "pair_id", "left").select("repo", "pos", *zero)


def walk(stream: DataFrame, state: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Write drifts of a stream of version rows to Parquet under sink, one folder per batch; state: a folder of last versions."""
    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        path = f"{state}/{number - 1}"
        jvm = spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        known = there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)
        every = materialize(rows.unionByName(spark.read.schema(rows.schema).parquet(path)) if known else rows)
        drifts(every).write.mode("overwrite").parquet(f"{sink}/batch={number}")
        last_versions(every).write.mode("overwrite").parquet(f"{state}/{number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
