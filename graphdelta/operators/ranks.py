"""Row numbers within keys of which one may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphdelta.operators.scratch import materialize


def numbered(df: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """df with `name`: row_number() within keys by order (ascending), without one task per key. Rows are dealt out by ranges of
    keys and order, numbered within a range, and each range adds the rows that its key has in the ranges before."""
    columns = {f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    dealt = df.withColumns(columns)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(dealt.repartitionByRange(parts, *keys, *columns).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # at most a row per range and key
    own = dealt.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*columns)))
    same = [own[k].eqNullSafe(offsets[k]) for k in (*keys, "_part")]
    joined = own.join(F.broadcast(offsets) if not keys else offsets, same)
    return joined.select(*(own[c] for c in df.columns), (own[name] + offsets["_before"]).cast("long").alias(name))
