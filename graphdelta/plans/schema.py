"""Tables of the engine: nodes and edges keyed by graph_id, changes and findings keyed by pair_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FP = "struct<members:array<string>,field_types:array<struct<t:string,n:int>>,member_types:array<struct<m:string,t:string>>,neighbors:array<string>,doc_hash:string>"
ATTRS = "array<struct<k:string,v:string>>"
NODES = f"graph_id string, id string, kind string, file string, start long, end long, attrs {ATTRS}, fp {FP}, seq long"
EDGES = "graph_id string, `from` string, `to` string, kind string, file string, start long, end long, ordinal int, seq long"
RENAMES = "pair_id string, old_path string, new_path string"
NODE_KINDS = ("Module", "Struct", "Enum", "Trait", "Fn", "Variant", "Table")
EDGE_KINDS = ("Uses", "Implements", "Associates", "Calls", "Transitions", "ForeignKey")
CHANGES = ("Added", "Removed", "Modified", "Moved", "EdgeAdded", "EdgeRemoved")


def rank(c: Column | str, names: tuple[str, ...]) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return (F.array_position(F.array(*map(F.lit, names)), c) - 1).cast("int")


def empty_attrs() -> Column:
    return F.array().cast(ATTRS)


def no_fp() -> Column:
    return F.lit(None).cast(FP)


def fingerprint(members: Column, field_types: Column | None = None, member_types: Column | None = None, neighbors: Column | None = None, doc_hash: Column | None = None) -> Column:
    """Canonical: all arrays sorted, sets without repeats."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.sort_array(F.array_distinct(members)).alias("members"),
        (F.sort_array(field_types) if field_types is not None else F.array().cast("array<struct<t:string,n:int>>")).alias("field_types"),
        (F.sort_array(member_types) if member_types is not None else F.array().cast("array<struct<m:string,t:string>>")).alias("member_types"),
        (F.sort_array(F.array_distinct(neighbors)) if neighbors is not None else none).alias("neighbors"),
        (doc_hash if doc_hash is not None else F.lit("0")).alias("doc_hash"),
    ).cast(FP)


def as_nodes(df: DataFrame) -> DataFrame:
    """Fill what a producer leaves out."""
    given = set(df.columns)
    default = {"file": F.lit(""), "start": F.lit(0), "end": F.lit(0), "attrs": empty_attrs(), "fp": no_fp(), "seq": F.lit(0), "graph_id": F.lit("")}
    kinds = dict(graph_id="string", id="string", kind="string", file="string", start="long", end="long", attrs=ATTRS, fp=FP, seq="long")
    return df.select(*((F.col(c) if c in given else default[c]).cast(t).alias(c) for c, t in kinds.items()))


def as_edges(df: DataFrame) -> DataFrame:
    given = set(df.columns)
    default = {"file": F.lit(""), "start": F.lit(0), "end": F.lit(0), "ordinal": F.lit(None), "seq": F.lit(0), "graph_id": F.lit("")}
    kinds = {"graph_id": "string", "from": "string", "to": "string", "kind": "string", "file": "string", "start": "long", "end": "long", "ordinal": "int", "seq": "long"}
    return df.select(*((F.col(c) if c in given else default[c]).cast(t).alias(c) for c, t in kinds.items()))


def normalize_nodes(nodes: DataFrame) -> DataFrame:
    """Total order of a sink."""
    return nodes.orderBy("graph_id", "id", "seq")


def normalize_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("graph_id", "from", "to", rank("kind", EDGE_KINDS), "ordinal", "file", "start", "end")


def union_graphs(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    return a[0].unionByName(b[0]), a[1].unionByName(b[1])
