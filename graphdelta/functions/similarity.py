"""Structural similarity of two fingerprints, as column expressions that stay in the JVM."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Weights:
    members: float = 0.4
    field_types: float = 0.4
    neighbors: float = 0.1
    doc: float = 0.1

    @property
    def total(self) -> float:
        return self.members + self.field_types + self.neighbors + self.doc


DEFAULT = Weights()


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; two empty ones are alike. The union's size follows from the intersection's, which is
    built once."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(F.transform(F.array(common), lambda c: c / (F.size(a) + F.size(b) - c))[0])


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of (t, n), each t once: sum of the lesser counts by sum of the greater ones; nothing on both sides is
    alike. The greater ones sum to all counts less the lesser ones."""
    entries = lambda x: F.map_from_entries(F.transform(x, lambda e: F.struct(e["t"], e["n"].cast("long"))))
    zero = F.lit(0).cast("long")
    total = lambda x: F.aggregate(x, zero, lambda s, e: s + e["n"])
    lesser = F.map_values(F.map_zip_with(entries(a), entries(b), lambda k, x, y: F.least(F.coalesce(x, zero), F.coalesce(y, zero))))
    every = total(a) + total(b)
    return F.when(every == 0, F.lit(1.0)).otherwise(F.transform(F.array(F.aggregate(lesser, zero, lambda s, c: s + c)), lambda c: c / (every - c))[0])


def doc_hash(doc: Column) -> Column:
    """Equality is all that is asked of it; blank documentation hashes to '0'."""
    return F.when(F.trim(doc) == "", "0").otherwise(F.sha2(F.trim(doc), 256))


def similarity(a: Column, b: Column, w: Weights = DEFAULT) -> Column:
    """Weighted mean over members, field types, neighbours and documentation; 0 if the weights sum to nothing."""
    if w.total <= 0:
        return F.lit(0.0)
    same = F.when(a["doc_hash"] == b["doc_hash"], 1.0).otherwise(0.0)
    score = jaccard(a["members"], b["members"]) * w.members + multiset_jaccard(a["field_types"], b["field_types"]) * w.field_types
    return (score + jaccard(a["neighbors"], b["neighbors"]) * w.neighbors + same * w.doc) / w.total
