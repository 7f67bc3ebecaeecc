"""Small graphs for tests."""



FP = "struct<members:array<string>,field_types:array<struct<t:string,n:int>>,member_types:array<struct<m:string,t:string>>,neighbors:array<string>,doc_hash:string>"


def fp(members=(), types=(), member_types=(), doc="0", neighbors=()):
    return {"members": sorted(members), "field_types": [{"t": t, "n": n} for t, n in sorted(types)], "member_types": [{"m": m, "t": t} for m, t in sorted(member_types)], "neighbors": sorted(neighbors), "doc_hash": doc}


def nodes(spark, rows, keyed="p"):
    """rows: dicts with id, kind and what else is not the default."""
    schema = f"pair_id string, id string, kind string, file string, start long, end long, attrs array<struct<k:string,v:string>>, fp {FP}, seq long"
    full = [(r.get("pair_id", keyed), r["id"], r.get("kind", "Module"), r.get("file", "f.rs"), r.get("start", 0), r.get("end", 0), [{"k": k, "v": v} for k, v in sorted(r.get("attrs", {}).items())], r.get("fp"), r.get("seq", i)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schema)


def edges(spark, rows, keyed="p"):
    """rows: (from, to, kind, ordinal) or shorter."""
    schema = "pair_id string, `from` string, `to` string, kind string, file string, start long, `end` long, ordinal int, seq long"
    full = []
    for i, r in enumerate(rows):
        a, b, kind, ordinal = [*r, *(None,) * (4 - len(r))]
        full.append((keyed, a, b, kind or "Uses", "f.rs", 0, 0, ordinal, i))
    return spark.createDataFrame(full, schema)


