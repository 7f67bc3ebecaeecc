"""Small tables for tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, sources=None):
    """texts: a list, numbered from 0, or pairs of id and text."""
    pairs = list(enumerate(texts)) if not texts or not isinstance(texts[0], tuple) else texts
    rows = [(i, t, "en", (sources or {}).get(i, "s"), None if t is None else len(t)) for i, t in pairs]
    return spark.createDataFrame(rows, DOCS)


def odd(spark, texts):
    """The same with columns that clash with names used inside."""
    from pyspark.sql import functions as F

    return documents(spark, texts).withColumns({c: F.lit(7) for c in ("score", "_text", "_0", "ratio", "n", "component", "component_id", "bands", "a", "b", "key", "_label", "_gone", "_null")})


def root(up, x):
    while up.setdefault(x, x) != x:
        x = up[x]
    return x


def union(pairs, ids):
    """Least id of each component."""
    up = {}
    for a, b in pairs:
        a, b = root(up, a), root(up, b)
        up[max(a, b)] = min(a, b)
    return {i: root(up, i) for i in ids}
