"""What a step may hold or send as its input grows."""

import re
from collections import Counter

from pyspark.sql import functions as F

from graphdelta.functions.similarity import similarity
from graphdelta.operators import diff, graphops, lint, match, tiles
from graphdelta.plans.config import Config
from graphdelta.sources import tablegraph as tg
from helpers import fp, nodes


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_in_their_row(spark, tmp_path):
    """no shuffle and no table of words, whatever a text holds; a document without a language counts like any other."""
    texts = ["", "  \n\t ", "b a b\x0bc  a\nb", "one", None, "Ü ü Ü"]
    docs = spark.createDataFrame([(i, x, None if i == 2 else "en", "web") for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    nodes, _ = tg.document_graph(spark, str(tmp_path))
    assert "Exchange" not in _plan(nodes) and "Aggregate" not in _plan(nodes)
    got = {r.seq: [(e.t, e.n) for e in r.fp.field_types] for r in nodes.collect()}
    words = lambda x: Counter(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    assert got == {i: sorted(words(x).items(), key=lambda e: e[0].encode()) for i, x in enumerate(texts)}
    assert {r.seq: sorted(r.m) for r in nodes.select("seq", F.col("fp.members").alias("m")).collect()} == {i: sorted(words(x)) for i, x in enumerate(texts)}


def _graph(spark, edges):
    return spark.createDataFrame([("p", a, b) for a, b in edges], "pair_id string, `from` string, `to` string")


def test_components_and_tiers_send_nothing_to_the_driver(spark):
    """no join of the components, tiers or state rules is a broadcast, whatever the size of a table's files."""
    rows = [(f"c{i}", f"n{i % 3}") for i in range(20)] + [("n0", "n1"), ("n1", "n2"), ("n2", "n0"), ("n0", "r"), ("s", "s"), ("r", "q"), ("q", "r"), ("q", "z")]
    edges = _graph(spark, rows)
    large = graphops.strong_components(edges, group_edges=3)
    expected = graphops.tarjan(rows)
    assert {r.id: r.component for r in large.collect()} == expected and large.count() == len(expected)
    tiers = graphops.crate_tiers(edges.select("pair_id", F.col("from").alias("id")), edges, ("pair_id",))
    assert "BroadcastHashJoin" not in _plan(graphops.colour_components(edges)) + _plan(tiers)
    assert {(r.id, r.tier) for r in tiers.collect()} == {*((f"c{i}", 3) for i in range(20)), ("n0", 2), ("n1", 2), ("n2", 2), ("r", 1), ("q", 1), ("s", 0)}
    nodes = edges.select("pair_id", F.explode(F.array("from", "to")).alias("id")).distinct().withColumn("kind", F.lit("Variant"))
    ways = edges.withColumn("kind", F.lit("Transitions"))
    changes = ways.select("pair_id", F.lit("EdgeAdded").alias("change"), "kind", F.col("from").alias("from_id"), F.col("to").alias("to_id"))
    found = lint.new_state_cycle(lint.Version(nodes, ways, changes, Config()), "deny")
    assert "BroadcastHashJoin" not in _plan(found)
    assert {r.message for r in found.collect()} == {"state cycle: n0 -> n1 -> n2", "state cycle: q -> r", "state cycle: s"}


def test_pairs_carry_numbers_alone(spark, monkeypatch):
    """F1 to F6: between the meeting of two nodes and their score a pair is two numbers, whatever its nodes hold; tiles of any size and
    tokens of any frequency give the same scores."""
    words = [f"w{i}" for i in range(12)]
    own = lambda seed: {"kind": "Struct", "fp": fp(w := [x for i, x in enumerate(words) if seed * (i + 3) % 7 < 4], [(x, 1 + (seed + len(x)) % 3) for x in w], doc=str(seed % 2), neighbors=w[: seed % 3])}
    base, head = ([{"id": f"crate::{side}{i}", **own(i * step)} for i in range(14)] for side, step in (("A", 3), ("B", 5)))
    for x in (base, head):
        x.append({"id": f"crate::{x[0]['id'][-2]}_empty", "kind": "Struct", "fp": fp()})
    removed, added = match.sides(diff.node_delta(nodes(spark, base), nodes(spark, head)))
    seen = []
    scored = match._scored
    monkeypatch.setattr(match, "_scored", lambda met, *rest: seen.append(met.dtypes) or scored(met, *rest))
    pairs = removed.select("rid", F.col("fp").alias("f")).crossJoin(added.select("aid", F.col("fp").alias("g")))
    expected = {(r.rid, r.aid): r.s for r in pairs.select("rid", "aid", similarity(F.col("f"), F.col("g")).alias("s")).collect() if r.s >= 0.5}
    for most, often in ((4096, 64), (3, 2)):
        monkeypatch.setattr(tiles, "TILE_NODES", most)
        monkeypatch.setattr(match, "OFTEN_PAIRS", often)
        assert {(r.rid, r.aid): r.score for r in match.candidates(removed, added, 0.5).collect()} == expected
    assert len(expected) > 10 and all(x == [("node", "bigint"), ("node2", "bigint")] for x in seen) and len(seen) == 2
