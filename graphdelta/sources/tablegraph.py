"""Versioned graphs derived from relational tables, as (nodes, edges) keyed by graph_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphdelta.functions.similarity import doc_hash
from graphdelta.plans.schema import as_edges, as_nodes, fingerprint

SPACE = r"[\x20\x09-\x0D]+"
EVENT_CUT, SHIP_CUT = "2024-01-16", "1998-05-24"
#: A pair of nations counts as linked in a quarter from so many times its even share of the quarter's lines on.
LINK_SHARE = 1.3

Graph = tuple[DataFrame, DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def one_pair(spark: SparkSession, base: str = "base", head: str = "head") -> DataFrame:
    return spark.range(1).select(F.lit("p").alias("pair_id"), F.lit(base).alias("base_id"), F.lit(head).alias("head_id"))


def _text(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), *(F.col(p).cast("string") if isinstance(p, str) else p for p in parts))


def event_graph(spark: SparkSession, sf_dir: str, version: Column | None = None) -> Graph:
    """Variant nodes ``crate::U<user>::<type>`` and Transitions between consecutive, different events of a user. The version is
    that of the later event: base before EVENT_CUT, head from there on, unless given."""
    version = version if version is not None else F.when(F.col("ts") < F.lit(EVENT_CUT).cast("timestamp"), "base").otherwise("head")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    file = _text("src/u", F.col("user_id").cast("string"), F.lit(".rs"))
    state = lambda c: _text("crate::U", F.col("user_id").cast("string"), F.lit("::"), F.col(c))
    own = rows.withColumn("prev", F.lag("event_type").over(order)).select(version.alias("graph_id"), state("event_type").alias("id"), F.when(F.col("prev") != F.col("event_type"), state("prev")).alias("prev"), file.alias("file"), F.col("event_id").alias("seq"))
    nodes = own.groupBy("graph_id", "id").agg(F.min("file").alias("file"), F.min("seq").alias("seq")).withColumn("kind", F.lit("Variant"))
    edges = own.where("prev IS NOT NULL").groupBy("graph_id", F.col("prev").alias("from"), F.col("id").alias("to")).agg(F.min("file").alias("file"), F.min("seq").alias("seq"), F.min("seq").alias("start")).withColumn("kind", F.lit("Transitions"))
    return as_nodes(nodes), as_edges(edges)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, id, seq (the doc_id), text: base has even ids, head odd ones."""
    return table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(
        F.when(F.col("doc_id") % 2 == 0, "base").otherwise("head").alias("graph_id"),
        _text("crate::", F.col("lang"), F.lit("::"), F.col("source"), F.lit("::D"), F.col("doc_id").cast("string")).alias("id"),
        F.col("doc_id").alias("seq"), F.coalesce("text", F.lit("")).alias("text"),
    )


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once a row."""
    return F.transform(F.array(value), use)[0]


def word_counts(text: Column) -> Column:
    """array<(t, n)> of a text's distinct words in order: runs of its sorted words. One row's work, so nothing is shuffled and a task
    holds one text at a time."""
    words = F.sort_array(F.filter(F.split(text, SPACE), lambda w: w != ""))
    starts = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    run = lambda s, p: F.transform(p, lambda i, k: F.struct(F.get(s, i).alias("t"), (F.coalesce(F.get(p, k + 1), F.size(s)) - i).cast("int").alias("n")))
    none = F.array().cast("array<struct<t:string,n:int>>")
    return _once(words, lambda s: F.when(F.size(s) > 0, _once(starts(s), lambda p: run(s, p))).otherwise(none))


def text_fingerprint(text: Column) -> Column:
    """Members are a text's distinct words, field types their counts; the documentation is its first line."""
    doc = doc_hash(F.split(text, "\n")[0])

    def of(bag: Column) -> Column:
        types = F.transform(bag, lambda e: F.struct(e["t"].alias("m"), e["n"].cast("string").alias("t")))
        return fingerprint(F.transform(bag, lambda e: e["t"]), bag, types, None, doc)

    return _once(word_counts(text), of)


def document_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Struct nodes ``crate::<lang>::<source>::D<doc_id>`` with the fingerprints of their texts."""
    own = documents(spark, sf_dir)
    nodes = own.select("graph_id", "id", F.lit("Struct").alias("kind"), F.lit("docs.rs").alias("file"), "seq", text_fingerprint(F.col("text")).alias("fp"))
    return as_nodes(nodes), as_edges(nodes.limit(0).select("graph_id", F.col("id").alias("from"), F.col("id").alias("to"), F.lit("Associates").alias("kind")))


def supplier_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Struct nodes ``crate::N<nation>::S<supplier>`` per half of the ship dates: members are the brands supplied, each with
    the least type of part as its type."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.when(F.col("l_shipdate") < F.lit(SHIP_CUT).cast("timestamp"), "base").otherwise("head").alias("graph_id"))
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    brands = lines.join(parts, "l_partkey").groupBy("graph_id", "l_suppkey", "p_brand").agg(F.min("p_type").alias("t"), F.count("*").cast("int").alias("n"))
    per = brands.groupBy("graph_id", "l_suppkey").agg(F.collect_list(F.struct(F.col("p_brand").alias("m"), "t")).alias("mt"))
    named = per.join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
    counts = F.transform(F.array_distinct(F.col("mt.t")), lambda t: F.struct(t.alias("t"), F.size(F.filter("mt", lambda e: e["t"] == t)).alias("n")))
    fp = fingerprint(F.col("mt.m"), counts, F.col("mt"))
    return as_nodes(named.select("graph_id", _text("crate::N", F.col("s_nationkey").cast("string"), F.lit("::S"), F.col("l_suppkey").cast("string")).alias("id"), F.lit("Struct").alias("kind"), fp.alias("fp")))


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """graph_id, caller, callee, seq: each line of an order as a call ``crate::O<order>`` to ``crate::P<part>``. Lines repeat,
    so their place within the order is taken over all columns."""
    lines = table(spark, sf_dir, "lineitem")
    version = F.when(F.col("l_shipdate") < F.lit(SHIP_CUT).cast("timestamp"), "base").otherwise("head")
    columns = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    place = Window.partitionBy("l_orderkey").orderBy(*columns)
    return lines.select(version.alias("graph_id"), _text("crate::O", F.col("l_orderkey").cast("string")).alias("caller"), _text("crate::B", F.col("l_suppkey").cast("string"), F.lit("::P"), F.col("l_partkey").cast("string")).alias("callee"), "l_partkey", F.row_number().over(place).cast("long").alias("seq"))


def nation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A version per quarter (``1998Q2``): modules ``crate::R<region>`` and ``crate::R<region>::N<nation>``, Uses edges from
    a supplier's nation to a customer's where they trade more than LINK_SHARE of an even share, and both ways between a nation
    and its region."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.concat(F.year("l_shipdate").cast("string"), F.lit("Q"), F.quarter("l_shipdate").cast("string")).alias("graph_id"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cn"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("sn"))
    trade = lines.join(suppliers, "l_suppkey").join(orders, "l_orderkey").join(customers, "o_custkey").groupBy("graph_id", "sn", "cn").agg(F.count("*").alias("n"))
    total = trade.groupBy("graph_id").agg(F.sum("n").alias("total"))
    nations = table(spark, sf_dir, "nation")
    name = lambda r, n: _text("crate::R", F.col(r).cast("string"), F.lit("::N"), F.col(n).cast("string"))
    ids = nations.select(F.col("n_nationkey").alias("key"), name("n_regionkey", "n_nationkey").alias("id"), F.col("n_regionkey").alias("region"))
    linked = trade.join(total, "graph_id").where(F.col("n") * 625 > F.lit(LINK_SHARE) * F.col("total"))
    linked = linked.join(ids.select(F.col("key").alias("sn"), F.col("id").alias("from")), "sn").join(ids.select(F.col("key").alias("cn"), F.col("id").alias("to")), "cn").select("graph_id", "from", "to")
    versions = total.select("graph_id")
    homes = versions.crossJoin(ids.select("id", _text("crate::R", F.col("region").cast("string")).alias("home")))  # 25 rows a version
    edges = linked.unionByName(homes.select("graph_id", F.col("id").alias("from"), F.col("home").alias("to"))).unionByName(homes.select("graph_id", F.col("home").alias("from"), F.col("id").alias("to")))
    files = ids.select("id", _text("src/r", F.col("region").cast("string"), F.lit("/n"), F.col("key").cast("string"), F.lit(".rs")).alias("file")).unionByName(ids.select(_text("crate::R", F.col("region").cast("string")).alias("id"), _text("src/r", F.col("region").cast("string"), F.lit("/mod.rs")).alias("file")).distinct())
    nodes = versions.crossJoin(files).withColumn("kind", F.lit("Module"))
    return as_nodes(nodes), as_edges(edges.withColumn("kind", F.lit("Uses")))


def quarter_pairs(nodes: DataFrame) -> DataFrame:
    """pair_id (the later version), base_id, head_id of adjacent versions. Versions are few: the window is over their names."""
    versions = nodes.select("graph_id").distinct()
    order = Window.orderBy("graph_id")
    return versions.select(F.col("graph_id").alias("pair_id"), F.lag("graph_id").over(order).alias("base_id"), F.col("graph_id").alias("head_id")).where("base_id IS NOT NULL")


#: Two versions of a small schema: version, table, column, type.
SCHEMA_ROWS = (
    ("base", "users", "id", "Int4"), ("base", "users", "name", "Text"), ("base", "users", "age", "Int4"),
    ("base", "posts", "id", "Int4"), ("base", "posts", "user_id", "Int4"), ("base", "logs", "id", "Int8"),
    ("head", "users", "id", "Int8"), ("head", "users", "name", "Text"), ("head", "users", "email", "Text"),
    ("head", "posts", "id", "Int4"), ("head", "posts", "user_id", "Int4"), ("head", "tags", "id", "Int4"),
)
SCHEMA_KEYS = (("base", "posts", "users"), ("base", "logs", "users"), ("head", "posts", "users"), ("head", "tags", "posts"))


def schema_graph(spark: SparkSession, rows=SCHEMA_ROWS, keys=SCHEMA_KEYS) -> Graph:
    """Table nodes with their sorted columns as an attribute, and ForeignKey edges."""
    cells = spark.createDataFrame(list(rows), "graph_id string, id string, c string, t string")
    columns = F.array_join(F.sort_array(F.collect_list(F.concat("c", F.lit(": "), "t"))), ", ")
    attrs = F.array(F.struct(F.lit("columns").alias("k"), columns.alias("v")))
    nodes = cells.groupBy("graph_id", "id").agg(attrs.alias("attrs")).withColumn("kind", F.lit("Table")).withColumn("file", F.lit("src/schema.rs"))
    edges = spark.createDataFrame(list(keys), "graph_id string, `from` string, `to` string").withColumn("kind", F.lit("ForeignKey")).withColumn("file", F.lit("src/schema.rs"))
    return as_nodes(nodes), as_edges(edges)


def renamed_nations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Module nodes per version (base, head) and file renames: of nations with key % 5 = 2 the file and the last segment are
    renamed, of those with key % 5 = 3 the module moves below another region."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    text = lambda c: F.col(c).cast("string")
    old, old_file = _text("crate::R", text("r"), F.lit("::N"), text("k")), _text("src/r", text("r"), F.lit("/n"), text("k"), F.lit(".rs"))
    other = (F.col("r") + 1).cast("string")
    new = F.when(F.col("k") % 5 == 2, _text("crate::R", text("r"), F.lit("::M"), text("k"))).when(F.col("k") % 5 == 3, _text("crate::R", other, F.lit("::N"), text("k"))).otherwise(old)
    new_file = F.when(F.col("k") % 5 == 2, _text("src/r", text("r"), F.lit("/m"), text("k"), F.lit(".rs"))).when(F.col("k") % 5 == 3, _text("src/r", other, F.lit("/n"), text("k"), F.lit(".rs"))).otherwise(old_file)
    base = as_nodes(n.select(F.lit("base").alias("graph_id"), old.alias("id"), old_file.alias("file"), F.lit("Module").alias("kind")))
    head = as_nodes(n.select(F.lit("head").alias("graph_id"), new.alias("id"), new_file.alias("file"), F.lit("Module").alias("kind")))
    renames = n.where(F.col("k") % 5 >= 2).where(F.col("k") % 5 <= 3).select(F.lit("p").alias("pair_id"), old_file.alias("old_path"), new_file.alias("new_path"))
    return base, head, renames
