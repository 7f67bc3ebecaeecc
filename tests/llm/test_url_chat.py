import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphdelta.llm import chat_format, url_filter
from graphdelta.llm.url_filter import Rule

SF = "/root/testdata/sf0.001"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")


def judged(frame):
    return {r.page_id: r for r in frame.collect()}


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.ORG/es/x?q=1", "https://example.org/en/12#f", "http://x.org", "ftp://b.com/fr/", "http://b.com/de/1?x", None, "no scheme", "", "http://", "http://b.com?fr/", "http://notorg/", "http://example.org/en/2", "a://b.com/de/://c.org/"]
    got = judged(url_filter.filter_urls(pages(spark, [(u, None) for u in urls])))
    seen = [(r.host, r.path, r.rule, r.verdict) for _, r in sorted(got.items())]
    assert seen == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("x.org", "", None, "allow"), ("b.com", "/fr/", "com/fr/", "allow"), ("b.com", "/de/1", "com/de/", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b.com", "", None, "allow"), ("notorg", "/", None, "allow"), ("example.org", "/en/2", "org/", "allow"), ("b.com", "/de/://c.org/", "com/de/", "block"),
    ]


def test_joined_rules_agree_with_inline_ones(spark):
    urls = [f"http://{h}/{p}" for h in ("a.b.com", "b.com", "com", "x.org", "") for p in ("", "fr/1", "de/2", "fr/x/y")]
    rules = (*url_filter.RULES, Rule("b.com/fr/", "block"), Rule("a.b.com/fr/x", "allow"), Rule("com/fr/", "block"))
    named = url_filter.with_host(pages(spark, [(u, None) for u in urls]))
    table = spark.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "host string, path string, rule string, verdict string")
    pick = lambda df: sorted((r.page_id, r.rule, r.rule_verdict) for r in df.collect())
    assert pick(url_filter.match_inline(named, rules)) == pick(url_filter.match_joined(named, table))


def brute_rank(seed, edges, damping, rounds):
    """Power iteration; edges: {(src, dst): weight}."""
    hosts = {*seed, *(x for e in edges for x in e)}
    total = sum(seed.values()) or 1.0
    start = {h: seed.get(h, 0.0) / total for h in hosts}
    out = {h: sum(w for (a, _), w in edges.items() if a == h) for h in hosts}
    rank = dict(start)
    for _ in range(rounds):
        rank = {h: (1 - damping) * start[h] + damping * sum(rank[a] * w / out[a] for (a, b), w in edges.items() if b == h) for h in hosts}
    n = sum(rank.values()) or 1.0
    return {h: r / n for h, r in rank.items()}


def test_scores_spread_over_links(spark):
    link = lambda *hosts: "".join(f'<a href="http://{h}/x">y</a>' for h in hosts)
    rows = [("http://good.org/a", link("m.net", "n.net")), ("http://m.net/1", link("n.net")), ("http://spam.net/1", link("bad.com", "bad.com")), ("http://bad.com/de/1", link("good.org")), ("http://lone.net/", ""), ("http://n.net/", None)]
    frame = pages(spark, rows)
    got = judged(url_filter.filter_urls(frame))
    verdict = {r.host: r.verdict for r in got.values()}
    assert verdict == {"good.org": "allow", "m.net": "allow", "n.net": "allow", "spam.net": "block", "bad.com": "block", "lone.net": "allow"}
    edges = {("good.org", "m.net"): 1.0, ("good.org", "n.net"): 1.0, ("m.net", "n.net"): 1.0, ("spam.net", "bad.com"): 1.0, ("bad.com", "good.org"): 1.0}
    trust = brute_rank({"good.org": 1.0}, edges, 0.85, 20)
    distrust = brute_rank({"bad.com": 1.0}, {(b, a): w for (a, b), w in edges.items()}, 0.85, 20)
    for r in got.values():
        assert abs((r.trust or 0) - trust.get(r.host, 0)) < 1e-6
        assert abs((r.distrust or 0) - distrust.get(r.host, 0)) < 1e-6


def test_url_edge_tables(spark):
    empty = pages(spark, [])
    assert url_filter.filter_urls(empty).count() == 0
    wide = pages(spark, [("http://a.org/", None), ("http://a.org/", None)]).withColumn("host", F.lit(1)).withColumn("trust", F.lit(2))
    assert url_filter.filter_urls(wide).count() == 2


def test_query_plans_have_no_python(spark):
    for frame in (url_filter.op1_url_filter(spark, SF), chat_format.op10_chat_format(spark, SF)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# ---- conversations -----------------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_digest(turns):
    ordered = sorted(turns)
    said = "".join(f"{r}\n{t}\n" for _, r, t in ordered)
    loss = "".join(t for _, r, t in ordered if r == "assistant")
    return len(ordered), sha(said), len(loss), sha(loss)


TEXTS = st.sampled_from(["", "a b c", "</s>[INST] ok [/INST]", "<s>[ROLE] x [TEXT] y</s>", "\\s\\l\\b \\", "é😀 [", "w " * 40, "line\nline\r\n", "<<SYS>>"])


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 9), st.sampled_from(["user", "assistant", "system", "[x]"]), TEXTS), min_size=1, max_size=25), st.sampled_from([4, 20, 1000]), st.sampled_from([0, 8]))
def test_windows_read_back(spark, rows, budget, history):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat_format.format_conversations(frame, budget, history)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.digests(chat_format.read_back(windows)).collect()}
    want = {c: brute_digest([(t, r, x) for k, t, r, x in rows if k == c]) for c in {r[0] for r in rows}}
    assert got == want
    for w in windows.collect():
        assert w.formatted.count("</s>") == w.formatted.count("<s>[ROLE] ")


def test_windows_keep_the_system_turn_and_repeat_history(spark):
    rows = [(0, 0, "system", "be kind"), *((0, k, "user" if k % 2 else "assistant", f"w{k} x y") for k in range(1, 9))]
    windows = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 16, 4).orderBy("window").collect()
    assert len(windows) > 1
    for w in windows[1:]:
        assert w.formatted.startswith("<s>[ROLE] system [TEXT] be kind</s>")
        assert w.n_repeated == 2  # the system turn and one of history
    masked = [w.formatted[s.start : s.start + s.length] for w in windows for s in w.loss]
    assert masked == [f"w{k} x y" for k in range(2, 9, 2)]
    for w in windows:
        assert sum(len(t.split()) + 1 for t in w.formatted.replace("<s>[ROLE] ", "\n").replace(" [TEXT] ", "\n").replace("</s>", "").split("\n")[2::2]) <= 16


def test_chat_nulls_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string, window int"
    frame = spark.createDataFrame([(None, None, None, None, 1), (1, None, "assistant", None, 1), (1, 0, "assistant", "x", 2), (1, 0, "assistant", "x", 2)], schema)
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat_format.digests(chat_format.read_back(chat_format.format_conversations(frame))).collect()}
    assert got == {None: (1, 0), 1: (3, 2)}
    assert chat_format.format_conversations(frame.limit(0)).count() == 0


def test_chat_query(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{SF}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat_format.op10_chat_format(spark, SF).collect()}
    assert got == {c: brute_digest([x[1:] for x in rows if x[0] == c]) for c in {x[0] for x in rows}}


def test_sql_twin_on_a_linked_graph(spark, tmp_path):
    import random

    import duckdb

    rng = random.Random(8)
    hosts = ["good.org", "a.good.org", "bad.com", "m.net", "n.net", "spam.net", "x.io"]
    rows = [(f"http://{rng.choice(hosts)}/{rng.choice(['de', 'fr', 'x', 'es'])}/{i}", "".join(f"<a HREF='//{rng.choice(hosts).upper()}/p'>t</a>" for _ in range(rng.randrange(4)))) for i in range(120)]
    pages(spark, [*rows, (None, None)]).coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = con.execute(url_filter.OP1_SQL)
    names = [x[0] for x in found.description]
    want = sorted((dict(zip(names, r, strict=True)) for r in found.fetchall()), key=lambda r: r["page_id"])
    got = sorted((r.asDict() for r in url_filter.op1_url_filter(spark, str(tmp_path)).collect()), key=lambda r: r["page_id"])
    for a, b in zip(got, want, strict=True):
        assert {k: a[k] for k in ("page_id", "host", "path", "rule", "verdict")} == {k: b[k] for k in ("page_id", "host", "path", "rule", "verdict")}
        assert all(abs((a[k] or 0) - (b[k] or 0)) < 2e-9 for k in ("trust", "distrust"))
