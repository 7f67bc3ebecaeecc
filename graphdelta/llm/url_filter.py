"""URL filter: rules first, then trust and distrust that spread over the host graph. DataFrame functions alone.

1. Each url gives a host and a path; the longest fitting rule decides (its string's length; then block before
   allow, then the string). Few rules become one expression; many are joined on (host suffix, path prefix).
2. Pages link hosts: an edge counts the pages of one host that link to the other; links within a host go.
3. Personalised PageRank starts at hosts by the share of their pages that a rule allows and runs along the edges
   (trust); the same from blocked shares runs against them (distrust: who links to blocked hosts). Both are scaled
   to sum 1. A host is blocked if its distrust exceeds `block_share` of the sum of both; a host that neither
   reaches is allowed.

Cases: a null url, or one without ``://``, has an empty host and path, fits no rule and is allowed; null html has no
links; repeated rows each get their row; an empty table gives no rows; columns beyond page_id, url and html are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphdelta.llm._common import discard, materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"(?i)href\s*=\s*[\x22']?(?:https?:)?//([^/?#\x22'\s<>]+)"
DAMPING, ROUNDS, BLOCK_SHARE, INLINE_RULES = 0.85, 20, 0.75, 64


@dataclass(frozen=True)
class Rule:
    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"), Rule("com/fr/", "allow"), Rule("com/de/", "block"))


def with_host(pages: DataFrame) -> DataFrame:
    url = F.coalesce("url", F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return pages.withColumns({
        "host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    })


def _fits(rule: Rule) -> Column:
    host = (F.col("host") == rule.host) | F.endswith("host", F.lit("." + rule.host))
    return host & F.startswith("path", F.lit(rule.path))


def match_inline(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.verdict != "block", r.text))
    none = F.lit(None).cast("string")
    if not ordered:
        return pages.withColumns({"rule": none, "rule_verdict": none})
    pick = reduce(lambda c, i: c.when(_fits(ordered[i]), F.lit(i)), range(1, len(ordered)), F.when(_fits(ordered[0]), F.lit(0)))
    names, verdicts = (F.array(*(F.lit(getattr(r, k)) for r in ordered)) for k in ("text", "verdict"))
    return pages.withColumn("_rule", pick).withColumns({"rule": F.get(names, F.col("_rule")), "rule_verdict": F.get(verdicts, F.col("_rule"))}).drop("_rule")


def match_joined(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """For many rules (host, path, rule, verdict): each url is looked up under every suffix of its host and, there, under
    the prefixes of its path that have the length of some rule of that suffix; all joins are on equal keys."""
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths")).withColumnRenamed("host", "suffix")
    urls = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tried = urls.withColumn("suffix", F.explode(suffixes)).join(lengths, "suffix")
    tried = tried.withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("path")).withColumn("prefix", F.substring("path", F.lit(1), F.col("n")))
    keyed = rules.select(F.col("host").alias("suffix"), F.col("path").alias("prefix"), F.struct(F.length("rule").alias("n"), (F.col("verdict") == "block").alias("block"), F.col("rule")).alias("r"), "verdict")
    best = tried.join(keyed, ["suffix", "prefix"]).groupBy("host", "path").agg(F.max("r").alias("r"))
    best = best.select("host", "path", F.col("r.rule").alias("rule"), F.when(F.col("r.block"), "block").otherwise("allow").alias("rule_verdict"))
    return pages.join(best, ["host", "path"], "left")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, w: pages of src that link to dst."""
    hosts = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)), lambda h: F.translate(h, UPPER, LOWER)))
    links = pages.where(F.col("host") != "").select(F.col("host").alias("src"), F.explode(hosts).alias("dst")).where(F.col("src") != F.col("dst"))
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("w"))


def host_scores(hosts: DataFrame, edges: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """host, trust, distrust. hosts: host, allow and block, the shares of their pages. Mass that leaves by hosts without
    edges is not handed on: that only scales the vector, and both are scaled to sum 1 at the end."""
    sums = hosts.agg(F.sum("allow"), F.sum("block")).first()
    share = lambda c, total: F.col(c) / F.lit(float(total or 1.0))
    seeds = hosts.select("host", share("allow", sums[0]).alias("trust"), share("block", sums[1]).alias("distrust"))
    edges = materialize(edges, "edges")
    if edges.isEmpty():
        discard(edges)
        return seeds
    out = edges.groupBy("src").agg(F.sum("w").alias("out"))
    into = edges.groupBy("dst").agg(F.sum("w").alias("into"))
    weighted = materialize(edges.join(out, "src").join(into, "dst").select("src", "dst", (F.col("w") / F.col("out")).alias("ahead"), (F.col("w") / F.col("into")).alias("back")), "weights")
    everyone = seeds.unionByName(weighted.select(F.explode(F.array("src", "dst")).alias("host"), F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust")))
    seeds = materialize(everyone.groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "seeds")
    ranks, old = seeds, []
    for k in range(rounds):
        zero = F.lit(0.0)
        ahead = weighted.join(ranks, F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("trust") * F.col("ahead")).alias("trust"), zero.alias("distrust"))
        back = weighted.join(ranks, F.col("dst") == F.col("host")).select(F.col("src").alias("host"), zero.alias("trust"), (F.col("distrust") * F.col("back")).alias("distrust"))
        start = seeds.select("host", *((F.col(c) * ((1 - damping) / damping)).alias(c) for c in ("trust", "distrust")))
        ranks = ahead.unionByName(back).unionByName(start).groupBy("host").agg(*((F.sum(c) * damping).alias(c) for c in ("trust", "distrust")))
        if k % 4 == 3 or k == rounds - 1:
            ranks = materialize(ranks, "ranks")
            discard(*old)
            old = [ranks]
    discard(edges)
    sums = ranks.agg(F.sum("trust"), F.sum("distrust")).first()
    return ranks.select("host", (F.col("trust") / F.lit(sums[0] or 1.0)).alias("trust"), (F.col("distrust") / F.lit(sums[1] or 1.0)).alias("distrust"))


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, block_share: float = BLOCK_SHARE) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of the host (null under no host)."""
    named = with_host(pages.select("page_id", "url", "html"))
    if len(rules) <= INLINE_RULES:
        judged = match_inline(named, rules)
    else:
        rows = pages.sparkSession.createDataFrame([(r.host, r.path, r.text, r.verdict) for r in rules], "host string, path string, rule string, verdict string")
        judged = match_joined(named, rows)
    is_ = lambda v: F.avg(F.when(F.col("rule_verdict") == v, 1.0).otherwise(0.0))
    hosts = materialize(judged.where(F.col("host") != "").groupBy("host").agg(is_("allow").alias("allow"), is_("block").alias("block")), "hosts")
    scores = host_scores(hosts, host_edges(named), damping, rounds)
    share = F.coalesce(F.round(F.col("distrust") / F.nullif(F.col("trust") + F.col("distrust"), F.lit(0.0)), 9), F.lit(0.0))
    own = F.when(share > block_share, "block").otherwise("allow")
    judged = judged.select("page_id", "host", "path", "rule", "rule_verdict").join(scores, "host", "left")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


#: One step of both walks is a sum over weighted flows; the host chr(0) holds 1 and hands out the seeds.
OP1_SQL = r"""
WITH RECURSIVE rules(host, path, rule, verdict) AS (VALUES ('org', '/', 'org/', 'allow'), ('example.org', '/es/', 'example.org/es/', 'block'), ('example.org', '/en/1', 'example.org/en/1', 'block'), ('com', '/fr/', 'com/fr/', 'allow'), ('com', '/de/', 'com/de/', 'block')),
u AS (SELECT row_number() OVER () AS n, page_id, coalesce(html, '') AS html, coalesce(url, '') AS url FROM pages),
r AS (SELECT n, page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM u),
h AS (SELECT n, page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
best AS (SELECT n, rule, verdict FROM h JOIN rules ON (h.host = rules.host OR ends_with(h.host, '.' || rules.host)) AND starts_with(h.path, rules.path)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC, verdict DESC, rule) = 1),
judged AS (SELECT h.*, best.rule, best.verdict FROM h LEFT JOIN best USING (n)),
links AS (SELECT DISTINCT n, host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\s*=\s*[\x22\x27]?(?:https?:)?//([^/?#\x22\x27\s<>]+)', 1)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM h WHERE host <> ''),
edges AS (SELECT src, dst, count(*)::DOUBLE AS w FROM links WHERE src <> dst GROUP BY src, dst),
shares AS (SELECT host, avg((verdict IS NOT DISTINCT FROM 'allow')::INT) AS allow, avg((verdict IS NOT DISTINCT FROM 'block')::INT) AS block FROM judged WHERE host <> '' GROUP BY host),
everyone AS (SELECT host FROM shares UNION SELECT src FROM edges UNION SELECT dst FROM edges),
seeds AS (SELECT host, 't' AS kind, coalesce(allow, 0) / coalesce(nullif((SELECT sum(allow) FROM shares), 0), 1) AS v FROM everyone LEFT JOIN shares USING (host)
  UNION ALL SELECT host, 'd', coalesce(block, 0) / coalesce(nullif((SELECT sum(block) FROM shares), 0), 1) FROM everyone LEFT JOIN shares USING (host)),
flow AS (SELECT src, dst, 't' AS kind, 0.85::DOUBLE * w / sum(w) OVER (PARTITION BY src) AS w FROM edges UNION ALL SELECT dst, src, 'd', 0.85::DOUBLE * w / sum(w) OVER (PARTITION BY dst) FROM edges
  UNION ALL SELECT chr(0), host, kind, 0.15::DOUBLE * v FROM seeds UNION ALL SELECT chr(0), chr(0), kind, 1::DOUBLE FROM (VALUES ('t'), ('d')) x(kind)),
walk AS (SELECT 0 AS k, host, kind, v::DOUBLE AS v FROM seeds UNION ALL SELECT 0, chr(0), kind, 1::DOUBLE FROM (VALUES ('t'), ('d')) x(kind)
  UNION ALL SELECT w.k + 1, f.dst, f.kind, sum(w.v * f.w) FROM walk w JOIN flow f ON f.kind = w.kind AND f.src = w.host WHERE w.k < 20 GROUP BY w.k, f.dst, f.kind),
ranks AS (SELECT host, kind, v / coalesce(nullif(sum(v) OVER (PARTITION BY kind), 0), 1) AS v FROM walk WHERE k = 20 AND host <> chr(0)),
scores AS (SELECT t.host, t.v AS trust, d.v AS distrust FROM ranks t JOIN ranks d ON d.host = t.host AND d.kind = 'd' WHERE t.kind = 't')
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN coalesce(round(distrust / nullif(trust + distrust, 0), 9), 0) > 0.75 THEN 'block' ELSE 'allow' END) AS verdict, round(trust, 9) AS trust, round(distrust, 9) AS distrust
FROM judged j LEFT JOIN scores s ON s.host = j.host
"""
