"""URL filtering by rules, and by trust carried over the link graph of hosts.

A rule settles the pages it fits. Hosts whose pages rules allow or block are the seeds of
two personalised PageRanks: trust runs along the links from trusted seeds, distrust runs
against them from blocked seeds (who links to blocked hosts is suspect). A page that no rule
fits is blocked where its host has more distrust than trust.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlake.llm.shared import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
LINK = r"""(?i)\bhref\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
#: Steps between two sums of what was brought; below TINY a double has no room for more.
FOLDED, TINY = 8, 1e-15


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(verdict, rule_host, rule_path) of rules given as a list."""
    return spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): the rules of each host and of the domains that it is under, the longest first; of equally long ones the first by name.

    A host is joined by its name and by what follows each of its dots, so any number of rules
    meets any number of hosts by an equi-join. Hosts without rules have no row.
    """
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("host", "[.]"))), lambda i: F.array_join(F.slice(F.split("host", "[.]"), i, 1 << 16), "."))
    of = F.struct((-F.length("rule_host") - F.length("rule_path")).alias("n"), "verdict", "rule_host", "rule_path")
    met = hosts.select("host", F.explode(above).alias("rule_host")).join(rules, "rule_host")
    return met.groupBy("host").agg(F.sort_array(F.collect_set(of)).alias("rules"))


def rule_of(rules: Column, path: Column) -> Column:
    """struct(verdict, rule) of the first of a host's rules that fits the path, else null."""
    found = F.get(F.filter(rules, lambda r: F.startswith(path, r["rule_path"])), 0)
    return F.when(found.isNotNull(), F.struct(found["verdict"].alias("verdict"), F.concat(found["rule_host"], found["rule_path"]).alias("rule")))


def host_edges(judged: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts, from the absolute links in the pages' html."""
    links = judged.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("to"))
    links = links.select("src", F.translate("to", UPPER, LOWER).alias("dst")).where("src <> dst")
    return links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float, least: float) -> DataFrame:
    """(host, trust, distrust) of both walks, taken so far that no verdict at `least` can change.

    seeds: (host, trust, distrust). Both walks move in one join a step, and only sums per
    host are shuffled; a host with a third of the links is combined before the shuffle.
    A step moves what the last one brought, so all later steps bring a host at most that
    sum times damping / (1 - damping).
    """
    state = seeds.select("host", F.explode(F.array(F.struct(F.lit("trust").alias("walk"), F.col("trust").alias("seed")), F.struct(F.lit("distrust").alias("walk"), F.col("distrust").alias("seed")))).alias("s")).select("host", "s.walk", "s.seed")
    flow = edges.select(F.lit("trust").alias("walk"), F.col("src").alias("a"), F.col("dst").alias("b"), "links").union(edges.select(F.lit("distrust"), "dst", "src", "links"))
    leaving = flow.groupBy("walk", "a").agg(F.sum("links").alias("all"))
    flow = cut(flow.join(leaving, ["walk", "a"]).select("walk", "a", "b", (F.col("links") / F.col("all")).alias("share")), "flow")
    nodes = cut(state.union(flow.select(F.col("a").alias("host"), "walk", F.lit(0.0)).union(flow.select("b", "walk", F.lit(0.0)))).groupBy("host", "walk").agg(F.max("seed").alias("seed")), "nodes")
    scores = nodes.select("host", "walk", (F.col("seed") * (1 - damping)).alias("score"))
    net = F.sum(F.when(F.col("walk") == "distrust", F.col("score")).otherwise(-F.col("score")))
    moved, brought, open_ = scores.where("score > 0"), [], not flow.isEmpty()
    while open_:
        arrives = flow.join(moved.select("walk", F.col("host").alias("a"), "score"), ["walk", "a"]).groupBy("walk", F.col("b").alias("host")).agg((damping * F.sum(F.col("score") * F.col("share"))).alias("score"))
        moved = cut(arrives.select("host", "walk", "score"), "moved")
        brought.append(moved)
        sums = [r["n"] for r in moved.groupBy("walk").agg(F.sum("score").alias("n")).collect()]  # two rows at most
        left = max(sums, default=0.0) * damping / (1 - damping)
        if len(brought) == FOLDED or left < TINY:
            for table in brought:
                scores = scores.union(table)
            scores = cut(scores.groupBy("host", "walk").agg(F.sum("score").alias("score")), "scores")
            brought = []
            open_ = left >= TINY and (left >= least or not scores.groupBy("host").agg(net.alias("net")).where(F.abs(F.col("net") - least) <= left).isEmpty())
    by = lambda walk: F.sum(F.when(F.col("walk") == walk, F.col("score")).otherwise(0.0)).alias(walk)
    return scores.groupBy("host").agg(by("trust"), by("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, damping: float = 0.85, least: float = 1e-6) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    rules: (verdict, host, path) each, as a list or, where there are very many, as a table
    (verdict, rule_host, rule_path). A url that is null or has no :// has neither host nor
    path, fits no rule and is allowed; null html has no links; repeated rows are judged
    each; an empty table gives none. Hosts without links keep what their own rules gave
    them. A host is blocked whose distrust is above its trust by more than `least`. Other
    columns are ignored.
    """
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else rule_table(spark, rules)
    url = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = cut(rules_of_hosts(url.select("host").distinct(), table), "rules-of-hosts")
    judged = url.join(ruled, "host", "left").withColumn("found", rule_of(F.col("rules"), F.col("path"))).drop("rules")
    share = lambda verdict: F.avg(F.when(F.col("found.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = cut(judged.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust")), "seeds")
    ranks = cut(propagate(seeds, host_edges(url), damping, least), "host-ranks")
    told = judged.drop("html").join(ranks, "host", "left")
    suspect = (F.col("host") != "") & (F.col("distrust") - F.col("trust") > least)
    verdict = F.coalesce(F.col("found.verdict"), F.when(suspect, "block").otherwise("allow"))
    return told.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "trust", "distrust")


def judge_sql(rules: Sequence[tuple[str, str, str]] = RULES, damping: float = 0.85, rounds: int = 10, least: float = 1e-6) -> str:
    """The same in DuckDB's SQL, with ten steps of the walks written out: equal where no link leads farther."""
    first = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for _, h, p in first)
    said = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for v, h, p in first)
    link = LINK.replace("'", "''")
    steps = [f"s0 AS MATERIALIZED (SELECT walk, host, seed, seed * {1 - damping} AS score FROM nodes)"]
    for k in range(rounds):
        steps.append(f"s{k + 1} AS MATERIALIZED (SELECT n.walk, n.host, n.seed, n.seed * {1 - damping} + {damping} * coalesce((SELECT sum(s.score * f.share) FROM flow f JOIN s{k} s ON s.walk = f.walk AND s.host = f.a WHERE f.b = n.host AND f.walk = n.walk), 0) AS score FROM nodes n)")
    return f"""
        WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                          regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, html FROM pages),
        j AS (SELECT *, CASE {rule} END AS rule, CASE {said} END AS said FROM u),
        seeds AS (SELECT host, avg(CASE WHEN said = 'allow' THEN 1.0 ELSE 0.0 END) AS trust, avg(CASE WHEN said = 'block' THEN 1.0 ELSE 0.0 END) AS distrust FROM j GROUP BY host),
        links AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{link}', 1)), '{UPPER}', '{LOWER}') AS dst FROM j WHERE host <> ''),
        edges AS (SELECT src, dst, count(*)::DOUBLE AS links FROM links WHERE src <> dst GROUP BY ALL),
        moves AS (SELECT 'trust' AS walk, src AS a, dst AS b, links FROM edges UNION ALL SELECT 'distrust', dst, src, links FROM edges),
        flow AS MATERIALIZED (SELECT walk, a, b, links / sum(links) OVER (PARTITION BY walk, a) AS share FROM moves),
        nodes AS MATERIALIZED (SELECT walk, host, max(seed) AS seed FROM (
            SELECT 'trust' AS walk, host, trust AS seed FROM seeds UNION ALL SELECT 'distrust', host, distrust FROM seeds
            UNION ALL SELECT walk, a, 0.0 FROM flow UNION ALL SELECT walk, b, 0.0 FROM flow) GROUP BY ALL),
        {", ".join(steps)},
        ranks AS (SELECT host, sum(CASE WHEN walk = 'trust' THEN score ELSE -score END) AS net FROM s{rounds} GROUP BY host)
        SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host <> '' AND net < -{least} THEN 'block' ELSE 'allow' END) AS verdict
        FROM j LEFT JOIN ranks USING (host)
    """
