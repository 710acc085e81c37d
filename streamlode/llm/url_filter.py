"""URL filter: rules first, then trust and distrust over the graph of hosts, in DataFrame operations only.

Pages that an allow rule fits seed trust at their host, pages that a block rule fits seed distrust.
Personalised PageRank carries trust along links and distrust against them; a host whose distrust exceeds
its trust is blocked. Both ranks are shares of their seeds and compared by a relative margin, so the test does
not depend on the corpus size. The ranks are carried on until none of them grows by more than a relative
tolerance; the SQL stops after ``STEPS`` steps and rounds to 12 decimals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r'href="(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^"/?#]*)'
#: Links of any case, with single, double or no quotes and blanks around the sign; LINK is what the SQL finds.
ANY_LINK = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^"'/?#\s>]*)"""
DAMPING, STEPS = 0.85, 10
#: Steps between two tests of convergence, the relative growth over them that ends it, and by how much distrust must exceed trust.
BLOCK, TOLERANCE, MARGIN = 5, 1e-7, 1e-6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (of equal length, the one listed first); null if none does."""
    text = verdict = None
    for action, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, prefix = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        text = F.when(fits, rule) if text is None else text.when(fits, rule)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    return text, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, links: how often pages of one host link to another. pages: host, html."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(ANY_LINK), 1)).alias("to"))
    found = found.select("src", F.translate("to", UPPER, LOWER).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return found.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("links"))


def host_ranks(judged: DataFrame) -> DataFrame:
    """host, trust and distrust of each host that any seed reaches. judged: host, html, rule_verdict."""
    share = lambda e, a, b, kind: e.join(e.groupBy(a).agg(F.sum("links").alias("all")), a).select(F.col(a).alias("from"), F.col(b).alias("to"), F.lit(kind).alias("kind"), (F.col("links") / F.col("all")).alias("share"))
    links = materialize(host_edges(judged))
    flow = materialize(share(links, "src", "dst", "allow").unionByName(share(links, "dst", "src", "block")))
    counts = judged.where("rule_verdict is not null and host <> ''").groupBy(F.col("host"), F.col("rule_verdict").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts)
    totals = counts.groupBy("kind").agg(F.sum("n").alias("all"))  # two rows
    seeds = materialize(counts.join(F.broadcast(totals), "kind").select("host", "kind", (F.col("n") / F.col("all") * (1 - DAMPING)).alias("rank")))
    ranks = seeds
    grows = not flow.isEmpty()
    while grows:  # ranks never fall, and what is still to come shrinks by DAMPING a step
        old = ranks
        for _ in range(BLOCK):
            moved = flow.join(ranks.withColumnRenamed("host", "from"), ["from", "kind"]).groupBy(F.col("to").alias("host"), "kind").agg(F.sum(F.col("rank") * F.col("share") * DAMPING).alias("rank"))
            ranks = seeds.unionByName(moved).groupBy("host", "kind").agg(F.sum("rank").alias("rank"))
        ranks = materialize(ranks)
        both = ranks.withColumn("old", F.lit(0.0)).unionByName(old.select("host", "kind", F.lit(0.0).alias("rank"), F.col("rank").alias("old")))
        growth = both.groupBy("host", "kind").agg(F.sum("rank").alias("rank"), F.sum("old").alias("old")).agg(F.max(F.when(F.col("rank") > 0, 1 - F.col("old") / F.col("rank")))).first()[0]
        grows = (growth or 0.0) > TOLERANCE
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    return ranks.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, most_broadcast: int = 500_000) -> DataFrame:
    """All rows and columns of pages, plus host, path, rule and verdict.

    A null url, or one without ``://``, has an empty host and path: no rule fits and it is allowed. Hosts
    that no seed reaches are allowed. Null html has no links. Input columns named like the new ones are
    replaced. Repeated rows are judged alike; no rows give no rows.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col("url"))
    parsed = pages.withColumns({"host": host, "path": path})
    text, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = parsed.withColumns({"rule": text, "rule_verdict": verdict})
    blocked = materialize(host_ranks(judged).where(F.col("distrust") > F.col("trust") * (1 + MARGIN)).select(F.col("host").alias("__host")))
    small = blocked.count() <= most_broadcast  # tens of bytes a host; beyond that a shuffled join, whose hot keys AQE splits
    joined = judged.join(F.broadcast(blocked) if small else blocked, F.col("host") == F.col("__host"), "left")
    method = F.when(F.col("__host").isNotNull(), "block").otherwise("allow")
    return joined.withColumn("verdict", F.coalesce("rule_verdict", method)).drop("rule_verdict", "__host")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def sql() -> str:
    """The same result for DuckDB, with the steps of the propagation written out."""
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(r[1])} THEN '{r[k]}'" for r in ordered) + " END"
    low = f"'{UPPER}', '{LOWER}'"
    steps = ",\n".join(
        f"r{k + 1} AS (SELECT host, kind, sum(rank) AS rank FROM (SELECT host, kind, rank FROM seeds UNION ALL SELECT f.dst, f.kind, r.rank * f.share * {DAMPING}::DOUBLE "
        f"FROM flow f JOIN r{k} r ON f.src = r.host AND f.kind = r.kind) GROUP BY host, kind)"
        for k in range(STEPS)
    )
    return rf"""
WITH u AS (SELECT page_id, html, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), {low}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
j AS (SELECT *, {case(1)} AS rule, {case(0)} AS rule_verdict FROM h),
x AS (SELECT host AS src, translate(unnest(regexp_extract_all(html, '{LINK}', 1)), {low}) AS dst FROM h),
e AS (SELECT src, dst, count(*) AS links FROM x WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst),
flow AS (SELECT src, dst, 'allow' AS kind, links::DOUBLE / sum(links) OVER (PARTITION BY src)::DOUBLE AS share FROM e
  UNION ALL SELECT dst, src, 'block', links::DOUBLE / sum(links) OVER (PARTITION BY dst)::DOUBLE FROM e),
n AS (SELECT host, rule_verdict AS kind, count(*) AS n FROM j WHERE rule_verdict IS NOT NULL AND host <> '' GROUP BY ALL),
seeds AS (SELECT host, kind, n::DOUBLE / sum(n) OVER (PARTITION BY kind)::DOUBLE * {1 - DAMPING!r}::DOUBLE AS rank FROM n),
r0 AS (SELECT * FROM seeds),
{steps},
b AS (SELECT host FROM r{STEPS} GROUP BY host
  HAVING round(coalesce(sum(rank) FILTER (kind = 'block'), 0), 12) > round(coalesce(sum(rank) FILTER (kind = 'allow'), 0), 12))
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""


SQL = sql()
