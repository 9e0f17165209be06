"""URL filters: host and path rules, and trust propagated over the links between hosts.

All of it is DataFrame expressions. Hosts whose pages the rules mostly block are distrusted
seeds, hosts with allowed pages and no blocked one are trusted seeds. Trust is personalised
PageRank from the trusted seeds along host edges; distrust is the same from the blocked seeds
along reversed edges (who links to a bad host is suspect). A page that no rule fits is blocked
if its host's distrust reaches the threshold and exceeds its trust. Every seed, trusted or
blocked, has the same share, so the two can be compared.

Ranks are integers (the seeds' shares are at most UNIT together) with floor division, so sums don't
depend on their order and the result is the same on any engine and partitioning. They start from
the teleport share and only grow; rounds end when no rank does, or after ROUNDS, when at most
0.85 ** 33 = 0.5 % of all shares can still move. A single seed reaches the threshold over at most 14 links.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import Work

UNIT = 10**15
#: Share of a rank that follows links, in hundredths.
DAMPING = 85
ROUNDS = 32
#: Distrust, in hundredths of what a blocked seed has without any link, from which a host is blocked.
THRESHOLD = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)href\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """Fits the host and all its subdomains, where the path starts with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (of equal lengths the last in order of name), or nulls. Rules are few: each is a comparison."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of absolute links between different hosts; pages has host and html."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(HREF), 1), lambda x: F.translate(F.regexp_extract(F.regexp_replace(x, "^//", "http://"), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)))).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").distinct()


def seeds_of(judged: DataFrame) -> DataFrame:
    """host, trusted, blocked (0 or 1) of the seed hosts; judged has host and verdict (null without a rule)."""
    n = judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b"), F.count("*").alias("n"))
    return n.select("host", F.when((F.col("a") > 0) & (F.col("b") == 0), 1).otherwise(0).alias("trusted"), F.when(2 * F.col("b") >= F.col("n"), 1).otherwise(0).alias("blocked")).where("trusted + blocked > 0")


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, work: Work | None = None) -> DataFrame:
    """host, trust, distrust after the given rounds, or fewer if nothing changes. Each round is a join of the
    edges with the ranks of their ends and a partially aggregated sum; it is written to the shared folder."""
    work = work or Work(edges.sparkSession, "ranks")
    out = edges.groupBy("src").agg(F.count("*").alias("n_out"))
    into = edges.groupBy("dst").agg(F.count("*").alias("n_in"))
    full = work.write(edges.join(out, "src").join(into, "dst"), "edges")
    own = seed_share(seeds)
    teleport = seeds.select("host", F.expr(f"trusted * {own} * {100 - DAMPING} div 100").alias("trust"), F.expr(f"blocked * {own} * {100 - DAMPING} div 100").alias("distrust"))
    ranks, seen = teleport, None
    if full.limit(1).count():
        for i in range(rounds):
            down = full.join(ranks, full.src == ranks.host).select(F.col("dst").alias("host"), F.expr(f"trust * {DAMPING} div 100 div n_out").alias("trust"), F.lit(0).cast("long").alias("distrust"))
            up = full.join(ranks, full.dst == ranks.host).select(F.col("src").alias("host"), F.lit(0).cast("long").alias("trust"), F.expr(f"distrust * {DAMPING} div 100 div n_in").alias("distrust"))
            ranks = work.write(teleport.unionByName(down).unionByName(up).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), f"round-{i}")
            if i:
                work.drop(f"round-{i - 1}")
            before, seen = seen, tuple(ranks.agg(F.sum("trust"), F.sum("distrust")).first())  # ranks never fall: equal sums are equal ranks
            if seen == before:
                break
    return ranks


def seed_share(seeds: DataFrame) -> int:
    """What each seed gets of UNIT."""
    n = seeds.agg(F.coalesce(F.sum(F.col("trusted") + F.col("blocked")), F.lit(0)).alias("n")).first()["n"]
    return UNIT // n if n else 0


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rounds: int = ROUNDS, threshold: int = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict and host_verdict of each page.

    A null url, or one without "://", has empty host and path: no rule and no link fits it, and it
    is allowed. Null html has no links. Null ids and repeated rows are kept; an empty table gives
    no rows. Html is read once, for the edges; the verdict needs urls alone.
    """
    work = Work(pages.sparkSession, "urls")
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumn("held", rule_for(F.col("host"), F.col("path"), rules))
    rows = rows.select("page_id", "host", "path", F.col("held.rule").alias("rule"), F.col("held.verdict").alias("own"))
    edges = work.write(host_edges(pages.select(host.alias("host"), F.col(html_col).alias("html"))), "links")
    seeds = work.write(seeds_of(rows.select("host", F.col("own").alias("verdict"))), "marked")
    ranks = propagate(edges, seeds, rounds, work)
    least = seed_share(seeds) * (100 - DAMPING) * threshold // 10000
    bad = ranks.where(f"distrust > trust and distrust >= {least}").select("host", F.lit("block").alias("host_verdict"))
    verdict = F.coalesce("host_verdict", F.lit("allow"))
    return rows.join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("own", verdict).alias("verdict"), verdict.alias("host_verdict"))
