"""URL filters: rules first, then trust and distrust carried over the links between hosts.

A rule fits its host and all subdomains where the path starts with the rule's; the longest fitting rule decides. Pages
without a rule take their host's verdict, which personalised PageRank gives: trust walks from the hosts of allowing rules
along the links, distrust from the hosts of blocking rules against them, each with restart at its seeds (weighted by the
share of a host's pages that the rules allow or block) for `ROUNDS` steps. PageRank mass shrinks with the number of hosts
that share a neighbour, so no fixed mass can be the limit. A third walk measures the mass that distrust competes with: also
against the links, from the hosts that distrust does not reach, and from the unblocked share of the seeds. A host is blocked
if distrust is at least `LEAST` of both together, and more than the trust that reaches it; all three shrink alike. Links are
counted by pair of hosts before anything moves, so a host with a third of all pages is one row; only hosts and their edges
go through the rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantmill.llm.common import cut

ROUNDS, DAMPING, LEAST, SALT = 10, 0.85, 0.25, 16
NEAR, STILL = 1 + 1e-9, 1e-14  # equal sums in another order are equal; no figure moves
# Fixed values: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(F.regexp_replace(url, r"^[\s\S]*?://", ""), "#", 1)).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end; empty without ://."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"^[\s\S]*?://[^/?#]*", "")).otherwise("")
    return F.coalesce(F.regexp_extract(rest, r"^[^?#]*", 0), F.lit(""))


def link_hosts(html: Column, own: Column) -> Column:
    """The host of each link of a page; a relative link leads to the page's own host."""
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1))
    full = F.transform(links, lambda x: F.when(F.startswith(x, F.lit("//")), F.concat(F.lit("http:"), x)).otherwise(x))
    return F.transform(full, lambda x: F.when(F.rlike(x, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), host_of(x)).otherwise(own))


def rules_frame(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule_host string, rule_path string, rule_verdict string")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: those that fit the host or a parent domain, longest first."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    met = hosts.where("host <> ''").select("host", F.explode(suffixes).alias("rule_host")).join(rules, "rule_host")
    name = F.concat("rule_host", "rule_path")
    order = F.struct((-F.length(name)).alias("k"), name.alias("rule"), F.col("rule_path").alias("path"), F.col("rule_verdict").alias("verdict"))
    return met.groupBy("host").agg(F.array_sort(F.collect_list(order)).alias("rules"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust after `rounds` rounds. edges(src, dst, n); seeds(host, trusted, blocked): weights 0 to 1.

    A host without a link in the direction of a walk keeps what it has.
    """
    walk = edges.select(F.lit("t").alias("kind"), F.col("src").alias("u"), F.col("dst").alias("v"), "n")
    walk = walk.union(edges.select(F.lit("d"), F.col("dst"), F.col("src"), "n"))
    both = lambda h: F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col(h).alias("u")), F.struct(F.lit("d").alias("kind"), F.col(h).alias("u"))))
    nodes = edges.select(F.col("src").alias("host")).union(edges.select("dst")).union(seeds.select("host")).distinct()
    nodes = nodes.select(both("host").alias("x")).select("x.kind", "x.u")
    total = walk.groupBy("kind", "u").agg(F.sum("n").alias("total"))
    stuck = nodes.join(total, ["kind", "u"], "left_anti").select("kind", "u", F.col("u").alias("v"), F.lit(1.0).alias("p"))
    step = cut(walk.join(total, ["kind", "u"]).select("kind", "u", "v", (F.col("n") / F.col("total")).alias("p")).union(stuck))
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("trusted").alias("w")), F.struct(F.lit("d").alias("kind"), F.col("blocked").alias("w")))).alias("x"))
    score = cut(nodes.join(start.select("x.kind", F.col("host").alias("u"), "x.w"), ["kind", "u"], "left").select("kind", "u", F.coalesce("w", F.lit(0.0)).alias("w")))
    score = score.withColumn("s", F.col("w"))
    for _ in range(rounds):  # a walk that stands still would go on as it is
        sent = score.where("s > 0").join(step, ["kind", "u"]).groupBy("kind", F.col("v").alias("u")).agg(F.sum(F.col("s") * F.col("p")).alias("got"))
        score = cut(score.join(sent, ["kind", "u"], "left").select("kind", "u", "w", ((1 - damping) * F.col("w") + damping * F.coalesce("got", F.lit(0.0))).alias("s"), F.col("s").alias("old")))
        if not (score.agg(F.max(F.abs(F.col("s") - F.col("old")))).first()[0] or 0.0) > STILL:
            break
    pick = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("s")).otherwise(0.0))
    return score.groupBy(F.col("u").alias("host")).agg(pick("t").alias("trust"), pick("d").alias("distrust"))


def standing(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust, clean: `propagate` and the third walk, from what distrust does not reach."""
    scores = cut(propagate(edges, seeds, rounds, damping))
    share = F.coalesce("blocked", F.lit(0.0))
    rest = F.when(F.col("distrust") == 0, 1.0).when(share > 0, 1 - share).otherwise(0.0)
    apart = cut(scores.join(seeds, "host", "left").select("host", F.lit(0.0).alias("trusted"), rest.alias("blocked")))
    return scores.join(propagate(edges, apart, rounds, damping).select("host", F.col("distrust").alias("clean")), "host")


def by_host(pages: DataFrame, hosts: DataFrame) -> DataFrame:
    """pages(host, page_id, path) with the columns of hosts (one row a host) or nulls. A host's pages are dealt over `SALT` keys, so a host that has most of them is many tasks."""
    spread = hosts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = pages.withColumn("_salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALT)).cast("int"))
    return dealt.join(spread, ["host", "_salt"], "left").drop("_salt")


def judge(pages: DataFrame, rules: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING, least: float = LEAST) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust, clean: one row per row of pages.

    Null urls, and urls without ://, have an empty host and path and are allowed. Of rules of one length the first by name
    decides. Null html has no link; very long html is read whole. Repeated rows are judged each, and count as often in a
    host's weight. Extra columns are ignored, also those named like columns of the result; an empty table gives no row.
    """
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    edges = own.where("host <> ''").select(F.col("host").alias("src"), F.explode(link_hosts(F.col("html"), F.col("host"))).alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    placed = own.select("page_id", "host", "path")
    fitting = host_rules(placed.select("host").distinct(), rules)
    first = F.get(F.filter(F.col("rules"), lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    ruled = cut(by_host(placed, fitting).withColumn("first", first).select("page_id", "host", "path", "first.rule", F.col("first.verdict").alias("ruled")))
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trusted"), share("block").alias("blocked"))
    scores = cut(standing(cut(edges), cut(seeds), rounds, damping))
    bad = (F.col("distrust") * NEAR >= least * (F.col("distrust") + F.col("clean"))) & (F.col("distrust") > F.col("trust") * NEAR)
    verdict = F.coalesce("ruled", F.when(bad, "block"), F.lit("allow"))
    return by_host(ruled, scores).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust", "clean")
