"""URL filters: rules first, else link-graph propagation.

Hosts are nodes, links between pages' hosts are weighted edges. Trust flows
from seeds along links (personalised PageRank), distrust from blocked seeds
against them; a host is blocked if its distrust, each score taken relative to a uniform
share, is above its trust and above a threshold. Rules decide a url before the host's
score does, and make the seeds: a host whose pages the rules mostly allow is
trusted, one whose pages they mostly block is distrusted.

Links are reduced to host pairs where pages are read, and each round is one
join and one partial aggregate over those pairs. Rounds go on until no host's score,
relative to a uniform share, moves by more than a hundredth of the threshold. A host
with many pages is one row in the graph; its pages get its score from a broadcast
table of the hosts with more than 1/``share`` of all pages, and the others by a join.

Definitions for odd rows. A null url, or one without ``://``, has an empty
host and path; no rule fits it and its host is not in the graph, so it is
allowed. Every row gives one result row. Null html has no links.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, materialise

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and paths that begin with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    return F.when(F.contains(url, F.lit("://")), F.substring(url, F.instr(url, "://") + 3, F.lit(2147483647)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(judged: DataFrame, rules: list[Rule], inline: int = 64) -> DataFrame:
    """``judged`` (with host, path) with the longest fitting rule's name and verdict, or nulls.

    Up to ``inline`` rules are one expression. More are joined by host suffix,
    on the distinct hosts, so that the join doesn't depend on pages per host.
    """
    first = lambda r: (-len(r.name), -len(r.host), r.name, r.verdict)
    if len(rules) <= inline:
        name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        for r in sorted(rules, key=first, reverse=True):
            fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
            name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
        return judged.withColumn("rule", name).withColumn("rule_verdict", verdict)
    spark = judged.sparkSession
    table = spark.createDataFrame([(r.host, r.path, r.name, r.verdict) for r in rules], "suffix string, rule_path string, name string, v string")
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> substring_index(host, '.', -i))")
    hosts = judged.select("host").distinct().select("host", F.explode(suffixes).alias("suffix")).join(table, "suffix")
    hosts = hosts.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.length("name")).alias("a"), (-F.length("suffix")).alias("b"), "name", "v", "rule_path"))).alias("fitting"))
    best = F.get(F.filter("fitting", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    return judged.join(hosts, "host", "left").withColumn("rule", best["name"]).withColumn("rule_verdict", best["v"]).drop("fitting")


def host_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): absolute links between different hosts."""
    link = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""), F.lit(1))
    out = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(link).alias("dst")).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    return out.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = 1e-3, damping: float = 0.85) -> DataFrame:
    """(host, trust, distrust) of edges (src, dst, n) and seeds (host, trusted, blocked weights).

    Both walks run at once: trust along the edges, distrust against them. Each
    score is a share of 1 over all hosts. Rounds go on until the scores times the number of hosts
    move by less than ``tolerance``; each shrinks the error by ``damping``, so they end.
    """
    total = seeds.agg(F.sum("trusted"), F.sum("blocked")).first()
    good, bad = float(total[0] or 0) or 1.0, float(total[1] or 0) or 1.0
    seeds = materialise(seeds.select("host", (F.col("trusted") / good).alias("t0"), (F.col("blocked") / bad).alias("d0")), "seeds")
    both = edges.select("src", "dst", "n", F.lit(True).alias("along")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n", F.lit(False).alias("along")))
    out = both.groupBy("src", "along").agg(F.sum("n").alias("all"))
    step = materialise(both.join(out, ["src", "along"]).select("src", "dst", "along", (F.col("n") / F.col("all")).alias("w")), "steps")
    scores = seeds.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
    if step.isEmpty():  # nothing to flow along: every round gives the same
        return scores.select("host", ((1 - damping) * F.col("trust")).alias("trust"), ((1 - damping) * F.col("distrust")).alias("distrust"))
    while True:
        moved = step.join(scores.withColumnRenamed("host", "src"), "src")
        moved = moved.groupBy(F.col("dst").alias("host")).agg(F.sum(F.when(F.col("along"), F.col("w") * F.col("trust")).otherwise(0.0)).alias("t"), F.sum(F.when(F.col("along"), 0.0).otherwise(F.col("w") * F.col("distrust"))).alias("d"))
        after = seeds.join(moved, "host", "full").select(
            "host",
            ((1 - damping) * F.coalesce("t0", F.lit(0.0)) + damping * F.coalesce("t", F.lit(0.0))).alias("trust"),
            ((1 - damping) * F.coalesce("d0", F.lit(0.0)) + damping * F.coalesce("d", F.lit(0.0))).alias("distrust"),
        )
        after = materialise(after, "scores")
        change = F.greatest(F.abs(after["trust"] - F.coalesce("t", F.lit(0.0))), F.abs(after["distrust"] - F.coalesce("d", F.lit(0.0))))
        most, hosts = after.join(scores.select("host", F.col("trust").alias("t"), F.col("distrust").alias("d")), "host", "left").agg(F.max(change), F.count("*")).first()
        forget(scores)
        scores = after
        if (most or 0.0) * hosts <= tolerance:
            return scores


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, threshold: float = 0.1, share: int = 1024) -> DataFrame:
    """(page_id, url, host, path, rule, verdict, trust, distrust) of every row.

    trust and distrust are relative to a uniform share: 1 is what a host would
    have if all had the same. A host without a rule's verdict is blocked if its
    distrust is above ``threshold`` and above its trust.
    """
    url = F.col(url_col).cast("string")
    judged = matched(pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path")), rules)
    by_host = judged.where("host <> ''").groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("a"), F.count_if(F.col("rule_verdict") == "block").alias("b"), F.count("*").alias("pages"))
    seeds = materialise(by_host.select("host", "pages", F.when(F.col("a") > F.col("b"), 1.0).otherwise(0.0).alias("trusted"), F.when(F.col("b") > F.col("a"), 1.0).otherwise(0.0).alias("blocked")), "hosts")
    scores = propagate(host_edges(pages.select(url.alias("url"), F.col(html_col).cast("string").alias("html"))), seeds, threshold / 100, damping)
    hosts = float(max(1, scores.count()))
    scores = scores.select("host", (F.col("trust") * hosts).alias("trust"), (F.col("distrust") * hosts).alias("distrust"))
    # hosts with more than 1/share of all pages are fewer than `share` rows; their pages need no shuffle
    most = (seeds.agg(F.sum("pages")).first()[0] or 0) // share
    hot = scores.join(seeds.where(F.col("pages") > most), "host", "left_semi").select("host", F.col("trust").alias("hot_trust"), F.col("distrust").alias("hot_distrust"))
    out = judged.join(F.broadcast(hot), "host", "left")
    out = out.withColumn("cold", F.when(F.col("hot_trust").isNull() & (F.col("host") != ""), F.col("host")))
    apart, rest = out.where("cold is null"), out.where("cold is not null").join(scores, "host", "left")
    out = apart.withColumn("trust", F.col("hot_trust")).withColumn("distrust", F.col("hot_distrust")).unionByName(rest)
    out = out.withColumn("trust", F.coalesce("trust", F.lit(0.0))).withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    own = F.when((F.col("distrust") > threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return out.select("page_id", "url", "host", "path", "rule", F.coalesce("rule_verdict", own).alias("verdict"), "trust", "distrust")
