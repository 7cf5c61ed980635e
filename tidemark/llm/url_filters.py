"""URL filter: longest matching rule, else trust and distrust that spread over the link graph of hosts.

DataFrame functions only. Trust is a personalised PageRank from the hosts that allow rules cover;
distrust is the same over reversed edges from the hosts that block rules cover (who links to bad
hosts is bad). A host's page is blocked when its distrust exceeds its trust times a factor.

Edges: absolute links in the pages' HTML, from the page's host to the link's, weighted by their
number, and links between a host and its parent domain in both directions (relative links and
redirects between www., blog. and the bare domain are the links that pages do not spell out).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import forget, written

#: The example rules: (verdict, host, path).
RULES = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Spread:
    """damping: share of a host's score that goes on along edges; tolerance: a step whose changes sum to less
    is the last (all scores sum to 1 at most); factor: blocked when distrust > factor * trust."""

    damping: float = 0.85
    tolerance: float = 1e-4
    factor: float = 1.0


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty if null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """struct(verdict, rule) of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's path. Longest is the
    longest host + path text; among equals the one listed first.
    """
    best = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        best = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(best)
    return best


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) from pages with columns host and html; no self-links, counted before the exchange."""
    linked = F.expr("regexp_extract_all(html, '(?i)href\\\\s*=\\\\s*[\"\\']?(?:[a-z]+:)?//([^\"\\'/?#>\\\\s]+)', 1)")
    links = pages.where("html IS NOT NULL").select(F.col("host").alias("src"), F.explode(linked).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    hosts = pages.select("host").union(links.select("dst")).where("host <> ''").distinct()
    # every host of three labels or more and its parent, up to the domain of two labels
    labels = F.split("host", r"\.")
    chain = F.when(
        F.size(labels) >= 3,
        F.transform(F.sequence(F.lit(1), F.size(labels) - 2), lambda i: F.struct(
            F.concat_ws(".", F.slice(labels, i, F.size(labels))).alias("child"),
            F.concat_ws(".", F.slice(labels, i + 1, F.size(labels))).alias("parent"),
        )),
    )
    family = hosts.select(F.explode(chain).alias("e")).select("e.child", "e.parent").distinct()
    kin = family.select(F.col("child").alias("src"), F.col("parent").alias("dst")).union(family.select("parent", "child"))
    return (
        links.unionByName(kin).where("src <> '' AND dst <> '' AND src <> dst")
        .groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    )


#: Steps of which the last one's change is looked at; their scores are written.
STEPS = 8


def spread(edges: DataFrame, seeds: DataFrame, how: Spread) -> DataFrame:
    """(kind, host, score): personalised PageRank over (kind, src, dst, weight) from seeds (kind, host, seed), those of a kind summing to 1.

    score = (1 - damping) * seed + damping * sum of what comes in; what a host without outgoing
    edges holds is not passed on. Steps go on until one changes the scores by less than the tolerance in
    all: it takes about log(tolerance) / log(damping) of them at most, however long the paths are. A
    hot host's incoming scores are summed before the exchange. The result is written.
    """
    out = edges.groupBy("kind", "src").agg(F.sum("weight").alias("out"))
    shares = written(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("weight") / F.col("out")).alias("share")))
    score, before, change = seeds.select("kind", "host", F.col("seed").alias("score")), None, math.inf
    given = seeds.select("kind", "host", (F.col("seed") * (1 - how.damping)).alias("score"), F.lit(0.0).alias("last"))
    while change > how.tolerance:
        for step in range(STEPS):
            passed = shares.join(score, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * how.damping).alias("score"))
            parts = passed.withColumn("last", F.lit(0.0)).unionByName(given)
            if step == STEPS - 1:
                parts = parts.unionByName(score.select("kind", "host", F.lit(0.0).alias("score"), F.col("score").alias("last")))
            both = parts.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.sum("last").alias("last"))
            score = both.select("kind", "host", "score")
        both = written(both)
        change = both.agg(F.sum(F.abs(F.col("score") - F.col("last")))).first()[0] or 0.0
        if before is not None:
            forget(before)
        before, score = both, both.select("kind", "host", "score")
    forget(shares)
    return score


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, how: Spread = Spread()) -> DataFrame:
    """A verdict for every row of pages (page_id, url, html).

    Returns page_id, host, path, rule, verdict, trust, distrust. Null or odd urls have empty host and
    path, no rule, scores 0 and are allowed. Repeated rows are judged alike and count as more seeds.
    Other columns are ignored. Without seeds of a kind that score is 0 everywhere.
    """
    cut = pages.select("page_id", "html", F.col("url").alias("_url"))
    named = cut.select("page_id", "html", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    named = named.withColumn("m", matched_rule(F.col("host"), F.col("path"), rules))
    per_host = named.where("host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("m.verdict") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("m.verdict") == "block", 1)).alias("blocked"),
    )
    per_host = written(per_host)
    edges = written(host_edges(named))
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    graphs = edges.withColumn("kind", F.lit("trust")).unionByName(turned.withColumn("kind", F.lit("distrust")))
    all_of = per_host.agg(F.sum("allowed"), F.sum("blocked")).first()
    seeds = [
        per_host.where(F.col(n) > 0).select(F.lit(kind).alias("kind"), "host", (F.col(n) / (whole or 1)).alias("seed"))
        for kind, n, whole in zip(("trust", "distrust"), ("allowed", "blocked"), all_of, strict=True)]
    seeds = written(seeds[0].unionByName(seeds[1]))
    scores = spread(graphs, seeds, how).groupBy("host").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in ("trust", "distrust")])
    by_method = F.when(F.coalesce("distrust", F.lit(0.0)) > how.factor * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")
    forget(per_host, edges, seeds)
    return named.drop("html").join(scores, "host", "left").select(
        "page_id", "host", "path", F.col("m.rule").alias("rule"), F.coalesce("m.verdict", by_method).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
