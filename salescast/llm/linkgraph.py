"""URL filter: host rules first, then trust and distrust propagated over the link graph of hosts.

The longest matching rule decides a page.  Every other page gets its host's verdict: trust runs forward
from hosts whose pages the allow rules cover (personalised PageRank), distrust runs backward from hosts
whose pages the block rules cover (who links to a blocked host is suspect, as far as its links go there),
and a host whose distrust reaches ``threshold`` and exceeds its trust is blocked.  A seed's weight is the
share of its pages that such rules decide.  Both scores lie between 0 and the number of hosts; distrust is 1 at most.  Links are the absolute links of the pages' HTML or, with ``resolve``, all its links, each resolved against its
page's address (or the page's base element); a link inside a host keeps its weight.

Inputs: pages (page_id, url, html); other columns are ignored.  A null url, or one without ``://``, has
empty host and path, matches no rule and is allowed.  Null or empty html has no links.  Repeated rows
count as pages of their own; repeated links between two hosts add to one edge's weight.  Equal trust and
distrust allow.  Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, table, written

# Fixed by the contract: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
DAMPING, STEPS, THRESHOLD = 0.85, 12, 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> Column:
    """struct(size, rule, verdict) of the longest rule that fits, or null."""
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
                   F.struct(F.lit(len(h) + len(p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
            for v, h, p in rules]
    return F.array_max(F.array(*fits)) if len(fits) > 1 else fits[0]


HREF = r"""\bhref\s*=\s*("[^"]*"|'[^']*'|[^"'\s>][^\s>]*)"""
BASE = r"""<base\b[^>]*?""" + HREF + "[^>]*>"


def resolved(host: Column, to: Column) -> Column:
    """The host of a link ``to`` from a page of ``host``; null for one to no host, such as mailto:."""
    to = F.trim(F.regexp_replace(to, r"""^["']|["']$""", ""))
    return F.when(to.startswith("//"), host_of(F.concat(F.lit("x:"), to))) \
        .when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), host_of(to)) \
        .when(~to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), host)


def resolved_links(pages: DataFrame) -> DataFrame:
    """(src, dst) of every href of the pages' HTML."""
    html = F.coalesce("html", F.lit(""))
    base = F.regexp_extract(html, "(?i)" + BASE, 1)
    return pages.select(F.col("host").alias("src"), F.when(base == "", F.col("host")).otherwise(
        F.coalesce(resolved(F.col("host"), base), F.col("host"))).alias("base"), F.explode(
            F.regexp_extract_all(F.regexp_replace(html, "(?i)" + BASE, ""), F.lit("(?i)" + HREF), F.lit(1))).alias("to")) \
        .select("src", resolved(F.col("base"), F.col("to")).alias("dst"))


def host_edges(pages: DataFrame, resolve: bool = False) -> DataFrame:
    """(src, dst, weight): the share of src's links that go to dst, links within src included."""
    links = resolved_links(pages) if resolve else pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(
        F.coalesce("html", F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?([a-z][a-z0-9+.-]*://[^"'\s>]*)"""), F.lit(1)))
        .alias("to")).select("src", host_of(F.col("to")).alias("dst"))
    links = links.where("src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))
    total = links.groupBy("src").agg(F.sum("n").alias("total"))
    return links.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("weight"))


def closed(edges: DataFrame, hosts: DataFrame) -> DataFrame:
    """``edges`` with a link to itself for every host without links: it keeps what it has."""
    every = hosts.select(F.col("host").alias("src")).union(edges.select("dst")).distinct()
    ends = every.join(edges.select("src").distinct(), "src", "left_anti")
    return edges.union(ends.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight")))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, steps: int = STEPS) -> DataFrame:
    """(host, score): score = (1 - damping) * seed + damping * what comes in over ``edges``, from score = seed.

    edges (src, dst, weight), seeds (host, seed).  A step sums partial sums per host; every third is
    written to cut the plan.
    """
    score = seeds.select("host", F.col("seed").alias("score"))
    for step in range(steps):
        came = score.join(edges, score["host"] == edges["src"]) \
            .groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("weight")).alias("came"))
        score = came.join(seeds, "host", "full_outer").select("host", (
            (1 - damping) * F.coalesce("seed", F.lit(0.0)) + damping * F.coalesce("came", F.lit(0.0))).alias("score"))
        if step % 3 == 2 or step == steps - 1:
            score = written(score, "url-score")
    return score


def judge_pages(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, damping: float = DAMPING,
                steps: int = STEPS, resolve: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages``."""
    parsed = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = parsed.withColumn("r", longest_rule(F.col("host"), F.col("path"), rules))
    seeds = written(judged.where("host <> ''").groupBy("host").agg(
        F.avg((F.coalesce("r.verdict", F.lit("")) == "allow").cast("double")).alias("allow"),
        F.avg((F.coalesce("r.verdict", F.lit("")) == "block").cast("double")).alias("block")), "url-seeds")
    edges = written(closed(written(host_edges(parsed, resolve), "url-links"), seeds), "url-edges")
    trust = propagate(edges, seeds.select("host", F.col("allow").alias("seed")).where("seed > 0"), damping, steps)
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    distrust = propagate(back, seeds.select("host", F.col("block").alias("seed")).where("seed > 0"), damping, steps)
    hosts = written(trust.withColumnRenamed("score", "trust").join(
        distrust.withColumnRenamed("score", "distrust"), "host", "full_outer"), "url-hosts")
    return judged.drop("html").join(hosts, "host", "left").select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when((F.coalesce("distrust", F.lit(0.0)) >= threshold)
                                       & (F.coalesce("distrust", F.lit(0.0)) > F.coalesce("trust", F.lit(0.0))),
                                       "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op6_link_graph(spark, sf_dir):
    return judge_pages(table(spark, sf_dir, "pages", "page_id", "url", "html"), resolve=True)
