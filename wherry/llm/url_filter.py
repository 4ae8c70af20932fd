"""URL filter: rules, and personalised PageRank over host links (native: DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, dropped, left, written

#: (verdict, host + path), as the contract fixes them.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
DAMPING = 0.85
#: The walk stops when what still moves is below this share of the seeds' mass; each step damps
#: it, so that takes at most ln(TOLERANCE) / ln(DAMPING), some 85, rounds.
TOLERANCE = 1e-6
#: A host is blocked from this much distrust on, if it has less trust.
MIN_DISTRUST = 0.05
#: Hosts after ``scheme://`` or ``//`` in a link; relative links stay on their host.
LINK = r"""(?i)\b(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'<>\s]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or a url without ``://``."""
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, name in sorted(rules, key=lambda r: len(r[1])):
        at = name.index("/")
        fits = ((host == name[:at]) | host.endswith("." + name[:at])) & path.startswith(name[at:])
        rule = F.when(fits, F.lit(name)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def propagated(seeds: DataFrame, edges: DataFrame, damping: float, tolerance: float) -> tuple[DataFrame, str]:
    """(host, mass): seeds plus all the mass that damped random walks carry from them, and the table's path.

    ``seeds`` has host and mass, ``edges`` src, dst and share (of the source's mass). Mass is
    pre-aggregated before it moves, so a hub is one row per task; each round is one written
    table of what moves and what has come so far, in place of the one before.
    """
    spark = seeds.sparkSession
    state, path = written(seeds.select("host", F.col("mass").cast("double").alias("moving"), F.col("mass").cast("double").alias("mass")), "rank")
    begun = moving = state.agg(F.sum("moving")).first()[0] or 0.0
    while moving > tolerance * begun:
        step = edges.join(state.where("moving > 0"), edges["src"] == state["host"]).groupBy(F.col("dst").alias("host")).agg((F.sum(F.col("moving") * F.col("share")) * damping).alias("come"))
        new = state.select("host", "mass").join(step, "host", "full_outer").na.fill(0.0, ["mass", "come"])
        new, new_path = written(new.select("host", F.col("come").alias("moving"), (F.col("mass") + F.col("come")).alias("mass")), "rank")
        dropped(spark, path)
        state, path = new, new_path
        moving = state.agg(F.sum("moving")).first()[0] or 0.0
    return state.select("host", F.round("mass", 9).alias("mass")), path


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst): distinct links between different hosts; ``pages`` has host and html."""
    links = pages.where(F.col("host") != "").select(
        F.col("host").alias("src"),
        F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)))).alias("dst"),
    )
    return links.select("src", ascii_lower(F.col("dst")).alias("dst")).where("src <> dst").distinct()


def _shares(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Each edge's equal share of its source, walking from ``src`` to ``dst``."""
    out = edges.groupBy(src).agg((1.0 / F.count(F.lit(1))).alias("share"))
    return edges.join(out, src).select(F.col(src).alias("src"), F.col(dst).alias("dst"), "share")


def url_filter(
    pages: DataFrame,
    rules=RULES,
    damping: float = DAMPING,
    tolerance: float = TOLERANCE,
    min_distrust: float = MIN_DISTRUST,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust.

    A url that a rule fits gets the longest rule's verdict. The others are judged by host:
    a host's seed is the share of its pages that rules allow (trust) or block (distrust);
    trust walks along links between hosts, distrust against them, until less than ``tolerance``
    of the seeds' mass moves, and a host is blocked if its distrust is at least ``min_distrust``
    and above its trust.

    Null urls and urls without ``://`` have empty host and path, fit no rule and are allowed.
    Null html has no links. Repeated rows get equal results; other columns are ignored; an
    empty table gives an empty result.
    """
    host, path = url_parts(F.col("url"))
    base = pages.select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "ruled": verdict})
    share = lambda v: F.avg(F.when(F.col("ruled") == v, 1.0).otherwise(0.0))
    hosts = base.where("host <> ''").groupBy("host").agg(share("allow").alias("t"), share("block").alias("d"))
    hosts, hosts_path = written(hosts, "hosts")
    edges, edges_path = written(host_edges(base), "host-edges")
    seed = lambda c: hosts.select("host", F.col(c).alias("mass")).where("mass > 0")
    along, along_path = written(_shares(edges, "src", "dst"), "links-along")
    against, against_path = written(_shares(edges, "dst", "src"), "links-against")
    trust, used_t = propagated(seed("t"), along, damping, tolerance)
    distrust, used_d = propagated(seed("d"), against, damping, tolerance)
    judged = trust.withColumnRenamed("mass", "trust").join(distrust.withColumnRenamed("mass", "distrust"), "host", "full_outer")
    judged, judged_path = written(judged.na.fill(0.0, ["trust", "distrust"]), "host-trust")
    dropped(pages.sparkSession, hosts_path, edges_path, along_path, against_path, used_t, used_d)
    left(judged_path)
    out = base.drop("html").join(judged, "host", "left").na.fill(0.0, ["trust", "distrust"])
    bad = (F.col("distrust") >= min_distrust) & (F.col("distrust") > F.col("trust"))
    return out.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", F.when(bad, "block").otherwise("allow")).alias("verdict"),
        "trust",
        "distrust",
    )
