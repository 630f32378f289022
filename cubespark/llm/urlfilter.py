"""URL verdicts from rules and from trust that spreads over the graph of hosts.  DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import LOWER, UPPER, fitting, written

#: (verdict, host, path): the longest rule that fits wins.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Hosts of links in HTML: of http, https or no scheme, in href or src, in letters of either case.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
DAMPING = 0.85
#: What all rounds left undone could still move, at most, of each walk's mass of 1.
TOLERANCE = 1e-7
#: Edges and seeds up to which the walks are arrays of one row, at about 100 bytes an edge; beyond, they are joins.
SMALL = 50_000
#: Digits of the share of distrust that count, so that a host with as much of both is even.
DIGITS = 6


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    rest = F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1)).otherwise("")
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"^[\s\S]*?://[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.coalesce(rest, F.lit(""))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def judged_by_rules(pages: DataFrame, rules=RULES, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and ruled (the rule's verdict); a handful of rules becomes one expression."""
    x = pages.withColumn("host", url_host(F.col(url_col))).withColumn("path", url_path(F.col(url_col)))
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    rule, ruled = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(ordered):
        fits = _fits(F.col("host"), F.col("path"), r)
        rule = F.when(fits, r[1] + r[2]).otherwise(rule)
        ruled = F.when(fits, r[0]).otherwise(ruled)
    return x.withColumn("rule", rule).withColumn("ruled", ruled)


def host_edges(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, w): links between hosts, counted, and one edge each way between a host and its parent domain.

    ``pages`` has host.  Links within a host say nothing about others and are left out.
    """
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> dst")
    links = links.groupBy("src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))
    hosts = pages.where("host <> ''").select("host").distinct()
    parts = F.split("host", r"\.")
    # a.b.c.d: (a.b.c.d, b.c.d), (b.c.d, c.d); a domain of two labels has no parent
    level = F.explode(F.when(F.size(parts) > 2, F.sequence(F.lit(1), F.size(parts) - 2)).otherwise(F.array().cast("array<int>")))
    up = hosts.withColumn("parts", parts).select("parts", level.alias("i")).select(
        F.array_join(F.slice("parts", F.col("i"), F.size("parts")), ".").alias("src"),
        F.array_join(F.slice("parts", F.col("i") + 1, F.size("parts")), ".").alias("dst"),
    ).distinct()
    both = up.union(up.select("dst", "src")).withColumn("w", F.lit(1.0))
    return links.union(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _in_arrays(steps: DataFrame, seeds: DataFrame, tolerance: float, damping: float) -> DataFrame:
    """``propagate`` for a graph of at most SMALL edges and seeds: rounds are functions of arrays, 64 of them a job."""
    nodes = steps.select(F.col("of").alias("kind"), F.col("dst").alias("host")).union(seeds.select("kind", "host"))
    nodes = nodes.agg(F.sort_array(F.collect_set(F.struct("kind", "host"))).alias("all")).select(F.posexplode("all").alias("i", "node"))
    nodes = written(nodes.select("i", "node.kind", "node.host"), "nodes")
    src = nodes.select(F.col("i").alias("src_i"), F.col("kind").alias("of"), F.col("host").alias("src"))
    into = steps.join(src, ["of", "src"]).select(F.col("of").alias("kind"), F.col("dst").alias("host"), F.struct("src_i", "p").alias("step"))
    into = into.groupBy("kind", "host").agg(F.sort_array(F.collect_list("step")).alias("steps"))
    rows = nodes.join(into, ["kind", "host"], "left").join(seeds, ["kind", "host"], "left")
    none = F.array().cast("array<struct<src_i:int,p:double>>")
    rows = rows.select(F.struct("i", F.coalesce("steps", none).alias("steps"), F.coalesce("mass", F.lit(0.0)).alias("mass")).alias("x"))
    graph = rows.agg(F.sort_array(F.collect_list("x")).alias("x")).select("x.steps", F.transform("x.mass", lambda m: m * (1 - damping)).alias("base"), F.col("x.mass").alias("rank"))

    def further(rank):
        def scored(steps, base):
            return F.aggregate(steps, base, lambda total, step: total + step["p"] * F.element_at(rank, step["src_i"] + 1))

        return F.zip_with("steps", "base", scored)

    while True:
        graph = graph.withColumn("last", F.aggregate(F.sequence(F.lit(1), F.lit(63)), F.col("rank"), lambda rank, _: further(rank)))
        graph = written(graph.withColumn("rank", further(F.col("last"))), "walks")
        moved = F.aggregate(F.zip_with("last", "rank", lambda a, b: F.abs(b - a)), F.lit(0.0), lambda total, x: total + x)
        new = F.size(F.filter(F.zip_with("last", "rank", lambda a, b: (a == 0) & (b > 0)), lambda x: x))
        state = graph.select(moved.alias("moved"), new.alias("new")).first()
        if state.new == 0 and state.moved * damping / (1 - damping) <= tolerance:
            break
    found = graph.select(F.posexplode("rank").alias("i", "score")).where("score > 0")
    return nodes.join(found, "i").select("kind", "host", "score")


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE, damping: float = DAMPING, small: int = SMALL) -> DataFrame:
    """Personalised PageRank of two kinds at once: (kind, host, score).

    seeds(kind, host, mass): kind 0 walks along the edges, kind 1 against them; masses sum to 1 by kind.  A round is
    one join and one sum; a host's outgoing edges are first counted, so its pages do not meet in one task.  Hosts
    without outgoing edges pass nothing on.  Every five rounds go to the shared folder, and the last of them is held
    against the one before: a round moves at most ``damping`` times what its predecessor moved, so all later rounds
    together move at most damping / (1 - damping) of that.  It ends when this is within ``tolerance`` for both kinds
    and the round reached no new host, so that every host with a path from a seed has a score.  A graph of at most
    ``small`` edges and seeds goes the same rounds without a shuffle for each.
    """
    steps = edges.select(F.lit(0).alias("kind"), "src", "dst", "w").union(edges.select(F.lit(1), "dst", "src", "w"))
    out = steps.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    steps = steps.join(out, ["kind", "src"]).select(F.col("kind").alias("of"), "src", "dst", (F.col("w") / F.col("all") * damping).alias("p"))
    steps = written(steps, "steps")
    seeds = written(seeds, "seeds")
    size = steps.count() + seeds.count()
    if 0 < size <= small:
        return _in_arrays(steps, seeds, tolerance, damping)
    none = F.lit(None).cast("double").alias("last")
    base = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("score"), none)
    rank = seeds.select("kind", "host", F.col("mass").alias("score"))
    while True:
        for i in range(5):
            moved = rank.join(steps, (F.col("kind") == F.col("of")) & (F.col("host") == F.col("src")))
            moved = moved.select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("p")).alias("score"), none)
            parts = moved.union(base)
            if i == 4:
                parts = parts.union(rank.select("kind", "host", F.lit(0.0), F.col("score")))
            rank = parts.groupBy("kind", "host").agg(F.sum("score").alias("score"), F.max("last").alias("last"))
        both = written(rank, "rank")
        rank = both.drop("last")
        by_kind = both.groupBy("kind").agg(F.sum(F.abs(F.col("score") - F.coalesce("last", F.lit(0.0)))).alias("moved"), F.count_if(F.col("last").isNull()).alias("new")).collect()
        if all(r.new == 0 and r.moved * damping / (1 - damping) <= tolerance for r in by_kind):
            return rank


def host_verdicts(judged: DataFrame, html_col: str = "html", threshold: float = 0.5, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust, verdict) of each host that either walk reaches.

    Seeds: a host's share of all pages that a rule allows (trust) or blocks (distrust).  A host is blocked where
    distrust is more than ``threshold`` of both, rounded to DIGITS digits, so an even host is allowed.
    """
    own = judged.where("ruled is not null and host <> ''").groupBy("host", "ruled").agg(F.count(F.lit(1)).alias("n"))
    own = written(own, "ruled")
    totals = own.groupBy("ruled").agg(F.sum("n").alias("all"))
    seeds = own.join(F.broadcast(totals), "ruled")  # two rows: allow and block
    seeds = seeds.select(F.when(F.col("ruled") == "allow", 0).otherwise(1).alias("kind"), "host", (F.col("n") / F.col("all")).alias("mass"))
    rank = propagate(written(host_edges(judged, html_col), "edges"), seeds, tolerance)
    both = rank.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("score")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == 1, F.col("score")).otherwise(0.0)).alias("distrust"),
    )
    part = F.round(F.try_divide(F.col("distrust"), F.col("trust") + F.col("distrust")), DIGITS)
    return written(both.withColumn("verdict", F.when(part > threshold, "block").otherwise("allow")), "verdicts")


def filter_urls(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.5, tolerance: float = TOLERANCE) -> DataFrame:
    """One row for each page: id, host, path, rule, verdict.

    The longest rule that fits decides; else the host's verdict by propagation; a host that no walk reaches, and a
    url that is null, empty or without ``://``, is allowed.  Null html has no links, and a
    null id is an id like others.  Repeated rows count as pages and come back as often.  An empty table gives no rows.
    """
    kept = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    judged = judged_by_rules(kept, rules)
    hosts = host_verdicts(judged, "html", threshold, tolerance).select(F.col("host").alias("v_host"), F.col("verdict").alias("v"))
    out = judged_by_rules(kept.drop("html"), rules).join(fitting(hosts), F.col("host") == F.col("v_host"), "left")
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", "v", F.lit("allow")).alias("verdict"))
