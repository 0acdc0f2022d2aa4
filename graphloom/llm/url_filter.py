"""URL filters: rules by host suffix and path prefix, then trust and distrust propagated over the host link graph.

Where no rule fits, a host's verdict comes from two personalised PageRanks over host edges: trust flows from the hosts
that only allow rules reach along links, distrust from the hosts that block rules reach against links. Both run in
Spark until what still moves is below a stated share of the whole. A host's links to itself are summed as a geometric
series, so they cost no rounds. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored

DAMPING, TOLERANCE, RATIO = 0.85, 1e-6, 1.0
TIE = 1e-9  #: ranks that differ by a smaller share are equal, whatever the order of addition
#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, A-Z lower-cased; empty without it."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def matched(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (as host then path) and its verdict; nulls where none fits."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    name: Column = F.lit(None).cast("string")
    verdict: Column = F.lit(None).cast("string")
    for rule in reversed(longest):
        fits = _fits(host, path, rule)
        name = F.when(fits, rule[1] + rule[2]).otherwise(name)
        verdict = F.when(fits, rule[0]).otherwise(verdict)
    return name, verdict


_SCHEME = r"\A[A-Za-z][A-Za-z0-9+.-]*:"
_ANCHOR = r"""(?is)<a(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def host_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst, n): links between hosts, from quoted and plain href values.

    A link with :// after a scheme, or with // at its start, has a host of its own; one with another scheme (mailto: and
    the like), none or only a fragment is no link; any other stays on its page's host.
    """
    at = F.explode(F.regexp_extract_all(F.col("h"), F.lit(_ANCHOR), 1)).alias("link")
    links = pages.select(host_of(pages[f"`{url}`"]).alias("src"), pages[f"`{html}`"].alias("h")).where("src <> ''").select("src", at)
    link = F.trim(F.regexp_replace("link", r"""\A["']|["']\z""", ""))
    own = host_of(F.concat(F.lit("x:"), F.regexp_extract(link, r"(?s)\A(?:[^:/?#]+:)?(//.*)", 1)))
    dst = F.when(link.rlike(_SCHEME + "//") | link.startswith("//"), own).when((link != "") & ~link.startswith("#") & ~link.rlike(_SCHEME), F.col("src"))
    return links.select("src", dst.alias("dst")).where("dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, *, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(kind, host, rank) over edges (kind, src, dst, n) and seeds (kind, host, weight), several kinds side by side.

    A walk from the seeds takes each further step with probability ``damping`` and ends where no link leads on; the rank
    is the share of all visits. Rounds end when what walks have still to visit is below ``tolerance`` of the visits of
    each kind, which geometric decay brings about: each round moves at most ``damping`` of what the last one moved.
    """
    out = edges.groupBy(F.col("kind").alias("k"), F.col("src").alias("s")).agg(F.sum("n").alias("total"))
    p = edges.join(out, (F.col("kind") == F.col("k")) & (F.col("src") == F.col("s"))).select(F.col("kind").alias("k"), "src", "dst", (damping * F.col("n") / F.col("total")).alias("p"))
    p = Stored(p, "shares").df
    stay = p.where("src = dst").select(F.col("k").alias("loop_kind"), F.col("src").alias("loop"), (1 / (1 - F.col("p"))).alias("stay"))
    stays = lambda df, kind, host: df.join(stay, (F.col(kind) == F.col("loop_kind")) & (F.col(host) == F.col("loop")), "left")
    longer = F.coalesce("stay", F.lit(1.0))
    share = Stored(stays(p.where("src <> dst"), "k", "dst").select("k", "src", "dst", (F.col("p") * longer).alias("p")), "shares").df
    first = stays(seeds, "kind", "host").select("kind", "host", (F.col("weight") * longer).alias("step"))
    now = Stored(first.select("*", F.col("step").alias("visits")), "visits")
    while True:
        moved = now.df.groupBy("kind").agg(F.sum("step").alias("step"), F.sum("visits").alias("visits")).collect()  # a row a kind
        if all(r["step"] <= tolerance * (1 - damping) * r["visits"] for r in moved):
            break
        step = now.df.where("step > 0").join(share, (F.col("kind") == F.col("k")) & (F.col("host") == F.col("src")))
        step = step.select("kind", F.col("dst").alias("host"), (F.col("step") * F.col("p")).alias("step"))
        both = step.withColumn("visits", F.col("step")).union(now.df.select("kind", "host", F.lit(0.0), "visits"))
        nxt = Stored(both.groupBy("kind", "host").agg(F.sum("step").alias("step"), F.sum("visits").alias("visits")), "visits")
        now.drop()
        now = nxt
    total = now.df.groupBy(F.col("kind").alias("k")).agg(F.sum("visits").alias("all"))
    return now.df.join(F.broadcast(total), F.col("kind") == F.col("k")).select("kind", "host", (F.col("visits") / F.col("all")).alias("rank"))  # a row a kind


def judge_urls(
    pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", rules: Sequence[tuple[str, str, str]] = RULES, damping: float = DAMPING, tolerance: float = TOLERANCE, ratio: float = RATIO
) -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust), a row a row.

    A host seeds distrust by its number of blocked pages and trust by its number of allowed ones, each set scaled to 1.
    Where no rule fits, a page is blocked when its host's distrust exceeds ``ratio`` times its trust, else allowed; a
    host that neither reaches is allowed. A url that is null or has no :// has an empty host and path and is allowed.
    Repeated rows are judged alike and count as pages of their own; a null html has no links; an empty table gives an
    empty result; other columns are not read.
    """
    rows = pages.select(pages[f"`{key}`"].alias("k"), host_of(pages[f"`{url}`"]).alias("host"), path_of(pages[f"`{url}`"]).alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumn("rule", rule).withColumn("told", verdict)
    edges = Stored(host_edges(pages, url=url, html=html), "edges").df
    both = edges.select(F.lit("allow").alias("kind"), "src", "dst", "n").union(edges.select(F.lit("block"), "dst", "src", "n"))
    seeds = ruled.where(F.col("told").isNotNull() & (F.col("host") != "")).groupBy(F.col("told").alias("kind"), "host").agg(F.count("*").alias("c"))
    total = seeds.groupBy(F.col("kind").alias("k")).agg(F.sum("c").alias("all"))
    seeds = seeds.join(F.broadcast(total), F.col("kind") == F.col("k")).select("kind", "host", (F.col("c") / F.col("all")).alias("weight"))  # a row a kind
    ranks = personalised_pagerank(both, seeds, damping=damping, tolerance=tolerance)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    scores = ranks.groupBy(F.col("host").alias("scored")).agg(of("allow").alias("trust"), of("block").alias("distrust"))
    judged = ruled.join(scores, F.col("host") == F.col("scored"), "left")
    spread = F.when(F.coalesce(F.col("distrust") > ratio * (1 + TIE) * F.col("trust"), F.lit(False)), "block").otherwise("allow")
    return judged.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("told", spread).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
