"""URL filters: rules first, then trust and distrust spread over the links between hosts.

Trust is a personalised PageRank from hosts with pages that an allow rule fits, along links; distrust runs
from hosts with blocked pages against the links (who links to bad hosts is suspect). Hosts link where a
page has an absolute link, and a host and its parent domain (``m.a.net`` and ``a.net``) link to each other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import staged
from .common import with_matches
from .decontam import LOWER, UPPER


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path begins with ``path``."""

    verdict: str
    host: str
    path: str

    def fits(self) -> Column:
        host = F.col("host")
        return ((host == self.host) | host.endswith("." + self.host)) & F.col("path").startswith(self.path)


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
DAMPING = 0.7
#: Rounds end when no host is new and none changes by more than this share of its value.
TOLERANCE = 1e-4
#: A host without a rule is blocked if its distrust is over this many times its trust.
DISTRUST_RATIO = 1.0
_LINKED_HOST = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/"'?#\s>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower-cased) and path; both empty for null and for a text without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_edges(pages: DataFrame) -> DataFrame:
    """Links between different hosts: (src, dst, weight), weight = number of links."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINKED_HOST), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    hosts = pages.select("host").filter("host <> ''").distinct()
    parent = hosts.select("host", F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("up")).filter("up <> ''")
    both = parent.select(F.col("host").alias("src"), F.col("up").alias("dst"))
    both = both.union(parent.select(F.col("up").alias("src"), F.col("host").alias("dst")))
    return links.union(both).filter("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, iterations: int | None = None) -> DataFrame:
    """(host, trust, distrust) from ``seeds`` (host, trust, distrust), each summing to 1, when they have settled or after ``iterations`` rounds.

    Trust runs from src to dst, distrust from dst to src, both shared by weight. They have settled when neither has come to a new host in a round,
    however far from the seeds, and none has changed by more than ``tolerance`` of itself: the rounds grow with the longest way
    from a seed and with log(tolerance) / log(damping). Mass that reaches a host without a link ends there; :func:`judge_urls` returns it to the seeds.
    Rounds are staged; links of a host that has a large part of all are spread.
    """
    ahead = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    back = edges.groupBy("dst").agg(F.sum("weight").alias("total"))
    share = (F.col("weight") / F.col("total")).alias("share")
    steps = edges.join(ahead, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), F.lit(True).alias("ahead"), share)
    steps = staged(steps.union(edges.join(back, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), F.lit(False).alias("ahead"), share)), "steps")
    total = steps.count()
    degrees = staged(steps.groupBy("host").agg(F.count("*").alias("many")), "degrees")
    zero = F.lit(0.0)
    base = staged(seeds, "seeds").select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    counted = lambda df: staged(df.join(degrees, "host", "left").withColumn("many", F.coalesce("many", F.lit(0).cast("long"))), "ranks")
    state, done = counted(seeds.select("host", "trust", "distrust")), 0
    while iterations is None or done < iterations:
        moved = with_matches(steps, state.filter("many > 0"), ["host"], "many", total, ["to"]).filter("match is not null").select(
            F.col("to").alias("host"),
            F.when(F.col("ahead"), F.col("match.trust") * F.col("share") * damping).otherwise(zero).alias("trust"),
            F.when(F.col("ahead"), zero).otherwise(F.col("match.distrust") * F.col("share") * damping).alias("distrust"),
        )
        rows = moved.union(base).select("*", zero.alias("trust_was"), zero.alias("distrust_was"))
        rows = rows.union(state.select("host", zero, zero, "trust", "distrust"))
        state, done = counted(rows.groupBy("host").agg(*[F.sum(c).alias(c) for c in rows.columns[1:]])), done + 1
        settled = lambda c: (F.col(c) == F.col(f"{c}_was")) | ((F.col(f"{c}_was") > 0) & (F.abs(F.col(c) - F.col(f"{c}_was")) <= tolerance * F.col(c)))
        if not state.filter(~(settled("trust") & settled("distrust"))).limit(1).count():
            break
    return state.select("host", "trust", "distrust")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, ratio: float = DISTRUST_RATIO) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and its host's trust and distrust.

    The longest fitting rule decides (host and path together; of equals the first by name). Else the page is
    blocked if its host's distrust is over ``ratio`` times its trust; hosts that nothing reaches are allowed.
    Null urls and those without ``://`` have an empty host and path, fit no rule and are allowed. Null html has no
    links; html is read whole, however long. Null and repeated ids are rows like any other; other columns are ignored; empty tables are fine.
    Trust and distrust are shares of all there is: what reaches a host without a link returns to the seeds, which scales all values alike. Jobs run while this is called.
    """
    host, path = url_parts(F.col("url").cast("string"))
    pages = pages.select("page_id", F.col("html").cast("string").alias("html"), host.alias("host"), path.alias("path"))
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host + r.path))
    rule = F.coalesce(*[F.when(r.fits(), F.lit(r.host + r.path)) for r in ordered], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(r.fits(), F.lit(r.verdict)) for r in ordered], F.lit(None).cast("string"))
    ruled = pages.select("page_id", "html", "host", "path", rule.alias("rule"), verdict.alias("ruled"))

    counts = ruled.filter("ruled is not null and host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("ruled") == "allow", 1)).alias("good"), F.count(F.when(F.col("ruled") == "block", 1)).alias("bad")
    )
    counts = staged(counts, "rule_counts")
    all_good, all_bad = (float(x or 1) for x in counts.agg(F.sum("good"), F.sum("bad")).first())
    seeds = counts.select("host", (F.col("good") / all_good).alias("trust"), (F.col("bad") / all_bad).alias("distrust"))
    ranks = spread(staged(host_edges(ruled.select("host", "html")), "host_edges"), seeds)

    # pages without a host, and those of a host with a large part of all, are spread
    pages_of = ruled.filter("host <> ''").groupBy("host").agg(F.count("*").alias("many"))
    all_trust, all_distrust = (float(x or 1) for x in ranks.agg(F.sum("trust"), F.sum("distrust")).first())
    shares = ranks.select(F.col("host").alias("of"), (F.col("trust") / all_trust).alias("trust"), (F.col("distrust") / all_distrust).alias("distrust"))
    shares = staged(shares.join(pages_of.withColumnRenamed("host", "of"), "of"), "shares")
    named = ruled.drop("html").withColumn("of", F.when(F.col("host") != "", F.col("host")))
    out = with_matches(named, shares, ["of"], "many", ruled.count(), ["page_id", "path"])
    out = out.withColumns({c: F.coalesce(f"match.{c}", F.lit(0.0)) for c in ("trust", "distrust")})
    verdict = F.coalesce("ruled", F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust", "distrust")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
