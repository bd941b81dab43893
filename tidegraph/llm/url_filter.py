"""URL filters: rule lists first, then a path-template tree judged by labelled purity.

A url is cut into host and path.  Rules such as ``example.org/es/`` decide the urls
they fit; the longest rule wins.  Those urls are also the labels of the method, which
judges the rest:

1. every path becomes a chain of segments, whose digit runs are already wildcards, and
   (host, chain) pairs are counted (a partial aggregate, so a hot host shrinks before it
   is shuffled);
2. level by level a segment under one (host, prefix) turns into ``*`` where the prefix
   has many children that each hold few urls; what is deeper than ``TREE_LEVELS`` levels
   is generalised in one step, each place of it by itself under the prefix of so many levels;
3. branches of different hosts with one template are merged where a two-sample z test on
   their labelled block rates cannot tell the host's own from the others, or where the
   host has no label there;
4. a template is rejected where the block rate of what it was merged with, smoothed towards
   the corpus', reaches ``BLOCK_AT`` on at least ``MIN_LABELS`` labelled urls.

Only DataFrame operations run.  The tree holds templates, not urls; pages meet it in
one equi-join on a narrow row whose tree side is unique, so adaptive execution can split
a hot host.  A null url, or one without ``://``, has empty host and path, fits no rule
and is allowed.  Repeated rows are judged
alike; of rules of equal length the first by text wins; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialise, temporary

TREE_LEVELS = 6
#: A prefix with at least so many children, of at most so many urls each on average, is variable.
MIN_CHILDREN, MAX_MEAN_URLS = 8, 4.0
#: Below this z value two block rates count as the same.
SAME_Z = 1.96
#: Weight, in urls, of the corpus' rate.
SMOOTHING = 2.0
BLOCK_AT = 0.8
#: A template is rejected only on the evidence of so many labelled urls.
MIN_LABELS = 3


@dataclass(frozen=True)
class UrlRule:
    """A rule fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @classmethod
    def parse(cls, verdict: str, text: str) -> UrlRule:
        host, slash, rest = text.partition("/")
        return cls(verdict, host.lower(), slash + rest)

    @property
    def text(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path up to ``?`` or ``#``; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def match_rules(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """Struct(rule, verdict) of the longest rule that fits, else null.

    The list is compiled into one CASE, so it should stay in the thousands at most.
    """
    chosen = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen if chosen is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def segments(path: Column) -> Column:
    """The segments with digit runs as ``*``."""
    return F.array_remove(F.split(F.regexp_replace(path, "[0-9]+", "*"), "/"), "")


def _star_at(depth: int):
    return lambda segment, i: F.when((i == depth) & ~segment.contains("*"), "*").otherwise(segment)


def _variable(children: DataFrame, *under: str) -> DataFrame:
    """Where, of (under, segment, n), many segments hold few urls each."""
    each = children.where(~F.col("segment").contains("*")).groupBy(*under, "segment").agg(F.sum("n").alias("n"))
    found = each.groupBy(*under).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("n"))
    return found.where((F.col("children") >= MIN_CHILDREN) & (F.col("n") <= MAX_MEAN_URLS * F.col("children"))).select(*under)


def template_tree(urls: DataFrame) -> DataFrame:
    """(host, chain) -> (template, purity, tree_verdict) for rows of host, chain and label (``block``, ``allow`` or null)."""
    with temporary(urls.sparkSession) as keep:
        return keep(materialise(_template_tree(urls), "tree"))


def _template_tree(urls: DataFrame) -> DataFrame:
    is_label = lambda v: F.coalesce((F.col("label") == v).cast("long"), F.lit(0).cast("long"))
    tree = (
        urls.groupBy("host", "chain")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(is_label("block")).alias("bad"), F.sum(is_label("allow")).alias("good"))
        .withColumn("template", F.col("chain"))
    )
    tree = materialise(tree, "templates")  # every later step reads it more than once
    deepest = tree.agg(F.max(F.size("chain"))).first()[0] or 0
    for depth in range(1, min(deepest, TREE_LEVELS) + 1):
        prefix = F.array_join(F.slice("template", 1, depth - 1), "/")
        here = tree.where(F.size("template") >= depth).select(
            "host", prefix.alias("prefix"), F.get("template", F.lit(depth - 1)).alias("segment"), "n"
        )
        starred = F.transform("template", _star_at(depth - 1))
        tree = (
            tree.withColumn("prefix", prefix)
            .join(_variable(here, "host", "prefix").withColumn("variable", F.lit(True)), ["host", "prefix"], "left")
            .withColumn("template", F.when(F.col("variable"), starred).otherwise(F.col("template")))
            .drop("prefix", "variable")
        )
        tree = materialise(tree, "templates")
    return _judge(_deeper(tree) if deepest > TREE_LEVELS else tree)


def _deeper(tree: DataFrame) -> DataFrame:
    """The tree with variable places below the levels of the loop turned into ``*``, in one step however deep a path is."""
    tree = tree.withColumn("prefix", F.array_join(F.slice("template", 1, TREE_LEVELS), "/"))
    below = tree.where(F.size("template") > TREE_LEVELS).select("host", "prefix", "n", F.posexplode("template").alias("place", "segment"))
    places = _variable(below.where(F.col("place") >= TREE_LEVELS), "host", "prefix", "place")
    places = places.groupBy("host", "prefix").agg(F.collect_list("place").alias("places"))  # at most one path's length
    starred = F.transform("template", lambda x, i: F.when(F.array_contains("places", i) & ~x.contains("*"), "*").otherwise(x))
    found = tree.join(places, ["host", "prefix"], "left").withColumn("template", F.when(F.col("places").isNull(), F.col("template")).otherwise(starred))
    return materialise(found.drop("prefix", "places"), "templates")


def _judge(tree: DataFrame) -> DataFrame:
    """Merge what the labels cannot tell apart, smooth, and decide."""
    tree = tree.withColumn("template", F.array_join("template", "/"))
    leaves = materialise(tree.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "leaves")
    pools = leaves.groupBy("template").agg(F.sum("bad").alias("p_bad"), F.sum("good").alias("p_good"))
    corpus = leaves.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()  # two numbers
    bad, good = corpus["bad"] or 0, corpus["good"] or 0
    corpus_rate = F.lit(bad / max(1, bad + good))

    seen, others = F.col("bad") + F.col("good"), F.col("p_bad") + F.col("p_good") - F.col("bad") - F.col("good")
    pooled = F.try_divide(F.col("p_bad"), F.col("p_bad") + F.col("p_good"))
    apart = F.abs(F.try_divide(F.col("bad"), seen) - F.try_divide(F.col("p_bad") - F.col("bad"), others))
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), seen) + F.try_divide(F.lit(1.0), others)))
    merged = F.coalesce(apart < SAME_Z * spread, apart == 0, F.lit(True))
    pick = lambda own, pool: F.when(F.col("merged"), F.col(pool)).otherwise(F.col(own))
    labels = F.col("bad") + F.col("good")
    verdicts = (
        leaves.join(pools, "template").withColumn("merged", merged)
        .withColumn("bad", pick("bad", "p_bad")).withColumn("good", pick("good", "p_good"))
        .select("host", "template", ((F.col("bad") + SMOOTHING * corpus_rate) / (labels + SMOOTHING)).alias("purity"), labels.alias("labels"))
    )
    return tree.join(verdicts, ["host", "template"]).select(
        "host", "chain", F.concat(F.lit("/"), "template").alias("template"), "purity",
        F.when((F.col("purity") >= BLOCK_AT) & (F.col("labels") >= MIN_LABELS), "block").otherwise("allow").alias("tree_verdict"),
    )


def judge(df: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, template and purity."""
    host, path = split_url(F.col(url_col))
    pages = df.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    pages = pages.withColumn("match", match_rules(F.col("host"), F.col("path"), rules))
    pages = pages.select(
        "page_id", "host", "path", F.col("match.rule").alias("rule"), F.col("match.verdict").alias("label"),
        segments(F.col("path")).alias("chain"),
    )
    tree = template_tree(pages.select("host", "chain", "label"))
    return pages.join(tree, ["host", "chain"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce(F.col("label"), F.when(F.col("host") != "", F.col("tree_verdict")), F.lit("allow")).alias("verdict"), "template", "purity",
    )
