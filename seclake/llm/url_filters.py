"""URL verdicts by rules and by a tree of path templates.

A rule names a host and the start of a path; the longest that fits a URL decides. URLs that no rule fits are
judged by templates learned from all URLs, the rules' verdicts being the labels:

1. Paths become shapes: digit runs and identifiers in their segments turn into `#`.
2. Level by level, each node of a host's tree looks at its branches. A node with many thinly used branches is
   variable, and its branches become one wildcard. Otherwise labelled branches merge where their blocked share does not differ
   from the node's by more than `z` standard errors; the others keep their name. An unlabelled branch is held against these merged
   siblings by its own evidence, what follows it: it joins them if a chi-square test of the two distributions of
   next segments does not tell them apart by more than `z`, and else the other unlabelled ones.
3. A template (host and merged path) is rejected if its blocked share, smoothed by `weight` labels of its parent's share, is
   at least `reject`. Shares are smoothed down the tree in this way, so that an unlabelled template has what its surroundings say. At
   the root of a host stands the overall share, at most half of `reject`: a host of which nothing is known is not rejected.

A node whose URLs are all labelled, or all not, or of one shape, is closed: whatever the templates below it, its open
URLs get the same verdict. So the tree is as deep as there is something to decide, however long the paths are.

Shapes are counted with partial sums first, so that the tree has a row for each host and shape, however often it
occurs; all joins on hosts or shapes go through `skew_join`.

Defined results: a URL that is null or has no `://` has an empty host and path, fits no rule and is judged as the
template of that empty host; repeated rows repeat their result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.workspace import written
from .common import LOWER, UPPER, named, skew_join

ALLOW, BLOCK = "allow", "block"


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str = ""


MOST_RULES = 1000


def url_host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def path_shape(path: Column) -> Column:
    """The path with identifiers and digit runs as `#`."""
    plain = F.regexp_replace(path, r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "#")
    return F.regexp_replace(plain, "[0-9]+", "#")


def fitting_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """(rule, verdict) of the longest rule that fits, or null. Rules are part of the plan and at most MOST_RULES."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in sorted(rules, key=lambda r: (-len(r.host + r.path), r))
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule: string, verdict: string>")


_SUMS = ("n", "blocked", "labelled")


def _followers(open_rows: DataFrame, names: DataFrame, z: float) -> DataFrame:
    """(host, template, branch) of unlabelled branches whose next segments are distributed like those of the merged labelled ones.

    With counts a of the branch and b of the siblings, the statistic is the sum of (a * r - b / r)^2 / (a + b), r^2 being the ratio of
    their totals; segments that only the siblings have are summed at once. Its mean is the number of segments less one, f, its variance 2 f.
    """
    node, key = ["host", "template"], ["host", "template", "branch"]
    kids = open_rows.groupBy(*key, "child").agg(F.sum("n").alias("n"))
    named_kids = written(skew_join(written(kids), names, key, "inner"))
    siblings = named_kids.where("name = '*='").groupBy(*node, "child").agg(F.sum("n").alias("b"))
    siblings = written(siblings)
    totals = written(siblings.groupBy(*node).agg(F.sum("b").alias("all_b"), F.count(F.lit(1)).alias("kinds_b")))
    own = written(named_kids.where("name = '*?'").select(*key, "child", F.col("n").alias("a")))
    met = skew_join(own, siblings, [*node, "child"], "left").withColumn("b", F.coalesce("b", F.lit(0)))
    sums = written(met.groupBy(*key).agg(F.sum("a").alias("all_a"), F.sum("b").alias("met_b"), F.count(F.lit(1)).alias("kinds_a"), F.sum(F.when(F.col("b") > 0, 1).otherwise(0)).alias("both"),
                                         F.sum(F.col("a") * F.col("a") / (F.col("a") + F.col("b"))).alias("aa"), F.sum(F.col("a") * F.col("b") / (F.col("a") + F.col("b"))).alias("ab"),
                                         F.sum(F.col("b") * F.col("b") / (F.col("a") + F.col("b"))).alias("bb")))
    held = skew_join(sums, totals, node, "inner")
    ratio = F.col("all_b") / F.col("all_a")
    statistic = F.col("aa") * ratio - 2 * F.col("ab") + F.col("bb") / ratio + (F.col("all_b") - F.col("met_b")) / ratio
    free = F.col("kinds_a") + F.col("kinds_b") - F.col("both") - 1
    return held.where(statistic <= free + z * F.sqrt(2.0 * free) + 1e-9).select(*key)


def templates(shapes: DataFrame, prior: float, weight: float = 4.0, min_branches: int = 16, thin: float = 4.0, z: float = 2.0) -> DataFrame:
    """Templates of the shapes: host, shape, template, the shapes' counts n, blocked, labelled, and the share that stands above the template."""
    segments = F.split(F.col("shape"), "/")
    rest = F.when(F.col("shape").startswith("/"), F.slice(segments, F.lit(2), F.size(segments))).otherwise(segments)
    state = written(shapes.select("host", "shape", *_SUMS, rest.alias("rest"), F.lit("").alias("template"), F.lit(prior).alias("prior")))
    sums = [F.sum(c).alias(c) for c in _SUMS]
    done, level, node, key = [], 0, ["host", "template"], ["host", "template", "branch"]
    while state.limit(1).count():
        nodes = state.groupBy(*node).agg(*[F.sum(c).alias(f"all_{c}") for c in _SUMS], F.count(F.lit(1)).alias("shapes"), F.count_distinct(F.get("rest", F.lit(level))).alias("width"))
        nodes = written(nodes.withColumn("closed", (F.col("all_labelled") == 0) | (F.col("all_labelled") == F.col("all_n")) | (F.col("shapes") == 1)))
        wide = nodes.where(F.col("shapes") > F.greatest(F.lit(1), F.lit(state.count() / 1000)))
        held = written(skew_join(state, nodes, node, "inner", wide))
        done.append(held.where("closed").select("host", "shape", "template", *_SUMS, "prior"))
        above = (F.col("all_blocked") + weight * F.col("prior")) / (F.col("all_labelled") + weight)
        going = held.where(~F.col("closed")).withColumn("prior", above).withColumn("branch", F.get("rest", F.lit(level)))
        done.append(going.where(F.col("branch").isNull()).select("host", "shape", F.concat("template", F.lit("/.")).alias("template"), *_SUMS, "prior"))  # paths that end here
        open_rows = written(going.where(F.col("branch").isNotNull()).withColumn("child", F.coalesce(F.get("rest", F.lit(level + 1)), F.lit(""))))
        branches = open_rows.groupBy(*key).agg(*sums, *[F.first(c).alias(c) for c in ("all_n", "all_blocked", "all_labelled", "width")])
        share = F.col("all_blocked") / F.col("all_labelled")
        alike = F.abs(F.col("blocked") / F.col("labelled") - share) <= z * F.sqrt(share * (1 - share) / F.col("labelled")) + 1e-12
        name = (
            F.when((F.col("width") >= min_branches) & (F.col("all_n") < thin * F.col("width")), "*").when(F.col("labelled") == 0, "*?").when(alike, "*=").otherwise(F.col("branch"))
        )
        names = written(branches.select(*key, name.alias("name")))
        joins = _followers(open_rows, names, z).withColumn("_joins", F.lit(True))
        names = written(names.join(joins, key, "left").select(*key, F.when(F.col("_joins"), "*=").otherwise(F.col("name")).alias("name")))
        placed = skew_join(open_rows, names, key, "inner").withColumn("template", F.concat("template", F.lit("/"), "name"))
        state, level = written(placed.select("host", "shape", *_SUMS, "rest", "template", "prior")), level + 1
    return reduce(DataFrame.unionByName, done) if done else state.drop("rest")


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], id_col: str = "page_id", url_col: str = "url", reject: float = 0.6, weight: float = 4.0,
               min_branches: int = 16, thin: float = 4.0, z: float = 2.0) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict, shape."""
    urls = named(pages, page_id=id_col, url=url_col)
    parsed = urls.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    ruled = parsed.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", F.col("_fit.rule").alias("rule"), F.col("_fit.verdict").alias("verdict"))
    ruled = written(ruled.withColumn("shape", path_shape(F.col("path"))))
    known = F.col("verdict").isNotNull().cast("long")
    shapes = written(ruled.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("verdict") == BLOCK, 1).otherwise(0)).alias("blocked"), F.sum(known).alias("labelled")))
    overall = shapes.agg(F.sum("blocked"), F.sum("labelled")).first()
    prior = min((overall[0] or 0) / overall[1], reject / 2) if overall[1] else 0.0
    trees = written(templates(shapes, prior, weight, min_branches, thin, z))
    # All shapes of a template have the same share above them.
    purity = trees.groupBy("host", "template").agg(((F.sum("blocked") + weight * F.first("prior")) / (F.sum("labelled") + weight)).alias("purity"))
    bad_templates = purity.where(F.col("purity") >= reject).select("host", "template")
    bad = skew_join(trees, written(bad_templates), ["host", "template"], "left_semi").select("host", "shape", F.lit(BLOCK).alias("found"))
    open_pages = ruled.where(F.col("verdict").isNull())
    judged = skew_join(open_pages, written(bad), ["host", "shape"], "left")
    judged = judged.withColumn("verdict", F.coalesce("found", F.lit(ALLOW))).drop("found")
    return ruled.where(F.col("verdict").isNotNull()).unionByName(judged).select("page_id", "host", "path", "rule", "verdict", "shape")
