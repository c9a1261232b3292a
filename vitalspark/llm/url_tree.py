"""Page addresses judged by rules, and else by templates of the paths of their host.

Paths are first told by shape: runs of digits and long hexadecimal names become `#`. Each host's
shapes then make a tree that is walked level by level. At a node with many different segments those
that few pages share are variable and become `*`. Those left are grouped by what mostly follows
them and by whether their share of bad pages is as usual for the node, below or above it; a branch
is merged with its group, as `~`, `~-` or `~+`, if all that follows it is spread as in the whole
group. What comes of a path is its template; a template is rejected when its share
of bad labelled pages, smoothed by its host's and this by that of all, reaches one half.

Only counts of (host, shape) pass through the tree, never pages. Pages get their template back by a
join on these; keys with more than 1 / HEAVY of all pages, HEAVY at most, are broadcast, so that no
task gets a large host, and the rest is joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Levels of the tree; what lies deeper is one segment, whole. At most so many heavy keys.
LEVELS, HEAVY = 6, 1000
#: A node with more segments than MANY has variable ones: those with under 1 / MANY of its pages.
MANY = 16
#: Branches are alike up to this distance of what follows, besides what so few pages give by chance; a share of bad pages is usual up to so many deviations.
APART, DEVIATIONS = 0.2, 2.0
#: Labelled pages that a host's share weighs against a template's own, all's against a host's, and PRIOR, what is believed without a label, against all's.
WEIGHT, PRIOR = 4.0, 0.1
#: Share of bad pages from which a template is rejected.
REJECT = 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What is between the first :// and the next /, ? or #, in lower case; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[bool, str, str]]) -> tuple[Column, Column]:
    """The longest rule (allow, host, path) that fits, as host and path in one, and whether it allows; both null if none fits.

    A rule fits its host and all subdomains where the path starts with the rule's. For a list of
    rules that a person writes: it becomes one expression.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:]))
    name, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for allowed, h, p in reversed(ordered):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, allow = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(allowed)).otherwise(allow)
    return name, allow


def shape_of(path: Column) -> Column:
    """Segments of a path, hexadecimal names of 16 or more and runs of digits as #; what lies below LEVELS is one segment."""
    shaped = lambda x: F.when(x.rlike("^[0-9a-fA-F-]{16,}$"), "#").otherwise(F.regexp_replace(x, "[0-9]+", "#"))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x, i: i > 0), shaped)
    deep = F.concat(F.slice(parts, 1, LEVELS - 1), F.array(F.array_join(F.slice(parts, LEVELS, F.size(parts)), "/")))
    return F.when(F.size(parts) > LEVELS, deep).otherwise(parts)


def named(counts: DataFrame) -> DataFrame:
    """(host, done, segment) of a level with `name`: the segment itself, `*`, or `~`, `~-`, `~+` where merged.

    counts: host, done (the template so far), segment, rest (shape of what follows), n, labelled, bad.
    """
    node, branch, group = ["host", "done"], ["host", "done", "segment"], ["host", "done", "leads", "side"]
    follows = counts.groupBy(*branch, "rest").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")])
    branches = follows.groupBy(*branch).agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")], F.count(F.lit(1)).alias("kinds"), F.max(F.struct("n", "rest"))["rest"].alias("leads"))
    nodes = branches.groupBy(*node).agg(F.count(F.lit(1)).alias("segments"), *[F.sum(c).alias(f"node_{c}") for c in ("n", "labelled", "bad")])
    pool = (F.col("node_bad") + 1.0) / (F.col("node_labelled") + 2.0)
    off = (F.col("bad") - F.col("labelled") * pool) / F.sqrt(F.greatest(F.lit(1.0), F.col("labelled") * pool * (1 - pool)))
    side = F.when(off < -DEVIATIONS, "-").when(off > DEVIATIONS, "+").otherwise("")
    variable = (F.col("segments") > MANY) & (F.col("n") * MANY < F.col("node_n"))
    told = branches.join(nodes, node).select(*branch, "n", "kinds", "leads", side.alias("side"), variable.alias("variable"))
    # What follows in a branch against what follows in all of its group.
    placed = follows.select(*branch, "rest", F.col("n").alias("m")).join(told.where(~F.col("variable")), branch)
    pooled = placed.groupBy(*group, "rest").agg(F.sum("m").alias("pooled"))
    groups = told.where(~F.col("variable")).groupBy(*group).agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("group_n"))
    over = F.sum(F.greatest(F.lit(0.0), F.col("m") / F.col("n") - F.col("pooled") / F.col("group_n")))
    apart = placed.join(pooled, [*group, "rest"]).join(groups, group).groupBy(*branch).agg(over.alias("apart"), F.first("members").alias("members"))
    alike = (F.col("members") > 1) & (F.round("apart", 9) <= F.round(APART + F.sqrt(F.col("kinds") / F.col("n")) / 2, 9))
    return told.join(apart, branch, "left").select(*branch, F.when(F.col("variable"), "*").when(alike, F.concat(F.lit("~"), "side")).otherwise(F.col("segment")).alias("name"))


def templates(classes: DataFrame) -> DataFrame:
    """host, shape, template: of every (host, shape) with its counts n, labelled, bad."""
    spark = classes.sparkSession
    tree = materialise(classes.withColumns({"done": F.lit(""), "level": F.lit(0)}), "tree")
    depth = tree.agg(F.max(F.size("shape"))).first()[0] or 0
    for level in range(depth):
        here = tree.where(F.size("shape") > level).withColumns({"segment": F.get("shape", F.lit(level)), "rest": F.array_join(F.slice("shape", level + 2, LEVELS + 1), "/")})
        names = named(here.select("host", "done", "segment", "rest", "n", "labelled", "bad"))
        on = here.join(names, ["host", "done", "segment"]).withColumn("done", F.concat("done", F.lit("/"), "name"))
        step = materialise(on.select(*tree.columns).unionByName(tree.where(F.size("shape") <= level)), "tree")
        discard(spark, tree)
        tree = step
    return tree.select("host", "shape", F.col("done").alias("template"), "n", "labelled", "bad")


def purity(made: DataFrame) -> DataFrame:
    """host, shape, template, bad_share: smoothed share of bad labelled pages of a template."""
    sums = lambda suffix: [F.sum(c).alias(f"{c}_{suffix}") for c in ("labelled", "bad")]
    each = made.groupBy("host", "template").agg(*sums("own"))
    hosts = each.groupBy("host").agg(*[F.sum(f"{c}_own").alias(f"{c}_host") for c in ("labelled", "bad")])
    every = hosts.agg(*[F.sum(f"{c}_host").alias(f"{c}_all") for c in ("labelled", "bad")])
    whole = (F.col("bad_all") + WEIGHT * PRIOR) / (F.col("labelled_all") + WEIGHT)
    of_host = (F.col("bad_host") + WEIGHT * whole) / (F.col("labelled_host") + WEIGHT)
    own = (F.col("bad_own") + WEIGHT * of_host) / (F.col("labelled_own") + WEIGHT)
    smoothed = each.join(hosts, "host").crossJoin(F.broadcast(every)).select("host", "template", own.alias("bad_share"))
    return made.join(smoothed, ["host", "template"]).select("host", "shape", "template", "n", "bad_share")


def judge(pages: DataFrame, key: str, url: str, labelled: DataFrame, rules: list[tuple[bool, str, str]]) -> DataFrame:
    """key, host, path, rule, verdict, template, bad_share: a row a page, repeated rows and null keys too.

    labelled: url and bad (0 or 1), a row a labelled page; nulls in either count as no label. Null
    addresses and those without :// have an empty host and path and are judged as any other. The verdict is the rule's, else
    allow or block by the template. Without labels every share is PRIOR
    and nothing is rejected. An empty table gives an empty one. Columns besides these are left out.
    """
    parts = [host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")]
    read = pages.select(F.col(key).alias("key"), *parts).withColumn("shape", shape_of(F.col("path")))
    known = labelled.where(F.col("bad").isNotNull() & F.col(url).isNotNull()).select(*parts, F.col("bad").cast("long").alias("bad"))
    none = F.lit(0).cast("long")
    counted = read.select("host", "shape", F.lit(1).cast("long").alias("n"), none.alias("labelled"), none.alias("bad"))
    counted = counted.unionByName(known.select("host", shape_of(F.col("path")).alias("shape"), none.alias("n"), F.lit(1).cast("long").alias("labelled"), "bad"))
    classes = counted.groupBy("host", "shape").agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")]).where("n > 0")
    made = templates(classes)
    told = materialise(purity(made), "templates")
    discard(pages.sparkSession, made)
    total = told.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * HEAVY > total
    on = ["host", "shape"]
    first = read.join(F.broadcast(told.where(heavy).select(*on, "template", "bad_share")), on, "left")
    rest = first.where("template is null").drop("template", "bad_share").join(told.where(~heavy).select(*on, "template", "bad_share"), on)
    rule, allow = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.when(F.coalesce(allow, F.col("bad_share") < REJECT), "allow").otherwise("block")
    return first.where("template is not null").unionByName(rest).select(F.col("key").alias(key), "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", "bad_share")
