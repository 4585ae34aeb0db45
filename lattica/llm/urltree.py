"""URL verdicts from rules and, where none fits, from a path-template tree of each host.

Under a host, paths form a tree of segments. From the root down, a segment that
looks like a number, date, hash or file number is a wildcard of its form; so are
literal children of a node, of any number, whose shares of blocked pages do not
differ by a chi-square test, a wildcard for each group of like shares. Children
without a label, or unlike all others, stay literal. A leaf is a template; it is
rejected if its smoothed share of blocked among labelled pages is high. The share
is smoothed toward that of the same path forms on the hosts of its registered
domain (its last two labels), and that toward the share on all hosts, which is
smoothed toward one half; so a template without labels of its own is judged by
those of its kind elsewhere. All of it is counting by (host, template) or by
path form, so a large host is spread over its templates and counted before it is
shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from lattica.plans.scratch import Scratch

#: Chi-square of one degree of freedom up to which two shares count as alike: its mean and two standard deviations.
ALIKE = 1 + 2 * math.sqrt(2)
#: Pseudo-counts of a share's prior, and the smoothed purity that rejects.
SMOOTH, REJECT = 2.0, 0.8

#: (verdict, host, path) of the rules.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def form(segment: Column) -> Column:
    """A wildcard for segments that vary by their form, else the segment."""
    return (
        F.when(segment.rlike(r"^\d+$"), F.lit("{n}"))
        .when(segment.rlike(r"^\d{4}-\d{1,2}(-\d{1,2})?$"), F.lit("{date}"))
        .when(segment.rlike(r"(?i)^[0-9a-f]{8}(-?[0-9a-f]{4}){3}-?[0-9a-f]{12}$|^(?=.*\d)[0-9a-f]{12,}$"), F.lit("{hash}"))
        .when(segment.rlike(r"^\d+\.[A-Za-z]{1,5}$"), F.concat(F.lit("{n}"), F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)))
        .when(segment.rlike(r"\d"), F.regexp_replace(segment, r"\d+", "{n}"))
        .otherwise(segment)
    )


def step_of(segment: Column) -> Column:
    """A segment in a template; ``*`` in front is kept for merged children."""
    made = form(segment)
    return F.concat(F.lit("/"), F.when(F.startswith(made, F.lit("*")), F.concat(F.lit("\\"), made)).otherwise(made))


def _chi(b: Column, m: Column, c: Column, n: Column) -> Column:
    """Chi-square of ``b`` blocked of ``m`` against ``c`` of ``n``."""
    cross = b * (n - c) - c * (m - b)
    return F.coalesce(F.try_divide((m + n) * cross * cross, (b + c) * (m + n - b - c) * m * n), F.lit(0.0))


def _group(done: Column, pool: Column) -> Column:
    """Add a pool of children of one share; it joins the last group if it is like the whole of it and like its least share."""
    last = F.try_element_at(done, F.lit(-1))
    agree = (_chi(last["b"], last["m"], pool["b"], pool["m"]) <= ALIKE) & (_chi(last["b0"], last["m0"], pool["b"], pool["m"]) <= ALIKE)
    joins = (F.size(done) > 0) & agree
    own = lambda name, kept: F.when(joins, kept).otherwise(pool[name])
    return F.concat(
        done,
        F.array(
            F.struct(
                pool["share"].alias("share"),
                pool["kids"].alias("kids"),
                (F.coalesce(last["g"], F.lit(0)) + F.when(joins, 0).otherwise(1)).alias("g"),
                own("b", last["b"] + pool["b"]).alias("b"),
                own("m", last["m"] + pool["m"]).alias("m"),
                own("b", last["b0"]).alias("b0"),
                own("m", last["m0"]).alias("m0"),
            )
        ),
    )


def like_children(children: DataFrame) -> DataFrame:
    """``(host, template, _c, g)`` of the labelled literal children that merge, by groups of like shares at each node.

    Children of one share are pooled, so a node costs its distinct shares, not its children.
    """
    share = F.try_divide(F.col("b").cast("double"), F.col("a") + F.col("b"))
    kids = children.filter("a + b > 0").filter(~F.startswith("_c", F.lit("/{"))).withColumn("share", share)
    pools = kids.groupBy("host", "template", "share").agg(
        F.sum("b").cast("double").alias("b"), F.sum(F.col("a") + F.col("b")).cast("double").alias("m"), F.count(F.lit(1)).alias("kids")
    )
    nodes = pools.groupBy("host", "template").agg(F.sort_array(F.collect_list(F.struct("share", "b", "m", "kids"))).alias("pools"))
    empty = F.array().cast("array<struct<share:double,kids:bigint,g:int,b:double,m:double,b0:double,m0:double>>")
    groups = nodes.select("host", "template", F.inline(F.aggregate("pools", empty, _group))).select("host", "template", "share", "kids", "g")
    groups = groups.withColumn("members", F.sum("kids").over(Window.partitionBy("host", "template", "g"))).filter("members > 1")
    return kids.join(groups, ["host", "template", "share"]).select("host", "template", "_c", "g")


def learn_templates(paths: DataFrame) -> DataFrame:
    """``paths(host, path, n, blocked, allowed)`` with the ``template`` of each path.

    One pass per level: a node's children are counted, its groups of like
    children are found, and paths follow them. A path alone in its node meets
    no other child further down, so it is done at once, however deep.
    """
    scratch = Scratch(paths.sparkSession)
    now = paths.withColumn("_s", F.filter(F.split("path", "/"), lambda s: s != "")).withColumn("template", F.lit(""))
    now = scratch.keep(now.withColumn("_done", F.size("_s") == 0), "paths")
    out = now.filter("_done").drop("_s", "_done")
    level = 0
    while not (here := now.filter("not _done")).isEmpty():
        here = here.withColumn("_c", step_of(F.get("_s", F.lit(level))))
        children = here.groupBy("host", "template", "_c").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"), F.count(F.lit(1)).alias("_paths"))
        children = scratch.keep(children, "children")
        merged = children.join(like_children(children), ["host", "template", "_c"], "left")
        known = merged.select("host", "template", "_c", "g", (F.col("g").isNull() & (F.col("_paths") == 1)).alias("_alone")).filter("g is not null or _alone")
        wild = F.concat(F.lit("/*"), F.when(F.col("g") > 1, F.col("g").cast("string")).otherwise(F.lit("")))
        rest = F.array_join(F.transform(F.slice("_s", F.lit(level + 2), F.size("_s")), step_of), "")
        alone = F.coalesce("_alone", F.lit(False))
        new = here.join(known, ["host", "template", "_c"], "left")
        new = new.withColumn("template", F.concat("template", F.when(F.col("g").isNotNull(), wild).otherwise(F.col("_c")), F.when(alone, rest).otherwise(F.lit(""))))
        new = new.withColumn("_done", alone | (F.size("_s") <= level + 1)).drop("_c", "g", "_alone")
        now = scratch.keep(new, "paths")
        out = out.unionByName(now.filter("_done").drop("_s", "_done"))
        level += 1
    return out


def domain_of(host: Column) -> Column:
    """The last two labels of a host; an address of four numbers is its own."""
    return F.when(host.rlike(r"^\d+(\.\d+){3}(:\d+)?$"), host).otherwise(F.substring_index(host, ".", -2))


def shape_of(path: Column) -> Column:
    """All segments of a path by their form: comparable between hosts."""
    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), step_of), "")


def prior_purities(paths: DataFrame, smooth: float) -> DataFrame:
    """``(domain, shape, prior)``: blocked share of labelled pages by path form on a registered domain, smoothed toward that on all hosts."""
    by = paths.groupBy("domain", "shape").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
    everywhere = by.groupBy("shape").agg(((F.sum("b") + smooth / 2) / (F.sum("b") + F.sum("a") + smooth)).alias("all"))
    return by.join(everywhere, "shape").select("domain", "shape", ((F.col("b") + smooth * F.col("all")) / (F.col("b") + F.col("a") + smooth)).alias("prior"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, smooth: float = SMOOTH, reject: float = REJECT) -> DataFrame:
    """``(page_id, host, path, rule, verdict, template, purity)`` for each row of ``pages(page_id, url)``, repeated rows each.

    A null url, or one without ``://``, has an empty host and path; a null page_id stays null. Urls of any
    length and depth count whole. An empty table gives no rows; other columns are ignored, whatever their
    names. Pages that a rule judges are the labels of the tree; purity is the template's share of blocked
    among them, smoothed as above. Without a rule a page is blocked from a purity of ``reject``.
    """
    scratch = Scratch(pages.sparkSession)
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.col("_r.verdict")
    paths = rows.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(verdict == "block", 1)).alias("blocked"), F.count(F.when(verdict == "allow", 1)).alias("allowed")
    )
    paths = scratch.keep(paths.withColumn("domain", domain_of(F.col("host"))).withColumn("shape", shape_of(F.col("path"))), "counted")
    priors = scratch.keep(prior_purities(paths, smooth), "priors")
    named = learn_templates(paths)
    named = scratch.keep(named, "named")
    by = named.groupBy("host", "template", "domain", "shape").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"), F.sum("n").alias("n"))
    by = scratch.keep(by, "forms").join(priors, ["domain", "shape"])
    by = by.groupBy("host", "template").agg(F.sum("b").alias("b"), F.sum("a").alias("a"), (F.sum(F.col("prior") * F.col("n")) / F.sum("n")).alias("prior"))
    purity = (F.col("b") + smooth * F.col("prior")) / (F.col("b") + F.col("a") + smooth)
    leaves = scratch.keep(by.select("host", "template", purity.alias("purity")), "leaves")
    known = scratch.keep(named.join(leaves, ["host", "template"]).select("host", "path", "template", "purity"), "known")
    out = rows.join(known, ["host", "path"], "left")
    own = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", "purity")
