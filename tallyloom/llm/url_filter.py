"""URL filters: fixed rules first, then a tree of path templates per host.

Paths are read segment by segment.  Segments that vary by nature (numbers, hexadecimal
strings, ids) become wildcards at once.  In the tree of what is left, the branches of a node
that vary by statistics (many, each rare) become one wildcard, and so do branches whose
labelled pages are alike: a branch keeps its name only if its share of bad pages differs
from that of its siblings.  Each leaf is a template; templates whose smoothed share of bad
pages is too high are blocked.

The tree is grown from counts per host and generalised path, never from single pages.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.rows import attach_row
from ..session import staged
from .base import lower_ascii

# The rules of the list, verdict and place.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"),
         ("allow", "com/fr/"), ("block", "com/de/"))

MANY, RARE = 16, 8          # more children than this, with fewer pages each, vary
DIFFERS = 1.96              # z of two shares that differ
LEAST = 5                   # labelled pages on either side of a comparison
SMOOTHING = 10.0            # labelled pages that the corpus' share counts for
BLOCK = 0.5                 # smoothed share of bad pages from which on to block


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(lower_ascii(found), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES
                 ) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; nulls where none does."""
    rule = verdict = F.lit(None).cast("string")
    for says, place in sorted(rules, key=lambda r: len(r[1])):      # the longest comes last
        own, slash, start = place.partition("/")
        fits = (((host == own) | F.endswith(host, F.lit(f".{own}")))
                & F.startswith(path, F.lit(slash + start)))
        rule, verdict = F.when(fits, place).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def general(segment: Column) -> Column:
    """A segment with what varies by nature as a wildcard; a file ending stays."""
    name = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 1)
    ending = F.regexp_extract(segment, r"(?s)^(.*?)(\.[A-Za-z]{1,5})?$", 2)
    shape = (F.when(F.rlike(name, F.lit("^[0-9]+([._-][0-9]+)*$")), "{number}")
             .when(F.rlike(name, F.lit("^(?=.*[0-9])[0-9A-Fa-f-]{8,}$")), "{hex}")
             .when(F.rlike(name, F.lit("^(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z_-]{16,}$")), "{id}"))
    return F.coalesce(F.concat(shape, ending), segment)


def segments(path: Column) -> Column:
    """Generalised segments, all of them."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), general)


def grow(shapes: DataFrame) -> DataFrame:
    """``shapes(host, segments, n, labelled, bad)`` with their ``template``.

    Level by level, each child's counts are held against those of its siblings; the sums
    are aggregates, so a node with very many children is no single group.  Paths leave when
    their last segment is named; it ends when none is left.
    """
    rows, level = shapes.withColumn("template", F.lit("")), 0
    done = [rows.where(F.size("segments") == 0)]
    while not (rows := rows.where(F.size("segments") > level)).isEmpty():
        child = F.get(F.col("segments"), F.lit(level))
        kids = (rows.where(child.isNotNull())
                .groupBy("host", "template", child.alias("child"))
                .agg(*[F.sum(c).alias(c) for c in ("n", "labelled", "bad")]))
        nodes = kids.groupBy("host", "template").agg(
            F.count("*").alias("kids"), F.sum("n").alias("all_n"),
            F.sum("labelled").alias("all_labelled"), F.sum("bad").alias("all_bad"))
        kids = kids.join(nodes, ["host", "template"])
        others, rest = F.col("all_labelled") - F.col("labelled"), F.col("all_bad") - F.col("bad")
        share = F.col("all_bad") / F.col("all_labelled")
        error = F.sqrt(share * (1 - share) * (1 / F.col("labelled") + 1 / others))
        known = (F.col("labelled") >= LEAST) & (others >= LEAST)
        differs = F.when(known, F.abs(F.try_divide("bad", "labelled") - F.try_divide(
            rest, others)) > DIFFERS * error).otherwise(F.lit(False))
        varies = (F.col("kids") > MANY) & (F.col("all_n") < RARE * F.col("kids"))
        alike = (F.col("kids") > 1) & F.col("child").rlike(r"^[^{]")
        name = F.when(~differs & (varies | alike), "*").otherwise(F.col("child"))
        names = kids.select(F.struct("host", "template", "child", name.alias("name")).alias("k"))
        k = F.col("k")
        # written level by level: both the counts and the names are read from it
        rows = staged(rows.join(names, (rows.host == k.host) & (rows.template == k.template)
                         & (child == k.child), "left").withColumn(
            "template", F.when(k.isNotNull(), F.concat_ws("/", rows.template, k["name"]))
            .otherwise(rows.template)).drop("k"))
        level += 1
        done.append(rows.where(F.size("segments") == level))
    return reduce(DataFrame.unionByName, done)


def bad_templates(pages: DataFrame, block: float = BLOCK) -> DataFrame:
    """``host, shape`` of all generalised paths whose template is to be blocked.

    ``pages`` has host, segments and ``bad`` (null without a label).
    """
    shapes = pages.groupBy("host", "segments").agg(
        F.count("*").alias("n"), F.count("bad").alias("labelled"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    leaves = staged(grow(staged(shapes)))
    corpus = leaves.agg(F.try_divide(F.sum("bad"), F.sum("labelled")).alias("share"))
    judged = attach_row(leaves.groupBy("host", "template").agg(
        F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")), corpus)
    smoothed = ((F.col("bad") + SMOOTHING * F.col("share"))
                / (F.col("labelled") + SMOOTHING))
    bad = judged.where(smoothed > block).select("host", "template")
    return leaves.join(bad, ["host", "template"], "left_semi").select("host", "segments")


def judge(pages: DataFrame, labels: DataFrame, *, key: str = "page_id", url: str = "url",
          label_key: str = "doc_id", rules: Sequence[tuple[str, str]] = RULES,
          block: float = BLOCK) -> DataFrame:
    """``key, host, path, rule, verdict`` for every page.

    A label says a page is bad if its quality is 0 or it is toxic; pages without one, or
    with nulls, count towards the tree only.  Several labels of a page count as one, bad
    if any is.  A url that is null or has no ``://`` has an empty host and path, and those
    form a template like any other.  Null or repeated keys are judged row by row; other
    columns are not looked at; an empty table gives an empty result.
    """
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rows = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("segments", segments(F.col("path")))
    said = labels.groupBy(F.col(label_key).alias("label_key")).agg(F.max(
        ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    known = rows.join(said, F.col("key") == F.col("label_key"), "left")
    bad = staged(bad_templates(known.select("host", "segments", "bad"), block))
    side = bad.select(F.struct("host", "segments").alias("b"))
    judged = rows.join(side, (rows.host == F.col("b.host"))
                       & (rows.segments == F.col("b.segments")), "left")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return judged.select(F.col("key").alias(key), "host", "path", rule.alias("rule"),
                         F.coalesce(verdict, F.when(F.col("b").isNotNull(), "block")
                                    .otherwise("allow")).alias("verdict"))
