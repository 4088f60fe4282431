"""Verdicts on urls by host rules and by a tree of path templates (operator 8).

Method: every host has a tree of path segments. From the root on, a segment of fewer than ``literal_pages`` pages below
its node becomes a wildcard (with its file ending); all others stay, whatever the node's size. Labelled leaves under one parent are merged in the
order of their shares of good labels, as long as a leaf does not differ significantly from the branch so far; a leaf without labels is in no branch. A template is rejected when its smoothed purity, the share of
good labels drawn towards its host's and the whole table's, is too low. Rules go first, the longest that fits.

Distinct paths are counted before anything is joined, and kept segments are rows joined on host, template and segment, so
a node may keep any number and neither a hot host nor a hot node meets in one task.

Defined cases: a null url, or one without ``://``, has an empty host and path and is judged as such; a page without
label teaches nothing; of several labels of one page the worst counts; null labels do not count; rows with one page id are
judged separately. With ``depth``, from so many segments on the rest of a path counts as one segment. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outflow.session import durable

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (lower-case) and path of a url, both empty where there is no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        domain, _, tail = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def judge_urls(
    pages: DataFrame, labels: DataFrame, page_id: str = "page_id", url: str = "url", label_id: str = "doc_id", good: str = "quality",
    rules: tuple[tuple[str, str], ...] = RULES, literal_pages: int = 5, depth: int | None = None, similar: float = 1.96,
    weight: float = 4.0, least_purity: float = 0.5,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity)."""
    host, path = url_parts(F.col(url).cast("string"))
    parsed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    marks = labels.where(F.col(good).isNotNull()).groupBy(F.col(label_id).alias("page_id")).agg(F.min(good).alias("good"))
    paths = parsed.join(marks, "page_id", "left").groupBy("host", "path").agg(
        F.count("*").alias("n"), F.count("good").alias("labelled"), F.sum(F.when(F.col("good") > 0, 1).otherwise(0)).alias("good")
    )
    parts = F.split("path", "/") if depth is None else F.split("path", "/", depth + 1)
    tree = durable(paths.withColumn("segments", F.slice(parts, 2, F.size(parts))).withColumn("template", F.lit("")))
    level = 0
    while True:
        # Below nodes of few pages nothing can be kept, however deep their paths go.
        nodes = tree.where(F.size("segments") > level).groupBy("host", "template").agg(F.sum("n").alias("n"))
        if (nodes.agg(F.max("n")).first()[0] or 0) < literal_pages:
            break
        tree = durable(_deeper(tree, level, literal_pages))
        level += 1
    rest = F.transform(F.slice("segments", level + 1, F.size("segments")), lambda s: F.concat(F.lit("/"), F.when(s == "", s).otherwise(_wildcard(s))))
    tree = durable(tree.withColumn("template", F.concat("template", F.array_join(rest, ""))))

    leaves = tree.groupBy("host", "template").agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "labelled", "good")])
    hosts = leaves.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("good").alias("host_good"))
    everywhere = hosts.agg(F.sum("host_good"), F.sum("host_labelled")).first()
    overall = (everywhere[0] or 0.0) / everywhere[1] if everywhere[1] else 1.0
    host_rate = (F.col("host_good") + weight * overall) / (F.col("host_labelled") + weight)
    leaves = leaves.join(hosts, "host").withColumn("host_rate", host_rate).withColumn("parent", F.regexp_extract("template", "^(.*)/[^/]*$", 1))
    # Leaves of one rate count together, so a node of n labels has at most about n^(2/3) rates.
    leaves = leaves.withColumn("rate", F.try_divide("good", "labelled"))
    rates = leaves.where("labelled > 0").groupBy("host", "parent", "rate").agg(F.sum("labelled").alias("labelled"), F.sum("good").alias("good"))
    line = F.sort_array(F.collect_list(F.struct("rate", "labelled", "good")))
    branches = rates.groupBy("host", "parent").agg(line.alias("line")).select("host", "parent", _branches("line", similar).alias("branches"))
    leaves = leaves.join(branches, ["host", "parent"], "left")
    own = F.element_at(F.filter("branches", lambda b: b["rate"] <= F.col("rate")), -1)
    # A leaf without labels has no rate and takes the prior alone.
    leaves = leaves.withColumn("own", F.when(F.col("labelled") > 0, own))
    labelled, good = (F.coalesce(F.col("own")[c], F.lit(0.0)) for c in ("labelled", "good"))
    leaves = leaves.select("host", "template", ((good + weight * F.col("host_rate")) / (labelled + weight)).alias("purity"))

    known = tree.select("host", "path", "template").join(leaves, ["host", "template"])
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return parsed.join(known, ["host", "path"]).select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
        F.concat("host", "template").alias("template"), "purity",
    )


def _branches(line: str, similar: float) -> Column:
    """The branches (lowest rate, labelled, good) of leaves in the order of their rates: one that differs from all before it in the branch begins the next."""

    def step(done: Column, leaf: Column) -> Column:
        last = done["last"]
        pooled = (leaf["good"] + last["good"]) / (leaf["labelled"] + last["labelled"])
        spread = F.sqrt(pooled * (1 - pooled) * (1 / leaf["labelled"] + 1 / last["labelled"]))
        differs = leaf["rate"] - last["good"] / last["labelled"] > similar * spread
        both = F.struct(last["rate"].alias("rate"), (last["labelled"] + leaf["labelled"]).alias("labelled"), (last["good"] + leaf["good"]).alias("good"))
        return F.struct(
            F.when(differs, F.concat(done["full"], F.array(last))).otherwise(done["full"]).alias("full"), F.when(differs, leaf).otherwise(both).alias("last")
        )

    first, rest = F.element_at(line, 1), F.slice(line, 2, F.greatest(F.size(line) - 1, F.lit(0)))
    start = F.struct(F.slice(line, 1, 0).alias("full"), first.alias("last"))
    return F.aggregate(rest, start, step, lambda done: F.concat(done["full"], F.array(done["last"])))


def _wildcard(segment: Column) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"\.[A-Za-z0-9]{1,5}$", 0))


def _deeper(tree: DataFrame, level: int, literal_pages: int) -> DataFrame:
    """The templates with one more segment, kept or generalised."""
    tree = tree.withColumn("segment", F.get("segments", F.lit(level)))
    values = tree.where(F.size("segments") > level).groupBy("host", "template", "segment").agg(F.sum("n").alias("k"))
    kept = values.where(F.col("k") >= literal_pages).select("host", "template", "segment", F.lit(True).alias("kept"))
    joined = tree.join(kept, ["host", "template", "segment"], "left")
    literal = F.coalesce("kept", F.lit(False)) | (F.col("segment") == "")
    added = F.when(F.size("segments") > level, F.concat(F.lit("/"), F.when(literal, F.col("segment")).otherwise(_wildcard(F.col("segment"))))).otherwise("")
    return joined.select("host", "path", "n", "labelled", "good", "segments", F.concat("template", added).alias("template"))
