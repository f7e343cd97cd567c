"""Operator 4, URL filters: path-template trees.

Each host has a tree of path segments, in which digits are ``{n}`` and long
hexadecimal runs ``{h}``. From the root down, level by level, the segments
below a node become branches by their labelled pages:

* A segment whose share of bad pages is not significantly unlike that of all
  its siblings together joins the wildcard ``*``, and so does one with under
  ``LABELS`` labelled pages, which could have no verdict of its own. As each is
  compared with the pooled counts, not with its neighbour, one without labels
  bridges nothing.
* Those that are unlike, worse or better, are held against the pool of their
  side: what is like it joins ``*-`` or ``*+``, the rest stay by themselves.

A node ends the tree where it has one path left, or too few labelled pages to
part; what lies below is ``**``. Depth and number of segments are not limited.
A template is rejected if its smoothed purity, the share of good labelled
pages shrunk to that of all, is under ``PURITY``. Fixed rules on hosts and
paths come before templates.

Trees are built from counts by (host, generalised path), and nodes from sums
that Spark aggregates before it shuffles; nothing gathers a node's segments.
What many rows of a hot node join is written first, as adaptive execution
splits a join of two plain exchanges.

Defined results: a null url, or one without ``://``, has an empty host and
path, and these form one template; pages without a label count as unlabelled;
a page with several label rows counts as bad if any is; a null page_id is
unlabelled; an empty table gives no rows; repeated rows each count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import common

#: Least labelled pages of a branch, and of what it is compared with.
LABELS = 10
PURITY = 0.5
STRENGTH = 10.0
Z = 1.96

#: (host, path, verdict), in any order (fixed values).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST = "(?s)^.*?://([^/?#]*)"
PATH = "(?s)^.*?://[^/?#]*([^?#]*)"


def host_of(url: str) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def general_path() -> Column:
    """The path without empty segments, its variable parts marked."""
    hexed = F.regexp_replace("path", r"\b[0-9a-f]*[0-9][0-9a-f]{7,}\b", "{h}")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(hexed, "[0-9]+", "{n}"), "/+", "/"), "^/|/$", "")


def unlike(n: Column, bad: Column, all_n: Column, all_bad: Column) -> Column:
    """Whether ``bad`` of ``n`` differs from the rest of ``all_bad`` of ``all_n``: the square of the two-sample z, without division."""
    n, bad, all_n, all_bad = (c.cast("double") for c in (n, bad, all_n, all_bad))
    apart = bad * all_n - all_bad * n
    return (n >= LABELS) & (all_n - n >= LABELS) & (apart * apart * all_n > F.lit(Z * Z) * n * (all_n - n) * all_bad * (all_n - all_bad))


def templates(counts: DataFrame) -> DataFrame:
    """(host, general, template, labelled, bad) for ``counts`` (host, general, n, labelled, bad)."""
    node, total = ["host", "template"], [F.sum(c).alias(c) for c in ("labelled", "bad")]
    rows = common.materialize(counts.withColumn("template", F.lit("")), "templates")
    done, level = [], 0
    while True:
        parts = F.split("general", "/")
        here = rows.withColumn("segment", F.coalesce(F.get(parts, F.lit(level)), F.lit("")))
        nodes = here.groupBy(node).agg(
            F.count("*").alias("paths"), F.max(F.size(parts)).alias("deepest"), (F.min("segment") == F.max("segment")).alias("single"),
            F.sum("labelled").alias("all_n"), F.sum("bad").alias("all_bad"),
        )
        nodes = nodes.withColumn("open", (F.col("paths") > 1) & (F.col("deepest") > level) & (F.col("all_n") >= 2 * LABELS))
        here = here.join(common.materialize(nodes, "nodes"), node)
        rest = F.array_join(F.slice(parts, level + 1, F.size(parts)), "/")
        end = F.when(F.col("deepest") <= level, F.col("template")).when(F.col("paths") == 1, F.concat_ws("/", "template", rest)).otherwise(F.concat("template", F.lit("/**")))
        done.append(here.where("not open").select("host", "general", end.alias("template"), "labelled", "bad"))
        here = here.where("open")
        branches = here.groupBy(*node, "segment").agg(*total, *(F.first(c).alias(c) for c in ("all_n", "all_bad", "single")))
        worse = F.col("bad") * F.col("all_n") > F.col("all_bad") * F.col("labelled")
        side = F.when(unlike(F.col("labelled"), F.col("bad"), F.col("all_n"), F.col("all_bad")), F.when(worse, "-").otherwise("+"))
        branches = common.materialize(branches.withColumn("side", side), "branches")
        if branches.isEmpty():
            break
        pools = branches.where("side is not null").groupBy(*node, "side").agg(F.count("*").alias("members"), F.sum("labelled").alias("pool_n"), F.sum("bad").alias("pool_bad"))
        branches = branches.join(common.materialize(pools, "pools"), [*node, "side"], "left")
        alone = F.when(F.col("side").isNull(), F.col("single")).otherwise((F.col("members") == 1) | unlike(F.col("labelled"), F.col("bad"), F.col("pool_n"), F.col("pool_bad")))
        name = F.when(alone, F.col("segment")).otherwise(F.concat(F.lit("*"), F.coalesce("side", F.lit(""))))
        names = common.materialize(branches.select(*node, "segment", F.concat_ws("/", "template", name).alias("next")), "names")
        rows = here.select("host", "general", "n", "labelled", "bad", "template", "segment").join(names, [*node, "segment"])
        rows = common.materialize(rows.select("host", "general", "n", "labelled", "bad", F.col("next").alias("template")), "templates")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def judge(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of each page; ``labels`` has doc_id (a page_id), quality and toxic."""
    bad = F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int"))
    known = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.coalesce(bad, F.lit(0)).alias("bad"))
    urls = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path")).withColumn("general", general_path())
    counts = urls.join(known, "page_id", "left").groupBy("host", "general").agg(F.count("*").alias("n"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    tree = common.materialize(templates(counts), "templates")
    whole = tree.agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")).first()
    good = 1 - (whole["bad"] + 0.5) / (whole["labelled"] + 1.0) if whole["labelled"] is not None else 1.0
    purity = (F.sum("labelled") - F.sum("bad") + F.lit(STRENGTH * good)) / (F.sum("labelled") + F.lit(STRENGTH))
    pure = common.materialize(tree.groupBy("host", "template").agg(purity.alias("purity")), "purity")
    judged = common.materialize(tree.join(pure, ["host", "template"]).select("host", "general", "template", "purity"), "judged")
    rule, verdict = rule_of()
    own = F.when(F.col("purity") < PURITY, F.lit("block")).otherwise(F.lit("allow"))
    out = urls.join(judged, ["host", "general"])
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "template", F.round("purity", 9).alias("purity"))


def op4_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages").select("page_id", "url"), common.read(spark, sf_dir, "labels"))
