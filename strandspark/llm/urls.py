"""URL filters by a path-template tree, with DataFrame operations only.

Rules (host, path) come first: a rule fits its host and all subdomains where the url's path starts with the rule's; the
longest wins. Their verdicts are also the labels from which the rest is learnt. Per host, paths are cut into segments
and a tree grows level by level: where a node has more than MAX_CHILDREN different next segments, they become one wildcard.
Templates of one host and one shape whose labelled shares of blocked pages no two-proportion test tells apart are merged.
A template is rejected if its share, smoothed towards its host's, which is smoothed towards that of all hosts, exceeds a half.

Null url, or one without `://`: host and path are empty strings. Empty path: no segments. Very long paths: whole; segments beyond
DEPTH are one. Null page_id: judged like any. Repeated rows: one result each, counted each. Empty table: no rows.
Other columns (html) are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandspark.llm.common import read_table, stored

#: (host, path, verdict); few, as they become one expression.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
MAX_CHILDREN, DEPTH, PRIOR, LEAST_LABELLED, SAME_Z = 12, 4, 4.0, 5, 1.96
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, host, path)."""
    rest = F.coalesce(F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1), F.lit(""))
    out = pages.select("page_id", rest.alias("rest")).withColumn("raw", F.regexp_extract("rest", r"^[^/?#]*", 0))
    path = F.regexp_extract(F.expr("substring(rest, length(raw) + 1)"), r"^[^?#]*", 0)
    return out.select("page_id", F.translate("raw", _UPPER, _LOWER).alias("host"), path.alias("path"))


def judged_by_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """df with rule and rule_verdict, both null where no rule fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text, verdict = F.when(fits, F.lit(host + path)).otherwise(text), F.when(fits, F.lit(what)).otherwise(verdict)
    return df.withColumn("rule", text).withColumn("rule_verdict", verdict)


def templates(paths: DataFrame) -> DataFrame:
    """paths (host, path, n, labelled, blocked), one row per different path, with its template."""
    cut = F.filter(F.split("path", "/"), lambda x: x != "")
    shallow = F.when(F.size(cut) > DEPTH, F.concat(F.slice(cut, 1, DEPTH - 1), F.array(F.array_join(F.slice(cut, DEPTH, 1 << 20), "/")))).otherwise(cut)
    now = paths.withColumn("segments", shallow).withColumn("template", F.lit(""))
    for level in range(DEPTH):
        segment = F.get("segments", F.lit(level))
        now = now.withColumn("segment", segment)
        children = now.filter(F.col("segment").isNotNull()).groupBy("host", "template", "segment").agg(F.count("*").alias("c"))
        many = children.groupBy("host", "template").agg(F.count("*").alias("children")).filter(F.col("children") > MAX_CHILDREN).select("host", "template", F.lit(True).alias("many"))
        grown = F.when(F.col("segment").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.when(F.col("many"), F.lit("*")).otherwise(F.col("segment"))))
        now = stored(now.join(many, ["host", "template"], "left").withColumn("template", grown).drop("many", "segment"), "tree")
    return now.drop("segments")


def smoothed(blocked: Column, labelled: Column, towards: Column) -> Column:
    return (blocked + F.lit(PRIOR) * towards) / (labelled + F.lit(PRIOR))


def template_verdicts(known: DataFrame) -> DataFrame:
    """(host, template, share, merged) from known (host, template, n, labelled, blocked): the smoothed share of blocked pages."""
    base = known.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    base = stored(base, "templates")
    total = base.agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("l")).first()
    overall = F.lit(((total.b or 0) + 0.5 * PRIOR) / ((total.l or 0) + PRIOR))
    hosts = base.groupBy("host").agg(smoothed(F.sum("blocked"), F.sum("labelled"), overall).alias("host_share"))
    shape = F.regexp_replace("template", r"[^/*]+", "x")
    rows = base.join(hosts, "host").withColumn("shape", shape).withColumn("enough", F.col("labelled") >= LEAST_LABELLED)
    rows = rows.withColumn("share", smoothed(F.col("blocked"), F.col("labelled"), F.col("host_share")))
    # siblings in the order of their shares; a new group begins where neighbours differ
    order = Window.partitionBy("host", "shape", "enough").orderBy("share", "template")
    n1, n2 = F.lag("labelled").over(order), F.col("labelled")
    p1, p2 = F.lag("blocked").over(order) / n1, F.col("blocked") / n2
    pooled = (F.lag("blocked").over(order) + F.col("blocked")) / (n1 + n2)
    apart = F.abs(p1 - p2) > SAME_Z * F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n1 + 1 / n2))
    marked = rows.withColumn("breaks", F.when(~F.col("enough"), F.lit(1)).when(F.coalesce(apart, F.lit(True)), F.lit(1)).otherwise(F.lit(0)))
    grouped = marked.withColumn("branch", F.sum("breaks").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    branches = grouped.groupBy("host", "shape", "enough", "branch").agg(F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.count("*").alias("merged"))
    out = grouped.join(branches, ["host", "shape", "enough", "branch"])
    return out.select("host", "template", smoothed(F.col("b"), F.col("l"), F.col("host_share")).alias("share"), "merged")


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, share."""
    judged = stored(judged_by_rules(parsed(pages), rules), "urls")
    ruled = F.col("rule_verdict").isNotNull()
    paths = judged.groupBy("host", "path").agg(F.count("*").alias("n"), F.count(F.when(ruled, 1)).alias("labelled"), F.count(F.when(F.col("rule_verdict") == "block", 1)).alias("blocked"))
    tree = templates(paths)
    shares = template_verdicts(tree)
    by_path = stored(tree.select("host", "path", "template").join(shares, ["host", "template"]), "shares")
    out = judged.join(by_path, ["host", "path"])
    learnt = F.when(F.col("share") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", learnt).alias("verdict"), "template", "share")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages"))
