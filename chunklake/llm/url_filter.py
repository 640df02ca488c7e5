"""URL filters as a sort-merge range join on reversed-host keys, with DataFrame functions only.

A rule (host, path prefix) has the key `reversed host` + U+0001 + path, which makes the URLs that it
fits on one host level an interval of keys. Each URL is a point on every level of its host that a rule's
host can have: levels of more labels than the longest host of a rule fit none. In each lane, rules and points are sorted together, and the last rule passed carries the stack of
nested rules around it; the innermost one that holds the point is the level's rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SEP = "\u0001"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reverse_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def most_labels(rules: DataFrame) -> int:
    """Labels of the longest host of a rule."""
    return rules.where("host is not null and path is not null").agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"] or 0


def rule_stacks(rules: DataFrame) -> DataFrame:
    """For each distinct rule (host, path, verdict): its key, and its stack: itself and all rules around it, innermost first.

    Rules around a rule are those whose keys are prefixes of its own: an equality join on its
    prefixes, so the work is the rules' total length. The same host and path twice: `block` wins.
    """
    key = F.concat(reverse_host(F.col("host")), F.lit(_SEP), F.col("path"))
    own = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict")).select(key.alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    heads = own.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("head"))
    around = heads.join(own.select(F.col("key").alias("head"), F.col("rule"), F.col("verdict")), "head")
    entry = F.struct((-F.length("head")).alias("neg"), F.col("head").alias("key"), F.col("rule"), F.col("verdict"))
    return around.groupBy("key").agg(F.array_sort(F.collect_list(entry)).alias("stack"))  # at most one entry per character of the key


def judge(pages: DataFrame, rules: DataFrame, lanes: int, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    The longest rule (host and path, in characters) that fits wins, ties going to the longer host; without
    one, rule is null and the verdict is `default`. Repeated rows are counted before the sort and come
    back as often as they were. Points are dealt over lanes by a hash of id and URL, and the rules go
    to every lane, so a hot host or URL is spread like any other; rules are a list that each lane can hold. A null URL has
    empty host and path, and a host of any number of labels is read up to those that a rule can have. Extra columns are not
    read. Rules with a null host or path are ignored; without rules, all get the default.
    """
    rows = pages.select(F.col(f"`{key}`").alias("page_id"), host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    rows = rows.groupBy("page_id", "host", "path").agg(F.count(F.lit(1)).alias("copies"))
    lane = F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(lanes)).cast("int")
    labels = F.reverse(F.split(F.substring_index("host", ".", -max(1, most_labels(rules))), r"\."))
    levels = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, F.lit(1), n), "."))
    marks = rule_stacks(rules).select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), "key", "stack")
    empty = F.lit(None).cast(marks.schema["stack"].dataType)
    points = rows.select(lane.alias("lane"), F.struct("page_id", "host", "path", "copies").alias("row"), F.explode(levels).alias("level"))
    points = points.select("lane", F.concat("level", F.lit(_SEP), F.col("row.path")).alias("key"), "row", F.length("level").alias("depth"), empty.alias("stack"))
    marks = marks.select("lane", "key", F.lit(None).cast(points.schema["row"].dataType).alias("row"), F.lit(0).alias("depth"), "stack")
    sweep = Window.partitionBy("lane").orderBy("key", F.col("row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = marks.unionByName(points).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("row is not null")
    fit = F.get(F.filter(F.coalesce("stack", F.array().cast(marks.schema["stack"].dataType)), lambda r: F.startswith(F.col("key"), r["key"])), F.lit(0))
    best = swept.select("lane", "row", "depth", fit.alias("fit")).select(
        "lane", "row", F.when(F.col("fit").isNotNull(), F.struct(F.length("fit.rule").alias("n"), "depth", F.col("fit.rule"), F.col("fit.verdict"))).alias("fit")
    )
    best = best.groupBy("lane", "row").agg(F.max("fit").alias("fit"))
    return best.select(
        "row.page_id", "row.host", "row.path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", F.lit(default)).alias("verdict"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("row.copies"))).alias("copy"),
    ).drop("copy")
