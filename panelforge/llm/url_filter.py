"""URL filters by a sort-merge range join (DataFrame functions only).

A host's labels in reverse, each closed by a dot, make a key; a rule's host is then
a prefix, that is an interval [prefix, prefix with its last dot replaced by the next
character). Intervals of prefixes nest, so the sorted ends cut the key space into
segments with a fixed stack of active rules each. Pages and segment starts are
range-partitioned and sorted together; a sweep carries the last stack forward, each
partition beginning with the one its predecessors ended with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.llm.common import default_partitions, stored

#: The stacks with which ranges begin are broadcast while they hold so many rules in all; beyond, they are joined by a shuffle.
BROADCAST_RULES = 100_000
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; null or no ://: empty."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def segments(rules: DataFrame) -> DataFrame:
    """(seg_key, stack): from seg_key up to the next one, these rules are active.

    rules: verdict, host, path. A host's own segment holds the rules of the host and
    of its parent domains, found by equality with its prefixes; after its interval
    the stack is its parent's.
    """
    rules = rules.dropDuplicates(["verdict", "host", "path"]).withColumn("prefix", host_key(F.col("host")))
    own = rules.groupBy("prefix").agg(F.collect_list(F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), "host", "path", "verdict")).alias("own"))
    labels = F.split(F.expr("left(prefix, length(prefix) - 1)"), r"\.", -1)
    above = own.select("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.concat(F.array_join(F.slice(labels, F.lit(1), k), "."), F.lit(".")))).alias("up"))
    joined = above.join(own.select(F.col("prefix").alias("up"), "own"), "up")
    stacks = joined.groupBy("prefix").agg(F.flatten(F.collect_list("own")).alias("stack"), F.flatten(F.collect_list(F.when(F.col("up") != F.col("prefix"), F.col("own")))).alias("outer"))
    ends = stacks.select(F.concat(F.expr("left(prefix, length(prefix) - 1)"), F.lit("/")).alias("seg_key"), F.col("outer").alias("stack"))
    return stacks.select(F.col("prefix").alias("seg_key"), "stack").unionByName(ends)


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Every page's host, path, longest fitting rule (or null) and verdict.

    A rule fits its host and all subdomains where the path starts with the rule's;
    the longest rule wins, of equal ones that of the longer host, then the greater
    host, path and verdict by name ("block" before "allow"). Null urls and urls without
    :// have empty host and path and get the default. A url of any length is read whole.
    Repeated rows each get a row. Other columns are ignored, whatever their names. An
    empty table gives an empty result; without rules all get the default.
    """
    spark = pages.sparkSession
    parts = default_partitions(spark)
    seen = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    seen = seen.select("id", "host", "path", host_key(F.col("host")).alias("key"))
    segs = segments(rules)
    kind = dict(segs.dtypes)["stack"]
    both = seen.select("id", "host", "path", "key", F.lit(1).alias("is_page"), F.lit(None).cast(kind).alias("stack")).unionByName(
        segs.select(F.lit(None).cast(dict(seen.dtypes)["id"]).alias("id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.col("seg_key").alias("key"), F.lit(0).alias("is_page"), "stack")
    )
    # a page's id and path cut a common host into several ranges; written out, since every reader must see one cut
    swept = stored(both.repartitionByRange(parts, "key", "is_page", "path", "id").withColumn("range", F.spark_partition_id()), "url-ranges")
    last = swept.where("is_page = 0").groupBy("range").agg(F.max_by("stack", "key").alias("ends_with"))
    ranges = swept.select("range").distinct().join(last, "range", "left")
    # one row for each partition
    carried = ranges.select("range", F.last("ends_with", True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("range").orderBy("key", "is_page").rowsBetween(Window.unboundedPreceding, 0)
    carried = stored(carried, "url-carried")
    size = carried.agg(F.coalesce(F.sum(F.size("carried") + 1), F.lit(0))).first()[0]
    active = swept.join(F.broadcast(carried) if size <= BROADCAST_RULES else carried, "range").withColumn("active", F.coalesce(F.last("stack", True).over(sweep), F.col("carried")))
    best = F.array_max(F.transform(F.filter(F.coalesce("active", F.array().cast(kind)), lambda r: F.col("path").startswith(r["path"])), lambda r: F.struct(r["size"].alias("size"), r["host_size"].alias("host_size"), r["host"].alias("host"), r["path"].alias("path"), r["verdict"].alias("verdict"))))
    judged = active.where("is_page = 1").withColumn("best", best)
    return judged.select(F.col("id").alias(id_col), "host", "path", F.concat(F.col("best.host"), F.col("best.path")).alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
