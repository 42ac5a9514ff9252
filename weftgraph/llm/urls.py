"""URL filters as a sort-merge range join, in DataFrame functions only.

The canonical key of a host is its labels in reverse order ("com.example.www."), so a host with all its
subdomains is one interval of keys, and intervals of different rule hosts are nested or disjoint. The
rules' interval ends, sorted, carry the stack of rules that are active from there on. URLs and interval
ends are sorted together, and a sweep gives each URL the latest stack before it. In the stack, the
longest rule whose path starts the URL's path wins.

The sweep is split by salt: URLs are dealt evenly over the tasks whatever their host, so a hot host is
no hot key, and each task gets all interval ends. Rules are a parameter list, checked against a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: (verdict, host, path)
Rule = tuple[str, str, str]
#: Rules that may be copied to every task.
MOST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or where there is no "://"."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def boundaries(spark, rules: list[Rule]) -> DataFrame:
    """Where the stack of active rules changes: at, stack (all rules active from there on).

    Each rule host opens its interval with its own and its ancestors' rules and closes it with its
    ancestors' rules. Of rules with one host and path, the greatest verdict holds: block before allow.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules; split the list")
    rows = [(verdict, host.translate(str.maketrans(UPPER, LOWER)), path) for verdict, host, path in rules]
    given = spark.createDataFrame(rows, "verdict string, host string, path string").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    per_host = given.groupBy("host").agg(F.collect_list(F.struct(F.length(rule).alias("size"), rule.alias("rule"), "path", "verdict")).alias("own"))
    label = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(label)), lambda i: F.array_join(F.slice(label, i, F.size(label)), "."))
    chain = per_host.select("host", F.explode(above).alias("ancestor")).join(per_host.select(F.col("host").alias("ancestor"), "own"), "ancestor")
    stacks = chain.groupBy("host").agg(
        F.flatten(F.collect_list("own")).alias("inner"),
        F.flatten(F.collect_list(F.when(F.col("host") != F.col("ancestor"), F.col("own")))).alias("outer"),
    )
    key = host_key(F.col("host"))
    close = F.concat(F.expr("substring(opens, 1, length(opens) - 1)"), F.lit("/"))  # "/" follows "."
    return stacks.withColumn("opens", key).select(F.explode(F.array(F.struct(F.col("opens").alias("at"), F.col("inner").alias("stack")), F.struct(close.alias("at"), F.col("outer").alias("stack")))).alias("b")).select("b.at", "b.stack")


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages (page_id, url).

    rule is the host and path of the longest rule that fits, or null; verdict is the rule's, or default.
    Null, empty and malformed urls have an empty host and path, and no rule fits them. Null page_ids
    stay; repeated rows stay. Other columns are ignored. An empty table gives no rows; no rules at all
    give every row the default.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    found = F.lit(None).cast("struct<size:int,rule:string,path:string,verdict:string>")
    if not rules:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ends = boundaries(spark, rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salt = F.pmod(F.xxhash64("page_id", "host", "path", F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    sides = urls.select(salt.alias("salt"), host_key(F.col("host")).alias("at"), F.lit(1).alias("kind"), "page_id", "host", "path")
    sides = sides.unionByName(ends.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    sweep = Window.partitionBy("salt").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = sides.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    fits = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    best = swept.withColumn("best", F.coalesce(F.array_max(fits), found))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
