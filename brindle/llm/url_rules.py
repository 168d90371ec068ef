"""Allow and block rules for urls by a sort-merge range join, in DataFrame functions only.

A host's key is its labels in reverse, each followed by a dot, so that a host and all of its
subdomains share a key prefix and a rule's host covers one interval of keys. Intervals nest or
are apart. Each end of an interval is a boundary row that carries the stack of rules that are
active from there on, outermost first. Boundaries and urls are sorted together by key, and a
sweep hands each url the stack of the last boundary before it; of the rules on that stack whose
path starts the url's path, the longest decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Least number of sorted runs that the urls of one range of keys are dealt over, and urls for each
#: further one: all urls may be of one host.
SALTS, SALT_ROWS = 64, 1_000_000
#: Ranges of keys, cut at boundaries; at most so many keys are held by the driver.
RANGES = 128

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack) in which stack holds the rules whose interval of keys covers `key`.

    rules: host, path, verdict. Equal rules with two verdicts count as block.
    """
    named = rules.select(
        host_key(F.col("host")).alias("at"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            "verdict",
            F.concat("host", "path").alias("rule"),
            "path",
        ).alias("r"),
    )
    starts = named.select("at").distinct()
    # The interval of prefix "com.example." ends before "com.example/", the next character up.
    ends = F.concat(F.expr("substring(at, 1, length(at) - 1)"), F.lit("/"))
    labels = F.split(F.expr("substring(at, 1, length(at) - 1)"), r"\.")
    covering = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit("."))
    )
    points = starts.select(F.col("at").alias("key"), F.explode(covering).alias("at")).unionByName(
        starts.select(ends.alias("key"), F.explode(F.slice(covering, F.lit(1), F.size(covering) - 1)).alias("at"))
    )
    emptied = starts.select(ends.alias("key"))  # keys after which no rule may be active
    stacks = points.join(named, "at").groupBy("key").agg(F.sort_array(F.collect_set("r")).alias("stack"))
    return emptied.select("key").distinct().join(stacks, "key", "full").select(
        "key", F.coalesce("stack", F.array().cast(stacks.schema["stack"].dataType)).alias("stack")
    )


def range_cuts(edges: DataFrame, ranges: int = RANGES) -> list[str]:
    """At most `ranges` boundary keys that cut the boundaries into ranges of about equal counts."""
    ranked = edges.select("key", F.ntile(ranges).over(Window.orderBy("key")).alias("n"))
    return sorted(r["key"] for r in ranked.groupBy("n").agg(F.min("key").alias("key")).collect())


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict, which replace columns of those names.

    rule is the deciding rule's host and path, or null, where the verdict is `otherwise`. A null
    url, or one without "://", has an empty host and path and meets no rule. Repeated rows are
    judged alike, an empty table of pages or of rules is allowed, extra columns pass through.
    """
    given = F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("given")
    rows = pages.select(given, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    edges = boundaries(rules)
    cuts = range_cuts(edges)
    range_of = lambda key: F.size(F.filter(F.lit(cuts).cast("array<string>"), lambda c: c <= key))
    keyed = rows.withColumn("key", host_key(F.col("host")))
    salts = max(SALTS, -(-pages.count() // SALT_ROWS))
    urls = keyed.select(
        range_of(F.col("key")).alias("range"),
        F.pmod(F.xxhash64("host", "path", F.spark_partition_id()), F.lit(salts)).alias("salt"),
        "key", F.lit(1).alias("kind"), "given", "host", "path",
        F.lit(None).cast(edges.schema["stack"].dataType).alias("stack"),
    )
    marks = edges.select(
        range_of(F.col("key")).alias("range"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("salt"),
        "key", F.lit(0).alias("kind"),
        F.lit(None).cast(urls.schema["given"].dataType).alias("given"),
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack",
    )
    sweep = Window.partitionBy("range", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = urls.unionByName(marks).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    best = F.array_max(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])))
    kept = [F.col(f"given.`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return swept.withColumn("best", best).select(
        *kept, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict")
    )
