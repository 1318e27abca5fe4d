"""URL rules by a sorted sweep over reversed-host keys (operator 9).

A rule covers a host, all its subdomains, and the paths that start with its path. Reversing the
labels of the host gives a key of which every covered URL has a prefix once the URL's host is cut to
as many labels as the rule has; so a rule is the interval of keys that start with its own, and
intervals are nested or disjoint. Rules and URL keys are range-partitioned and swept in order of
their keys. The last rule that started carries the stack of rules around it; those of the stack that
the key starts with are active, and the longest rule over all cuts of the host wins. A partition
begins with the stack that the ones before it end with.

Only built-in functions are used. Equal hosts and paths are judged once and joined back, so a URL
with many copies costs one key. URLs give one key per number of labels that some rule has.

Defined cases: NULL urls and urls without ``://`` have an empty host and path. Without a fitting
rule the verdict is ``allow`` and the rule NULL. Rules of equal length tie to the one with the
longer host, then to the smaller verdict; a repeated rule counts once. Empty rule or page tables give unruled or no
rows. Repeated rows stay; columns other than page_id and url are never read.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tremorframe.llm import common

RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
DEFAULT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_EDGE = "\u0001"  # stands between host and path in a key


def host_of(url: Column) -> Column:
    found = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(found, F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit(f".{_EDGE}"), path)


def _stacks(rules: DataFrame) -> DataFrame:
    """key and stack of each rule: the rules around it and itself, longest key last."""
    # the different lengths of rule keys: at most as many as the longest key has characters
    lengths = [r[0] for r in rules.select(F.length("key")).distinct().collect()]
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("key"))
    cuts = rules.select("key").distinct().withColumn("n", F.explode(fitting))
    cuts = cuts.select("key", F.expr("left(key, n)").alias("outer"))
    around = cuts.join(rules.withColumnRenamed("key", "outer"), "outer")
    return around.groupBy("key").agg(
        F.collect_set(F.struct(F.length("outer").alias("depth"), "outer", "host", "path", "verdict")).alias("stack")
    )


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict of ``pages`` (page_id, url) under ``rules`` (host, path, verdict)."""
    pages = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rules = rules.select("host", "path", "verdict").groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    rules = common.staged(rules.withColumn("key", _key(_labels(F.col("host")), F.col("path"))), "rules")
    sizes = [r[0] for r in rules.select(F.size(_labels(F.col("host")))).distinct().collect()]

    urls = pages.select("host", "path").distinct()
    labels = _labels(F.col("host"))
    cuts = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= F.size(labels))
    points = urls.withColumn("n", F.explode(cuts))
    points = points.select(_key(F.slice(labels, F.lit(1), F.col("n")), F.col("path")).alias("key"), "host", "path")
    starts = _stacks(rules).select("key", "stack")
    events = starts.select("key", F.lit(0).alias("kind"), "stack", F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"))
    events = events.unionByName(points.select("key", F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["stack"].dataType).alias("stack"), "host", "path"))
    events = events.withColumn("salt", F.xxhash64("host", "path"))
    ordered = events.repartitionByRange("key", "kind", "salt").withColumn("part", F.spark_partition_id())
    ordered = common.staged(ordered, "sweep")

    ends = ordered.filter("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("end"))
    parts = ordered.select("part").distinct().join(ends, "part", "left")
    # one row per partition of the sweep
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = parts.select("part", F.last("end", ignorenulls=True).over(before).alias("carried"))
    sweep = W.partitionBy("part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    current = F.last("stack", ignorenulls=True).over(sweep)
    swept = ordered.repartitionByRange("part").withColumn("current", current).filter("kind = 1")
    swept = swept.join(F.broadcast(carried), "part")
    current = F.coalesce("current", "carried")
    active = F.filter(current, lambda r: F.col("key").startswith(r["outer"]))
    ranked = F.transform(
        active,
        lambda r: F.struct(
            (F.length(r["host"]) + F.length(r["path"])).alias("size"),
            F.length(r["host"]).alias("host_size"),
            F.concat(r["host"], r["path"]).alias("rule"),
            r["verdict"].alias("verdict"),
        ),
    )
    fitting = swept.select("host", "path", F.array_max(ranked).alias("best")).filter("best IS NOT NULL")
    best = fitting.groupBy("host", "path").agg(F.max("best").alias("best"))
    out = pages.join(best, ["host", "path"], "left")
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Rules as SQL literals, so that no Python process makes them."""
    if not rules:
        return spark.sql("SELECT '' AS host, '' AS path, '' AS verdict WHERE false")
    quoted = [", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in rule) for rule in rules]
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"({q})" for q in quoted) + " AS t(host, path, verdict)")


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages", "page_id", "url"), rule_table(spark))


QUERIES = {"op9_url_rules": op9_url_rules}

ORACLES = {
    "op9_url_rules": f"""
WITH rules(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
parsed AS (
  SELECT row_number() OVER () AS n, page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
best AS (
  SELECT n, max_by(h || p, length(h) + length(p)) AS rule, max_by(v, length(h) + length(p)) AS verdict
  FROM parsed JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p)
  GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, '{DEFAULT}') AS verdict
FROM parsed LEFT JOIN best USING (n)
"""
}
