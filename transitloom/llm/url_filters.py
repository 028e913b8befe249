"""Operator 8: URL block and allow lists as a sort-merge range join.

A host becomes a key with its labels reversed (``www.example.net`` -> ``net.example.www.``),
so that a host and its subdomains are one interval of keys, and the hosts of rules nest. A
sorted sweep over pages and the ends of these intervals keeps the stack of the hosts that are
active, which are no more than a host has labels. Each of them has its own sweep over paths:
there a rule is the interval of the paths that start with its own, and since these nest too,
an event needs the innermost rule alone: its own where it begins, the one around it where it
ends. So neither the rules of a host nor those above it are ever gathered in one row. Of the
rules that the hosts of its stack give a page, the longest counts.

Sweeps are dealt by top-level label or rule host and a salt; events are repeated for each
salt. Salts follow the counted pages, and are fewer where rules are many, so that repeated
events never outnumber the pages. Only numbers, hosts and paths move.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import if_small, partitions, written

#: Pages of a label or a rule host in one sweep, at most where rules are few.
SWEEP_ROWS = 1 << 16

#: Up to "://", the host, the path.
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The rules of the registered query.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: Column) -> Column:
    return _lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _nested(hosts: DataFrame) -> DataFrame:
    """(key, stack): from this key on, the rule hosts in stack are active, outermost first."""
    named = hosts.select(host_key(F.col("at")).alias("key"), "at")
    labels = F.split("key", r"\.")
    above = named.select("key", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("depth", "of"))
    found = above.join(named.withColumnRenamed("key", "of"), "of")
    stacks = found.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "at"))), lambda x: x["at"]).alias("here"))
    # "/" is the byte after ".": the first key past all that start with this one
    end = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    outer = F.slice("here", F.lit(1), F.size("here") - 1)
    return stacks.select(F.inline(F.array(F.struct("key", F.col("here").alias("stack")), F.struct(end.alias("key"), outer.alias("stack")))))


def _path_events(rules: DataFrame) -> DataFrame:
    """(at, place, top): at a host, from this path on, ``top`` is the innermost rule that is active, or null."""
    own = F.struct("size", "rule", "verdict")
    prefixes = rules.select("at", "path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.col("path").substr(F.lit(1), n))).alias("of")).filter(F.col("of") != F.col("path"))
    around = prefixes.join(rules.select("at", F.col("path").alias("of"), own.alias("outer")), ["at", "of"]).groupBy("at", "path").agg(F.max("outer").alias("outer"))
    both = rules.join(around, ["at", "path"], "left")
    bytes_ = F.encode("path", "UTF-8")
    # no text holds the byte FF: the first place past all paths that start with this one
    end = F.concat(bytes_, F.unhex(F.lit("FF")))
    return both.select("at", F.inline(F.array(F.struct(bytes_.alias("place"), own.alias("top")), F.struct(end.alias("place"), F.col("outer").alias("top")))))


def _salts(pages: Column, rules: Column, least: int) -> Column:
    """Salts of a sweep: of SWEEP_ROWS pages at most, but a salt's pages at least as many as its events."""
    return F.greatest(F.lit(1), F.least(F.greatest(F.lit(least), F.ceil(pages / SWEEP_ROWS)), F.floor(pages / F.greatest(F.lit(1), 2 * rules)))).cast("int")


def filter_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """Each page's host, path, rule and verdict: (id, host, path, rule, verdict), a row for each page.

    rules: (verdict, host, path); a rule fits its host and all subdomains if the path starts
    with the rule's. The longest host and path wins, and block beats allow where the same rule
    has both. A rule without a host or a verdict is left out. Null urls and those without
    "://" have an empty host and path, fit no rule and get ``default`` with a null rule; so
    does every page where there are no rules. Ids may be null or repeat. Columns of other
    names are not read.
    """
    spark = pages.sparkSession
    least = 4 * max(64, partitions(spark))
    named = rules.select(_lower(F.col("host")).alias("at"), F.coalesce("path", F.lit("")).alias("path"), "verdict").filter("at <> '' and verdict is not null")
    whole = F.concat("at", "path")
    named = written(named.groupBy("at", "path").agg(F.max("verdict").alias("verdict")).select("at", "path", F.length(whole).alias("size"), whole.alias("rule"), "verdict"), "url-rules")
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"), F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "url-pages")

    hosts = named.groupBy("at").agg(F.count("*").alias("rules"))
    counted = rows.count(), hosts.count()
    count = salts or spark.range(1).select(_salts(F.lit(counted[0]), F.lit(counted[1]), least)).first()[0]
    top = F.substring_index("key", ".", 1)
    keyed = rows.select("row", "path", host_key(F.col("host")).alias("key"), F.pmod(F.xxhash64("row"), F.lit(count)).cast("int").alias("salt")).withColumn("top", top).withColumn("page", F.lit(True))
    events = _nested(hosts).withColumn("top", F.regexp_replace(top, "/$", "")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("page", F.lit(False))
    sweep = Window.partitionBy("top", "salt").orderBy("key", "page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = keyed.unionByName(events, allowMissingColumns=True).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).filter("page")
    met = written(swept.select("row", F.explode("active").alias("at"), "path"), "url-hosts")

    pages_of = met.groupBy("at").agg(F.count("*").alias("pages")).join(hosts, "at")
    pieces = F.lit(salts) if salts else _salts(F.col("pages"), F.col("rules"), least)
    dealt = written(pages_of.select("at", pieces.alias("pieces")), "url-salts")
    few = if_small(dealt, 64)
    events = _path_events(named).join(few, "at").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    events = events.select("at", "piece", "place", F.lit(False).alias("page"), F.struct("top").alias("here"))
    own = met.join(few, "at").select("at", F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int").alias("piece"), F.encode("path", "UTF-8").alias("place"), F.lit(True).alias("page"), "row")
    sweep = Window.partitionBy("at", "piece").orderBy("place", "page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fits = own.unionByName(events, allowMissingColumns=True).withColumn("now", F.last("here", ignorenulls=True).over(sweep)).filter("page and now.top is not null")
    best = fits.groupBy("row").agg(F.max("now.top").alias("best"))
    done = rows.join(best, "row", "left")
    return done.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


FILTER_URLS_SQL = r"""
WITH p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
