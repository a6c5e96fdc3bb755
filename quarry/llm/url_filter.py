"""URL filters as a sort-merge range join; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import HEAVY, ascii_lower, lookup, materialize

#: (host, path, verdict) of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
DEFAULT = "allow"


def split_url(url) -> dict:
    """host and path columns: host after the first '://' up to / ? # or the end, A-Z lower-cased; path from there to ? # or the end."""
    url = F.coalesce(url, F.lit(""))
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return {"host": ascii_lower(F.regexp_extract(url, pattern, 1)), "path": F.regexp_extract(url, pattern, 2)}


def reversed_host(host):
    """Canonical key of a host: labels from the right, so that a domain's key is a prefix of its subdomains' keys."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _sweep_events(rules: DataFrame) -> DataFrame:
    """Both ends of each rule's interval of keys, each with the rule on top of the stack after it.

    Prefix intervals of one host are nested or disjoint. The stack is kept by depth: the top
    after an event at depth d is the last rule that was opened at depth d.
    """
    path = F.col("path").cast("binary")
    end = F.concat(path, F.unhex(F.lit("FF")))  # FF is in no UTF-8 text: above every string with this prefix
    rule = F.struct("rule", "verdict", F.length("rule").alias("chars"), F.length("rule_host").alias("host_chars"))
    both = F.array(F.struct(path.alias("k"), F.lit(0).alias("kind"), F.lit(1).alias("d")), F.struct(end.alias("k"), F.lit(1).alias("kind"), F.lit(-1).alias("d")))
    e = rules.select("host_key", rule.alias("own"), F.explode(both).alias("e")).select("host_key", "own", "e.*")
    e = e.withColumn("depth", F.sum("d").over(Window.partitionBy("host_key").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)))
    opened = F.when(F.col("kind") == 0, F.col("own"))
    last = F.last(opened, ignorenulls=True).over(Window.partitionBy("host_key", "depth").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return e.select("host_key", "k", "kind", F.struct(F.when(F.col("depth") > 0, last).alias("rule")).alias("top"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url") -> DataFrame:
    """Columns of pages plus host, path, rule, verdict; rules has host, path, verdict.

    A rule fits its host and all subdomains when the path starts with the rule's path; the
    longest rule wins, then the one with the longer host; of equal rules with different verdicts
    'block' wins. Distinct (host, path) pairs are judged once. A pair gets one key for each
    host suffix that has rules; keys and rule ends are merged in sort order within a host, and the
    last event before a key names the top of the stack, its longest rule. Hosts that hold over
    1/HEAVY of the keys are swept in that many salted slices, each with that host's events. Null urls and urls
    without '://' have empty host and path and no rule; empty tables give empty results.
    """
    made = ["host", "path", "rule", "verdict"]
    parts = split_url(F.col(url))
    pages = pages.select(F.struct(*[c for c in pages.columns if c not in made]).alias("_row"), parts["host"].alias("_host"), parts["path"].alias("_path"))
    pairs = materialize(pages.groupBy("_host", "_path").agg(F.count("*").alias("_n")), "urls")
    rules = rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("rule_host <> ''")
    rules = rules.groupBy("rule_host", "path").agg(F.max("verdict").alias("verdict"))
    rules = materialize(rules.withColumns({"rule": F.concat("rule_host", "path"), "host_key": reversed_host(F.col("rule_host"))}), "rules")
    labels = rules.agg(F.max(F.size(F.split("host_key", r"\.")))).first()[0] or 0
    hosts = rules.select("host_key").distinct()
    small = hosts.count() <= 100_000
    parts = F.reverse(F.split("_host", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.size(parts), F.lit(labels)))), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    points = pairs.select("_host", "_path", F.explode(suffixes).alias("host_key")).join(F.broadcast(hosts) if small else hosts, "host_key", "left_semi")
    count = points.groupBy("host_key").agg(F.count("*").alias("_points"))
    least = max(2, -(-pairs.count() // HEAVY))
    heavy = materialize(count.where(F.col("_points") >= least).select("host_key", F.ceil(F.col("_points") / least).cast("int").alias("_slices")), "hosts")
    slices = F.coalesce("_slices", F.lit(1))
    points = points.join(F.broadcast(heavy), "host_key", "left").withColumn("_slice", F.pmod(F.xxhash64("_host", "_path"), slices).cast("int"))
    points = points.select("host_key", "_slice", F.col("_path").cast("binary").alias("k"), F.lit(2).alias("kind"), F.lit(None).cast("struct<rule:struct<rule:string,verdict:string,chars:int,host_chars:int>>").alias("top"), "_host", "_path")
    events = _sweep_events(rules).join(F.broadcast(heavy), "host_key", "left").withColumn("_slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    events = events.select("host_key", "_slice", "k", "kind", "top", F.lit(None).cast("string").alias("_host"), F.lit(None).cast("string").alias("_path"))
    sweep = Window.partitionBy("host_key", "_slice").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = points.unionByName(events).withColumn("_top", F.last("top", ignorenulls=True).over(sweep)).where("kind = 2")
    best = swept.select("_host", "_path", F.col("_top.rule").alias("_rule")).where("_rule is not null")
    best = best.groupBy("_host", "_path").agg(F.max_by("_rule", F.struct("_rule.chars", "_rule.host_chars")).alias("_rule"))
    judged = materialize(pairs.join(best, ["_host", "_path"], "left").select("_host", "_path", "_n", F.col("_rule.rule").alias("_r"), F.col("_rule.verdict").alias("_v")), "judged")
    out = lookup(pages, judged, ["_host", "_path"], "_n")
    return out.select("_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_r").alias("rule"), F.coalesce("_v", F.lit(default)).alias("verdict"))


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")
