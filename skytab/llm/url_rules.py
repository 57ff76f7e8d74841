"""URL rules found by equi-joins of expanded URL expressions on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules up to this many are broadcast (under 100 bytes each); more are joined by a shuffle.
BROADCAST_RULES = 50_000


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without it."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", prefix_bytes: int = 4) -> DataFrame:
    """``pages`` (page_id, url) judged by ``rules`` (host, path, verdict): page_id, host, path, rule, verdict, matches.

    A rule fits its host and all subdomains, if the URL's path starts with the rule's. Of the rules
    that fit, the longest decides (host and path together; then the longer host; then block before
    allow); without one, rule is null and the verdict is ``default``. Each URL is expanded into those
    host suffixes and path prefixes whose numbers of labels and characters occur among the rules. Of an
    expression only the first bytes of its SHA-256 and its two numbers are written out; it meets rules
    on these bytes, and the whole digest confirms them.

    A null url, or one without ``://``, has an empty host and path. Rules with a null part are
    ignored; rows that repeat a page_id are judged each; empty tables give no rows or no fits; other
    columns are ignored. Rows of one popular rule are spread by page_id after the join.
    """
    rules = rules.select("host", "path", "verdict").dropna().distinct()
    rules = rules.select(
        F.translate("host", UPPER, LOWER).alias("r_host"),
        F.col("path").alias("r_path"),
        F.col("verdict").alias("r_verdict"),
    ).withColumn("r_digest", F.sha2(F.concat("r_host", F.lit("\n"), "r_path"), 256))
    rules = rules.withColumn("r_prefix", _prefix(F.col("r_digest"), prefix_bytes))
    numbers = lambda c: F.array(*(F.lit(r[0]) for r in rules.select(c).distinct().orderBy(c).collect())).cast("array<int>")
    labels = numbers(F.size(F.split("r_host", r"\.", -1)).alias("n"))  # both lists are as long as the rules are wide
    lengths = numbers(F.length("r_path").alias("n"))
    small = rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES

    rows = pages.select("page_id", "url").withColumn("host", url_host(F.col("url"))).withColumn("path", url_path(F.col("url")))
    rows = rows.select("page_id", "host", "path").withColumn("__row", F.struct(F.spark_partition_id(), F.monotonically_increasing_id()))
    n_labels = F.when(F.col("host") == "", F.lit(0)).otherwise(F.length("host") - F.length(F.replace("host", F.lit("."), F.lit(""))) + 1)
    hosts = F.filter(labels, lambda n: n <= n_labels)
    paths = F.filter(lengths, lambda n: n <= F.length("path"))
    each = lambda h, p: F.struct(_prefix(_digest(h, p), prefix_bytes).alias("prefix"), h.alias("labels"), p.alias("length"))
    rows = rows.withColumn("__keys", F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: each(h, p)))))
    return _joined(rows, F.broadcast(rules) if small else rules, default)


def _digest(labels: Column, length: Column) -> Column:
    """SHA-256 of the last labels of the row's host and the first characters of its path."""
    suffix = F.call_function("substring_index", F.col("host"), F.lit("."), -labels)
    return F.sha2(F.concat(suffix, F.lit("\n"), F.substring(F.col("path"), F.lit(1), length)), 256)


def _prefix(digest: Column, n: int) -> Column:
    return F.conv(F.substring(digest, 1, 2 * n), 16, 10).cast("long")


def _joined(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    keyed = rows.select("page_id", "host", "path", "__row", F.explode_outer("__keys").alias("k")).select("page_id", "host", "path", "__row", "k.*")
    # an equation of digests would become a join key; as a prefix test it confirms what meets on the short key
    confirmed = F.startswith(_digest(F.col("labels"), F.col("length")), F.col("r_digest"))
    joined = keyed.join(rules, (keyed["prefix"] == rules["r_prefix"]) & confirmed, "left")
    rank = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("n"),
        F.length("r_host").alias("h"),
        (F.col("r_verdict") == "block").alias("b"),
        F.concat("r_host", "r_path").alias("rule"),
        F.col("r_verdict").alias("verdict"),
    )
    best = joined.groupBy("__row", "page_id", "host", "path").agg(F.max(F.when(F.col("r_digest").isNotNull(), rank)).alias("best"), F.count("r_digest").alias("matches"))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"), "matches")
