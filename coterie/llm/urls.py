"""URL filters: allow and block rules on hosts and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coterie.session import written

#: Hex digits of the digest on which URLs and rules are joined.
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased; empty without ``://`` or for a null URL."""
    return _lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def _lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _n_labels(host: Column) -> Column:
    return F.length(host) - F.length(F.translate(host, ".", "")) + 1


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # A host has no "/", so the joined string has one reading.
    return F.sha2(F.concat(host, F.lit(" "), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rules`` has host, path and verdict.  A rule fits its host and all subdomains
    of it, if the URL's path starts with the rule's path.  The longest fitting rule
    wins (characters of host and path; at a tie the longer host, then ``block``).
    Without one, rule is null and verdict ``default``.

    Each distinct (host, path) is expanded into its host suffixes times its path
    prefixes, of the numbers of labels and the lengths that rules have; these meet the
    rules in an equi-join on the first digits of their digests, and the full digest
    confirms.  A long host or path costs its length per such number.  Repeated pages
    are judged once and all returned.  A null or malformed URL has empty host and
    path.  Rules with a null host, path or verdict are ignored; columns of ``pages``
    named like the four results are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)),
                                                                       "path": url_path(F.col(url))})
    rules = rules.select(_lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"),
                         F.col("verdict").alias("rule_verdict")).dropna()
    rules = rules.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
    rules = rules.groupBy("digest", "rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    rules = written(rules.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS)), "url-rules")
    # The distinct lengths of rule paths, and numbers of labels of rule hosts: as many as the
    # longest path has characters, and the longest host labels, at most.
    lengths = sorted(r.n for r in rules.select(F.length("rule_path").alias("n")).distinct().collect())

    counts = sorted(r.n for r in rules.select(_n_labels(F.col("rule_host")).alias("n")).distinct().collect())

    counts = F.filter(F.array(*map(F.lit, counts)).cast("array<int>"), lambda n: n <= _n_labels(F.col("host")))
    # The last n labels, from the end of the host.
    suffixes = F.transform(counts, lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    urls = pages.select("host", "path").where("host <> ''").distinct()
    lengths = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("path"))
    prefixes = F.transform(lengths, lambda n: F.substr("path", F.lit(1), n))
    expressions = urls.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    expressions = expressions.withColumn("own", _digest(F.col("suffix"), F.col("prefix")))
    expressions = expressions.withColumn("short", F.substring("own", 1, PREFIX_DIGITS))
    found = expressions.join(rules, "short").where("own = digest")
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("m"),
                    F.col("rule_verdict").alias("verdict"),
                    F.concat("rule_host", "rule_path").alias("rule"))
    best = found.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return pages.join(best, ["host", "path"], "left").select(
        *[c for c in pages.columns if c not in ("host", "path")], "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
