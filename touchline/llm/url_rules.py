"""URL filtering against block and allow rules through hashes of host suffixes and path prefixes.

A rule is a host, a path and a verdict. It fits the host and its subdomains where the URL's path
starts with the rule's path. Every distinct URL is expanded into its host suffixes (at dots) joined
with its path prefixes (up to a slash); rules are stored under the prefix up to their last slash. The
expressions meet the rules in an equi-join on the first eight hex digits of their SHA-256; then
the full digests and the rest of the rule's path are compared. Of the rules that fit, the longest wins (host and path together;
then the longer host; then block). URLs without a rule get the verdict of `otherwise`.

URLs are expanded only as deep as some rule reaches, so a URL of thousands of slashes costs no more than others.
Only built-in functions are used. No side is broadcast here: the engine does it where it knows the rules to be small.

NULL URLs, or URLs without `://`, have an empty host and path, and no rule fits them. Repeated rows stay.
Columns of `pages` other than the URL are passed through; `host`, `path`, `rule` and `verdict` replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 8


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.translate(path, "/", ""))


def _suffixes(host: Column, most: int) -> Column:
    """The last 1 to `most` labels of a host; none of an empty one."""
    found = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.call_function("substring_index", host, F.lit("."), -k))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def _prefixes(path: Column, least: int, most: int) -> Column:
    """The prefixes of a path that end after its `least`-th to `most`-th slash; of none, the empty one."""
    deep = F.filter(F.sequence(F.lit(least), F.lit(most)), lambda k: k <= _slashes(path))
    return F.transform(deep, lambda k: F.when(k == 0, "").otherwise(F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/"))))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(`host`, `path`, `rule`, `verdict`) of the distinct (`host`, `path`) of `urls` that some rule fits."""
    key_path = F.regexp_extract("path", "(?s)^(.*/)?", 0)
    rules = rules.select(
        F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).where("host <> ''").select("host", "path", "verdict", F.sha2(F.concat("host", key_path), 256).alias("_digest"), _slashes(key_path).alias("_deep"))
    labels = F.size(F.split("host", "\\."))
    reach = rules.agg(F.max(labels), F.min("_deep"), F.max("_deep")).first()
    most, least, deepest = (0, 0, 0) if reach[0] is None else reach
    listed = rules.select(
        F.substring("_digest", 1, SHORT).alias("_short"), F.col("_digest").alias("_full"), F.concat("host", "path").alias("rule"),
        F.col("path").alias("_rule_path"), "verdict", F.length("host").alias("_host_length"),
    )
    spelled = urls.select("host", "path").distinct().where("host <> ''")
    spelled = spelled.select("host", "path", F.explode(_suffixes(F.col("host"), max(most, 1))).alias("_suffix"))
    spelled = spelled.select("host", "path", F.explode(F.transform(_prefixes(F.col("path"), least, deepest), lambda p: F.concat("_suffix", p))).alias("_expr"))
    spelled = spelled.select("host", "path", F.sha2("_expr", 256).alias("_digest")).withColumn("_short", F.substring("_digest", 1, SHORT))
    fits = spelled.join(listed, "_short").where((F.col("_digest") == F.col("_full")) & F.startswith("path", "_rule_path"))
    order = F.struct(F.length("rule"), "_host_length", F.when(F.col("verdict") == "block", 1).otherwise(0), "rule", "verdict")
    return fits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), order).alias("_won")).select(
        "host", "path", "_won.rule", "_won.verdict"
    )


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """`pages` with `host`, `path`, the winning `rule` (or NULL) and the `verdict`."""
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict") or c == url_col]
    named = pages.select(*[F.col(f"`{c}`").alias(f"_in_{c}") for c in keep], host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    won = match_rules(named, rules)
    return named.join(won, ["host", "path"], "left").select(
        *[F.col(f"`_in_{c}`").alias(c) for c in keep], "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict")
    )
