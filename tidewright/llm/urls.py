"""URL filtering by host and path rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import ascii_lower, with_columns
from tidewright.operators.keys import lookup_join

_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty if none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if none."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _short(digest: Column) -> Column:
    """The first 32 bits of a SHA-256 in hex, as a number."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def judge_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Every row of ``pages`` with ``host``, ``path``, the deciding ``rule`` and the ``verdict``.

    ``rules`` has ``host``, ``path`` and ``action`` (allow or block). A rule fits its host and all subdomains where
    the url's path starts with the rule's; the longest rule (host and path together) decides, then the one with the
    longer host, then block before allow. Without one, ``rule`` is NULL and the verdict ``default``.

    Each distinct url is expanded into host suffix + path prefix expressions, no deeper than the deepest rule.
    Expressions meet the rules by an equi-join on 32 bits of their SHA-256; full digests and the rest of the rule's
    path are compared after it. The verdicts return to the rows by a join on the url that can be split, so one
    url or host with a third of the rows does no harm. A rule's path is cut after its last slash to be an
    expression, so prefixes that end inside a path segment work as well.

    NULL urls and urls without ``://`` have empty host and path and the default verdict. Rules with a NULL host,
    path or action, or an empty host, fit nothing. Result columns replace columns of the same name.
    """
    usable = rules.select("host", "path", "action").filter(
        (F.col("host") != "") & F.col("path").isNotNull() & F.col("action").isNotNull()
    )
    tests = usable.select(
        F.struct(
            F.length(F.concat("host", "path")).alias("length"),
            F.length("host").alias("host_length"),
            (F.col("action") == "block").cast("int").alias("strict"),
            F.concat("host", "path").alias("rule"),
            F.col("action").alias("action"),
        ).alias("match"),
        F.col("path").alias("rule_path"),
        F.sha2(F.concat(ascii_lower(F.col("host")), F.regexp_extract("path", r"(?s)^(.*/)?", 0)), 256).alias("digest"),
    ).withColumn("short", _short(F.col("digest")))
    depth = usable.agg(
        F.coalesce(F.max(F.size(F.split("host", r"\."))), F.lit(0)).alias("labels"),
        F.coalesce(F.max(F.size(F.split("path", "/", -1)) - 1), F.lit(0)).alias("slashes"),
    ).first()
    urls = pages.select(F.col(f"`{url_col}`").alias("url")).filter(F.col("url").isNotNull()).distinct()
    expanded = (
        urls.select("url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
        .filter("host <> ''")
        .withColumn("labels", F.split("host", r"\.", -1))
        .withColumn("steps", F.split("path", "/", -1))
        .select(
            "url",
            "path",
            F.transform(
                F.sequence(F.lit(1), F.least(F.size("labels"), F.lit(max(1, depth["labels"])))),
                lambda n: F.array_join(F.slice("labels", -n, n), "."),
            ).alias("suffixes"),
            F.transform(
                F.sequence(F.lit(0), F.least(F.size("steps") - 1, F.lit(depth["slashes"]))),
                lambda n: F.when(n == 0, "").otherwise(F.concat(F.array_join(F.slice("steps", 1, n), "/"), F.lit("/"))),
            ).alias("prefixes"),
        )
        .select("url", "path", F.explode("suffixes").alias("suffix"), "prefixes")
        .select("url", "path", "suffix", F.explode("prefixes").alias("prefix"))
        .withColumn("url_digest", F.sha2(F.concat("suffix", "prefix"), 256))
        .withColumn("short", _short(F.col("url_digest")))
    )
    verdicts = (
        expanded.join(tests, "short")
        .filter((F.col("url_digest") == F.col("digest")) & F.startswith("path", "rule_path"))
        .groupBy("url")
        .agg(F.max("match").alias("match"))
    )
    rows = pages.select(
        F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"), F.col(f"`{url_col}`").alias("url")
    )
    judged = lookup_join(rows, verdicts, ["url"], "left")
    new = {
        "host": url_host(F.col("url")),
        "path": url_path(F.col("url")),
        "rule": F.col("match.rule"),
        "verdict": F.coalesce(F.col("match.action"), F.lit(default)),
    }
    return with_columns("row", judged, **new)
