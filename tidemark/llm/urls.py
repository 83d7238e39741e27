"""URL filters by expansion, short hash prefixes and full digests.

A URL is expanded into pairs of a host suffix and a path prefix. The SHA-256 of each
pair's first digits is looked up among the rules by an equi-join; a hit counts only if
the whole digest agrees. Of the rules that fit, the longest wins. Suffixes and prefixes
are made only of the sizes that occur among the rules, so a URL's expressions are
bounded by the rule list and not by the length of the URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verdict, host and path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
PREFIX_DIGITS = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://`` or for null."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark, rules) -> DataFrame:
    """The rules with their digests. ``rules``: (verdict, host, path) tuples, or a frame with these columns."""
    df = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "verdict string, host string, path string")
    digest = F.sha2(F.concat_ws("\n", "host", "path"), 256)
    return (
        df.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), "path")
        .where("host is not null and path is not null")
        .distinct()
        .select(
            F.col("verdict").alias("__verdict"),
            F.concat("host", "path").alias("__rule"),
            F.length("host").alias("__hlen"),
            digest.alias("__digest"),
            F.substring(digest, 1, PREFIX_DIGITS).alias("__short"),
        )
    )


def judge_urls(
    df: DataFrame,
    rules=None,
    url_col: str = "url",
    keep: tuple[str, ...] = ("page_id",),
    default: str = "allow",
) -> DataFrame:
    """One row for each row of ``df``: ``keep`` columns, host, path, rule, verdict and the numbers of short and full hits.

    A rule fits its host and all subdomains of it if the path starts with the rule's. Of
    the rules that fit, the longest text wins, then the longer host, then block before
    allow. Where none fits, the verdict is ``default``; a URL without a host (null, empty
    or without ``://``) can't be fetched and is blocked. Rows that repeat stay apart. An
    empty table gives an empty result; columns other than ``keep`` and the URL are not read.
    """
    rules = RULES if rules is None else rules
    frame = rules_frame(df.sparkSession, rules)
    if isinstance(rules, DataFrame):  # two short lists of sizes, whatever the number of rules
        sizes = rules.select(F.size(F.split("host", "[.]")).alias("h"), F.length("path").alias("p")).where("h is not null and p is not null")
        sizes = sizes.agg(F.collect_set("h"), F.collect_set("p")).first()
        labels, lengths = sorted(sizes[0]), sorted(sizes[1])
    else:
        labels = sorted({h.count(".") + 1 for _, h, _ in rules})
        lengths = sorted({len(p) for _, _, p in rules})
    rows = df.select(
        *keep,
        host_of(F.col(url_col)).alias("host"),
        path_of(F.col(url_col)).alias("path"),
        F.monotonically_increasing_id().alias("__row"),
    )
    parts = F.split("host", "[.]")
    suffixes = F.filter(
        F.transform(F.lit(labels).cast("array<int>"), lambda n: F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), "."))),
        lambda s: s.isNotNull() & (s != ""),
    )
    prefixes = F.filter(
        F.transform(F.lit(lengths).cast("array<int>"), lambda n: F.when(F.length("path") >= n, F.substring(F.col("path"), F.lit(1), n))),
        lambda s: s.isNotNull(),
    )
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat(s, F.lit("\n"), p), 256))))
    asked = rows.withColumn("__ask", F.explode_outer(pairs)).withColumn("__short", F.substring("__ask", 1, PREFIX_DIGITS))
    found = asked.join(frame, "__short", "left")
    full = F.col("__ask") == F.col("__digest")
    #: Greatest wins; "block" is greater than "allow".
    hit = F.when(full, F.struct(F.length("__rule").alias("l"), F.col("__hlen").alias("h"), F.col("__verdict").alias("v"), F.col("__rule").alias("r")))
    best = found.groupBy("__row", *keep, "host", "path").agg(
        F.max(hit).alias("__hit"),
        F.count("__digest").alias("n_short"),
        F.count(F.when(full, 1)).alias("n_full"),
    )
    verdict = F.coalesce(F.col("__hit.v"), F.when(F.col("host") == "", F.lit("block")).otherwise(F.lit(default)))
    return best.select(*keep, "host", "path", F.col("__hit.r").alias("rule"), verdict.alias("verdict"), "n_short", "n_full")
