"""URL rules: host-suffix and path-prefix expressions, joined on short hash prefixes, confirmed on full digests.

Built-in DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_HEX = 8
#: Pairs of host and path that hold more than one in so many rows are hot; there are fewer than this.
MOST_HOT = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://` or for null."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def _suffixes(host: Column, labels: Column) -> Column:
    """The host's last n labels for each n in ``labels`` that it has."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.filter(labels, lambda n: n <= F.size(parts)),
                       lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))


def _prefixes(path: Column, lengths: Column) -> Column:
    """The path's first n characters for each n in ``lengths`` that it has."""
    return F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))


def filter_urls(pages: DataFrame, rules: DataFrame, url_column: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` appended.

    ``rules`` has ``host, path, verdict``. A rule fits its host and every subdomain if the url's path starts with the
    rule's path (character-wise); the longest rule (host and path together) wins, of equally long ones a blocking one,
    then the smallest text. ``rule`` is host + path of the winner, else null, and ``verdict`` is then ``default``.

    Each distinct (host, path) is expanded into the host suffixes and path prefixes whose label counts and lengths some
    rule has (one small row of integers, bounded by the longest rule), joined on the first ``PREFIX_HEX`` hex digits of the
    expression's SHA-256 and confirmed on the whole digest; the winner is one map-side combined aggregation. Rows of a (host, path) that holds
    more than a share of 1 / MOST_HOT of all rows (urls without a host among them) meet its winner by broadcast, of fewer than MOST_HOT
    rows, and are spread over all tasks. A url that is null or has no `://` has empty host and path and meets no rule; a rule without host or path (null) is ignored; repeated rows and rules change
    nothing; columns of ``pages`` named like an output column are replaced. Empty tables give empty results, no rules give
    ``default``.
    """
    rules = (rules.where("host is not null and path is not null")
             .select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")).distinct())
    shapes = rules.agg(F.collect_set(F.size(F.split("rule_host", r"\.", -1))).alias("label_counts"), F.collect_set(F.length("rule_path")).alias("path_lengths"))
    keyed = rules.withColumn("digest", _digest(F.concat_ws("\n", "rule_host", "rule_path"))).withColumn("short", F.substring("digest", 1, PREFIX_HEX))

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    pages = pages.select(*kept, host_of(F.col(url_column)).alias("host"), path_of(F.col(url_column)).alias("path"))
    urls = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))
    expressions = (urls.select("host", "path").where("host <> '' or path <> ''").crossJoin(F.broadcast(shapes))
                   .withColumn("suffix", F.explode(_suffixes(F.col("host"), F.col("label_counts"))))
                   .withColumn("prefix", F.explode(_prefixes(F.col("path"), F.col("path_lengths"))))
                   .select("host", "path", _digest(F.concat_ws("\n", "suffix", "prefix")).alias("full"))
                   .withColumn("short", F.substring("full", 1, PREFIX_HEX)))
    hits = expressions.join(keyed, "short").where("full = digest")
    text = F.concat("rule_host", "rule_path")
    rank = F.struct(-F.length(text), F.when(F.col("rule_verdict") == "block", 0).otherwise(1), text.alias("rule"), F.col("rule_verdict").alias("verdict"))
    best = hits.groupBy("host", "path").agg(F.min(rank).alias("best")).select("host", "path", "best.rule", "best.verdict")
    total = urls.agg(F.sum("n").alias("total"))
    hot = urls.crossJoin(F.broadcast(total)).where(F.col("n") * MOST_HOT > F.col("total")).select("host", "path")
    winners = hot.join(best, ["host", "path"], "left").select(
        F.col("host").alias("hot_host"), F.col("path").alias("hot_path"), F.struct("rule", "verdict").alias("hot_best"))

    # every row keeps its own columns in one struct, so that none of their names can clash
    rows = pages.select(F.struct(*kept).alias("row") if kept else F.lit(None).alias("row"), "host", "path")
    rows = rows.join(F.broadcast(winners), (rows["host"] == winners["hot_host"]) & (rows["path"] == winners["hot_path"]), "left")
    is_hot = F.col("hot_best").isNotNull()
    rows = rows.select("row", "host", "path", "hot_best", F.when(is_hot, 1 + F.monotonically_increasing_id()).otherwise(F.lit(0)).alias("salt"))
    judged = rows.join(best.withColumn("salt", F.lit(0).cast("long")), ["host", "path", "salt"], "left")
    found = F.when(F.col("hot_best").isNotNull(), F.col("hot_best")).otherwise(F.struct("rule", "verdict"))
    return judged.select(*[F.col("row").getField(c).alias(c) for c in kept], "host", "path",
                         found["rule"].alias("rule"), F.coalesce(found["verdict"], F.lit(default)).alias("verdict"))
