"""URL filters: host-suffix and path-prefix expressions against a rule list.

A rule is a host with an optional path prefix (``example.org/en/1``). It fits its host and every
subdomain, where the url's path starts with the rule's path; the longest rule that fits decides.

Each rule is keyed by its host and the *stem* of its path, which is the path up to its last slash.
Each url is expanded into every (host suffix, slash-ended path prefix) that is no deeper than the
deepest rule, so the expansion is bounded by the rules and not by the url. Both sides meet on the
first 32 bits of a SHA-256 digest; the full digest and the rest of the path then confirm the hit.

Defined results: a null url, or one without ``://``, has an empty host and path and fits no rule.
Repeated rows are judged each for itself; columns of the input other than the id and the url are
not looked at, whatever their names. Rules that repeat count once; of equally long rules ``block``
wins. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from braggflow.llm.common import lower_ascii, small_side


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url: host up to the first of ``/?#``, path up to the first of ``?#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, stem: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), stem), 256)


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) for each row of pages; rules: (host, path, verdict)."""
    rules = rules.select(
        lower_ascii(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict")
    ).where("r_host is not null and r_verdict is not null")
    rules = rules.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))  # block over allow
    stem = F.regexp_extract("r_path", r"^(.*/)?", 0)
    rules = rules.withColumn("r_digest", _digest(F.col("r_host"), stem)).withColumn("r_key", _prefix(F.col("r_digest")))
    depth = rules.agg(
        F.coalesce(F.max(F.size(F.split("r_host", r"\."))), F.lit(0)), F.coalesce(F.max(F.size(F.split("r_path", "/")) - 1), F.lit(0))
    ).first()
    labels, slashes = depth[0], depth[1]

    host, path = split_url(F.col(url_col))
    urls = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    parts, segments = F.split("host", r"\."), F.split("path", "/")
    suffixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.greatest(-n, -F.size(parts)), n), ".")),
    )
    stems = F.transform(
        F.sequence(F.lit(0), F.least(F.size(segments) - 1, F.lit(slashes))),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(segments, 1, n), "/"), F.lit("/"))),
    )
    expanded = (
        urls.select("*", F.posexplode(suffixes).alias("n", "suffix"))
        .select("*", F.posexplode(stems).alias("m", "stem"))
        .withColumn("digest", _digest(F.col("suffix"), F.col("stem")))
        .withColumn("key", _prefix(F.col("digest")))
    )
    fits = (F.col("key") == F.col("r_key")) & (F.col("digest") == F.col("r_digest")) & F.expr("startswith(path, r_path)") & (F.col("n") > 0)
    hits = expanded.join(small_side(rules), fits, "left").where("r_host is not null or (n = 0 and m = 0)")
    name = F.concat("r_host", "r_path")
    best = F.max(F.when(F.col("r_host").isNotNull(), F.struct(F.length(name).alias("len"), F.col("r_verdict").alias("verdict"), name.alias("rule"))))
    out = hits.groupBy("row").agg(F.first("id").alias("id"), F.first("host").alias("host"), F.first("path").alias("path"), best.alias("best"))
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
