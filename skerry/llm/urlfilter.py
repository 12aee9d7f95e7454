"""URL filters: host-suffix and path-prefix expressions, joined by short hash prefixes, confirmed by full digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 32  # copies of the expressions of rules that URLs have
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where there is no `://`."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every suffix of the host at a label, with every prefix of the path of one of the lengths."""
    labels = F.split(host, r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    long = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda n: n <= F.char_length(path))
    paths = F.transform(long, lambda n: F.substr(path, F.lit(1), n))
    return F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.concat(h, p))))


def judge(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", prefix_bytes: int = 4) -> DataFrame:
    """One row for each distinct non-null URL: (url, rule, verdict).

    rules: (host, path, verdict), verdict `allow` or `block`. A rule fits its host and all subdomains of it,
    if the URL's path starts with the rule's path. Of fitting rules the longest (host and path together) wins,
    then the one of the longer host, then block. Without one the verdict is default. Rules with a null are void.
    The lengths of the rules' paths, at most as many as a path has characters, are read first; rules themselves
    are joined, and Spark broadcasts them only if their size allows it. URLs are judged once each, however often they stand there.
    Distinct expressions meet the rules first; the few that hit come back to the URLs in SALTS copies, so that an
    expression that a third of all URLs have, like `com/`, is no single key.
    """
    rules = rules.dropna(subset=["host", "path", "verdict"]).select(
        F.concat(F.translate("host", UPPER, LOWER), "path").alias("rule"), F.char_length("host").alias("host_len"), "verdict", F.char_length("path").alias("path_len")
    )
    lengths = sorted(r[0] for r in rules.select("path_len").distinct().collect())
    rules = rules.withColumn("rule_digest", F.sha2("rule", 256)).withColumn("short", F.substring("rule_digest", 1, 2 * prefix_bytes))
    distinct = urls.select(F.col(url_col).alias("url")).dropna().distinct()
    host, path = host_and_path(F.col("url"))
    tried = (
        distinct.select("url", F.explode(expressions(host, path, lengths)).alias("expression"))
        .select("url", F.sha2("expression", 256).alias("digest"))
        .withColumn("short", F.substring("digest", 1, 2 * prefix_bytes))
    )
    hits = tried.select("short", "digest").distinct().join(rules, "short").filter(F.col("digest") == F.col("rule_digest"))
    hits = hits.select("digest", "rule", "host_len", "verdict").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    best = (
        tried.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
        .join(hits, ["digest", "salt"])
        .groupBy("url")
        .agg(F.max(F.struct(F.char_length("rule").alias("n"), "host_len", "verdict", "rule")).alias("best"))
    )
    return distinct.join(best, "url", "left").select("url", "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Every row of pages as (page_id, host, path, rule, verdict).

    A null url, or one without `://`, has an empty host and path, fits no rule and gets the default. Repeated rows
    and ids stay; other columns are not read; an empty table gives an empty one.
    """
    judged = judge(pages, rules, url_col, default)
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    shown = ["page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")]
    there = rows.filter("url is not null").join(judged, "url", "left").select(*shown)
    none = F.lit(None).cast("string")  # null urls, however many, don't meet in one task
    return there.unionByName(rows.filter("url is null").withColumns({"rule": none, "verdict": none}).select(*shown))
