"""URL filters by host-suffix and path-prefix expressions.

Each distinct (host, path head) is expanded into the expressions that a rule
could name, the expressions meet the rules in an equi-join on the first 32 bits
of their SHA-256, and the full digest is compared before a rule counts. The
longest rule that fits decides.

Defined cases: a null url or one without `://` has an empty host and path and
gets the default verdict; of two rules with the same host and path the blocking
one counts; repeated rows are judged each; other columns are kept, but for ones with the names of the
four results (or `_head`, `_verdict`), which are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agentlens.llm.common import ascii_lower, table, written

#: (verdict, host, path); fixed values of the query.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Rule sets up to this size are broadcast (about 200 bytes a rule); larger ones join by shuffle.
BROADCAST_RULES = 50_000
URL_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL_PARTS, 2)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """One row per (host, path): key, digest, rule, verdict, n_chars."""
    rows = spark.createDataFrame(list(rules), "rule_verdict string, rule_host string, rule_path string")
    return (
        rows.groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))  # "block" sorts after "allow"
        .withColumn("rule", F.concat("rule_host", "rule_path"))
        .withColumn("rule_digest", F.sha2("rule", 256))
        .select(F.substring("rule_digest", 1, 8).alias("key"), "rule_digest", "rule", "rule_verdict", F.char_length("rule").alias("rule_chars"))
    )


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule (null if none fits) and verdict."""
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, _, path in rules}) or [0]
    labels = max((host.count(".") + 1 for _, host, _ in rules), default=1)
    taken = [c for c in pages.columns if c in {"host", "path", "rule", "verdict", "_head", "_verdict"}]
    parts = pages.drop(*taken).withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))}).withColumn("_head", F.substring("path", 1, lengths[-1]))
    requests = parts.filter(F.col("host") != "").select("host", "_head").distinct()
    names = F.split("host", r"\.")
    expressions = (
        requests.withColumn("_names", names)
        .withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.size("_names"), F.lit(labels)))))
        .withColumn("_suffix", F.array_join(F.slice("_names", -F.col("_n"), F.col("_n")), "."))
        .withColumn("_length", F.explode(F.array(*map(F.lit, lengths))))
        .filter(F.char_length("_head") >= F.col("_length"))
        .select("host", "_head", F.sha2(F.concat("_suffix", F.substring("_head", F.lit(1), F.col("_length"))), 256).alias("_digest"))
        .withColumn("key", F.substring("_digest", 1, 8))
    )
    rule_rows = rule_table(spark, rules)
    if len(rules) <= BROADCAST_RULES:
        rule_rows = F.broadcast(rule_rows)
    best = (
        expressions.join(rule_rows, "key")
        .filter(F.col("_digest") == F.col("rule_digest"))
        .groupBy("host", "_head")
        .agg(F.max(F.struct("rule_chars", "rule", "rule_verdict")).alias("_best"))
        .select("host", "_head", F.col("_best.rule").alias("rule"), F.col("_best.rule_verdict").alias("_verdict"))
    )
    # written before it is joined: the pages of a hot host then come from an exchange of their own, which can be split
    return parts.join(written(best), ["host", "_head"], "left").withColumn("verdict", F.coalesce("_verdict", F.lit(default))).drop("_head", "_verdict")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


SQL = {
    "op6_url_filter": r"""
    WITH u AS (
        SELECT page_id,
               translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
        FROM pages),
    r(verdict, rhost, rpath) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
    f AS (
        SELECT u.*, (SELECT max((length(rhost || rpath), rhost || rpath, r.verdict)) FROM r
                     WHERE (u.host = rhost OR ends_with(u.host, '.' || rhost)) AND starts_with(u.path, rpath)) AS best
        FROM u)
    SELECT page_id, host, path, best[2] AS rule, coalesce(best[3], 'allow') AS verdict FROM f
    """
}
