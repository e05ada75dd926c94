"""Whose rows they are: the member by the repository's settings, the device by its name and home."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values of the event tables
UNKNOWN, UNKNOWN_HOST, UNKNOWN_HOME = "(unknown)", "(unknown-host)", "(unknown-home)"


def filled(text: Column, other: str) -> Column:
    return F.when(F.trim(text) != "", text).otherwise(F.lit(other))


def device_id(host: Column, home: Column) -> Column:
    return F.concat(F.lit("device:"), F.md5(F.concat_ws("\n", filled(host, UNKNOWN_HOST), F.coalesce(home, F.lit(UNKNOWN_HOME)))))


def with_member(df: DataFrame, emails: DataFrame, everywhere: str | None = None, repo_root: str = "repo_root") -> DataFrame:
    """`df` with member_email: the one that `emails` (repo_root, email) has for the row's repository, else the one set for all, else unknown.

    Rows without a repository, null or blank, have the one for all. A repository that is
    listed more than once has the smallest of its addresses, so no row is doubled.
    """
    known = emails.filter(F.trim("email") != "").groupBy(F.trim("repo_root").alias("_repo")).agg(F.min("email").alias("_email"))
    rows = df.drop("member_email").withColumn("_repo", F.nullif(F.trim(repo_root), F.lit("")))
    return rows.join(known, "_repo", "left").withColumn("member_email", F.coalesce("_email", F.lit(everywhere), F.lit(UNKNOWN))).drop("_repo", "_email")
