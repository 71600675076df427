"""Commits as tables: `commits` (sha, ord, at, path) has one row for each file that a commit touched, oldest first by ord;
`snapshots` (sha, path, text) has the files of each commit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.plans.patterns import any_match


def commits_touching(commits: DataFrame, patterns: Column) -> DataFrame:
    """(sha, ord, files): the commits that touch a path of the patterns, with those files in order."""
    own = commits.filter(any_match(patterns, F.col("path")))
    return own.groupBy("sha", "ord").agg(F.array_sort(F.collect_set("path")).alias("files"))


def tree_at(snapshots: DataFrame, sha: str) -> DataFrame:
    """(path, text) of one commit; with the table partitioned by sha, only its folder is read."""
    return snapshots.filter(F.col("sha") == sha).select("path", "text")


def text_at(snapshots: DataFrame, sha: str, path: str) -> DataFrame:
    return tree_at(snapshots, sha).filter(F.col("path") == path).select("text")


def as_of(commits: DataFrame, versions: DataFrame, keys: list[str]) -> DataFrame:
    """Each commit (sha, ord) with the last version (keys, ord, more) that was written at or before it, for every key.

    Versions and commits are put in one order and the last version is carried forward, so nothing is compared pair by pair; a
    key's rows are its versions and one row a commit.
    """
    more = [c for c in versions.columns if c not in (*keys, "ord")]
    marks = commits.select("sha", "ord").distinct()
    held = versions.groupBy(*keys).agg(F.min("ord").alias("__from"))
    asked = held.join(F.broadcast(marks), F.col("__from") <= F.col("ord")).select(*keys, "ord", "sha", F.lit(1).alias("__last"), F.lit(None).cast(versions.select(F.struct(*more).alias("s")).schema["s"].dataType).alias("__v"))
    told = versions.select(*keys, "ord", F.lit(None).cast("string").alias("sha"), F.lit(0).alias("__last"), F.struct(*more).alias("__v"))
    carried = Window.partitionBy(*keys).orderBy("ord", "__last").rowsBetween(Window.unboundedPreceding, 0)
    out = told.unionByName(asked).withColumn("__v", F.last("__v", ignorenulls=True).over(carried)).filter("__last = 1")
    return out.select("sha", *keys, *(F.col(f"__v.{c}").alias(c) for c in more))
