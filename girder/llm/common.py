"""Helpers shared by the operators: table reading, joins with hot keys, what Python workers hold."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.lineage import settled as stash  # noqa: F401

#: A word, as the contracts state it: a run of bytes other than space and \t..\r.
WORD = r"[^\x20\x09-\x0D]+"


BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it while a column of `df` bears it (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


_holder: list[tuple[str, Callable[[], None] | None]] = []


def holding(name: str, clear: Callable[[], None] | None = None) -> None:
    """Called where an operator's work begins in a Python worker, which Spark reuses for later stages: what another operator
    left there (vocabularies, tables of results) is dropped first, so stages don't add up in memory."""
    if _holder and _holder[0][0] != name:
        _, drop = _holder.pop()
        if drop:
            drop()
            gc.collect()
    if not _holder:
        _holder.append((name, clear))


HOT, MOST_HOT = 10_000, 200_000  # rows that make a key hot, and how many hot keys are broadcast


def spread_join(big: DataFrame, small: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """big.join(small, key) for a `small` with one row a key, where one key may hold a large share of `big`.

    Rows of hot keys stay where they are and meet `small` by broadcast. `hot` holds these keys, by default those with over HOT
    rows, of which there are few beside the rows. They are counted first; beyond MOST_HOT nothing is broadcast, and the join is
    left to Spark, which splits skewed partitions.
    """
    keys = big.groupBy(key).count().filter(F.col("count") > HOT) if hot is None else hot
    keys = stash(keys.select(F.col(key).alias("__hot")))
    n = keys.limit(MOST_HOT + 1).count()
    if not 0 < n <= MOST_HOT:
        return big.join(small, key)
    on = F.col(key) == F.col("__hot")
    rest = big.join(F.broadcast(keys), on, "left_anti").join(small, key)
    return rest.unionByName(big.join(F.broadcast(small.join(F.broadcast(keys), on, "left_semi")), key))


def bounded_batches(df: DataFrame) -> DataFrame:
    """`df`, after its session was told to hand Python at most BATCH_ROWS rows or BATCH_BYTES bytes at once.

    Texts are long: ten thousand of them, Spark's default, take a few hundred MB of Arrow buffers and Python objects in each
    task. The plan is lazy, so the setting has to outlast this call; it stays for the session, and a user's smaller one stays.
    """
    conf = df.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{key}").rstrip("b")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return df
