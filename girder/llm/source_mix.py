"""Operator 7: mixing sources to target weights by systematic sampling.

Within a source every document expects `target / source size` copies. The expectations are summed up in a fixed order, one
random offset is added, and a document is emitted once for each whole number that its step crosses. The order runs by size,
so the copies spread evenly over short and long documents and the words taken come near the target.

The prefix sum is built from blocks: a source is cut by the binary order of size and a hash of the id, block sums are added
up over the small block table, and a window runs inside each block alone. So a source with a third of all rows is no hot
task, and only ids and sizes are shuffled.

Defined results: a null text has size 0; a null source is a source of its own, ordered last; documents of size 0 are never
taken; an empty table gives an empty result; repeated rows count as documents of their own; the offset comes from `seed` and
the source's name, so reruns agree. Extra columns are kept by `mix`; helper columns carry a prefix of two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.llm.common import WORD, stash

WEIGHTS = (5, 2, 1)
CAP = 3  # no source or document is taken more often
SALT = 64  # hash buckets in which a source's documents of one binary order of size are kept


#: DuckDB SQL for `taken` over the table documents, with the parameters above.
SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM d GROUP BY source),
f AS (SELECT *, 3 * source_size / weight AS ratio FROM s),
c AS (SELECT l.ratio, coalesce(sum(3 * g.source_size) FILTER (g.ratio <= l.ratio), 0) AS filled, coalesce(sum(g.weight) FILTER (g.ratio > l.ratio), 0) AS open_weight
  FROM (SELECT ratio FROM f UNION SELECT -1.0) AS l, f AS g GROUP BY l.ratio),
b AS (SELECT arg_min(((SELECT sum(source_size) FROM s) - filled)::DOUBLE / open_weight, ratio) AS share FROM c
  WHERE open_weight > 0 AND ((SELECT sum(source_size) FROM s) - filled)::DOUBLE / open_weight < (SELECT min(ratio) FROM f WHERE f.ratio > c.ratio)),
t AS (SELECT source, source_size, least(weight * coalesce((SELECT share FROM b), 1e300), (3 * source_size)::DOUBLE) AS target FROM s),
k AS (SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ((md5_number_lower(coalesce(d.source, '') || '/7') % 1073741824)::DOUBLE / 1073741824.0) AS shift,
    length(bin(size)) - 1 AS b, (md5_number_lower(doc_id::VARCHAR || '/7') % 64)::INT AS salt
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY 4 * b + (((size << 2) >> b) & 3), salt, size, doc_id) AS n FROM k WHERE size > 0)
SELECT doc_id, size, source_size, target, (size * least(3, floor(n * rate + shift) - floor((n - 1) * rate + shift)))::BIGINT AS taken FROM r
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM k WHERE size = 0
"""


def lower_md5(text: Column) -> Column:
    """The lower 32 bits of an MD5's lower half, read as a little-endian number."""
    digits = F.md5(text.cast("binary"))
    return F.conv(F.concat(*(F.substring(digits, 17 + 2 * k, 2) for k in (3, 2, 1, 0))), 16, 10).cast("long")


def n_words(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """`source, source_size` with the target of each: shares of the whole by weight, capped, the excess reshared by weight.

    One pass per round of resharing runs over the source table; only two sums of it reach the driver.
    """
    # a source's weight repeats by its rank; ranks come from range blocks so that no window holds the whole table
    ordered = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    key = F.coalesce(F.substring(F.hex(F.col("source")), 1, 4), F.lit("~"))
    ranked = stash(ordered.withColumn("__block", key))
    by_block = Window.orderBy("__block")
    before = ranked.groupBy("__block").agg(F.count("*").alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__block").orderBy(F.hex("source"))) - 1
    rank = (F.col("__before") + inside) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank + 1).cast("int"))
    table = stash(ranked.join(before, "__block").select("source", "source_size", weight.alias("weight")))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    share, left = 0.0, -1
    limit = F.col("source_size") * F.lit(cap)
    while True:
        free = F.col("weight") * F.lit(share) < limit
        full, open_weight, n = table.agg(F.sum(F.when(~free, limit).otherwise(0)), F.sum(F.when(free, F.col("weight")).otherwise(0.0)), F.count_if(free)).first()
        if not n or n == left or not total:
            break
        share, left = (total - full) / open_weight, n
    value = F.least(F.col("weight") * F.lit(share), limit.cast("double"))
    return table.select("source", "source_size", value.alias("target"))


def drawn(sizes: DataFrame, seed: int = 7, salt: int = SALT) -> DataFrame:
    """`sizes` (source, size, __id and any more) with source_size, target and copies."""
    table = targets(sizes)
    same = F.col("__s").eqNullSafe(F.col("source"))
    # quarters of the binary order of size
    order = F.expr("CASE WHEN size > 0 THEN 4 * (length(bin(size)) - 1) + ((shiftleft(size, 2) >> (length(bin(size)) - 1)) & 3) ELSE -1 END").cast("int")
    with_rate = sizes.withColumn("__order", order).withColumn("__salt", F.pmod(lower_md5(F.concat_ws("/", F.col("__id").cast("string"), F.lit(str(seed)))), F.lit(salt)).cast("int"))
    blocks = with_rate.groupBy("source", "__order", "__salt").agg(F.count("*").alias("__n"))
    walk = Window.partitionBy("source").orderBy("__order", "__salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(F.col("source").alias("__s"), F.col("__order").alias("__o"), F.col("__salt").alias("__t"), F.coalesce(F.sum(F.when(F.col("__order") >= 0, F.col("__n"))).over(walk), F.lit(0)).alias("__before"))
    starts = starts.join(F.broadcast(table) if table.count() <= 10_000 else table, F.col("__s").eqNullSafe(F.col("source"))).drop("source")
    inside = Window.partitionBy("source", "__order", "__salt").orderBy("size", "__id").rowsBetween(Window.unboundedPreceding, 0)
    ranked = with_rate.withColumn("__k", F.row_number().over(inside)).join(starts, same & (F.col("__order") == F.col("__o")) & (F.col("__salt") == F.col("__t")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = F.pmod(lower_md5(F.concat_ws("/", F.coalesce("source", F.lit("")), F.lit(str(seed)))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    upto = lambda k: F.floor(k * rate + offset)
    k = F.col("__before") + F.col("__k")
    copies = F.when(F.col("size") > 0, F.least(F.lit(CAP), upto(k) - upto(k - 1))).otherwise(0).cast("int")
    return ranked.withColumn("copies", copies).drop("__s", "__o", "__t", "__before", "__k", "__order", "__salt")


def taken(documents: DataFrame, seed: int = 7) -> DataFrame:
    """Per document: doc_id, size, source_size, target (its source's) and taken, the words that the mix takes."""
    sizes = documents.select("doc_id", F.col("source"), n_words().alias("size"), F.col("doc_id").alias("__id"))
    return drawn(stash(sizes), seed).select("doc_id", "size", F.col("source_size").cast("long"), "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def mix(documents: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of `documents`, each as often as it was drawn, with the input's columns.

    The draw runs on ids and sizes alone; its counts are joined back by id, source and a hash of the text (rows that agree in
    all three share one draw and count together).
    """
    names = documents.columns
    keyed = documents.withColumn("__text", F.xxhash64("text"))
    sizes = keyed.select("doc_id", "source", "__text", n_words().alias("size")).groupBy("doc_id", "source", "__text").agg(F.sum("size").alias("size")).withColumn("__id", F.struct("doc_id", "__text"))
    counts = drawn(stash(sizes), seed).filter("copies > 0").select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("__text").alias("__t"), "copies")
    on = F.col("doc_id").eqNullSafe(F.col("__d")) & F.col("source").eqNullSafe(F.col("__s")) & (F.col("__text") == F.col("__t"))
    repeated = keyed.join(counts.withColumnRenamed("copies", "__copies"), on).withColumn("__each", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return repeated.select(*names)
