"""Change feeds: debounced file events, and a stream-static check of the files that changed.

The watcher's trailing debounce is a session window. Windows over event time with a watermark are an extension: the batch
form below and the stream give the same sessions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.operators.families import import_violations
from girder.sources.files import EXTENSIONS, SKIPPED


def is_relevant(path: Column, manifests: tuple[str, ...] = ("architecture.yaml", "architecture.yml", "architecture.json")) -> Column:
    """Manifests, ledgers and known source files outside of skipped folders."""
    skip = "(^|/)(" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + ")(/|$)"
    ext = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    return ~path.rlike(skip) & (ext.isin(*EXTENSIONS) | F.substring_index(path, "/", -1).isin(*manifests) | path.rlike(r"(^|/)\.?ledgers/.*\.json$"))


def sessions(events: DataFrame, gap: str, keys: list[str], path: str = "path", ts: str = "ts", late: str | None = None) -> DataFrame:
    """Groups of events no further apart than the gap, with their distinct paths in order. Works on batches and streams."""
    rows = events.withWatermark(ts, late) if events.isStreaming and late else events
    grouped = rows.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("n"), F.sort_array(F.collect_set(path)).alias("paths"))
    return grouped.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n", "paths")


def checked(changes: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations of changed edges against static rules, micro-batch by micro-batch."""
    return import_violations(changes, rules)


def each_batch(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "150 milliseconds"):
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
