"""Tool output as diagnostics (0-based positions), and unified diffs as hunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIELDS = ("file", "line", "col", "code", "message")


def _lines(df: DataFrame, text: str) -> DataFrame:
    return df.select("*", F.posexplode(F.split(text, "\r?\n")).alias("pos", "row"))


def first_line(text: Column) -> Column:
    return F.element_at(F.split(text, "\r?\n"), 1)


def tsc(df: DataFrame, text: str = "text") -> DataFrame:
    """`file(line,col): error TSn: message` lines."""
    pattern = r"^(.+?)\((\d+),(\d+)\): error (TS\d+): (.*)$"
    g = lambda i: F.regexp_extract("row", pattern, i)
    return _lines(df, text).filter(F.col("row").rlike(pattern)).select(g(1).alias("file"), (g(2).cast("int") - 1).alias("line"), (g(3).cast("int") - 1).alias("col"), g(4).alias("code"), g(5).alias("message"))


def eslint(df: DataFrame, text: str = "text") -> DataFrame:
    """A JSON array of files with messages."""
    schema = "array<struct<filePath:string,messages:array<struct<ruleId:string,line:int,column:int,message:string>>>>"
    files = df.select(F.explode(F.from_json(text, schema, {"mode": "FAILFAST"})).alias("f")).select(F.col("f.filePath").alias("file"), F.explode("f.messages").alias("m"))
    at = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)) - 1, F.lit(0))
    return files.select("file", at("m.line").alias("line"), at("m.column").alias("col"), F.coalesce("m.ruleId", F.lit("")).alias("code"), first_line(F.col("m.message")).alias("message"))


def oxlint(df: DataFrame, text: str = "text") -> DataFrame:
    """A JSON object with diagnostics and the span of their first label."""
    schema = "struct<diagnostics:array<struct<filename:string,code:string,message:string,labels:array<struct<span:struct<line:int,column:int>>>>>>"
    rows = df.select(F.explode(F.from_json(text, schema, {"mode": "FAILFAST"})["diagnostics"]).alias("d"))
    span = F.get("d.labels", F.lit(0))["span"]
    at = lambda c: F.greatest(F.coalesce(span[c], F.lit(1)) - 1, F.lit(0))
    return rows.select(F.col("d.filename").alias("file"), at("line").alias("line"), at("column").alias("col"), F.coalesce("d.code", F.lit("")).alias("code"), first_line(F.col("d.message")).alias("message"))


def by_regex(df: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Lines of any tool by a pattern with the groups file and line, and column, code and message where it has them."""
    names = re.findall(r"\((?!\?)|\(\?<([A-Za-z]\w*)>", pattern)
    at = {n: i + 1 for i, n in enumerate(names) if n}
    if not {"file", "line"} <= at.keys():
        raise ValueError("the pattern needs the groups file and line")
    g = lambda n: F.regexp_extract("row", pattern, at[n]) if n in at else F.lit("")
    col = F.when(g("column") != "", g("column").cast("int") - 1).otherwise(0)
    return _lines(df, text).filter(F.col("row").rlike(pattern)).select(g("file").alias("file"), (g("line").cast("int") - 1).alias("line"), col.alias("col"), g("code").alias("code"), g("message").alias("message"))


PARSERS = {"tsc": tsc, "eslint": eslint, "oxlint": oxlint}


def parsed(df: DataFrame, format: str, pattern: str | None = None) -> DataFrame:
    return by_regex(df, pattern) if format == "regex" else PARSERS[format](df)


def unique(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.dropDuplicates(list(FIELDS))


def diff(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(hunks, files) of `git diff -U0` texts: hunks (path, hunk_start, hunk_end), files (path, state deleted or added).

    A line belongs to the file whose header came last. A hunk that only deletes counts as the line it stands at; a deleted
    file has no hunks, an added one without any covers its first line.
    """
    rows = _lines(df.select(*keys, text), text).drop(text)
    order = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    header = r"^diff --git a/(.+?) b/(.+)$"
    path = F.when(F.col("row").rlike(header), F.regexp_extract("row", header, 2))
    rows = rows.withColumn("path", F.last(path, ignorenulls=True).over(order)).filter("path is not null").filter(~F.col("row").rlike(header))
    state = F.when(F.col("row").startswith("deleted file mode") | (F.col("row") == "+++ /dev/null"), "deleted").when(F.col("row").startswith("new file mode"), "added")
    states = rows.withColumn("state", state).filter("state is not null").select(*keys, "path", "state").distinct()
    pattern = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    start = F.regexp_extract("row", pattern, 1).cast("long")
    count = F.when(F.regexp_extract("row", pattern, 2) == "", 1).otherwise(F.regexp_extract("row", pattern, 2).cast("long"))
    by = [*keys, "path"]
    found = rows.filter(F.col("row").rlike(pattern)).join(states.filter("state = 'deleted'").select(*by), by, "left_anti")
    hunks = found.select(*by, start.alias("hunk_start"), F.greatest(start, start + count - 1).alias("hunk_end"))
    one = F.lit(1).cast("long")
    bare = states.filter("state = 'added'").select(*by).join(hunks.select(*by), by, "left_anti").select(*by, one.alias("hunk_start"), one.alias("hunk_end"))
    return hunks.unionByName(bare), states


def with_untracked(hunks: DataFrame, paths: DataFrame) -> DataFrame:
    """Untracked files count as touched whole."""
    return hunks.select("path", "hunk_start", "hunk_end").unionByName(paths.select("path", F.lit(1).cast("long").alias("hunk_start"), F.lit((1 << 53) - 1).cast("long").alias("hunk_end")))
