"""Detectors: a tree of all / any / not over leaf terms, compiled to Columns over candidates.

A unit is a file, a declaration or a match. At the file unit every term is existential and the tree is one boolean. At the
other units the candidates come from the leaves that were evaluated: leaves run cheapest first, and an `all` stops at a
file-level child that fails, so leaves behind it are not evaluated and source no candidates. That is kept here as one
`evaluated` column a leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions.text import base_of, basename, dirname, resolved
from girder.plans.patterns import any_match, compiled, to_java

# Fixed value: leaves from cheap to expensive.
COST = ("path", "imports", "exports", "members", "requires", "content", "syntax", "report", "fn")


@dataclass
class Term:
    """kind: all, any, not, or a leaf. A leaf that answers for declarations or matches has rows of its own."""

    kind: str
    terms: list[Term] = field(default_factory=list)
    file: list[str] = field(default_factory=list)
    file_not: list[str] = field(default_factory=list)
    pattern: str | None = None
    names: list[str] = field(default_factory=list)
    requires: list[str] = field(default_factory=list)
    rows: DataFrame | None = None  # path, key, anchor: what the leaf found (exports, members, syntax, report, fn, imports)
    level: str = "file"  # file, declaration or match

    def leaves(self) -> list[Term]:
        return [x for t in self.terms for x in t.leaves()] if self.terms else [self]


def all_of(*terms: Term) -> Term:
    return Term("all", list(terms))


def any_of(*terms: Term) -> Term:
    return Term("any", list(terms))


def none_of(term: Term) -> Term:
    return Term("not", [term])


def cost(term: Term) -> int:
    return max(COST.index(x.kind) for x in term.leaves())


def by_cost(terms: list[Term]) -> list[Term]:
    return sorted(terms, key=cost)


def is_file_level(term: Term, unit: str) -> bool:
    return unit == "file" or all(x.level == "file" for x in term.leaves())


def needs_syntax(term: Term) -> bool:
    return any(x.kind == "syntax" for x in term.leaves())


def _literal(patterns: list[str]) -> Column:
    return F.array(*map(F.lit, compiled("detector", "pattern", patterns))) if patterns else F.array().cast("array<string>")


def _file_answer(term: Term) -> Column:
    """Answer of a leaf that needs nothing but the file row (path, text)."""
    path = F.col("path")
    if term.kind == "path":
        ok = any_match(_literal(term.file), path) if term.file else F.lit(True)
        return ok & ~any_match(_literal(term.file_not), path)
    return F.coalesce(F.col("text").rlike(to_java(term.pattern, multiline=True)), F.lit(False))


def answers(files: DataFrame, term: Term, paths: DataFrame | None = None) -> tuple[DataFrame, dict[int, Column]]:
    """`files` with one boolean column for each leaf that holds somewhere in the file; leaves by identity."""
    out, columns = files, {}
    for i, leaf in enumerate(sorted(term.leaves(), key=lambda x: COST.index(x.kind))):
        name = f"__leaf{i}"
        if leaf.kind in ("path", "content"):
            out = out.withColumn(name, _file_answer(leaf))
        elif leaf.kind == "requires":
            sibling = F.transform(F.array(*map(F.lit, leaf.requires)), lambda t: resolved(dirname(F.col("path")), F.replace(t, F.lit("{base}"), base_of(basename(F.col("path"))))))
            wanted = files.select("path", F.explode(sibling).alias("s"))
            missing = wanted.join(paths.select(F.col("path").alias("s")), "s", "left_anti").select("path").distinct().withColumn(name, F.lit(False))
            out = out.join(missing, "path", "left").withColumn(name, F.coalesce(name, F.lit(True)))
        else:
            rows = leaf.rows.filter(any_match(_literal(leaf.names), F.col("key"))) if leaf.names and leaf.kind in ("exports", "members") else leaf.rows
            out = out.join(rows.select("path").distinct().withColumn(name, F.lit(True)), "path", "left").withColumn(name, F.coalesce(name, F.lit(False)))
        columns[id(leaf)] = F.col(name)
    return out, columns


def _judged(term: Term, of: dict[int, Column]) -> Column:
    if term.kind == "all":
        return reduce(lambda a, b: a & b, [_judged(t, of) for t in term.terms])
    if term.kind == "any":
        return reduce(lambda a, b: a | b, [_judged(t, of) for t in term.terms])
    if term.kind == "not":
        return ~_judged(term.terms[0], of)
    return of[id(term)]


def _prepared(term: Term, unit: str, of: dict[int, Column], live: Column, evaluated: dict[int, Column]) -> Column | None:
    """Marks when each leaf is evaluated (`live`: whether the walk gets here); the file-level verdict, if it has one.

    As in a first pass over the tree: null verdicts decide nothing, an `all` that fails ends its own walk with false.
    """
    if term.kind == "all":
        stopped = F.lit(False)
        for child in by_cost(term.terms):
            verdict = _prepared(child, unit, of, live & ~stopped, evaluated)
            if verdict is not None:
                stopped = stopped | F.coalesce(~verdict, F.lit(False))
        return F.when(stopped, F.lit(False))
    if term.kind == "any":
        held = F.lit(False)
        for child in by_cost(term.terms):
            verdict = _prepared(child, unit, of, live & ~held, evaluated)
            if verdict is not None and unit == "file":
                held = held | F.coalesce(verdict, F.lit(False))
        return F.when(held, F.lit(True))
    if term.kind == "not":
        verdict = _prepared(term.terms[0], unit, of, live, evaluated)
        return None if verdict is None else ~verdict
    evaluated[id(term)] = evaluated.get(id(term), F.lit(False)) | live
    return of[id(term)] if is_file_level(term, unit) else None


def file_hits(files: DataFrame, term: Term, paths: DataFrame | None = None) -> DataFrame:
    """Paths for which the detector holds at the file unit. File-level leaves filter before others are judged."""
    rows, of = answers(files, term, paths)
    return rows.filter(_judged(term, of)).select("path")


def candidates(files: DataFrame, term: Term, unit: str, paths: DataFrame | None = None) -> DataFrame:
    """(path, key, anchor): candidates of the declaration or match unit for which the detector holds."""
    rows, of = answers(files, term, paths)
    evaluated: dict[int, Column] = {}
    verdict = _prepared(term, unit, of, F.lit(True), evaluated)
    names = {id(leaf): f"__on{i}" for i, leaf in enumerate(term.leaves())}
    rows = rows.withColumns({names[k]: c for k, c in evaluated.items()})
    if verdict is not None:
        rows = rows.filter(F.coalesce(verdict, F.lit(True)))
    pools = []
    for leaf in term.leaves():
        if leaf.level == "file" or (unit == "match" and leaf.level == "declaration"):
            continue
        found = leaf.rows.filter(any_match(_literal(leaf.names), F.col("key"))) if leaf.names else leaf.rows
        if unit == "declaration" and leaf.level == "match":
            found = found.filter("anchor is not null").select("path", F.col("anchor").alias("key"), "anchor")
        live = rows.filter(F.col(names[id(leaf)])).select("path")
        pools.append(found.select("path", "key", "anchor").join(live, "path", "left_semi"))
    if not pools:
        return files.sparkSession.createDataFrame([], "path string, key string, anchor string")
    pool = reduce(DataFrame.unionByName, pools).groupBy("path", "key").agg(F.min("anchor").alias("anchor"))
    flags = rows.select("path", *[c for c in rows.columns if c.startswith("__leaf")])
    pool = pool.join(flags, "path")
    own: dict[int, Column] = dict(of)
    for i, leaf in enumerate(term.leaves()):
        if leaf.level == "file":
            continue
        found = leaf.rows.filter(any_match(_literal(leaf.names), F.col("key"))) if leaf.names else leaf.rows
        at = "anchor" if unit == "declaration" and leaf.level == "match" else "key"
        mine = "anchor" if unit == "match" and leaf.level == "declaration" else "key"
        mark = found.select(F.col("path").alias("__p"), F.col(at).alias("__k")).filter("__k is not null").distinct().withColumn(f"__own{i}", F.lit(True))
        pool = pool.join(mark, (F.col("path") == F.col("__p")) & (F.col(mine) == F.col("__k")), "left").drop("__p", "__k")
        own[id(leaf)] = F.coalesce(f"__own{i}", F.lit(False))
    return pool.filter(_judged(term, own)).select("path", "key", "anchor")


def truth_table(files: DataFrame, term: Term, paths: DataFrame | None = None) -> DataFrame:
    """(path, leaf, kind, holds): every leaf judged, nothing skipped."""
    rows, of = answers(files, term, paths)
    each = [F.struct(F.lit(i).alias("leaf"), F.lit(leaf.kind).alias("kind"), of[id(leaf)].alias("holds")) for i, leaf in enumerate(term.leaves())]
    return rows.select("path", F.explode(F.array(*each)).alias("x")).select("path", "x.leaf", "x.kind", "x.holds")


def unique_keys(rows: DataFrame, group: list[str], key: str, order: list[str]) -> DataFrame:
    """Equal keys numbered in source order: the second becomes key~2, the third key~3."""
    n = F.row_number().over(Window.partitionBy(*group, key).orderBy(*order))
    return rows.withColumn("unique_key", F.when(n > 1, F.concat(F.col(key), F.lit("~"), n)).otherwise(F.col(key)))


def innermost(positions: DataFrame, declared: DataFrame) -> DataFrame:
    """positions (path, line, col) with `anchor`: the name of the declaration that holds the place, null where none does.

    declared: path, ord, name, start_line, start_col, end_line, end_col, both ends included. Of several the one that starts last
    counts, of equal starts the later one. They meet by file, and each place keeps one row while it is aggregated.
    """
    at, start, end = F.struct("line", "col"), F.struct(F.col("start_line").alias("line"), F.col("start_col").alias("col")), F.struct(F.col("end_line").alias("line"), F.col("end_col").alias("col"))
    places = positions.select("path", "line", "col").distinct()
    inside = places.join(declared, "path").filter((start <= at) & (at <= end))
    found = inside.groupBy("path", "line", "col").agg(F.max_by("name", F.struct("start_line", "start_col", "ord")).alias("anchor"))
    return positions.join(found, ["path", "line", "col"], "left")
