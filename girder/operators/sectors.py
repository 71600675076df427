"""Sectors of a campaign: what its perimeter claims, where every file stands, and the sector of a hit."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.text import dirname, without_extension
from girder.operators.campaigns import below
from girder.plans.patterns import any_match

# The names of sectors that no perimeter makes.
IMPLICIT, LEGACY, SHARED = "scope", "legacy", "shared"


@dataclass
class Perimeter:
    """kind: none, file, glob, marker, match or project.

    glob: `patterns`, regular expressions of a sector's prefix, the first that matches counts. marker: `rows` of (marker, sector,
    owns), where owns are structs of a regular expression and the folder it starts in, or none. match: `rows` of (path, anchor).
    project: `rows` of (sector, root).
    """

    kind: str = "none"
    patterns: list[str] = field(default_factory=list)
    rows: DataFrame | None = None


@dataclass
class Sectors:
    """claims (path, sector, claim_ord); files (path, sector, drift): the placed ones; names (sector, roots)."""

    claims: DataFrame
    files: DataFrame
    names: DataFrame


def _patterns(patterns: list[str]) -> Column:
    return F.array(*map(F.lit, patterns)) if patterns else F.array().cast("array<string>")


def under(root: Column, path: Column) -> Column:
    return (root == "") | (path == root) | path.startswith(F.concat(root, F.lit("/")))


def root_of(roots: Column, path: Column) -> Column:
    """The first of a sector's roots that holds the path; the repository if none does."""
    return F.coalesce(F.get(F.filter(roots, lambda r: under(r, path)), F.lit(0)), F.lit(""))


def claims(files: DataFrame, perimeter: Perimeter) -> DataFrame:
    """(path, sector, roots, claim_ord): what the perimeter claims of the files (path); a file may be claimed more than once.

    Files meet folders by equality on their exploded ancestors, and a marker's own patterns only where their fixed folder fits.
    """
    path = F.col("path")
    row = lambda df, sector, roots, order: df.select("path", sector.alias("sector"), roots.alias("roots"), order.cast("string").alias("claim_ord"))
    if perimeter.kind == "none":
        return row(files, F.lit(IMPLICIT), F.array(F.lit("")), F.lit("0"))
    if perimeter.kind == "file":
        return row(files, without_extension(path), F.array(dirname(path)), F.lit("0"))
    if perimeter.kind == "glob":
        named = F.coalesce(*(F.when(path.rlike(p), F.regexp_replace(F.regexp_extract(path, p, 0), "/$", "")) for p in perimeter.patterns))
        return row(files.withColumn("__s", named).filter("__s is not null"), F.col("__s"), F.array("__s"), F.lit("0"))
    if perimeter.kind == "match":
        own = files.join(perimeter.rows.select("path", "anchor").distinct(), "path")
        return row(own, F.concat("path", F.lit("#"), "anchor"), F.array(dirname(path)), F.col("anchor"))
    if perimeter.kind == "project":
        return row(below(files, perimeter.rows.select("sector", "root")), F.col("sector"), F.array("root"), F.col("sector"))
    if perimeter.kind != "marker":
        raise ValueError(f"no perimeter is called {perimeter.kind}")
    folder = dirname(F.col("marker"))
    named = perimeter.rows.select("marker", "sector", "owns", F.array_distinct(F.concat(F.array(folder), F.transform("owns", lambda o: o["root"]))).alias("roots"))
    whole = below(files, named.filter(F.size("owns") == 0).withColumn("root", folder)).select("path", "sector", "roots", "marker")
    starts = named.select("marker", "sector", "roots", F.explode("owns").alias("own")).select("marker", "sector", "roots", "own.pattern", "own.root")
    some = below(files, starts).filter(F.call_function("rlike", path, F.col("pattern"))).select("path", "sector", "roots", "marker")
    self_ = files.join(named.withColumn("path", F.col("marker")), "path").select("path", "sector", "roots", "marker")
    every = reduce(DataFrame.unionByName, (whole, some, self_)).distinct()
    return row(every, F.col("sector"), F.col("roots"), F.col("marker"))


def discovered(files: DataFrame, perimeter: Perimeter, shared: list[str] | None = None, legacy: list[str] | None = None, scope: list[str] | None = None) -> Sectors:
    """Every file in its sector. Shared files come out first; a file's first claim counts, and claims of two sectors are drift;
    an unclaimed file is legacy where the patterns allow it, and anywhere without patterns. Files out of scope are in none."""
    path = F.col("path")
    seen = files.select("path").filter(any_match(_patterns(scope), path)) if scope is not None else files.select("path")
    is_shared = any_match(_patterns(shared), path) if shared is not None else F.lit(False)
    claimed = claims(seen.filter(~is_shared), perimeter)
    first = claimed.groupBy("path").agg(F.min_by("sector", F.struct("claim_ord", "sector")).alias("claimed"), (F.count_distinct("sector") > 1).alias("drift"))
    in_legacy = F.lit(True) if legacy is None else any_match(_patterns(legacy), path)
    sector = F.when(is_shared, F.lit(SHARED)).otherwise(F.coalesce("claimed", F.when(in_legacy, F.lit(LEGACY))))
    placed = seen.join(first, "path", "left").select("path", sector.alias("sector"), F.coalesce("drift", F.lit(False)).alias("drift")).filter("sector is not null")
    in_order = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_set(F.struct("claim_ord", "roots"))), lambda c: c["roots"])))
    names = claimed.groupBy("sector").agg(in_order.alias("roots"))
    rest = placed.filter(F.col("sector") == LEGACY).select("sector").distinct()
    if shared is not None:
        rest = rest.unionByName(files.sparkSession.createDataFrame([(SHARED,)], "sector string"))
    return Sectors(claimed.select("path", "sector", "claim_ord"), placed, names.unionByName(rest.withColumn("roots", F.array(F.lit("")))))


def membership(path: str, files: DataFrame, perimeter: Perimeter, shared: list[str] | None = None, legacy: list[str] | None = None, scope: list[str] | None = None) -> DataFrame:
    """(path, sector, root) of one file, for a host that sees one at a time; no row for a file in no sector."""
    sectors = discovered(files.filter(F.col("path") == path), perimeter, shared, legacy, scope)
    return sectors.files.join(sectors.names, "sector").select("path", "sector", root_of(F.col("roots"), F.col("path")).alias("root"))


def hit_sectors(hits: DataFrame, sectors: Sectors, perimeter: Perimeter, legacy: list[str] | None = None) -> DataFrame:
    """hits (path, subject, more) with `sector` and `root`; hits in no sector go. Where declarations are sectors, the one that the
    subject names counts, else the file's only one, else legacy."""
    at = hits.join(sectors.files.select("path", "sector"), "path")
    if perimeter.kind == "match":
        own = sectors.claims.select("path", F.col("sector").alias("__named"), F.lit(True).alias("__own")).distinct()
        alone = own.groupBy("path").agg(F.count("*").alias("__n"))
        at = at.withColumn("__named", F.concat("path", F.lit("#"), F.substring_index("subject", "#", 1))).join(own, ["path", "__named"], "left").join(alone, "path", "left")
        in_legacy = F.lit(True) if legacy is None else any_match(_patterns(legacy), F.col("path"))
        chosen = F.when(F.col("sector") == SHARED, F.col("sector")).when(F.col("__own"), F.col("__named")).when(F.col("__n") == 1, F.col("sector")).when(in_legacy, F.lit(LEGACY))
        at = at.withColumn("sector", chosen).filter("sector is not null").drop("__named", "__own", "__n")
    return at.join(sectors.names, "sector").withColumn("root", root_of(F.col("roots"), F.col("path"))).drop("roots")


def lacking(sectors: Sectors, found: DataFrame) -> DataFrame:
    """(sector): those none of whose files is among `found` (path)."""
    have = sectors.files.join(found.select("path").distinct(), "path", "left_semi").select("sector").distinct()
    return sectors.names.select("sector").join(have, "sector", "left_anti")


def spread_out(sectors: Sectors) -> DataFrame:
    """(sector): those with a file outside of their first root."""
    first = sectors.names.select("sector", F.get("roots", F.lit(0)).alias("root"))
    return sectors.files.join(first, "sector").filter(~under(F.col("root"), F.col("path"))).select("sector").distinct()


def off_host(sectors: Sectors, hosts: list[str]) -> DataFrame:
    """(sector): those with a file that no host's pattern matches."""
    return sectors.files.filter(~any_match(_patterns(hosts), F.col("path"))).select("sector").distinct()
