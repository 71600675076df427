"""Measures of a policy against its tree: coverage, residue, vacancy, slack, limits, baselines, scalars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.text import ancestors, basename, dirname, round_measure
from girder.operators.families import fingerprint, governed_files, kept, matched, rules_selecting
from girder.plans.patterns import any_match, substituted, to_java

# Fixed value: the file pattern of a folder rule that admits any name.
OPEN_LAYOUT = r"^.*$"


def counted_files(files: DataFrame, outside: Column) -> DataFrame:
    return files.filter(~any_match(outside, F.col("path")))


def is_allowlist() -> Column:
    """An allowlist names no target and some exceptions; one of externals alone reports, but bounds no file."""
    return (F.size("to") == 0) & (F.size("to_not") > 0)


def reach_of(files: DataFrame, imports: DataFrame | None = None, folders: DataFrame | None = None, members: DataFrame | None = None, surface: DataFrame | None = None, graph: DataFrame | None = None) -> DataFrame:
    """path, imports, structure (enumerated, open or null), members, surface, graph: which families reach each file."""
    out = files.select("path")
    hits = []
    for name, rules in (("imports", imports.filter(is_allowlist()) if imports is not None else None), ("members", members), ("surface", surface)):
        if rules is not None:
            hits.append(rules_selecting(out, rules).select("path", F.lit(name).alias("family")))
    if graph is not None:
        inside = any_match(F.col("within"), F.col("path")) & ~any_match(F.col("within_not"), F.col("path"))
        hits.append(matched(out, graph, inside).select("path", F.lit("graph").alias("family")))
    if hits:
        flags = reduce(DataFrame.unionByName, hits).groupBy("path").agg(*(F.bool_or(F.col("family") == n).alias(n) for n in ("imports", "members", "surface", "graph")))
        out = out.join(flags, "path", "left")
    else:
        out = out.withColumns({n: F.lit(None).cast("boolean") for n in ("imports", "members", "surface", "graph")})
    if folders is not None:
        opened = governed_files(files, folders).groupBy("path").agg(F.bool_and(F.array_contains("files", to_java(OPEN_LAYOUT))).alias("all_open"))
        out = out.join(opened, "path", "left").withColumn("structure", F.when(F.col("all_open"), "open").when(~F.col("all_open"), "enumerated"))
    else:
        out = out.withColumn("structure", F.lit(None).cast("string"))
    return out.select("path", *(F.coalesce(n, F.lit(False)).alias(n) for n in ("imports", "members", "surface", "graph")), "structure")


def fraction(covered: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(1.0)).otherwise(covered / total)


def coverage_of(reach: DataFrame) -> DataFrame:
    """family, covered, total, share."""
    counts = reach.agg(*(F.count_if(n).alias(n) for n in ("imports", "members", "surface", "graph")), F.count_if(F.col("structure") == "enumerated").alias("structure"), F.count("*").alias("total"))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("family"), F.col(n).alias("covered")) for n in ("graph", "imports", "members", "structure", "surface"))))
    return counts.select(each.alias("x"), "total").select("x.family", "x.covered", "total", fraction(F.col("x.covered"), F.col("total")).alias("share"))


def residue_files(reach: DataFrame) -> DataFrame:
    """Files no family polices; a file in an open folder alone is one."""
    return reach.filter(~F.col("imports") & ~F.coalesce(F.col("structure") == "enumerated", F.lit(False)) & ~F.col("members") & ~F.col("surface") & ~F.col("graph")).select("path")


def folders_wholly_in(subset: DataFrame, files: DataFrame) -> DataFrame:
    """The topmost folders all of whose files are in the subset."""
    count = lambda df, n: df.select(F.explode(ancestors(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count("*").alias(n))
    whole = count(files, "walked").join(count(subset, "own"), "folder").filter("walked = own").select("folder")
    above = whole.select("folder", F.explode_outer(ancestors(F.col("folder"))).alias("above"))
    nested = above.join(whole.select(F.col("folder").alias("above")), "above", "left_semi").select("folder")
    return whole.join(nested, "folder", "left_anti")


def vacant_nodes(files: DataFrame, rules: DataFrame, allowances: DataFrame) -> DataFrame:
    """node, allowances: nodes none of whose carrying rules selects a file, with the distinct entries they wrote."""
    live = rules_selecting(files, rules).select("ord").distinct().withColumn("live", F.lit(True))
    carried = allowances.join(live, "ord", "left")
    return carried.groupBy("node").agg(F.bool_or(F.coalesce("live", F.lit(False))).alias("live"), F.count_distinct("allow_kind", "entry").alias("allowances")).filter("not live").select("node", "allowances")


def slack_of(files: DataFrame, edges: DataFrame, rules: DataFrame, allowances: DataFrame) -> DataFrame:
    """place, is_fragment, allow_kind, entry, used_at, of: one row for each entry as one place wrote it, vacant nodes left out.

    An entry is slack where used_at is 0; one of a fragment is concentrated where fewer nodes use it than hold it.
    """
    vacant = vacant_nodes(files, rules, allowances).select("node")
    held = allowances.join(vacant, "node", "left_anti")
    selected = rules_selecting(edges, rules).select("ord", "captures", "target_path", "target_kind", "target_package")
    external = (F.col("allow_kind") == "external") & (F.col("target_kind") == "external") & (F.col("target_package") == F.col("entry"))
    allowed = (F.col("allow_kind") == "allow") & F.col("pattern").isNotNull() & any_match(substituted(F.array("pattern"), F.col("captures")), F.col("target_path"))
    used = kept(selected.join(F.broadcast(allowances), "ord"), F.coalesce(external, F.lit(False)) | allowed).select("node", "allow_kind", "entry").distinct().withColumn("used", F.lit(True))
    rows = held.select("node", "allow_kind", "entry", "fragment").distinct().join(used, ["node", "allow_kind", "entry"], "left")
    return rows.groupBy(F.coalesce("fragment", "node").alias("place"), F.col("fragment").isNotNull().alias("is_fragment"), "allow_kind", "entry").agg(F.count_distinct(F.when(F.col("used"), F.col("node"))).alias("used_at"), F.count_distinct("node").alias("of"))


def is_concentrated() -> Column:
    """Used at less than half of the nodes that hold it."""
    return F.col("used_at") * 2 < F.col("of")


def standing(direction: Column, limit: Column, tolerance: Column, value: Column) -> Column:
    """within, breached (worse than the limit by more than the tolerance) or surpassed; NaN compares as false."""
    worse = F.when(direction == "down", value - limit).otherwise(limit - value)
    known = ~F.isnan(worse)
    return F.when(known & (worse > tolerance), "breached").when(known & (-worse > tolerance), "surpassed").otherwise("within")


def shortfalls(coverage: DataFrame, floors: dict[str, float]) -> DataFrame:
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in floors.items() for x in kv)), F.col("family"))
    rows = coverage.filter(F.col("family").isin(*floors)).withColumn("floor", limit)
    return rows.filter(standing(F.lit("up"), F.col("floor"), F.lit(0.0), F.col("share")) == "breached").select("family", F.col("share").alias("actual"), "floor")


def overruns(counts: DataFrame, ceilings: dict[str, float]) -> DataFrame:
    """counts: measure, value; rows above their ceilings."""
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in ceilings.items() for x in kv)), F.col("measure"))
    return counts.filter(F.col("measure").isin(*ceilings)).withColumn("ceiling", limit).filter(standing(F.lit("down"), F.col("ceiling"), F.lit(0.0), F.col("value").cast("double")) == "breached")


# -- baselines ---------------------------------------------------------------------------------------------------------


def baseline_of(found: DataFrame) -> DataFrame:
    return found.select(fingerprint().alias("entry")).distinct()


def unbaselined(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Violations, repeats included, that the baseline does not hold."""
    keyed = found.withColumn("entry", fingerprint())
    return keyed.join(baseline.select("entry").distinct(), "entry", "left_anti").select("entry", *found.columns)


def stale_entries(found: DataFrame, baseline: DataFrame) -> DataFrame:
    return baseline.select("entry").distinct().join(baseline_of(found), "entry", "left_anti")


def flagged(found: DataFrame, baseline: DataFrame) -> DataFrame:
    keyed = found.withColumn("entry", fingerprint())
    known = baseline.select("entry").distinct().withColumn("baselined", F.lit(True))
    return keyed.join(known, "entry", "left").withColumn("baselined", F.coalesce("baselined", F.lit(False)))


# -- scalars -----------------------------------------------------------------------------------------------------------


def value_of_parts(of: Column, per: Column, ratio: Column, scale: Column) -> Column:
    """A sum, or a scaled ratio that is 0 over nothing unless the parts did not measure."""
    share = F.when((per == 0) & ~F.isnan(of), F.lit(0.0)).otherwise(scale * of / F.nullif(per, F.lit(0.0)))
    return round_measure(F.when(ratio, F.coalesce(share, F.lit(float("nan")))).otherwise(of))


def distance_to_target(direction: Column, target: Column, value: Column) -> Column:
    """0 without a target, 1 for what did not measure, else what is still to go."""
    gap = F.when(direction == "down", value - target).otherwise(target - value)
    return F.when(target.isNull(), F.lit(0.0)).when(F.isnan(value), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), round_measure(gap)))


def governing_names(files: DataFrame) -> DataFrame:
    return files.select("path", dirname(F.col("path")).alias("folder"), basename(F.col("path")).alias("name"))
