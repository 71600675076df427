"""The policy's families: imports, exports, members, surface, structure. Each is facts joined with a broadcast rule table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.functions.text import base_of, basename, dirname, resolved
from girder.plans.patterns import any_match, captures, reportable

MOST_LITERAL = 500  # patterns of one rule table that are written into a plan
VIOLATION = ("kind", "rule_name", "message", "file", "subject")


def fingerprint() -> Column:
    """Identity of a violation that no edit of a file's lines changes."""
    return F.concat_ws("|", "kind", "rule_name", "file", F.coalesce("subject", F.lit("")))


def formatted() -> Column:
    return F.concat(F.lit("["), F.col("rule_name"), F.lit("] "), F.replace(F.col("message"), F.lit("{name}"), F.coalesce("subject", F.lit("{name}"))))


def violations(rows: DataFrame, kind: str, file: Column, subject: Column) -> DataFrame:
    return rows.select(F.lit(kind).alias("kind"), F.col("name").alias("rule_name"), "message", file.alias("file"), subject.cast("string").alias("subject"))


def kept(rows: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition holds, judged above everything that was planned so far.

    The condition becomes the output of a generator, which the optimizer does not look through: it would otherwise copy
    pattern expressions into joins and infer filters from them for one side, where the path is not known.
    """
    return rows.withColumn("__hit", F.explode(F.array(condition))).filter("__hit").drop("__hit")


def matched(files: DataFrame, rules: DataFrame, condition: Column) -> DataFrame:
    """Files with the rules that the condition pairs them with; the rule table is small by construction, and broadcast."""
    return kept(files.crossJoin(F.broadcast(rules)), condition)


def rules_selecting(files: DataFrame, rules: DataFrame, path: str = "path") -> DataFrame:
    """Files with each rule that selects them and its captures. A file that no rule selects is gone before any facts are
    joined, so its imports are never resolved.

    Rules come from the driver and are few; up to MOST_LITERAL patterns are written into the plan, where each is compiled once a
    task. As values of a column they would be compiled again for nearly every row.
    """
    caught = captures(F.col("from_"), F.col("groups"), F.col("from_not"), F.col(path))
    listed = rules.select("ord", "from_", "from_not").collect()
    if sum(len(r["from_"]) + len(r["from_not"]) for r in listed) <= MOST_LITERAL:
        found = lambda patterns: reduce(Column.__or__, (F.col(path).rlike(p) for p in patterns), F.lit(False))
        chosen = F.array_compact(F.array(*(F.when(found(r["from_"]) & ~found(r["from_not"]), F.lit(r["ord"])) for r in listed)))
        selected = files.withColumn("ord", F.explode(chosen)).join(F.broadcast(rules), "ord")
    else:
        selected = matched(files, rules, any_match(F.col("from_"), F.col(path)) & ~any_match(F.col("from_not"), F.col(path)))
    return selected.withColumn("captures", F.explode(F.array(caught)))


def import_violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """edges: path, target_path, target_kind, target_package; one row each, repeats included."""
    selected = rules_selecting(edges, rules)
    of_kind = F.col("dependency_kind").isNull() | (F.col("dependency_kind") == F.col("target_kind"))
    granted = F.coalesce((F.col("target_kind") == "external") & F.array_contains("externals", F.col("target_package")), F.lit(False))
    hit = of_kind & ~granted & reportable(F.col("to"), F.col("to_not"), F.col("captures"), F.col("target_path"))
    return violations(kept(selected, hit), "import", F.col("path"), F.col("target_path"))


def unresolved(imports: DataFrame, targets: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, failures) of the imports of selected files: resolved ones with their targets, and the rest."""
    selected = imports.join(rules_selecting(imports.select("path").distinct(), rules).select("path").distinct(), "path", "left_semi")
    joined = selected.join(targets, ["path", "specifier"], "left")
    failed = F.col("target_path").isNull()
    return joined.filter(~failed), joined.filter(failed).select("path", "specifier")


def export_violations(bindings: DataFrame, rules: DataFrame) -> DataFrame:
    """bindings: path, specifier, bind_ord, symbol, binding_kind, target_path. A rule with a fix reports an edge once."""
    selected = rules_selecting(bindings, rules.withColumnRenamed("kinds", "rule_kinds"))
    covered = F.array_contains("rule_kinds", F.col("binding_kind")) & (F.col("symbols").isNull() | F.array_contains("symbols", F.col("symbol")))
    hit = kept(selected, covered & reportable(F.col("to"), F.col("to_not"), F.col("captures"), F.col("target_path")))
    each = F.when(F.col("fix").isNull(), F.col("bind_ord")).otherwise(F.lit(-1))
    grouped = hit.withColumn("each", each).groupBy("path", "specifier", "target_path", "ord", "name", "message", "each").agg(F.array_sort(F.collect_list(F.struct("bind_ord", "symbol"))).alias("hits"))
    symbols = F.array_join(F.transform("hits", lambda h: h["symbol"]), ",")
    return violations(grouped, "export", F.col("path"), F.concat("target_path", F.lit("#"), symbols))


def member_violations(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """sites: path, subject, name, in_decl, declares."""
    s = sites.select("path", F.col("subject").alias("site_subject"), F.col("name").alias("site_name"), "in_decl", F.col("declares").alias("site_declares"))
    r = rules_selecting(s, rules)
    site = F.col("site_name")
    governs = (
        (F.col("subject") == F.col("site_subject"))
        & ((F.size("in_") == 0) | any_match(F.col("in_"), F.col("in_decl")))
        & (F.col("declares").isNull() | F.coalesce(F.array_contains("declares", F.col("site_declares")), F.lit(False)))
        & ((F.size("match") == 0) | any_match(F.col("match"), site))
        & ~any_match(F.col("match_not"), site)
    )
    return violations(kept(r, governs & ~any_match(F.col("allow"), site)), "member", F.col("path"), site)


def surface_violations(files: DataFrame, sites: DataFrame, rules: DataFrame) -> DataFrame:
    """sites: path, name, kind, declares, reexport. A count is demanded of a file with no site at all, too."""
    selected = rules_selecting(files.select("path"), rules).withColumnRenamed("declares", "rule_declares").withColumnRenamed("reexport", "rule_reexport")
    s = sites.select(F.col("path").alias("site_path"), F.col("name").alias("site_name"), F.col("kind").alias("site_kind"), "declares", "reexport")
    name = F.col("site_name")
    governs = (
        (F.col("kinds").isNull() | F.array_contains("kinds", F.col("site_kind")))
        & (F.col("rule_declares").isNull() | F.array_contains("rule_declares", F.col("declares")))
        & (F.col("rule_reexport").isNull() | (F.col("rule_reexport") == F.col("reexport")))
        & ((F.size("match") == 0) | any_match(F.col("match"), name))
        & ~any_match(F.col("match_not"), name)
    )
    spoken = kept(selected.join(s, F.col("path") == F.col("site_path")), governs)
    bad = F.when(F.col("demand") == "forbid", F.lit(True)).when(F.col("demand") == "allow", ~any_match(F.col("allow"), name)).otherwise(~any_match(F.array("convention"), name))
    per_site = violations(kept(spoken.filter("demand <> 'count'"), bad), "surface", F.col("path"), name)
    n = spoken.filter("demand = 'count'").groupBy("path", "ord").agg(F.count("*").alias("n"))
    counted = selected.filter("demand = 'count'").select("path", "ord", "name", "message", "least", "most").join(n, ["path", "ord"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = (F.col("n") < F.coalesce("least", F.lit(0))) | (F.col("n") > F.coalesce(F.col("most").cast("long"), F.lit((1 << 62))))
    return per_site.unionByName(violations(counted.filter(out), "surface", F.col("path"), F.lit(None)))


def parity_violations(files: DataFrame, paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Required siblings that no path on disk, walked or not, supplies."""
    path = F.col("path")
    picked = matched(files.select("path"), rules, any_match(F.col("file"), path) & ~any_match(F.col("file_not"), path))
    sibling = resolved(dirname(path), F.replace(F.col("template"), F.lit("{base}"), base_of(basename(path))))
    wanted = picked.withColumn("template", F.explode("requires")).withColumn("sibling", sibling)
    missing = wanted.join(paths.select(F.col("path").alias("on_disk")), F.col("sibling") == F.col("on_disk"), "left_anti")
    return violations(missing, "structure", path, F.col("sibling"))


def naming_violations(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The first pattern that fills the subject group names what is judged: by equality with a group, or by a convention."""
    path = F.col("path")
    tries = F.transform(
        F.arrays_zip("file", "groups"),
        lambda z: F.struct(
            (F.call_function("rlike", path, z["file"]) & (z["groups"] >= F.col("subject"))).alias("ok"),
            F.when(z["groups"] >= F.col("subject"), F.call_function("regexp_extract", path, z["file"], F.least(F.col("subject"), z["groups"]))).alias("subject"),
            F.when(z["groups"] >= F.col("same_as"), F.call_function("regexp_extract", path, z["file"], F.least(F.col("same_as"), z["groups"]))).alias("expected"),
        ),
    )
    named = matched(files.select("path"), rules, any_match(F.col("file"), path) & ~any_match(F.col("file_not"), path))
    named = named.withColumn("hit", F.get(F.filter(tries, lambda t: t["ok"] & (t["subject"] != "")), F.lit(0))).filter("hit is not null")
    same = F.coalesce(F.col("hit.subject") == F.col("hit.expected"), F.lit(False))
    fine = F.when(F.col("same_as").isNotNull(), same).otherwise(F.col("convention").isNull() | F.coalesce(any_match(F.array("convention"), F.col("hit.subject")), F.lit(False)))
    return violations(kept(named, ~fine), "structure", path, F.col("hit.subject"))


def layout_violations(files: DataFrame, folders: DataFrame) -> DataFrame:
    """Files whose folder some rule governs and whose name none of the governing rules admits; the first rule is blamed."""
    governed = governed_files(files, folders)
    path = F.col("path")
    verdict = governed.groupBy("path").agg(F.bool_or(any_match(F.col("files"), basename(path))).alias("fine"), F.min_by(F.struct("name", "message"), "ord").alias("rule"))
    return violations(verdict.filter("not fine").select("path", "rule.name", "rule.message"), "structure", path, basename(path))


def governed_files(files: DataFrame, folders: DataFrame) -> DataFrame:
    return matched(files.select("path"), folders, any_match(F.col("folder"), dirname(F.col("path"))))


def root_violations(files: DataFrame, folders: DataFrame, roots: DataFrame) -> DataFrame:
    """Files below a root in folders that no folder rule governs; the first root is blamed, the folder is the subject."""
    path = F.col("path")
    stray = files.select("path").join(governed_files(files, folders).select("path"), "path", "left_anti")
    found = matched(stray, roots.withColumnRenamed("path", "root"), any_match(F.col("root"), path)).groupBy("path").agg(F.min_by(F.struct("name", "message"), "ord").alias("rule"))
    return violations(found.select("path", "rule.name", "rule.message"), "structure", path, dirname(path))


def findings(families: list[DataFrame]) -> DataFrame:
    """All families' violations, a bag: repeats stay."""
    return reduce(DataFrame.unionByName, families)


def explain(path: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Every rule of the import, export, member and surface tables that governs one path."""
    spark = next(iter(tables.values())).sparkSession
    one = spark.createDataFrame([(path,)], "path string")
    return reduce(DataFrame.unionByName, [rules_selecting(one, t).select("path", F.lit(k).alias("family"), F.col("name").alias("rule_name"), "ord") for k, t in tables.items()])
