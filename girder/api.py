"""The user's verbs over fact tables and a policy: check, conformance, coverage, baseline, explain, infer, atlas."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.lineage import settled
from girder.operators import families as fam
from girder.operators import graph as G
from girder.operators import infer as I
from girder.operators import measures as M
from girder.plans.patterns import any_match, substituted
from girder.plans.policy import Policy
from girder.plans.rules import allowance_table, rule_table
from girder.sources.documents import baseline_document

NONE = "kind string, rule_name string, message string, file string, subject string"


@dataclass
class Facts:
    """files (path), paths (path), observed (path, specifier, target_path, target_kind, target_package), bindings, members, exports.
    An import that resolved to nothing has a null target_path."""

    files: DataFrame
    paths: DataFrame
    observed: DataFrame
    bindings: DataFrame | None = None
    members: DataFrame | None = None
    exports: DataFrame | None = None


def _graph(facts: Facts) -> tuple[DataFrame, DataFrame]:
    """Nodes, and edges that are settled once for all the graph's rules."""
    return facts.files.select(F.col("path").alias("node")), settled(G.edges_of(facts.files, facts.observed.select("path", "target_path", "target_kind")))


def unresolved(facts: Facts, policy: Policy) -> DataFrame:
    """(path, specifier): imports without a target, of files that an import rule selects; the others are never resolved."""
    lost = facts.observed.filter("target_path is null").select("path", "specifier")
    if not policy.imports or not policy.report_unresolved:
        return lost.limit(0)
    lost = lost.filter(~any_match(G.listed(policy.ignore_unresolved), F.col("specifier")))
    chosen = fam.rules_selecting(lost.select("path").distinct(), rule_table(facts.files.sparkSession, policy.imports)).select("path").distinct()
    return lost.join(chosen, "path", "left_semi")


def findings(facts: Facts, policy: Policy) -> DataFrame:
    """All violations. Only families that the policy speaks to are planned."""
    spark, out = facts.files.sparkSession, []
    table = lambda rules: rule_table(spark, rules)
    if policy.imports:
        out.append(fam.import_violations(facts.observed.filter("target_path is not null"), table(policy.imports)))
    if policy.exports and facts.bindings is not None:
        out.append(fam.export_violations(facts.bindings.filter("target_path is not null"), table(policy.exports)))
    if policy.members and facts.members is not None:
        out.append(fam.member_violations(facts.members, table(policy.members)))
    if policy.surface and facts.exports is not None:
        out.append(fam.surface_violations(facts.files, facts.exports, table(policy.surface)))
    if policy.parity:
        out.append(fam.parity_violations(facts.files, facts.paths, table(policy.parity)))
    if policy.naming:
        out.append(fam.naming_violations(facts.files, table(policy.naming)))
    if policy.folders:
        out.append(fam.layout_violations(facts.files, table(policy.folders)))
        if policy.roots:
            out.append(fam.root_violations(facts.files, table(policy.folders), table(policy.roots)))
    if policy.has_graph_rules():
        nodes, edges = _graph(facts)
        out += [G.cycle_violations(nodes, edges, r.name, r.message, r.within, r.within_not) for r in policy.cycles]
        out += [G.orphan_violations(nodes, edges, r.name, r.message, r.within, r.within_not, r.entry) for r in policy.orphans]
        out += [G.reach_violations(nodes, edges, r.name, r.message, r.from_, r.to, r.via) for r in policy.reach]
    return fam.findings(out) if out else spark.createDataFrame([], NONE)


def reach(facts: Facts, policy: Policy) -> DataFrame:
    spark = facts.files.sparkSession
    table = lambda rules: rule_table(spark, rules) if rules else None
    files = M.counted_files(facts.files, G.listed(policy.outside)) if policy.outside else facts.files
    return M.reach_of(files, table(policy.imports), table(policy.folders), table(policy.members), table(policy.surface), table([*policy.cycles, *policy.orphans]))


def coverage(facts: Facts, policy: Policy) -> DataFrame:
    return M.coverage_of(reach(facts, policy))


def counts(facts: Facts, policy: Policy) -> DataFrame:
    """measure, value: residue, vacant, slack, concentration."""
    spark = facts.files.sparkSession
    residue = M.residue_files(reach(facts, policy)).agg(F.lit("residue").alias("measure"), F.count("*").alias("value"))
    if not any(r.allowances for r in policy.imports):
        return residue
    rules, allowances = rule_table(spark, policy.imports), allowance_table(spark, policy.imports)
    vacant = M.vacant_nodes(facts.files, rules, allowances).agg(F.lit("vacant").alias("measure"), F.count("*").alias("value"))
    entries = M.slack_of(facts.files, facts.observed, rules, allowances)
    slack = entries.agg(F.lit("slack").alias("measure"), F.count_if(F.col("used_at") == 0).alias("value"))
    dense = entries.agg(F.lit("concentration").alias("measure"), F.count_if(F.col("is_fragment") & (F.col("used_at") > 0) & M.is_concentrated()).alias("value"))
    return residue.unionByName(vacant).unionByName(slack).unionByName(dense)


def check(facts: Facts, policy: Policy, baseline: DataFrame | None = None, campaigns: DataFrame | None = None) -> dict[str, DataFrame]:
    """Violations with their baselined flag, unresolved imports, stale entries, and limits that do not hold. `failure` has one row, in the order
    stale, the first reason of the first failing campaign, shortfall, overrun, excess, violations; its reason is null where the check
    passes. campaigns: campaign, reasons, as `records.failures` gives them."""
    spark = facts.files.sparkSession
    base = baseline if baseline is not None else spark.createDataFrame([], "entry string")
    found = M.flagged(findings(facts, policy), base)
    stale = M.stale_entries(found, base)
    limits = policy.limits
    cover = coverage(facts, policy)
    short = M.shortfalls(cover, limits["coverage"]) if limits.get("coverage") else spark.createDataFrame([], "family string, actual double, floor double")
    unreached = cover.select(F.col("family").alias("measure"), (F.col("total") - F.col("covered")).alias("value"))
    over = M.overruns(unreached, limits["unreached"]) if limits.get("unreached") else spark.createDataFrame([], "measure string, value long, ceiling double")
    excess = M.overruns(counts(facts, policy), limits["conformance"]) if limits.get("conformance") else spark.createDataFrame([], "measure string, value long, ceiling double")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    sums = n(stale, "a").crossJoin(n(short, "b")).crossJoin(n(over, "c")).crossJoin(n(excess, "d")).crossJoin(n(found.filter("not baselined"), "e"))
    failing = campaigns if campaigns is not None else spark.createDataFrame([], "campaign string, reasons array<string>")
    sums = sums.crossJoin(failing.agg(F.min_by(F.get("reasons", F.lit(0)), "campaign").alias("campaign")))
    reason = F.when(F.col("a") > 0, "stale").when(F.col("campaign").isNotNull(), F.col("campaign")).when(F.col("b") > 0, "shortfall").when(F.col("c") > 0, "overrun").when(F.col("d") > 0, "excess").when(F.col("e") > 0, "violations")
    return {"violations": found, "unresolved": unresolved(facts, policy), "stale": stale, "shortfalls": short, "overruns": over, "excesses": excess, "failure": sums.select(reason.alias("reason"))}


def write_baseline(facts: Facts, policy: Policy, path: str) -> DataFrame:
    """Records the present violations (one text row per entry); returns them."""
    entries = M.baseline_of(findings(facts, policy))
    entries.orderBy("entry").write.mode("overwrite").text(path)
    return entries


def baseline_text(entries: DataFrame, most: int = 1_000_000) -> str:
    """The JSON document, for a baseline whose size is checked first."""
    if entries.limit(most + 1).count() > most:
        raise ValueError("the baseline is too large for one document")
    return baseline_document([r[0] for r in entries.collect()])


def explain(spark: SparkSession, policy: Policy, path: str) -> DataFrame:
    rules = {"import": policy.imports, "export": policy.exports, "member": policy.members, "surface": policy.surface}
    return fam.explain(path, {k: rule_table(spark, v) for k, v in rules.items() if v})


def snapshot(facts: Facts, policy: Policy) -> DataFrame:
    """The conformance document as one row of JSON: ok, coverage, counts, cycles, and violations by kind and by height."""
    nodes, edges = _graph(facts)
    found = findings(facts, policy)
    tall = G.by_height(found, G.heights(nodes, edges))
    one = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    parts = one(coverage(facts, policy), "coverage").crossJoin(one(counts(facts, policy), "counts")).crossJoin(one(found.groupBy("kind").agg(F.count("*").alias("n")), "violations"))
    parts = parts.crossJoin(one(tall.groupBy("height").agg(F.count("*").alias("n")), "heights")).crossJoin(one(G.cycles(nodes, edges).select("comp", F.size("members").alias("size")), "cycles"))
    return parts.select(F.to_json(F.struct(F.lit(2).alias("version"), (F.size("violations") == 0).alias("ok"), "coverage", "counts", "violations", "heights", "cycles")).alias("snapshot"))


def inferred(facts: Facts, depth: int = 2) -> DataFrame:
    """(node, allow): the as-built allowlists, small enough to be written as a manifest."""
    _, edges = _graph(facts)
    return I.allow_sets(edges, depth)


def inferred_manifest(facts: Facts, depth: int = 2, most: int = 10_000) -> str:
    """A manifest that the tree checks clean against: each folder allows itself and what it imports."""
    rows = inferred(facts, depth).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many nodes for one manifest")
    tree: dict = {}
    for r in sorted(rows):
        parts, at = r["node"].split("/"), tree
        for p in parts[:-1]:
            at = at.setdefault(p + "/", {"partial": True, "children": {}}).setdefault("children", {})
        at.setdefault(parts[-1] + "/", {"partial": True})["imports"] = {"allow": [r["node"] + "/**", *(a + "/**" for a in r["allow"])]}
    return json.dumps({"tree": tree}, indent=2)


def atlas_edges(facts: Facts, policy: Policy) -> DataFrame:
    """Each local edge with its verdict (allowed, refused or ungoverned) and the first allowance that admits it."""
    spark = facts.files.sparkSession
    local = facts.observed.filter("target_kind = 'local'")
    rules, allowances = rule_table(spark, policy.imports), allowance_table(spark, policy.imports)
    selected = fam.rules_selecting(local, rules)
    fits = any_match(substituted(F.array("pattern"), F.col("captures")), F.col("target_path"))
    admitted = fam.kept(selected.join(allowances.filter("pattern is not null"), "ord"), fits).groupBy("path", "target_path").agg(F.min_by(F.struct("node", "entry"), F.struct("ord", "allow_ord")).alias("admitted_by"))
    refused = fam.import_violations(local, rules).select(F.col("file").alias("path"), F.col("subject").alias("target_path")).distinct().withColumn("refused", F.lit(True))
    governed = selected.select("path", "target_path").distinct().withColumn("governed", F.lit(True))
    out = local.select("path", "target_path").distinct()
    for other in (refused, governed, admitted):
        out = out.join(other, ["path", "target_path"], "left")
    verdict = F.when(F.col("refused"), "refused").when(F.col("governed"), "allowed").otherwise("ungoverned")
    return out.select("path", "target_path", verdict.alias("verdict"), F.col("admitted_by.node").alias("admitted_by"), F.col("admitted_by.entry").alias("entry"))


def governing_chain(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes (node, pattern, depth, wildcards, parent): per file and depth the node with fewest wildcards, kept while each is
    the parent of the next."""
    from pyspark.sql import Window

    hit = fam.matched(files.select("path"), nodes, F.call_function("rlike", F.col("path"), F.col("pattern")))
    best = hit.withColumn("rn", F.row_number().over(Window.partitionBy("path", "depth").orderBy("wildcards", "node"))).filter("rn = 1")
    order = Window.partitionBy("path").orderBy("depth")
    linked = best.withColumn("ok", F.coalesce(F.lag("node").over(order) == F.col("parent"), F.col("parent").isNull()))
    whole = F.min(F.col("ok").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return linked.withColumn("whole", whole).filter("whole = 1").select("path", "depth", "node")
