"""An as-built policy from observed edges: which nodes import from which, and what could be generalized."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.operators.graph import groups
from girder.plans.patterns import CONVENTIONS


def node_of(path: str, depth: int):
    """The governing folder of a path at a depth."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.size(parts) - 1)), "/")


def governors(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """(path, node): the deepest node above each path, by equality on exploded ancestors."""
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    found = paths.select("path", above.alias("node")).join(nodes.select("node"), "node")
    return found.groupBy("path").agg(F.max_by("node", F.length("node")).alias("node"))


def allow_sets(edges: DataFrame, depth: int) -> DataFrame:
    """(node, allow): what each node's files import from outside of it."""
    rows = edges.select(node_of("src", depth).alias("node"), node_of("dst", depth).alias("target")).filter("node <> target").distinct()
    return rows.groupBy("node").agg(F.array_sort(F.collect_set("target")).alias("allow"))


def similar_pairs(traits: DataFrame, parent: str, node: str, trait: str, least: float = 0.5, shared: int = 2) -> DataFrame:
    """Sibling pairs that share enough traits, or whose Jaccard likeness is high; pairs meet only through a common trait."""
    t = traits.select(parent, node, trait).distinct()
    n = t.groupBy(parent, node).agg(F.count("*").alias("n"))
    a, b = t.toDF("p", "a", "t"), t.toDF("p", "b", "t")
    both = a.join(b, ["p", "t"]).filter("a < b").groupBy("p", "a", "b").agg(F.count("*").alias("common"))
    sized = both.join(n.toDF("p", "a", "na"), ["p", "a"]).join(n.toDF("p", "b", "nb"), ["p", "b"])
    like = F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))
    return sized.filter((F.col("common") >= shared) | (like >= least)).select("p", "a", "b", "common", like.alias("likeness"))


def families_of(pairs: DataFrame) -> DataFrame:
    """(node, root): siblings joined through similar pairs."""
    return groups(pairs.select("a", "b"))


def convention_of(name):
    """The first convention that a name follows, null for none."""
    return F.coalesce(*(F.when(name.rlike(p), F.lit(k)) for k, p in CONVENTIONS.items()))


def collapsed(tree: dict[str, dict], allow: dict[str, frozenset]) -> dict[str, frozenset]:
    """Children whose allow sets equal each other's fold into their parent; a policy's nodes are few and on the driver."""
    out = dict(allow)
    for node in sorted(tree, key=lambda n: -n.count("/")):
        own = [c for c in tree[node] if c in out]
        if len(own) > 1 and len({out[c] for c in own}) == 1:
            out[node] = out.get(node, frozenset()) | out[own[0]]
            for c in own:
                out.pop(c)
    return out


def shared_by_all(items: DataFrame, group: str, member: str, item: str) -> DataFrame:
    """(group, item): what every member of a group has."""
    pairs = items.select(group, member, item).distinct()
    size = pairs.groupBy(group).agg(F.count_distinct(member).alias("__n"))
    have = pairs.groupBy(group, item).agg(F.count("*").alias("__have"))
    return have.join(size, group).filter("__have = __n").select(group, item)
