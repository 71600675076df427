"""The import graph: cycles, orphans, reach, height.

Small graphs (at most `most_local` edges, a checked size) are solved on the driver in linear time, since a source tree's graph
is small beside its facts. Larger ones run as DataFrame loops over frontiers whose lineage is cut each round; nothing but
counts reaches the driver there. Both ways give the same rows.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.lineage import settled
from girder.operators.families import violations
from girder.plans.patterns import any_match, compiled

MOST_LOCAL = 200_000
ARROW = " ↔ "


def edges_of(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (src, dst) of local targets that were walked."""
    local = targets.filter("target_kind = 'local'").select(F.col("path").alias("src"), F.col("target_path").alias("dst"))
    walked = files.select(F.col("path").alias("dst"))
    return local.join(walked, "dst", "left_semi").select("src", "dst").distinct()


def listed(patterns: list[str]) -> Column:
    return F.array(*map(F.lit, compiled("graph", "pattern", patterns))) if patterns else F.array().cast("array<string>")


def in_scope(path: Column, within: list[str], within_not: list[str]) -> Column:
    return any_match(listed(within), path) & ~any_match(listed(within_not), path)


def _small(edges: DataFrame, most_local: int) -> list[tuple] | None:
    rows = edges.select("src", "dst").distinct().limit(most_local + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= most_local else None


# -- strongly connected components -------------------------------------------------------------------------------------


def _tarjan(nodes: list, ahead: dict) -> dict:
    """Component (its least member) of each node, without recursion."""
    order, low, on, stack, comp = {}, {}, set(), [], {}
    for root in nodes:
        if root in order:
            continue
        work = [(root, iter(ahead.get(root, ())))]
        order[root] = low[root] = len(order)
        stack.append(root)
        on.add(root)
        while work:
            v, it = work[-1]
            for w in it:
                if w not in order:
                    order[w] = low[w] = len(order)
                    stack.append(w)
                    on.add(w)
                    work.append((w, iter(ahead.get(w, ()))))
                    break
                if w in on:
                    low[v] = min(low[v], order[w])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == order[v]:
                    members = []
                    while True:
                        w = stack.pop()
                        on.discard(w)
                        members.append(w)
                        if w == v:
                            break
                    least = min(members)
                    comp.update((m, least) for m in members)
    return comp


def strong_components(nodes: DataFrame, edges: DataFrame, most_local: int = MOST_LOCAL) -> DataFrame:
    """(node, comp): comp is the least member of the node's strongly connected component."""
    spark = nodes.sparkSession
    kind = dict(edges.dtypes)["src"]
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    rows = _small(edges, most_local)
    if rows is not None:
        ahead: dict = {}
        for a, b in rows:
            ahead.setdefault(a, []).append(b)
        comp = _tarjan(sorted({x for r in rows for x in r}), ahead)
        found = spark.createDataFrame(sorted(comp.items()), f"node {kind}, comp {kind}")
    else:
        found = _coloured(ends, edges, kind)
    alone = nodes.select("node").distinct().join(ends, "node", "left_anti").select("node", F.col("node").alias("comp"))
    return found.unionByName(alone)


def _coloured(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """Forward colouring by the least reachable-from node, then backward search inside each colour; peeled until none is left."""
    spark = nodes.sparkSession
    left, links = settled(nodes), settled(edges.filter("src <> dst"))
    done = spark.createDataFrame([], f"node {kind}, comp {kind}")
    while not left.isEmpty():
        # nodes without a way in or out are components of their own
        while True:
            core = left.join(links.select(F.col("src").alias("node")), "node", "left_semi").join(links.select(F.col("dst").alias("node")), "node", "left_semi")
            core = settled(core)
            n, m = left.count(), core.count()
            if n == m:
                break
            done = settled(done.unionByName(left.join(core, "node", "left_anti").select("node", F.col("node").alias("comp"))))
            links = settled(links.join(core.select(F.col("node").alias("src")), "src", "left_semi").join(core.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"))
            left = core
        if not m:
            break
        colour = settled(left.select("node", F.col("node").alias("c")))
        while True:
            came = links.join(colour.select(F.col("node").alias("src"), F.col("c").alias("pc")), "src").groupBy(F.col("dst").alias("node")).agg(F.min("pc").alias("pc"))
            step = settled(colour.join(came, "node", "left").select("node", F.least("c", F.coalesce("pc", "c")).alias("c"), (F.coalesce("pc", "c") < F.col("c")).alias("moved")))
            moved = step.filter("moved").isEmpty()
            colour = step.select("node", "c")
            if moved:
                break
        # a colour's root reaches all of the colour; what also reaches the root is its component
        inner = links.join(colour.toDF("src", "sc"), "src").join(colour.toDF("dst", "dc"), "dst").filter("sc = dc").select("src", "dst")
        inner = settled(inner)
        seen = settled(colour.filter("node = c").select("node", F.col("c").alias("comp")))
        front = seen
        while not front.isEmpty():
            back = inner.join(front.toDF("dst", "comp"), "dst").select(F.col("src").alias("node"), "comp").distinct()
            front = settled(back.join(seen.select("node"), "node", "left_anti"))
            seen = settled(seen.unionByName(front))
        done = settled(done.unionByName(seen))
        left = settled(left.join(seen.select("node"), "node", "left_anti"))
        links = settled(links.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi").select("src", "dst"))
    return done


def cycles(nodes: DataFrame, edges: DataFrame, most_local: int = MOST_LOCAL) -> DataFrame:
    """(comp, members): components of more than one node, or with an edge onto themselves."""
    comp = strong_components(nodes, edges, most_local)
    loops = edges.filter("src = dst").select(F.col("src").alias("node"), F.lit(True).alias("loop")).distinct()
    groups = comp.join(loops, "node", "left").groupBy("comp").agg(F.array_sort(F.collect_set("node")).alias("members"), F.bool_or(F.coalesce("loop", F.lit(False))).alias("loop"))
    return groups.filter((F.size("members") > 1) | F.col("loop")).select("comp", "members")


def cycle_violations(nodes: DataFrame, edges: DataFrame, name: str, message: str, within: list[str], within_not: list[str] = (), most_local: int = MOST_LOCAL) -> DataFrame:
    """Cycles of the graph that the scope induces: both ends of an edge must be in scope."""
    scoped = nodes.filter(in_scope(F.col("node"), within, list(within_not)))
    inner = edges.filter(in_scope(F.col("src"), within, list(within_not)) & in_scope(F.col("dst"), within, list(within_not)))
    rows = cycles(scoped, inner, most_local).withColumns({"name": F.lit(name), "message": F.lit(message)})
    return violations(rows, "cycle", F.array_min("members"), F.array_join("members", ARROW))


def orphan_violations(nodes: DataFrame, edges: DataFrame, name: str, message: str, within: list[str], within_not: list[str] = (), entry: list[str] = ()) -> DataFrame:
    """Files in scope, no entry, that no edge at all leads to."""
    scoped = nodes.filter(in_scope(F.col("node"), within, list(within_not)) & ~any_match(listed(list(entry)), F.col("node")))
    rows = scoped.join(edges.select(F.col("dst").alias("node")), "node", "left_anti").withColumns({"name": F.lit(name), "message": F.lit(message)})
    return violations(rows, "orphan", F.col("node"), F.lit(None))


# -- reach -------------------------------------------------------------------------------------------------------------


def reach(edges: DataFrame, origins: DataFrame, via: list[str] = (), most_local: int = MOST_LOCAL) -> DataFrame:
    """(origin, node, hops, route): all that an origin reaches without stepping onto `via`, with the canonical shortest route.

    Layers are walked in the order of discovery and neighbours in sorted order, so a node's parent is the one that was
    queued first. The origin itself is neither tested nor reported.
    """
    spark = edges.sparkSession
    open_ = edges.filter(~any_match(listed(list(via)), F.col("dst"))).select("src", "dst").distinct()
    kind = dict(edges.dtypes)["src"]
    schema = f"origin {kind}, node {kind}, hops int, route array<{kind}>"
    rows = _small(open_, most_local)
    if rows is not None:
        ahead: dict = {}
        for a, b in rows:
            ahead.setdefault(a, []).append(b)
        table = {k: sorted(v) for k, v in ahead.items()}

        def walk(parts):
            import pandas as pd

            for part in parts:
                out = []
                for o in part["origin"]:
                    parent, queue = {o: None}, deque([(o, 0)])
                    while queue:
                        v, d = queue.popleft()
                        for w in table.get(v, ()):
                            if w not in parent:
                                parent[w] = v
                                queue.append((w, d + 1))
                                route, x = [w], v
                                while x is not None:
                                    route.append(x)
                                    x = parent[x]
                                out.append((o, w, d + 1, route[::-1]))
                yield pd.DataFrame(out, columns=["origin", "node", "hops", "route"])

        return origins.select("origin").distinct().mapInPandas(walk, schema)
    start = origins.select("origin").distinct()
    seen = settled(start.select("origin", F.col("origin").alias("node"), F.lit(0).alias("hops"), F.array("origin").alias("route"), F.lit(0).cast("long").alias("rank")))
    front, hops = seen, 0
    links = settled(open_.toDF("x", "y"))
    while not front.isEmpty():
        hops += 1
        step = front.join(links, F.col("node") == F.col("x")).groupBy("origin", F.col("y").alias("to")).agg(F.min_by(F.struct("rank", "route"), "rank").alias("by"))
        step = step.join(seen.select(F.col("origin").alias("so"), F.col("node").alias("sn")), (F.col("origin") == F.col("so")) & (F.col("to") == F.col("sn")), "left_anti")
        order = Window.partitionBy("origin").orderBy("by.rank", "to")
        front = settled(step.select("origin", F.col("to").alias("node"), F.lit(hops).alias("hops"), F.concat("by.route", F.array("to")).alias("route"), F.row_number().over(order).cast("long").alias("rank")))
        seen = settled(seen.unionByName(front))
    return seen.filter("hops > 0").select("origin", "node", "hops", "route")


def reach_violations(nodes: DataFrame, edges: DataFrame, name: str, message: str, from_: list[str], to: list[str], via: list[str] = (), most_local: int = MOST_LOCAL) -> DataFrame:
    origins = nodes.filter(any_match(listed(from_), F.col("node"))).select(F.col("node").alias("origin"))
    found = reach(edges, origins, via, most_local).filter(any_match(listed(to), F.col("node")))
    text = F.concat(F.lit(message + " ("), F.array_join("route", " -> "), F.lit(")"))
    return violations(found.withColumns({"name": F.lit(name), "message": text}), "reach", F.col("origin"), F.col("node"))


# -- height ------------------------------------------------------------------------------------------------------------


def heights(nodes: DataFrame, edges: DataFrame, most_local: int = MOST_LOCAL) -> DataFrame:
    """(node, height): the longest way down to a leaf over the graph of components; members of one share it."""
    spark = nodes.sparkSession
    comp = strong_components(nodes, edges, most_local)
    a, b = comp.toDF("src", "ca"), comp.toDF("dst", "cb")
    between = edges.join(a, "src").join(b, "dst").filter("ca <> cb").select(F.col("ca").alias("src"), F.col("cb").alias("dst")).distinct()
    kind = dict(edges.dtypes)["src"]
    rows = _small(between, most_local)
    if rows is not None:
        ahead, into, count = {}, {}, {}
        for x, y in rows:
            ahead.setdefault(x, []).append(y)
            into.setdefault(y, []).append(x)
        count = {x: len(v) for x, v in ahead.items()}
        ready = deque(y for y in into if y not in ahead)
        height = {y: 0 for y in ready}
        while ready:
            y = ready.popleft()
            for x in into.get(y, ()):
                height[x] = max(height.get(x, 0), height[y] + 1)
                count[x] -= 1
                if not count[x]:
                    ready.append(x)
        table = spark.createDataFrame(sorted(height.items()), f"comp {kind}, height int")
    else:
        down = settled(between.toDF("x", "y"))
        table = settled(comp.select("comp").distinct().withColumn("height", F.lit(0)))
        while True:
            best = down.join(table.toDF("y", "h"), "y").groupBy(F.col("x").alias("comp")).agg((F.max("h") + 1).alias("up"))
            step = settled(table.join(best, "comp", "left").select("comp", F.greatest("height", F.coalesce("up", F.lit(0))).alias("height"), (F.coalesce("up", F.lit(0)) > F.col("height")).alias("moved")))
            still = step.filter("moved").isEmpty()
            table = step.select("comp", "height")
            if still:
                break
    return comp.join(table, "comp", "left").select("node", F.coalesce("height", F.lit(0)).alias("height"))


def by_height(found: DataFrame, height: DataFrame) -> DataFrame:
    """Violations with the height of their subject, else of their file, else 0, in report order."""
    h = height.toDF("at", "h")
    rows = found.join(h.toDF("subject", "hs"), "subject", "left").join(h.toDF("file", "hf"), "file", "left")
    from girder.operators.families import fingerprint

    rows = rows.withColumn("height", F.coalesce("hs", "hf", F.lit(0))).withColumn("fingerprint", fingerprint())
    return rows.select("height", "fingerprint", *found.columns).orderBy("height", F.collate("fingerprint", "UNICODE"))


# -- undirected groups -------------------------------------------------------------------------------------------------


def groups(pairs: DataFrame) -> DataFrame:
    """(node, root) of the connected components of pairs (a, b): least labels passed on, with pointer jumps, until they stay."""
    both = settled(pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settled(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root")))
    while True:
        near = both.join(label.toDF("b", "rb"), "b").groupBy(F.col("a").alias("node")).agg(F.min("rb").alias("rb"))
        step = label.join(near, "node").select("node", F.least("root", "rb").alias("r"), "root")
        jump = label.toDF("r", "rr")
        step = settled(step.join(jump, "r", "left").select("node", F.least("r", F.coalesce("rr", "r")).alias("r"), "root"))
        if step.filter("r <> root").isEmpty():
            return step.select("node", F.col("r").alias("root"))
        label = step.select("node", F.col("r").alias("root"))
