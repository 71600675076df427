"""Families, graph, measures, detectors, ledgers, policies, sources and feeds on small fixtures."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from girder import api
from girder.functions import text as ft
from girder.operators import campaigns as C
from girder.operators import detect as D
from girder.operators import families as fam
from girder.operators import graph as G
from girder.operators import infer as I
from girder.operators import measures as M
from girder.plans import policy as P
from girder.plans.patterns import PatternError, compiled, fixed_prefix, glob_to_regex, groups_of, to_java
from girder.plans.rules import ExportRule, FolderRule, ImportRule, MemberRule, ParityRule, RootRule, SurfaceRule, rule_table
from girder.sources import documents, extract, files, reports
from girder.streaming import feed


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- one planted violation a family ------------------------------------------------------------------------------------

LAYERS, WIDTH = ["soil", "root", "stem", "leaf"], 6  # a layer may import itself and the layers before it


def at(layer, i):
    return f"plant/{layer}/m{i}.ts"


def garden():
    """A tree of clean layers, and what is planted into it: (files, edges, bindings, members, exports, expected fingerprints).

    Every module imports two of the layer below, so a clean garden breaks no rule; each planting adds its facts and says what
    is to be found.
    """
    files = [at(x, i) for x in LAYERS for i in range(WIDTH)] + [f"plant/soil/m{i}.proof.ts" for i in range(WIDTH)]
    edges = [(at(x, i), at(below, (i + d) % WIDTH)) for below, x in zip(LAYERS, LAYERS[1:]) for i in range(WIDTH) for d in (0, 2)]
    bindings = [(a, b, 0, "open", "named", b) for a, b in edges]
    members = [(at("stem", i), "members", "takeWater", "WaterPort", "type") for i in range(WIDTH)]
    exports = [(at("root", i), f"r{i}", "named", "variable", False) for i in range(WIDTH)]
    expected = []
    for i, layer in enumerate(LAYERS[:3]):  # an import against the layers
        a, b = at(layer, 1), at(LAYERS[i + 1], 4)
        edges.append((a, b))
        expected.append(f"import|up-{layer}|{a}|{b}")
    files.append("yard/shed.ts")  # outside of every folder, and reached from a leaf
    edges.append((at("soil", 5), "yard/shed.ts"))
    expected += [f"import|up-soil|{at('soil', 5)}|yard/shed.ts", "structure|placed|yard/shed.ts|yard", f"reach|exposed|{at('leaf', 5)}|yard/shed.ts"]
    bindings.append((at("root", 2), at("soil", 2), 1, "raw", "named", at("soil", 2)))
    expected.append(f"export|sealed|{at('root', 2)}|{at('soil', 2)}#raw")
    members += [(at("stem", 3), "members", "grab", "WaterPort", "type"), (at("soil", 0), "calls", "now", None, None), (at("soil", 0), "calls", "now", None, None)]
    expected += [f"member|verbs|{at('stem', 3)}|grab"] + 2 * [f"member|timeless|{at('soil', 0)}|now"]
    exports += [(at("leaf", 2), "secretKey", "named", "variable", False), (at("root", 4), "extra", "named", "variable", False)]
    expected += [f"surface|hidden|{at('leaf', 2)}|secretKey", f"surface|single|{at('root', 4)}|"]
    files.remove("plant/soil/m3.proof.ts")
    expected.append(f"structure|proof|{at('soil', 3)}|plant/soil/m3.proof.ts")
    files.append("plant/stem/weed.ts")
    expected += ["structure|stem|plant/stem/weed.ts|weed.ts", "orphan|lonely|plant/stem/weed.ts|"]
    edges += [(at("leaf", 0), at("leaf", 1)), (at("leaf", 1), at("leaf", 0))]
    expected.append(f"cycle|loops|{at('leaf', 0)}|{at('leaf', 0)} ↔ {at('leaf', 1)}")
    return files, edges, bindings, members, exports, sorted(expected)


FILES, EDGES, BINDINGS, MEMBERS, EXPORTS, EXPECTED = garden()


@pytest.fixture(scope="module")
def planted(spark):
    f = spark.createDataFrame([(p,) for p in FILES], "path string")
    outside = [(at("soil", 0), "sun", "node_modules/sun/i.js", "external", "sun"), (at("soil", 1), "./lost", None, None, None), ("yard/shed.ts", "./gone", None, None, None)]
    observed = spark.createDataFrame([(a, b, b, "local", None) for a, b in EDGES] + outside, "path string, specifier string, target_path string, target_kind string, target_package string")
    bindings = spark.createDataFrame([*BINDINGS, (at("soil", 1), "./lost", 0, "raw", "named", None)], "path string, specifier string, bind_ord int, symbol string, binding_kind string, target_path string")
    members = spark.createDataFrame(MEMBERS, "path string, subject string, name string, in_decl string, declares string")
    exports = spark.createDataFrame(EXPORTS, "path string, name string, kind string, declares string, reexport boolean")
    return api.Facts(f, files.all_paths(f), observed, bindings, members, exports)


def policy():
    own = lambda k: [f"^plant/({'|'.join(LAYERS[: k + 1])})/"]
    return P.Policy(
        imports=[ImportRule(f"up-{x}", "layers look down", [f"^plant/{x}/"], [], [], own(k), ["sun"]) for k, x in enumerate(LAYERS[:3])],
        exports=[ExportRule("sealed", "open it first", ["^plant/"], [], ["^plant/soil/"], [], ["raw"])],
        members=[MemberRule("verbs", "a port takes", ["^plant/stem/"], [], "members", ["Port$"], ["type"], [], [], ["^take"]), MemberRule("timeless", "soil has no clock", ["^plant/soil/"], [], "calls", [], None, ["^now$"])],
        surface=[SurfaceRule("hidden", "keep it", ["^plant/"], match=["^secret"]), SurfaceRule("single", "one export", ["^plant/root/"], demand="count", least=1, most=1)],
        parity=[ParityRule("proof", "prove it", [r"^plant/soil/m[0-9]\.ts$"], [], ["{base}.proof.ts"])],
        folders=[FolderRule(x, "modules only", [f"^plant/{x}$"], ["^m[0-9]"]) for x in LAYERS],
        roots=[RootRule("placed", "where is this", ["^(plant|yard)/"])],
        cycles=[graph_rule("loops", within=["^plant/"])],
        orphans=[graph_rule("lonely", within=["^plant/"], entry=["^plant/leaf/", "proof"])],
        reach=[graph_rule("exposed", from_=["^plant/leaf/m5"], to=["^yard/"])],
    )


def graph_rule(name, **k):
    from girder.plans.rules import GraphRule

    return GraphRule(name, name, **k)


def test_unresolved_imports(planted):
    """Only of files that an import rule selects, unless the policy says otherwise; their bindings are not judged."""
    p = policy()
    assert [tuple(r) for r in api.unresolved(planted, p).collect()] == [(at("soil", 1), "./lost")]
    p.ignore_unresolved = ["lost$"]
    assert api.unresolved(planted, p).isEmpty()
    p.ignore_unresolved, p.report_unresolved = [], False
    assert api.unresolved(planted, p).isEmpty()
    assert api.check(planted, policy())["unresolved"].count() == 1


def test_every_family(planted):
    found = api.findings(planted, policy()).select(fam.fingerprint().alias("f"))
    assert sorted(r[0] for r in found.collect()) == EXPECTED


def test_check_and_baseline_round_trip(spark, planted, tmp_path):
    p = policy()
    assert api.check(planted, p)["failure"].first()[0] == "violations"
    api.write_baseline(planted, p, str(tmp_path / "base"))
    base = spark.read.text(str(tmp_path / "base")).toDF("entry")
    out = api.check(planted, p, base)
    assert out["failure"].first()[0] is None and out["stale"].isEmpty() and out["violations"].filter("not baselined").isEmpty()
    assert base.count() == len(set(EXPECTED))
    more = base.unionByName(spark.createDataFrame([("import|x|y|z",)], "entry string"))
    assert api.check(planted, p, more)["failure"].first()[0] == "stale"
    p.limits = {"coverage": {"imports": 0.9}, "conformance": {"residue": 0}}
    out = api.check(planted, p, base)
    assert out["failure"].first()[0] == "shortfall" and out["shortfalls"].count() == 1
    assert '"version": 1' in api.baseline_text(base)


def test_explain_names_the_rule_that_reported(spark, planted):
    p = policy()
    for r in api.findings(planted, p).filter("kind in ('import', 'export', 'member', 'surface')").collect():
        named = {x["rule_name"] for x in api.explain(spark, p, r["file"]).collect()}
        assert r["rule_name"] in named


def test_one_new_edge_is_one_new_finding(spark, planted):
    new = planted.observed.limit(0).unionByName(spark.createDataFrame([(at("soil", 0), "m", at("leaf", 2), "local", None)], planted.observed.schema))
    rules = rule_table(spark, policy().imports)
    a, b = fam.import_violations(planted.observed, rules), fam.import_violations(planted.observed.unionByName(new), rules)
    assert [tuple(r)[3:] for r in b.exceptAll(a).collect()] == [(at("soil", 0), at("leaf", 2))]


def test_captures_are_data(spark):
    rows = [("src/my.module/a.ts", "src/myxmodule/b.ts"), ("src/my.module/a.ts", "src/my.module/b.ts"), ("src/$2/a.ts", "src/$2/b.ts")]
    edges = spark.createDataFrame([(a, b, "local", None) for a, b in rows], "path string, target_path string, target_kind string, target_package string")
    rules = [ImportRule("own", "", ["^src/([^/]+)/"], [], [], ["^src/$1/"]), ImportRule("no-group", "", ["^src/"], [], ["^src/$1"], [])]
    assert [(r["rule_name"], r["subject"]) for r in fam.import_violations(edges, rule_table(spark, rules)).collect()] == [("own", "src/myxmodule/b.ts")]


def test_unresolved_imports_are_failures(spark):
    imports = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "./gone"), ("lib/x.ts", "./gone")], "path string, specifier string")
    targets = spark.createDataFrame([("src/a.ts", "./b", "src/b.ts", "local", None)], "path string, specifier string, target_path string, target_kind string, target_package string")
    ok, bad = fam.unresolved(imports, targets, rule_table(spark, [ImportRule("r", "", ["^src/"])]))
    assert ok.count() == 1 and values(bad) == [("src/a.ts", "./gone")]


# -- patterns ----------------------------------------------------------------------------------------------------------


def test_dialect():
    assert to_java(r"a$") == r"a\z" and to_java(r"[[a&&b]") == r"[\[a\&&b]" and to_java(r"^src/$1/") == "^src/$1/"
    assert groups_of(r"(a)(?:b)(?<n>c)\((?=d)[(]") == 2
    with pytest.raises(PatternError):
        compiled("r", "from", "(")
    assert glob_to_regex("src/*/x?.{a}/**") == "^src/[^/]*/x[^/]\\.([^/]+)(?:/.*)?$" and fixed_prefix("src/a/b*/c") == "src/a"


def test_paths(spark):
    one = spark.createDataFrame([("src/a/b.test.ts",), (".env",), ("x.ts",), ("node_modules/@s/p/node_modules/q/i.js",)], "p string")
    got = one.select(ft.dirname(F.col("p")), ft.base_of(ft.basename(F.col("p"))), ft.npm_package(F.col("p")), ft.resolved(ft.dirname(F.col("p")), F.lit("../x/./y"))).collect()
    assert [tuple(r) for r in got] == [("src/a", "b.test", None, "src/x/y"), ("", ".env", None, "x/y"), ("", "x", None, "x/y"), ("node_modules/@s/p/node_modules/q", "i", "q", "node_modules/@s/p/node_modules/x/y")]


def test_scalars(spark):
    row = spark.range(1).select(ft.fnv1a(F.lit("foobar")), ft.fnv1a_ascii(F.lit("foobar")), ft.fnv1a(F.lit("é😀")), ft.round_measure(F.lit(-0.0000005)), ft.duration_ms(F.lit("2d")), ft.duration_ms(F.lit("2x")), ft.singular(F.lit("policies")), ft.stereotype(F.lit("a.b.ts")), ft.non_blank_lines(F.lit("a\n \n\nb")), ft.number_of(F.lit(" 1e3 ")))
    a, b, c, r, d, e, s, t, n, x = row.first()
    assert a == b == "bf9cf968" and len(c) == 8 and r == 0.0 and d == 172_800_000 and e is None and s == "policy" and t == "*.b.ts" and n == 2 and x == 1000.0


def test_nan_is_never_breached(spark):
    rows = spark.createDataFrame([("down", 1.0, float("nan")), ("down", 1.0, 2.0), ("up", 1.0, 2.0), ("up", 1.0, 1.4)], "d string, l double, v double")
    assert [r[0] for r in rows.select(M.standing(F.col("d"), F.col("l"), F.lit(0.5), F.col("v"))).collect()] == ["within", "breached", "surpassed", "within"]


# -- graph -------------------------------------------------------------------------------------------------------------


def random_graph(spark, seed, n=14, m=22):
    rnd = random.Random(seed)
    e = list({(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(m)})
    return [f"n{i:02}" for i in range(n)], e, spark.createDataFrame([(f"n{i:02}",) for i in range(n)], "node string"), spark.createDataFrame(e, "src string, dst string")


def test_distributed_graph_agrees_with_local(spark):
    _, _, nodes, edges = random_graph(spark, 3)
    assert values(G.strong_components(nodes, edges)) == values(G.strong_components(nodes, edges, most_local=0))
    assert values(G.heights(nodes, edges)) == values(G.heights(nodes, edges, most_local=0))
    origins = nodes.select(F.col("node").alias("origin"))
    assert values(G.reach(edges, origins, ["n03"])) == values(G.reach(edges, origins, ["n03"], most_local=0))


def test_literal_graphs(spark):
    def cycles(*e):
        edges = spark.createDataFrame(list(e), "src string, dst string")
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        return sorted(tuple(r["members"]) for r in G.cycles(nodes, edges).collect())

    assert cycles(("a", "b"), ("b", "c"), ("c", "a"), ("c", "leaf")) == [("a", "b", "c")]
    assert cycles(("a", "a"), ("a", "b")) == [("a",)]
    assert cycles(("a", "b"), ("b", "a"), ("x", "y"), ("y", "x")) == [("a", "b"), ("x", "y")]
    edges = spark.createDataFrame([("src/a", "out/b"), ("out/b", "src/a")], "src string, dst string")
    nodes = spark.createDataFrame([("src/a",), ("out/b",)], "node string")
    assert G.cycle_violations(nodes, edges, "c", "", ["^src/"]).isEmpty()
    assert G.orphan_violations(nodes, edges, "o", "", ["^src/"]).isEmpty()  # an importer out of scope counts


def test_route_is_the_first_queued(spark):
    edges = spark.createDataFrame([("o", "b"), ("o", "a"), ("a", "z"), ("b", "y"), ("a", "y"), ("y", "t"), ("z", "t")], "src string, dst string")
    got = {r["node"]: r["route"] for r in G.reach(edges, spark.createDataFrame([("o",)], "origin string")).collect()}
    assert got["t"] == ["o", "a", "y", "t"] and "o" not in got


def test_groups(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["root"] for r in G.groups(pairs).collect()} == {0, 100}


# -- detectors ---------------------------------------------------------------------------------------------------------


def test_a_stopped_all_sources_no_candidates(spark):
    f = spark.createDataFrame([("a.ts", "x"), ("b.ts", "y")], "path string, text string")
    decl = spark.createDataFrame([(p, k, k) for p in ("a.ts", "b.ts") for k in ("One", "Two")], "path string, key string, anchor string")
    leaf = lambda *n: D.Term("members", rows=decl, names=[f"^{x}$" for x in n], level="declaration")
    only_a = D.Term("path", file=["^a"])
    got = D.candidates(f, D.all_of(only_a, D.none_of(leaf("One"))), "declaration")
    assert values(got.select("path", "key")) == []  # a negated leaf sources only its own candidates, which then fail
    got = D.candidates(f, D.all_of(only_a, leaf("One", "Two"), D.none_of(leaf("One"))), "declaration")
    assert values(got.select("path", "key")) == [("a.ts", "Two")]
    got = D.candidates(f, D.any_of(D.all_of(only_a, leaf("One")), leaf("Two")), "declaration")
    assert values(got.select("path", "key")) == [("a.ts", "One"), ("a.ts", "Two"), ("b.ts", "Two")]
    assert D.candidates(f, D.none_of(only_a), "match").isEmpty()


def test_detector_trees_at_the_file_unit(spark):
    f = spark.createDataFrame([(f"{a}{b}.ts", f"{'x' * a}\n{'y' * b}") for a, b in itertools.product(range(2), range(2))], "path string, text string")
    x, y = D.Term("content", pattern="^x$"), D.Term("content", pattern="^y$")
    assert [r[0] for r in D.file_hits(f, D.all_of(x, D.none_of(y))).collect()] == ["10.ts"]
    assert D.file_hits(f, D.any_of(x, y)).count() == 3
    assert D.truth_table(f, D.any_of(x, y)).filter("holds").count() == 4
    paths = spark.createDataFrame([("10.test.ts",)], "path string")
    assert [r[0] for r in D.file_hits(f, D.Term("requires", requires=["{base}.test.ts"]), paths).collect()] == ["10.ts"]


def test_ordinals(spark):
    rows = spark.createDataFrame([("f", "k", i) for i in range(3)] + [("f", "j", 0)], "path string, key string, ord int")
    assert {r["unique_key"] for r in D.unique_keys(rows, ["path"], "key", ["ord"]).collect()} == {"k", "k~2", "k~3", "j"}


# -- ledgers -----------------------------------------------------------------------------------------------------------


def plain_reconcile(holdouts, entries):
    anchor = lambda e: e[: e.rindex("#")] if "#" in e else e[:-1]
    content = lambda e: None if e.count("#") < 2 else e[: e.index("#")] + "#" + e[e.rindex("#") + 1 :]
    known, now = set(holdouts), set(entries)
    out = [(e, "ledgered", None) for e in entries if e in known]
    left, stale = [e for e in entries if e not in known], [h for h in holdouts if h not in now]
    for key in (anchor, content):
        queue, rest = {}, []
        for h in stale:
            if key(h) is not None:
                queue.setdefault(key(h), []).append(h)
        paired = set()
        for e in left:
            if key(e) is not None and queue.get(key(e)):
                was = queue[key(e)].pop(0)
                paired.add(was)
                out.append((e, "drifted", was))
            else:
                rest.append(e)
        left, stale = rest, [h for h in stale if h not in paired]
    return sorted([*out, *((e, "unrecorded", None) for e in left), *((h, "stale", None) for h in stale)], key=str)


def test_reconcile_pairs_in_order(spark):
    rnd = random.Random(6)
    for _ in range(3):
        pool = [f"f{rnd.randrange(2)}#d{rnd.randrange(3)}#{rnd.randrange(5)}" for _ in range(40)] + ["plain"]
        old, new = list(dict.fromkeys(rnd.sample(pool, 14))), list(dict.fromkeys(rnd.sample(pool, 14)))
        table = lambda xs: spark.createDataFrame([("o", "s", e, i) for i, e in enumerate(xs)], "objective string, sector string, entry string, ord int")
        got = C.reconcile(table(old), table(new), "match").select("entry", "state", "was")
        assert sorted(map(tuple, got.collect()), key=str) == plain_reconcile(old, new)


def test_clear_twice_changes_nothing(spark):
    rows = lambda xs: spark.createDataFrame([("o", "s", e, i) for i, e in enumerate(xs)], "objective string, sector string, entry string, ord int")
    empty = spark.createDataFrame([], "objective string, sector string, entered string, initial double, cleared double, closed double, last_cleared string, holdouts array<string>")
    none = empty.select("objective", "sector")
    first = C.cleared(empty, C.reconcile(rows(["x"]).limit(0), rows(["a", "b"])), none, "t1")
    held = lambda l: l.select("objective", "sector", F.posexplode("holdouts").alias("ord", "entry"))
    again = C.cleared(first, C.reconcile(held(first), rows(["a", "b"])), none, "t2")
    assert values(first) == values(again)
    less = C.cleared(first, C.reconcile(held(first), rows(["b", "c"])), none, "t3").first()
    assert (less["cleared"], less["holdouts"], less["last_cleared"], less["initial"]) == (1.0, ["b"], "t3", 2.0)
    shut = C.cleared(first, C.reconcile(held(first), rows(["a"])), first.select("objective", "sector"), "t4").first()
    assert (shut["closed"], shut["holdouts"]) == (2.0, [])
    new, receipts = C.conceded(first, C.reconcile(held(first), rows(["a", "b", "z"])), "t5", "me", "why")
    assert values(new) == [("o", "s", "z")] and receipts.first()["delta"] == 1.0


def test_measure_ledger(spark):
    schema = "sector string, direction string, entered string, initial double, recorded double, improved double, closed double, last_improved string, value double, inside boolean"
    nan = float("nan")
    rows = [
        ("new", "down", None, None, None, None, None, None, 5.0, True),
        ("better", "down", "t0", 9.0, 9.0, 0.0, None, "t0", 4.0, True),
        ("near", "down", "t0", 9.0, 9.0, 0.0, None, "t0", 8.9, True),
        ("left", "down", "t0", 9.0, 9.0, 0.0, None, "t0", nan, False),
        ("back", "up", "t0", 1.0, 1.0, 0.0, 1.0, "t0", 3.0, True),
        ("unmeasured", "up", None, None, None, None, None, None, nan, True),
    ]
    df = spark.createDataFrame(rows, schema).withColumn("objective", F.lit("o"))
    records, moved = C.cleared_measure(df, F.lit(0.5), "t1")
    got = {r["sector"]: (r["initial"], r["recorded"], r["improved"], r["closed"]) for r in records.collect()}
    assert got == {"new": (5.0, 5.0, 0.0, None), "better": (9.0, 4.0, 5.0, None), "near": (9.0, 9.0, 0.0, None), "left": (9.0, 9.0, 0.0, 9.0), "back": (1.0, 3.0, 0.0, None)}
    assert [(r["sector"], r["from"], r["to"], r["at"]) for r in moved.collect()] == [("back", 1.0, 3.0, "t1")]
    receipts = moved.withColumn("direction", F.lit("up"))
    assert {r["sector"]: r["holds"] for r in C.measure_arithmetic(records, receipts).collect()} == dict.fromkeys(got, True)
    assert not C.measure_arithmetic(records.filter("sector = 'back'"), receipts.limit(0)).first()["holds"]
    held, grown = C.conceded_measure(records.withColumn("value", F.lit(6.0)), "t2", "me", "why")
    assert {r["sector"]: r["recorded"] for r in held.collect()} == {"new": 6.0, "better": 6.0, "near": 6.0, "left": 9.0, "back": 6.0} and grown.count() == 4
    assert [tuple(r) for r in C.measure_totals(records).collect()] == [("o", 19.0 + 2.0, "t1")]
    goals = records.withColumn("target", F.when(F.col("direction") == "down", 2.0))
    done = {(r["objective"], r["progress"]) for r in C.measure_progress(goals.filter("direction = 'down'")).collect()}
    assert done == {("o", 1 - (18.0 - 6.0) / (23.0 - 6.0))}  # open: new, better, near
    assert {r["sector"]: r["p"] for r in goals.select("sector", C.measure_sector_progress().alias("p")).collect()} == {"new": 0.0, "better": 5 / 7, "near": 0.0, "left": 0.0, "back": 0.0}


def test_rebaselined(spark):
    rows = lambda xs: spark.createDataFrame([("o", *x) for x in xs], "objective string, sector string, entry string")
    holdouts, receipts = C.rebaselined(rows([("s", "a"), ("s", "b"), ("t", "x"), ("u", "y")]), rows([("s", "b"), ("s", "c"), ("s", "d"), ("t", "x")]), "t1", "me", "phase p changed")
    assert sorted(tuple(r)[1:] for r in holdouts.collect()) == [("s", "b"), ("s", "c"), ("s", "d"), ("t", "x")]
    assert sorted((r["sector"], r["from"], r["to"], r["reason"]) for r in receipts.collect()) == [("s", 2, 3, "phase p changed"), ("u", 1, 0, "phase p changed")]


def test_plans(spark):
    plan = lambda rows: spark.createDataFrame([(p, i, *x) for i, (p, *x) in enumerate(rows)], "phase string, ord int, hash string, defined boolean, concessions int")
    assert C.common_order(list("abc"), list("bac")) == ("b", "c") and C.common_order(list("abcd"), list("dcab")) == ("a", "b")
    for one, two in itertools.product(itertools.permutations("abcd"), repeat=2):
        kept = C.common_order(list(one), list(two))
        assert all(tuple(x for x in way if x in kept) == kept for way in (one, two))
        assert len(kept) == max(len(c) for n in range(5) for c in itertools.combinations(one, n) if tuple(x for x in two if x in c) == c)
    was = plan([("a", "1", True, 0), ("b", "2", True, 0), ("c", "3", True, 0), ("gone", "4", True, 0), ("last", "9", False, 0)])
    now = plan([("b", "2", True, 0), ("a", "1", True, 1), ("c", "5", True, 0), ("new", "7", True, 0), ("last", "8", False, 0)])
    assert {tuple(r) for r in C.plan_diff(was, now).collect()} == {("a", "changed"), ("c", "unreceipted"), ("gone", "unreceipted"), ("new", "refined"), ("last", "refined")}
    assert C.plan_diff(None, now).isEmpty()
    first = was.withColumn("placed", F.when(F.col("phase") == "c", F.lit("3")))
    assert ("c", "unreceipted") not in {tuple(r) for r in C.plan_diff(first, now).collect()}


# -- policies ----------------------------------------------------------------------------------------------------------

MANIFEST = """
aliases: {"@app": src/app}
defs:
  base: {external: [zod], allow: "@app/shared/**"}
exports:
  - {name: bus, message: m, module: "@app/infra/bus.ts", symbols: [makeBus], except: "@app/main.ts"}
graph:
  cycles: [{name: c, message: m, within: "src/**"}]
tree:
  src/app/:
    children:
      main.ts: {imports: {allow: "src/**"}}
      shared/: {layout: open, imports: {allow: "@app/shared/**"}}
      "{feature}/":
        imports: {use: base, deny: [{match: "@app/infra/**", message: no infra}]}
        children:
          "*.handler.ts": {requires: ["{base}.test.ts"], name: kebab-case}
          "*.handler.test.ts": {}
          "index.ts": {}
"""


def test_manifest(spark):
    p = P.load(MANIFEST)
    assert not P.failing_probes(p) and [r.name for r in p.exports] == ["bus"]
    allow = next(r for r in p.imports if r.name.endswith("{feature}/imports"))
    assert {a.fragment for a in allow.allowances} == {"base"} and allow.externals == ["zod"]
    edge = lambda a, b: (a, b, "local", None)
    rows = [edge("src/app/pay/x.handler.ts", "src/app/shared/u.ts"), edge("src/app/pay/x.handler.ts", "src/app/infra/db.ts"), edge("src/app/shared/u.ts", "src/app/pay/index.ts"), edge("src/app/main.ts", "src/app/pay/index.ts")]
    found = fam.import_violations(spark.createDataFrame(rows, "path string, target_path string, target_kind string, target_package string"), rule_table(spark, p.imports))
    assert sorted((r["file"], r["rule_name"].rpartition("/")[2]) for r in found.collect()) == [("src/app/pay/x.handler.ts", "deny-0"), ("src/app/pay/x.handler.ts", "imports"), ("src/app/shared/u.ts", "imports")]
    f = spark.createDataFrame([("src/app/pay/x.handler.ts",), ("src/app/pay/stray.ts",), ("src/app/shared/any.ts",), ("src/app/pay/BadName.handler.ts",)], "path string")
    assert [r["subject"] for r in fam.layout_violations(f, rule_table(spark, p.folders)).collect()] == ["stray.ts"]
    assert "BadName" in [r["subject"] for r in fam.naming_violations(f, rule_table(spark, p.naming)).collect()]


@pytest.mark.parametrize(
    "text",
    [
        "tree: {src/: {imports: {}}}",
        "tree: {src/: {wrong: 1}}",
        "wrong: 1",
        "defs: {a: {use: a}}\ntree: {src/: {use: a}}",
        "tree: {src/: {partial: true}}\nlimits: {partial: 0}",
        'tree: {src/: {children: {"*.a.ts": {imports: {allow: "x/**"}}, "{x}.a.ts": {imports: {allow: "x/**"}}}}}',
        'tree: {src/: {imports: {allow: "**", deny: [{match: "lib/**", matchNot: "lib/**", message: m}]}}}',
    ],
)
def test_bad_manifests_are_refused(text):
    with pytest.raises(P.Refused):
        P.load(text)


def test_includes():
    texts = {"sub/part.json": '{"allow": "src/**"}', "loop.json": '{"include": "loop.json"}'}
    p = P.load('{"tree": {"src/": {"imports": {"include": "sub/part.json"}}}}', "architecture.json", texts.__getitem__)
    assert p.imports[0].to_not
    with pytest.raises(P.Refused):
        P.load('{"tree": {"include": "loop.json"}}', "architecture.json", texts.__getitem__)


def test_an_inferred_policy_checks_clean(spark, planted):
    p = P.load(api.inferred_manifest(planted), "architecture.json")
    local = planted.observed.filter("target_kind = 'local'")
    assert p.imports and fam.import_violations(local, rule_table(spark, p.imports)).isEmpty()


def test_snapshot_and_atlas(planted):
    doc = api.snapshot(planted, policy()).first()[0]
    assert '"version":2' in doc and '"ok":false' in doc
    p = P.Policy(imports=[ImportRule("stem", "", ["^plant/stem/"], [], [], ["^plant/(stem|root)/"], allowances=[api_allow("stem", "^plant/(stem|root)/")])])
    verdicts = {(r["path"], r["target_path"]): (r["verdict"], r["admitted_by"]) for r in api.atlas_edges(planted, p).collect()}
    assert verdicts[at("stem", 0), at("root", 0)] == ("allowed", "stem") and verdicts[at("leaf", 0), at("leaf", 1)] == ("ungoverned", None)
    assert verdicts[at("stem", 1), at("leaf", 4)][0] == "refused"


def api_allow(node, pattern):
    from girder.plans.rules import Allowance

    return Allowance(node, "allow", node, pattern)


# -- sources -----------------------------------------------------------------------------------------------------------

CODE = """import def, { a as b, type C } from './x.js';
import * as ns from "pkg/sub"; import './side';
import eq = require('old');
export { one, two as three } from "./again";
export * from './all';
export const V = 1; export default class Foo { bar(): void { call(x.y()); } readonly baz = 2; constructor() {} }
export interface Shape { find(): void; name?: string }
type T = { left: number } & { right: string };
const lazy = () => import(`./lazy`); const c = require("cjs"); import(computed);
"""


def test_extractor(spark):
    specifiers, bindings, members, exports = extract.facts_of_text(CODE, "a.ts")
    assert specifiers == ["./x.js", "pkg/sub", "./side", "old", "./again", "./all", "./lazy", "cjs"]
    assert [(b["specifier"], b["symbol"], b["kind"], b["local"]) for b in bindings] == [("./x.js", "default", "default", "def"), ("./x.js", "a", "named", "b"), ("./x.js", "C", "named", "C"), ("pkg/sub", "*", "namespace", "ns"), ("old", "default", "default", "eq"), ("./again", "one", "named", None), ("./again", "two", "named", None), ("./all", "*", "namespace", None)]
    assert [(e["name"], e["kind"], e["declares"], e["reexport"]) for e in exports] == [("one", "named", "other", True), ("three", "named", "other", True), ("*", "namespace", "other", True), ("V", "named", "variable", False), ("default", "default", "class", False), ("Shape", "named", "interface", False)]
    declared = [(m["name"], m["in_decl"]) for m in members if m["subject"] == "members"]
    assert declared == [("bar", "Foo"), ("baz", "Foo"), ("find", "Shape"), ("name", "Shape"), ("left", "T"), ("right", "T")]
    assert {m["name"] for m in members if m["subject"] == "calls"} >= {"call", "y"}
    padded = extract.facts_of_text(CODE.replace("\n", "\n\n  "), "a.ts")
    assert padded == (specifiers, bindings, members, exports)
    assert extract.facts_of_text("<p>import 'no'</p><script>import y from './yes'</script>", "a.svelte")[0] == ["./yes"]
    nested = extract.facts(spark.createDataFrame([("a.ts", CODE), ("b.ts", None), ("c.ts", "export {")], "path string, text string"))
    assert extract.imports_of(nested).count() == 8 and extract.exploded(nested, "export_sites").filter("path = 'a.ts'").count() == 6


def test_scan_and_resolution(spark, tmp_path):
    for p, t in {"src/a.ts": "import './b.js'; import './sub'; import 'zod'; import 'node:fs'; import './gone'", "src/b.ts": "", "src/sub/index.ts": "", "src/x.d.ts": "", "node_modules/zod/i.ts": "", "src/read me.ts": "", "src/n.txt": ""}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    f = files.source_files(spark, str(tmp_path))
    assert [r[0] for r in f.select("path").orderBy("path").collect()] == ["src/a.ts", "src/b.ts", "src/read me.ts", "src/sub/index.ts"]
    packages = spark.createDataFrame([("zod", "node_modules/zod/i.js")], "package string, target_path string")
    got = files.resolved_imports(extract.imports_of(extract.facts(f)), files.all_paths(f), packages)
    assert {r["specifier"]: (r["target_path"], r["target_kind"]) for r in got.collect()} == {"./b.js": ("src/b.ts", "local"), "./sub": ("src/sub/index.ts", "local"), "zod": ("node_modules/zod/i.js", "external"), "node:fs": ("node:fs", "builtin"), "./gone": (None, None)}


def test_packages(spark):
    f = spark.createDataFrame([("p/one/project.json", '{"name": "n1"}'), ("p/two/project.json", "{}"), ("p/two/package.json", '{"name": "n2"}'), ("p/three/project.json", "{}"), ("p/one/src/x.ts", "")], "path string, text string")
    assert values(files.workspace_projects(f)) == [("p/one", "n1"), ("p/three", "three"), ("p/two", "n2")]
    assert values(files.package_roots(files.all_paths(f), "project.json")) == [("p/one", "p/one/src"), ("p/three", None), ("p/two", None)]


def test_reports(spark):
    one = lambda t: spark.createDataFrame([(t,)], "text string")
    assert values(reports.parsed(one("a.ts(3,5): error TS22: bad\nx\n"), "tsc")) == [("a.ts", 2, 4, "TS22", "bad")]
    ox = '{"diagnostics": [{"filename": "a", "code": "c", "message": "m\\nn", "labels": [{"span": {"line": 2, "column": 3}}]}, {"filename": "b", "message": "q", "labels": []}]}'
    assert values(reports.parsed(one(ox), "oxlint")) == [("a", 1, 2, "c", "m"), ("b", 0, 0, "", "q")]
    assert values(reports.unique(reports.parsed(one("f:7\nf:7"), "regex", r"^(?<file>\w+):(?<line>\d+)$"))) == [("f", 6, 0, "", "")]
    with pytest.raises(ValueError):
        reports.by_regex(one(""), "(?<file>x)")


DIFF = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@ f\n+a\n@@ -9 +12,0 @@\ndiff --git a/g b/g\ndeleted file mode 1\n--- a/g\n+++ /dev/null\n@@ -1 +0,0 @@\n-z\ndiff --git a/n b/n\nnew file mode 1\n"


def test_diffs(spark):
    hunks, changed = reports.diff(spark.createDataFrame([(DIFF,)], "text string"))
    assert values(hunks) == [("n", 1, 1), ("x", 12, 12), ("x", 3, 6)] and values(changed) == [("g", "deleted"), ("n", "added")]
    assert reports.with_untracked(hunks, spark.createDataFrame([("u",)], "path string")).filter("path = 'u'").first()["hunk_end"] == 2**53 - 1


def test_documents(spark, tmp_path):
    (tmp_path / "bad.json").write_text("{nope")
    assert documents.read_baseline(spark, str(tmp_path / "bad.json")).isEmpty()
    (tmp_path / "good.json").write_text(documents.baseline_document(["b", "a", "b"]))
    assert values(documents.read_baseline(spark, str(tmp_path / "good.json"))) == [("a",), ("b",)]
    d = tmp_path / "ledgers"
    d.mkdir()
    (d / "obj.json").write_text('{"version": 2, "kind": "holdouts", "created": "t", "sectors": {"s": {"entered": "t", "initial": 2, "cleared": 1, "closed": 0, "lastCleared": "t", "holdouts": ["a"]}}, "concessions": []}')
    sectors, held, given = documents.read_ledgers(spark, str(d / "obj.json"))
    assert sectors.first()["cleared"] == 1.0 and values(held) == [("obj", "s", 0, "a")] and given.isEmpty()
    (d / "odd.json").write_text('{"version": 2, "extra": 1}')
    with pytest.raises(documents.Refused):
        documents.read_ledgers(spark, str(d))
    assert documents.canonical_digest({"b": 1, "a": [2]}) == documents.canonical_digest({"a": [2], "b": 1})


def test_similar_siblings(spark):
    t = spark.createDataFrame([("p", n, x) for n, xs in {"a": "xyz", "b": "xy", "c": "q"}.items() for x in xs], "parent string, node string, trait string")
    assert [(r["a"], r["b"]) for r in I.similar_pairs(t, "parent", "node", "trait").collect()] == [("a", "b")]
    assert I.collapsed({"p": ["p/a", "p/b"]}, {"p/a": frozenset("x"), "p/b": frozenset("x")}) == {"p": frozenset("x")}


# -- feeds -------------------------------------------------------------------------------------------------------------


def test_sessions_as_a_stream_and_as_a_batch(spark, tmp_path):
    rows = [("r", f"2024-01-01 00:00:{s:02}.{ms:03}", p) for s, ms, p in ((0, 0, "b"), (0, 100, "a"), (0, 240, "b"), (5, 0, "c"))] + [("r", "2024-01-02 00:00:00", "end")]
    table = spark.createDataFrame(rows, "repo string, t string, path string").select("repo", F.to_timestamp("t").alias("ts"), "path")
    batch = feed.sessions(table, "150 milliseconds", ["repo"])
    assert [r["paths"] for r in batch.orderBy("session_start").collect()] == [["a", "b"], ["c"], ["end"]]
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    out = feed.sessions(stream, "150 milliseconds", ["repo"], late="1 second")
    q = out.writeStream.format("memory").queryName("feed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r["paths"]) for r in spark.table("feed").collect()}
    assert got <= {("a", "b"), ("c",), ("end",)} and ("a", "b") in got
    assert [r[0] for r in spark.createDataFrame([("a.ts",), ("dist/a.ts",), ("x.md",), ("architecture.yaml",)], "p string").filter(feed.is_relevant(F.col("p"))).collect()] == ["a.ts", "architecture.yaml"]
