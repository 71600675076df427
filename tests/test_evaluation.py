"""Campaigns over sectors: perimeters, evaluation, and the verbs that write ledgers."""

import pytest
from pyspark.sql import functions as F

from girder.operators import evaluation as E
from girder.operators import records as R
from girder.operators import sectors as S
from girder.sources import history as H

RECORD = f"sector string, reached int, since string, attested {R.ATTESTED}, notes array<struct<text:string,by:string,at:string>>"
LEDGER = "objective string, sector string, entered string, initial double, cleared double, closed double, last_cleared string, holdouts array<string>"


def files(spark, *paths):
    return spark.createDataFrame([(p,) for p in paths], "path string")


def placed(sectors):
    return {r["path"]: r["sector"] for r in sectors.files.collect()}


def test_perimeters(spark):
    tree = files(spark, "a/x.ts", "a/b/y.ts", "c/z.ts", "lib/s.ts", "top.ts")
    assert set(placed(S.discovered(tree, S.Perimeter())).values()) == {"scope"}
    assert placed(S.discovered(tree, S.Perimeter("file")))["a/b/y.ts"] == "a/b/y"
    globbed = placed(S.discovered(tree, S.Perimeter("glob", ["^a/b/", "^[^/]+/"]), shared=["^lib/"], legacy=["^top"]))
    assert globbed == {"a/x.ts": "a", "a/b/y.ts": "a/b", "c/z.ts": "c", "lib/s.ts": "shared", "top.ts": "legacy"}
    projects = spark.createDataFrame([("web", "a"), ("inner", "a/b")], "sector string, root string")
    nx = S.discovered(tree, S.Perimeter("project", rows=projects), legacy=[], scope=["/"])
    assert placed(nx) == {"a/x.ts": "web", "a/b/y.ts": "inner"}
    assert {r["path"] for r in nx.files.filter("drift").collect()} == {"a/b/y.ts"}
    with pytest.raises(ValueError):
        S.claims(tree, S.Perimeter("moon"))


def test_declarations_as_sectors(spark):
    tree = files(spark, "a/x.ts", "a/y.ts", "a/z.ts")
    anchors = spark.createDataFrame([("a/x.ts", "One"), ("a/x.ts", "Two"), ("a/y.ts", "Only")], "path string, anchor string")
    perimeter = S.Perimeter("match", rows=anchors)
    sectors = S.discovered(tree, perimeter)
    hits = spark.createDataFrame([("a/x.ts", "Two#ab"), ("a/x.ts", "Other#ab"), ("a/x.ts", None), ("a/y.ts", None), ("a/z.ts", "One#ab")], "path string, subject string")
    got = sorted((r["path"], str(r["subject"]), r["sector"], r["root"]) for r in S.hit_sectors(hits, sectors, perimeter).collect())
    assert got == [("a/x.ts", "None", "legacy", ""), ("a/x.ts", "Other#ab", "legacy", ""), ("a/x.ts", "Two#ab", "a/x.ts#Two", "a"), ("a/y.ts", "None", "a/y.ts#Only", "a"), ("a/z.ts", "One#ab", "legacy", "")]


def test_one_file(spark):
    tree, glob = files(spark, "a/x.ts", "b/y.ts"), S.Perimeter("glob", ["^a/"])
    assert [tuple(r) for r in S.membership("a/x.ts", tree, glob).collect()] == [("a/x.ts", "a", "a")]
    assert [tuple(r) for r in S.membership("b/y.ts", tree, glob).collect()] == [("b/y.ts", "legacy", "")]
    assert S.membership("b/y.ts", tree, glob, legacy=[]).count() == 0


def test_terms_of_sectors(spark):
    sectors = S.discovered(files(spark, "a/x.ts", "a/y.ts", "b/z.ts"), S.Perimeter("glob", ["^[^/]+/"]))
    names = lambda df: sorted(r["sector"] for r in df.collect())
    assert names(S.lacking(sectors, files(spark, "a/y.ts"))) == ["b"]
    assert names(S.off_host(sectors, ["^a/"])) == ["b"]
    assert names(S.spread_out(sectors)) == []
    owns = spark.createDataFrame([("a/m.json", "m", [("^b/", "b")])], "marker string, sector string, owns array<struct<pattern:string,root:string>>")
    assert names(S.spread_out(S.discovered(files(spark, "b/z.ts", "a/m.json"), S.Perimeter("marker", rows=owns)))) == ["m"]
    assert [r["entry"] for r in E.sector_hits(S.lacking(sectors, files(spark, "a/y.ts")), "has").collect()] == ["~"]


@pytest.fixture(scope="module")
def plan(spark):
    phases = spark.createDataFrame([(0, "fix", ["lint"], False, False), (1, "agree", [], True, False), (2, "shrink", ["size", "debt"], False, False)], "ord int, phase string, objectives array<string>, attested boolean, open boolean")
    objectives = spark.createDataFrame([("lint", None, False, False, "down", None), ("size", None, False, True, "down", 10.0), ("debt", None, False, False, "down", None)], "objective string, until string, over_shared boolean, measured boolean, direction string, target double")
    return E.Plan(phases, objectives)


@pytest.fixture(scope="module")
def sectors(spark):
    return S.discovered(files(spark, "a/x.ts", "b/y.ts", "c/z.ts"), S.Perimeter("glob", ["^[^/]+/"]))


@pytest.fixture(scope="module")
def records(spark):
    agreed = [("agree", "me", "t0", "met", None, None)]
    return spark.createDataFrame([("a", 0, "t0", [], []), ("b", 2, "t0", agreed, [])], RECORD)


HIT = "objective string, sector string, path string, entry string"


@pytest.fixture(scope="module")
def evaluation(spark, sectors, plan, records):
    hits = spark.createDataFrame([("lint", "a", "a/x.ts", "x.ts"), ("debt", "b", "b/y.ts", "y.ts"), ("debt", "c", "c/z.ts", "z.ts")], HIT)
    values = spark.createDataFrame([("size", "b", 14.0), ("size", "c", float("nan"))], "objective string, sector string, value double")
    return E.evaluated(sectors, plan, hits, records, values)


def test_evaluated(evaluation, plan):
    rows = {(r["sector"], r["objective"]): r for r in evaluation.states.collect()}
    assert len(rows) == 9
    assert {s: rows[s, "lint"]["phase_at"] for s in "abc"} == {"a": 0, "b": 2, "c": 1}  # c has met lint, and nobody agreed
    assert {s: rows[s, "size"]["n"] for s in "abc"} == {"a": 0.0, "b": 4.0, "c": 1.0}
    assert {(s, o) for (s, o), r in rows.items() if r["inside"]} == {("a", "lint"), ("b", "lint"), ("c", "lint"), ("b", "size"), ("b", "debt")}
    assert {(s, o) for (s, o), r in rows.items() if r["behind"]} == {(s, o) for s in "ac" for o in ("size", "debt")}
    assert sorted(tuple(r) for r in E.counted(evaluation).select("objective", "sector").collect()) == [("debt", "b"), ("lint", "a")]
    assert sorted(tuple(r) for r in E.toward_next(evaluation, plan).collect()) == [("a", "lint", 1.0), ("b", "debt", 1.0), ("b", "size", 4.0)]


def test_parts(spark, sectors):
    parts = spark.createDataFrame([("size", "a/x.ts", 3.0, 1.0), ("size", "gone.ts", 9.0, 1.0)], "objective string, path string, of double, per double")
    assert [tuple(r) for r in E.summed_parts(parts, sectors).collect()] == [("size", "a", 3.0, 1.0)]


def test_clear_and_records(spark, evaluation, records, plan):
    ledger = spark.createDataFrame([("lint", "a", "t0", 2.0, 0.0, 0.0, "t0", ["gone.ts", "x.ts"]), ("debt", "c", "t0", 1.0, 0.0, 0.0, "t0", ["old.ts"]), ("lint", "lost", "t0", 1.0, 0.0, 0.0, "t0", ["q.ts"])], LEDGER)
    out, receipts, outcomes = E.cleared(evaluation, ledger, "t1")
    rows = {(r["objective"], r["sector"]): (r["initial"], r["cleared"], r["closed"], r["last_cleared"], r["holdouts"]) for r in out.collect()}
    assert rows == {
        ("lint", "a"): (2.0, 1.0, 0.0, "t1", ["x.ts"]),
        ("lint", "b"): (0.0, 0.0, 0.0, "t1", []),
        ("lint", "c"): (0.0, 0.0, 0.0, "t1", []),
        ("lint", "lost"): (1.0, 0.0, 1.0, "t0", []),  # a sector that is gone is past every window
        ("debt", "b"): (1.0, 0.0, 0.0, "t1", ["y.ts"]),
        ("debt", "c"): (1.0, 0.0, 0.0, "t0", ["old.ts"]),  # behind its window: held
    }
    assert receipts.count() == 0
    assert {r["objective"]: (r["cleared"], r["closed"], r["entered"], r["rebaselined"], r["left"]) for r in outcomes.collect()} == {"lint": (1.0, 1.0, 2, 0, 1), "debt": (0.0, 0.0, 1, 0, 2)}
    again, _, _ = E.cleared(evaluation, out, "t2")
    assert {(r["objective"], r["sector"]): tuple(r[2:]) for r in again.collect()} == {(r["objective"], r["sector"]): tuple(r[2:]) for r in out.collect()}
    held, receipts, _ = E.cleared(evaluation, ledger, "t1", receipted=("lint",), reason="asks for more")
    assert {(r["objective"], r["sector"]): r["holdouts"] for r in held.collect()}["lint", "a"] == ["x.ts"]
    assert [(r["sector"], r["from"], r["to"], r["reason"]) for r in receipts.collect()] == [("a", 2, 1, "asks for more")]
    after = {r["sector"]: (r["reached"], r["since"]) for r in E.advanced(evaluation, records, "t1").collect()}
    assert after == {"a": (0, "t0"), "b": (2, "t0"), "c": (1, "t1")}


def test_ledger_phase_and_moves(spark, evaluation, records, plan):
    ledger = spark.createDataFrame([("lint", "a", "t0", 1.0, 1.0, 0.0, "t0", []), ("lint", "b", "t0", 1.0, 0.0, 0.0, "t0", ["y.ts"])], LEDGER)
    at = E.ledger_phase(records, ledger, plan)
    assert {r["sector"]: r["phase_at"] for r in at.collect()} == {"a": 1, "b": 0}
    moved = {r["sector"]: (r["was"], r["now"], r["back"], r["passed"]) for r in E.moves(evaluation, records, at, plan).collect()}
    assert moved == {"a": (1, 0, True, []), "b": (0, 2, False, ["agree"])}


def test_concede_sends_back(spark, sectors, plan, records):
    hits = spark.createDataFrame([("lint", "b", "b/y.ts", "y.ts"), ("lint", "b", "b/y.ts", "w.ts")], HIT)
    e = E.evaluated(sectors, plan, hits, records)
    ledger = spark.createDataFrame([("lint", "b", "t0", 0.0, 0.0, 0.0, "t0", []), ("debt", "b", "t0", 1.0, 0.0, 0.0, "t0", ["k.ts"])], LEDGER)
    wanted = spark.createDataFrame([("lint", "b", "y.ts")], "objective string, sector string, entry string")
    after, receipts, left, sent = E.conceded(e, ledger, records, plan, "lint", "t1", "me", "it grew", wanted)
    assert {(r["objective"], r["sector"]): r["holdouts"] for r in after.collect()} == {("lint", "b"): ["y.ts"], ("debt", "b"): ["k.ts"]}
    assert [(r["sector"], r["delta"], r["holdouts"], r["kind"]) for r in receipts.collect()] == [("b", 1.0, ["y.ts"], "growth")]
    assert [tuple(r) for r in sent.collect()] == [("b", 2, 0, ["agree"])]
    assert {r["sector"]: [a["revoked"]["reason"] for a in r["attested"]] for r in left.collect()} == {"a": [], "b": ["conceded lint: it grew"]}
    with pytest.raises(ValueError):
        E.conceded(e, ledger, records, plan, "lint", "t1", "me", "r", wanted.withColumn("entry", F.lit("no.ts")))
    with pytest.raises(ValueError):
        E.conceded(e, ledger, records, plan, "size", "t1", "me", "r")


def test_tables_of_nothing(spark, plan, records):
    empty = S.discovered(files(spark), S.Perimeter("glob", ["^a/"]))
    e = E.evaluated(empty, plan, spark.createDataFrame([], HIT), records)
    assert e.states.count() == 0
    assert [df.count() for df in E.cleared(e, spark.createDataFrame([], LEDGER), "t1")] == [0, 0, 0]


def test_trees_of_commits(spark):
    snapshots = spark.createDataFrame([("s1", "a.ts", "one"), ("s2", "a.ts", "two")], "sha string, path string, text string")
    assert [r["text"] for r in H.text_at(snapshots, "s2", "a.ts").collect()] == ["two"]
    assert H.tree_at(snapshots, "s3").count() == 0


def test_small_records(spark):
    phases = spark.createDataFrame([("p", 0, "h", False, ["c1"], ["size"]), ("q", 1, "g", True, None, [])], "phase string, ord int, hash string, open boolean, concessions array<string>, grows array<string>")
    assert sorted(tuple(r) for r in R.plan_of(phases).collect()) == [("p", 0, "h", True, 1), ("q", 1, "g", False, 0)]
    at = spark.createDataFrame([("a", 0), ("b", 1)], "sector string, phase_at int")
    assert [tuple(r) for r in R.grows(phases, at).collect()] == [("a", "size")]
    assert [r["value"] for r in R.base_side(spark.createDataFrame([(1.0,), (float("nan"),)], "value double")).collect()] == [1.0, None]
    rows = spark.createDataFrame([("size", "a", "down", 5.0, 5.2), ("size", "b", "down", 5.0, 9.0)], "objective string, sector string, direction string, recorded double, value double").withColumn("closed", F.lit(None).cast("double"))
    out, receipts, left = R.conceded_measures(rows, F.lit(0.5), "t1", "me", "r")
    assert {r["sector"]: r["recorded"] for r in out.collect()} == {"a": 5.0, "b": 9.0}
    assert [(r["from"], r["to"]) for r in receipts.collect()] == [(5.0, 9.0)] and [r["sector"] for r in left.collect()] == ["a"]
    totals = spark.createDataFrame([("2024-01-01", "2024-01-05", None)], "created string, last_improved string, sector_clock string")
    asked = lambda days, now: totals.select(R.measure_stalled(totals, days and days * 86_400_000, now)).first()[0]
    assert [asked(7, "2024-01-10"), asked(7, "2024-01-20"), asked(None, "2025-01-01")] == [False, True, False]
