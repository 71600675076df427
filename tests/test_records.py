"""Records, user functions, and reports."""

import pytest
from pyspark.sql import functions as F

from girder.operators import detect as D
from girder.operators import records as R


@pytest.fixture(scope="module")
def records(spark):
    schema = f"sector string, reached int, since string, attested {R.ATTESTED}, notes array<struct<text:string,by:string,at:string>>"
    return spark.createDataFrame([("s", 1, "2024-01-01", [("agree", "a", "2024-01-02", "said so", None, None)], []), ("t", 0, "2024-01-01", [], [("n", "b", "2024-02-01")])], schema)


def test_attestations_and_notes(spark, records):
    at = spark.createDataFrame([("s", 1), ("t", 0)], "sector string, phase_at int")
    phases = spark.createDataFrame([(0, "fix", False), (1, "agree", True)], "ord int, phase string, attested boolean")
    twice, refused = R.attested(records, at, phases, "agree", "b", "2024-03-01", "met", "minutes.md")
    assert [len(r["attested"]) for r in twice.orderBy("sector").collect()] == [2, 0]
    assert [tuple(r) for r in refused.collect()] == [("t", "stands elsewhere")]
    assert {r["refused"] for r in R.attested(records, at, phases, "fix", "b", "t", "r")[1].collect()} == {"not an attested phase"}
    assert {r["refused"] for r in R.attested(records, at, phases, "no", "b", "t", "r")[1].collect()} == {"no such phase"}
    gone = R.revoked(twice, ["agree"], "2024-04-01", "c", "sent back")
    assert gone.select(F.size(R.live_attestations())).distinct().collect()[0][0] == 0
    assert {a["revoked"]["by"] for r in gone.collect() for a in r["attested"]} == {"c"}
    assert {r["sector"]: r["sector_clock"] for r in R.clock(gone).collect()} == {"s": "2024-03-01", "t": "2024-02-01"}
    full = records.withColumn("notes", F.array_repeat(F.struct(F.lit("old").alias("text"), F.lit("b").alias("by"), F.lit("2024-01-05").alias("at")), F.when(F.col("sector") == "s", R.MOST_NOTES).otherwise(R.MOST_NOTES - 1)))
    more, refused = R.noted(full, "new", "me", "2024-05-01")
    assert {r["sector"]: (len(r["notes"]), r["notes"][-1]["text"]) for r in more.collect()} == {"s": (20, "old"), "t": (20, "new")}
    assert [r["sector"] for r in refused.collect()] == ["s"]
    with pytest.raises(ValueError):
        R.noted(records, "x" * 501, "me", "t")
    moved = R.reached(records, spark.createDataFrame([("s", 0), ("t", 2)], "sector string, phase_at int"), "2024-06-01")
    assert {r["sector"]: (r["reached"], r["since"]) for r in moved.collect()} == {"s": (1, "2024-01-01"), "t": (2, "2024-06-01")}


def test_sent_back(spark):
    at = lambda *x: spark.createDataFrame(list(x), "sector string, phase_at int")
    phases = spark.createDataFrame([(0, "a", False), (1, "b", True), (2, "c", True)], "ord int, phase string, attested boolean")
    assert [tuple(r) for r in R.sent_back(at(("s", 3), ("t", 1)), at(("s", 0), ("t", 2)), phases).collect()] == [("s", 3, 0, ["b", "c"])]


def test_functions(spark):
    f = spark.createDataFrame([("a.ts", "one two"), ("b.ts", "")], "path string, text string")

    @R.registered("own#long")
    def long(path, text):
        return len(text) > 3

    assert [r[0] for r in R.predicate_hits(f, R.function("own#long")).collect()] == ["a.ts"]
    subjects = R.predicate_subjects(f, lambda p, t: t.split())
    leaf = D.Term("fn", rows=subjects, level="match")
    assert {r["key"] for r in D.candidates(f, leaf, "match").collect()} == {"one", "two"}
    got = {r["path"]: r["value"] for r in R.measured(f, lambda p, t: len(t) - 1).collect()}
    assert got["a.ts"] == 6.0 and got["b.ts"] != got["b.ts"]
    with pytest.raises(KeyError):
        R.function("none")


def test_bindings_of_captured_names(spark):
    matches = spark.createDataFrame([("f", "k1", "ns.get"), ("f", "k2", "local"), ("g", "k3", "ns")], "path string, key string, identifier string")
    bindings = spark.createDataFrame([("f", 1, 0, "*", "ns", "second.ts"), ("f", 0, 0, "make", "ns", "first.ts")], "path string, spec_ord int, bind_ord int, symbol string, local string, target_path string")
    assert [(r["key"], r["target_path"]) for r in R.binding_admits(matches, bindings).collect()] == [("k1", "first.ts")]
    assert R.binding_admits(matches, bindings, ["*"]).isEmpty()


def test_markers(spark):
    assert R.marker_of("export default { name: 'pay', owns: ['a', \"b\",], /* x */ deep: {k: 1} } as const;\n") == {"name": "pay", "owns": ["a", "b"], "deep": {"k": 1}}
    assert R.marker_of("export default { name: run() }") is None and R.marker_of("") is None
    f = spark.createDataFrame([("src/a/sector.ts", "export default {name: 'A'}"), ("src/b/sector.ts", "const x = 1"), ("src/b/c.ts", "")], "path string, text string")
    assert sorted(tuple(r) for r in R.markers(f, "sector.ts").collect()) == [("src/a/sector.ts", "A"), ("src/b/sector.ts", "b")]


def test_reports(spark):
    states = spark.createDataFrame([("o", "s", "x", "unrecorded"), ("o", "s", "y", "stale"), ("o", "t", "z", "ledgered")], "objective string, sector string, entry string, state string")
    sectors = spark.createDataFrame([("o", "t", "t0"), ("o", "u", "t0")], "objective string, sector string, entered string")
    held = states.filter("state <> 'unrecorded'").select("objective", "sector", "entry")
    rows = {r["sector"]: tuple(r)[2:] for r in R.report(states, sectors, held).collect()}
    assert rows == {"s": (1, 1, 0, 0, False, 1), "t": (0, 0, 0, 1, True, 1), "u": (0, 0, 0, 0, True, 0)}
    schema = "campaign string, objective string, sector string, inside boolean, count int, entered boolean, new int, stale int, holds boolean, unmeasured boolean, drift int, unreceipted int, on_complete string"
    lines = [
        ("all", "o", "s", True, 2, True, 1, 1, False, True, 1, 1, "keep"),
        ("missing", "o", "s", True, 0, True, 0, 0, True, False, 0, 0, "remove"),
        ("missing", "o", "t", True, 0, False, 3, 0, True, False, 0, 0, "remove"),
        ("done", "o", "s", True, 0, True, 0, 0, True, False, 0, 0, "remove"),
        ("fine", "o", "s", True, 3, True, 0, 0, True, False, 0, 0, "remove"),
    ]
    bad = {r["campaign"]: r["reasons"] for r in R.failures(R.campaign_report(spark.createDataFrame(lines, schema))).collect()}
    assert bad == {"all": ["drift", "unreceipted", "unmeasured", "stale", "arithmetic", "growth"], "missing": ["missing ledger"], "done": ["complete"]}
    granted, unknown = R.chosen_holdouts(states, spark.createDataFrame([("o", "s", "x"), ("o", "s", "no")], "objective string, sector string, entry string"))
    assert [r["entry"] for r in granted.collect()] == ["x"] and [r["entry"] for r in unknown.collect()] == ["no"]
    two = spark.createDataFrame([("s", 1.0), ("s", 1.0), ("t", 2.0)], "sector string, delta double")
    assert R.fresh_concessions(two, two.filter("sector = 't'")).count() == 2
    modes = spark.createDataFrame([(None, None, True), (None, None, False), ("advise", "ratchet", False)], "p string, c string, o boolean").select(R.on_touch(F.col("p"), F.col("c"), F.col("o")))
    assert [r[0] for r in modes.collect()] == ["advise", "ratchet", "advise"]


def test_ladder_and_deltas(spark):
    phases = spark.createDataFrame([(0, ["a", "b"], False), (1, ["c"], False), (2, [], True)], "ord int, objectives array<string>, open boolean")
    shares = spark.createDataFrame([("s", 0, "a", 1.0), ("s", 0, "b", 0.0), ("t", 2, "a", 0.5)], "sector string, phase_at int, objective string, paid double")
    assert {r["sector"]: r["position"] for r in R.ladder(shares, phases).collect()} == {"s": 0.5, "t": 2.0}
    h = spark.createDataFrame([("1", 5), ("2", 3)], "commit string, n int")
    assert [r["n_delta"] for r in R.deltas(h, ["n"]).orderBy("commit").collect()] == [None, -2]
    shared = spark.createDataFrame([("c", 2), ("a", 0)], "objective string, n int")
    objectives = spark.createDataFrame([("a", None), ("c", None)], "objective string, until string")
    positions = spark.createDataFrame([("s", 0), ("t", 1)], "sector string, phase_at int")
    named = phases.withColumn("phase", F.col("ord").cast("string"))
    assert [tuple(r) for r in R.prerequisites(shared, objectives, named, positions).collect()] == [("c", 2, ["t"])]
