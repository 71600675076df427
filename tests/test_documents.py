"""The snapshot's shape, probes of every family, and a check that campaigns fail."""

import json

import pytest

from girder import api
from girder.plans import policy as P
from girder.sources import documents as D

MANIFEST = {"tree": {"src/": {"partial": True, "imports": {"allow": ["src/**"]}}}, "graph": {"cycles": [{"name": "loops", "message": "l", "within": ["src/**"]}]}}


@pytest.fixture(scope="module")
def facts(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/b.ts",)], "path string")
    edges = [("src/a.ts", "./b", "src/b.ts", "local", None), ("src/b.ts", "./a", "src/a.ts", "local", None), ("src/a.ts", "zod", "node_modules/zod/index.js", "external", "zod")]
    return api.Facts(files, files, spark.createDataFrame(edges, "path string, specifier string, target_path string, target_kind string, target_package string"))


def test_snapshot_round_trip(facts):
    text = api.snapshot(facts, P.load(json.dumps(MANIFEST), "m.json")).first()[0]
    read = D.decode_snapshot(text)
    assert read["ok"] is False and {c["size"] for c in read["cycles"]} == {2}
    assert set(D.snapshot_schema()["properties"]) == set(read)
    for broken in ({**read, "more": 1}, {k: v for k, v in read.items() if k != "counts"}, {**read, "ok": 1}, {**read, "version": True}, {**read, "cycles": [{"comp": "x", "size": "2"}]}, {**read, "heights": {}}):
        with pytest.raises(D.Refused):
            D.decode_snapshot(json.dumps(broken))
    with pytest.raises(D.Refused):
        D.decode_snapshot("{")


def test_a_failing_campaign_fails_the_check(spark, facts):
    policy = P.load(json.dumps(MANIFEST), "m.json")
    failing = spark.createDataFrame([("b", ["growth"]), ("a", ["drift", "stale"])], "campaign string, reasons array<string>")
    assert api.check(facts, policy, campaigns=failing)["failure"].first()[0] == "drift"
    assert api.check(facts, policy, campaigns=failing.limit(0))["failure"].first()[0] == "violations"


def loaded(node, **top):
    return P.load(json.dumps({"tree": {"src/": {"partial": True, **node}}, **top}), "m.json")


@pytest.mark.parametrize(
    "node",
    [
        {"members": [{"message": "m", "allow": ["*"]}]},
        {"members": [{"message": "m", "match": ["find*"], "matchNot": ["find*"]}]},
        {"members": [{"message": "m", "match": ["find*"], "probe": {"name": "getOne"}}]},
        {"surface": [{"message": "m", "allow": ["*"]}]},
        {"surface": [{"message": "m", "convention": {"regex": "^.*$"}}]},
        {"surface": [{"message": "m", "count": {"min": 0}}]},
        {"surface": [{"message": "m", "kinds": ["default"], "forbid": True, "probe": {"sites": [{"name": "x", "kind": "named"}]}}]},
    ],
)
def test_rules_that_cannot_fire_are_refused(node):
    with pytest.raises(P.Refused):
        loaded(node)


def test_rules_that_fire_are_loaded():
    policy = loaded(
        {
            "members": [{"message": "m", "allow": ["find*"], "in": ["*Repository"], "declares": ["interface"]}],
            "surface": [{"message": "m", "convention": {"regex": "^[a-z]+$"}}, {"message": "m", "count": {"max": 1}}, {"message": "m", "count": {"min": 1}}, {"message": "m", "kinds": ["default"], "forbid": True}],
        },
        exports=[{"name": "e", "message": "m", "module": ["lib/**"], "symbols": ["makeBus"]}],
    )
    assert len(policy.surface) == 4 and len(policy.members) == 1 and len(policy.exports) == 1
    with pytest.raises(P.Refused):
        loaded({}, exports=[{"name": "e", "message": "m", "module": ["lib/**"], "probe": {"symbol": "x"}, "symbols": ["makeBus"]}])
