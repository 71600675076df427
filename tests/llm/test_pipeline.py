"""The pipeline's stages, each on what its predecessor kept."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from girder.llm import simhash_tiles
from girder.llm.common import stash


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stash(stage(spark, docs, sf))
        kept[name] = docs.count()
        if k < 4:
            assert docs.columns == names
        if name == "near_duplicates":
            assert docs.select("text").distinct().count() == kept[name]
        if name == "personal_data":
            assert docs.filter("text rlike '@mail'").count() == 0
    assert 200 > kept["quality"] > kept["near_duplicates"] == kept["personal_data"] > 0
    assert kept["tokens"] == kept["mix"]
    assert corpus_pipeline.run(spark, sf).count() == kept["tokens"]


def test_stages_on_empty_and_odd_tables(spark, sf, docs, no_docs):
    for start in (no_docs, docs):
        rows = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            rows = stash(stage(spark, rows, sf))
            assert k == 4 or rows.columns == start.columns
        assert start is docs or rows.count() == 0


def test_near_duplicates_against_brute_force(spark):
    """Recall over all pairs of texts whose five-word shingles have a similarity of 0.8 or more, and what may go at all."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    rows += [(10**6 + i, " ".join(f"w{i}" if i and j == 30 * i % 97 else f"v{j}" for j in range(97))) for i in range(40)]
    rows += [(2 * 10**6 + i, t) for i, t in enumerate((None, "", " ", "two words", "Two  words", "two word"))]
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string")
    words = {i: (t or "").lower().split() for i, t in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders, pairs = {}, 0
    for i, s in sets.items():
        shared = {}
        for x in s or {None}:
            for j in holders.setdefault(x, []):
                shared[j] = shared.get(j, 0) + 1
            holders[x].append(i)
        for j, n in shared.items():
            if not s or n / (len(s) + len(sets[j]) - n) >= 0.8:
                pairs += words[i] != words[j]
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert pairs > 40
    kept = {r["doc_id"] for r in simhash_tiles.one_of_each(docs).collect()}
    assert kept == {i for i in root if find(i) == i}


def test_large_groups_in_parts(spark, monkeypatch):
    """Candidate groups cut into parts give the links of whole ones: a chain of neighbours, like texts, and strangers among them."""
    from girder.llm import shingle_groups

    monkeypatch.setattr(shingle_groups, "PART", 7)
    texts = [" ".join(f"w{j}" for j in range(4 * i, 4 * i + 120)) for i in range(60)]  # a chain: each is like its neighbours alone
    texts += [" ".join(f"v{j}" if j != 3 * i else f"x{i}" for j in range(100)) for i in range(30)]
    texts += [" ".join(f"v{j}" if j % 9 else f"y{i}-{j}" for j in range(100)) for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("__k", F.col("doc_id"))
    rows = shingle_groups.marked(docs)
    whole = {r["node"]: r["root"] for r in shingle_groups.placed(docs, rows).collect()}
    parts = {r["node"]: r["root"] for r in shingle_groups.placed(docs, rows, 5).collect()}
    assert len(set(whole.values())) == len(set(parts.values())) == len({(whole[n], parts[n]) for n in whole}) < 60


def test_candidates_come_from_tiles_of_wide_fingerprints(spark):
    """Links of wide fingerprints, by one group, by draws of bits and around pivots, against all texts alike by 0.8."""
    from girder.llm import shingle_groups
    from girder.llm.components import components

    rnd = np.random.default_rng(2)
    sets = [rnd.integers(0, 1 << 63, n, dtype=np.uint64) for n in rnd.integers(30, 400, 500)]
    sets += [np.concatenate((s[: len(s) - len(s) // 9], rnd.integers(0, 1 << 63, len(s) // 9, dtype=np.uint64))) for s in sets]  # at 0.8 or just above
    sets += [np.concatenate((sets[7][3:], rnd.integers(0, 1 << 63, 3, dtype=np.uint64))) for _ in range(300)]
    prints = np.array([simhash_tiles.wide(s) for s in sets])
    distance = np.bitwise_count(prints[:500] ^ prints[500:1000]).sum(1)
    assert 0.12 < distance.mean() / 256 < 0.17 and distance.max() <= simhash_tiles.WIDE_RADIUS
    nodes = spark.createDataFrame([(i, *map(int, p)) for i, p in enumerate(prints.view(np.int64))], ", ".join(f"{c} long" for c in ("node", *shingle_groups.PRINTS)))
    want = [i if i < 500 else i - 500 if i < 1000 else 7 for i in range(1300)]
    for group, split in ((4096, 10**6), (128, 10**6), (128, 100)):
        roots = {r["node"]: r["root"] for r in components(simhash_tiles.wide_links(nodes, group, split)).collect()}
        found = [roots.get(i, i) for i in range(1300)]
        assert all(f == i if i < 500 else True for i, f in enumerate(found))
        assert sum(f == w for f, w in zip(found, want, strict=True)) >= 1298
