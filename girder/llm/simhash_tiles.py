"""Operator 9: SimHash near-duplicates by tiled exact comparison.

Fingerprints are 64 majority bits over the XXH64 of a document's 3-word shingles. Distinct fingerprints are compared exactly, in
tiles: a group of fingerprints is ordered by population count and cut into tiles of 512; a tile pair whose counts lie further
apart than the radius of three bits is skipped, all others are compared with a numpy exclusive-or and bit count.

Tiles over all fingerprints would grow with their square, so they are dealt into groups of some eight tiles first, without
losing a pair: of four fields of 16 bits at least one agrees within three bits, so each field's first bits, as many as the number
of fingerprints asks for, deal every fingerprint into four groups; for more of them pairs of five fields (ten groups), then
triples of six (twenty). A few thousand fingerprints are one group. A group that turns out far larger is dealt again by the
next finer fields, and what is too large even then is cut into parts whose pairs are tasks of their own. Each task hands
on a forest over what it found linked, never all pairs, and the forests' union goes to a distributed components step.

`one_of_each`, the pipeline's stage, asks for five-word shingles with a similarity of 0.8, which 64 bits cannot tell from less:
each bit of such texts differs with a chance of 0.15. It takes wide fingerprints of 256 bits, made and compared in the same way
within 72 bits, which such a pair exceeds with a chance under 0.000001 (0.0001 for texts of eight and nine words, whose bits differ
with a chance of 0.19). No fields agree for sure at that radius, so each
fingerprint is dealt into groups of some 32 tiles by several draws of its bits, as many as leave a pair apart with a chance
under MISS. What the tiles link are candidates, which `shingle_groups` verifies.

Defined results: a null or empty text has fingerprint zero, which links like any other; a text of one or two words has that
sequence as its only shingle; equal fingerprints are one node; a null id never becomes a component id unless all are null;
an empty table gives an empty result; `one_of_each` returns the input's columns untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girder.llm.common import bounded_batches, holding, spread_join, stash
from girder.llm.components import components

RADIUS = 3
SHINGLE = 3
TILE = 512
GROUP = 8 * TILE  # fingerprints of a group that is aimed at
SPLIT = 8 * GROUP  # and at most, before a group is dealt again or cut
LEVELS = ((4, 1), (5, 2), (6, 3))  # fields, and how many of them agree at least within three bits
WIDE, WIDE_RADIUS, WIDE_GROUP = 4, 72, 32 * TILE  # numbers of a wide fingerprint, its radius, and the group aimed at
FIRST = 24  # bits in which the first numbers may differ; a pair of similarity 0.8 exceeds it with a chance under 0.00001
DIFFER, MISS = 0.1515, 0.0004  # the chance that a bit differs at a similarity of 0.8, and that a pair shares no group
PRINTS = [f"p{k}" for k in range(WIDE)]
_HASH = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in over half the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six white-space bytes
    if not words:
        return 0
    pieces = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return int(majority(np.fromiter(map(_HASH, pieces), np.uint64)))


def majority(h: np.ndarray) -> np.uint64:
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        votes += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * votes > len(h), bitorder="little").view(np.uint64)[0]


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further hashes of hashes (splitmix64)."""
    h = h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def wide(h: np.ndarray) -> np.ndarray:
    """The wide fingerprint of a text's shingle hashes: majority bits of WIDE numbers a hash."""
    return np.array([majority(_mixed(h, k) if k else h) for k in range(WIDE)], np.uint64)


def _fingerprints(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    holding("simhash")
    for part in parts:
        made = np.fromiter(map(fingerprint, part.pop("text")), np.uint64, len(part))
        yield part.assign(fp=made.view(np.int64))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and the fingerprint as a signed 64-bit number."""
    return bounded_batches(documents).select("doc_id", "text").mapInPandas(_fingerprints, "doc_id long, fp long")


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits set in each fingerprint: numbers, or rows of WIDE numbers."""
    counts = np.bitwise_count(values)
    return counts.astype(np.int64) if values.ndim == 1 else counts.sum(1, dtype=np.int64)


def _radius(values: np.ndarray) -> int:
    return RADIUS if values.ndim == 1 else WIDE_RADIUS


def _near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs within the radius."""
    if a.ndim == 1:
        return np.nonzero(np.bitwise_count(a[:, None] ^ b[None, :]) <= RADIUS)
    i, j = np.nonzero(np.bitwise_count(a[:, :1] ^ b[:, 0][None, :]) <= FIRST)
    near = _bits(a[i] ^ b[j]) <= WIDE_RADIUS
    return i[near], j[near]


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b: equal in a component, its least place."""
    while True:
        low = np.minimum(labels[a], labels[b])
        if (labels[a] == low).all() and (labels[b] == low).all():
            return labels
        np.minimum.at(labels, labels[a], low)
        np.minimum.at(labels, labels[b], low)
        labels = labels[labels]


def forest(left: np.ndarray, right: np.ndarray | None = None, tile: int = TILE, counts: dict[str, int] | None = None) -> list[tuple[int, int]]:
    """(place, least place it is linked to, step by step) over distinct fingerprints, by tiles; with `right` only links
    between the two sides are looked for, whose places follow those of `left`. `counts` gets the tile pairs compared and skipped."""
    sides, radius = [], _radius(left)
    for values, base in ((left, 0), *(((right, len(left)),) if right is not None else ())):
        pops = _bits(values)
        order = np.argsort(pops, kind="stable")
        sides.append([(values[o], o + base, pops[o[0]], pops[o[-1]]) for o in (order[t : t + tile] for t in range(0, len(order), tile))])
    labels = np.arange(len(left) + (0 if right is None else len(right)))
    compared = skipped = held = 0
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i, (x, at_x, low_x, high_x) in enumerate(sides[0]):
        others = sides[0][i:] if right is None else sides[1]
        for y, at_y, low_y, high_y in others:
            if low_y - high_x > radius or low_x - high_y > radius:
                skipped += 1
                continue
            compared += 1
            a, b = _near(x, y)
            found.append((at_x[a], at_y[b]))
            held += len(a)
            if held > 1 << 20:
                labels = joined(labels, *map(np.concatenate, zip(*found, strict=True)))
                found, held = [], 0
    if found:
        labels = joined(labels, *map(np.concatenate, zip(*found, strict=True)))
    if counts is not None:
        counts["compared"] = counts.get("compared", 0) + compared
        counts["skipped"] = counts.get("skipped", 0) + skipped
    own = np.flatnonzero(labels != np.arange(len(labels)))
    return list(zip(own.tolist(), labels[own].tolist(), strict=True))


def _values(part: pd.DataFrame) -> np.ndarray:
    """Fingerprints; wide ones as rows of their node and numbers."""
    return (part["fp"] if "fp" in part else part[["node", *PRINTS]]).to_numpy(np.int64).view(np.uint64)


def _split(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, fingerprints)"""
    return (values, values) if values.ndim == 1 else (values[:, 0], values[:, 1:])


def _grouped(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows sorted by key, as (key, values, side) of whole groups; a group may run over several batches."""
    held: tuple[np.ndarray, ...] = ()
    for part in parts:
        side = part["side"].to_numpy(bool) if "side" in part else np.zeros(len(part), bool)
        new = (part["key"].to_numpy(np.int64), np.ascontiguousarray(_values(part)), side)
        held = tuple(map(np.concatenate, zip(held, new, strict=True))) if held else new
        done = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if done:
            yield tuple(x[:done] for x in held)
            held = tuple(x[done:] for x in held)
    if held and len(held[0]):
        yield held


def _links(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of each group."""
    for key, values, _ in _grouped(parts):
        name, fp = _split(values)
        cuts = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(key)]
        size = ends - starts
        two = starts[size == 2]
        near = _bits(fp[two] ^ fp[two + 1]) <= _radius(fp)
        out = [(name[two][near], name[two + 1][near])]
        for s, e in zip(starts[size > 2], ends[size > 2], strict=True):
            pairs = np.array(forest(fp[s:e]), np.int64).reshape(-1, 2).T
            out.append((name[s:e][pairs[1]], name[s:e][pairs[0]]))
        a, b = map(np.concatenate, zip(*out, strict=True))
        yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def _crossed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links between the two sides of each group, inside the one side where there is no other."""
    for key, values, side in _grouped(parts):
        name, fp = _split(values)
        cuts = np.flatnonzero(np.diff(key)) + 1
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(key)], strict=True):
            one, two = (np.flatnonzero(side[s:e] == x) + s for x in (False, True))
            pairs = np.array(forest(fp[one], fp[two] if len(two) else None), np.int64).reshape(-1, 2).T
            every = name[np.concatenate((one, two))]
            yield pd.DataFrame({"a": every[pairs[1]].view(np.int64), "b": every[pairs[0]].view(np.int64)})


def dealt(nodes: DataFrame, level: int, bits: int, home: Column | None = None) -> DataFrame:
    """(fp, key): each fingerprint in its groups by `bits` bits of the fields of a level."""
    fields, agree = LEVELS[level]
    edges = [64 * k // fields for k in range(fields + 1)]
    each = -(-bits // agree)
    part = [F.shiftrightunsigned("fp", b - min(each, b - a)).bitwiseAND(F.lit((1 << min(each, b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
    keys = [F.xxhash64(F.lit(64 * level + t), *(part[i] for i in some), *(() if home is None else (home,))) for t, some in enumerate(combinations(range(fields), agree))]
    return nodes.select("fp", F.explode(F.array(*keys)).alias("key"))


def _sorted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(*keys).sortWithinPartitions(*keys)


def links(nodes: DataFrame, group: int = GROUP, split: int = SPLIT) -> DataFrame:
    """Distinct fingerprints (fp) to links (a, b) that keep together what pairs within the radius do."""
    n = nodes.count()
    bits = max(0, (max(n, 1) - 1).bit_length() - group.bit_length() + 1)
    level = 0 if bits <= 16 else 1 if bits <= 24 else 2
    if not bits:
        return nodes.select("fp", F.lit(0).cast("long").alias("key")).coalesce(1).mapInPandas(_links, "a long, b long")
    out, rows = [], dealt(nodes, level, min(bits, 30))
    while True:
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > split)
        big = stash(sizes.select(F.col("key").alias("big"), "n"))
        if not big.limit(1).count():
            out.append(_sorted(rows, "key").mapInPandas(_links, "a long, b long"))
            break
        on = F.col("key") == F.col("big")
        out.append(_sorted(rows.join(big, on, "left_anti"), "key").mapInPandas(_links, "a long, b long"))
        rest = rows.join(big, on).select("fp", "key", "n")
        if level == len(LEVELS) - 1:
            out.append(_parted(rest, group))
            break
        level += 1
        rows = dealt(stash(rest.select("fp", "key")), level, 30 if level == 2 else 24, F.col("key"))
    edges = out[0]
    for more in out[1:]:
        edges = edges.unionByName(more)
    return edges


def _parted(rest: DataFrame, group: int) -> DataFrame:
    """Links of groups that no finer fields part: each is cut into n / group parts, and every two parts are a task."""
    parts = F.ceil(F.col("n") / group).cast("int")
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    pair = rest.select("fp", "key", parts.alias("parts"), own.alias("own")).withColumn("other", other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    tiles = pair.select("fp", F.xxhash64("key", low, high).alias("key"), (F.col("own") > F.col("other")).alias("side"))
    return _sorted(tiles, "key").select("key", "fp", "side").mapInPandas(_crossed, "a long, b long")


def draws(bits: int) -> int:
    """How many draws of `bits` of a wide fingerprint's bits leave a pair of similarity 0.8 apart with a chance under MISS."""
    every = 64 * WIDE
    chance = [comb(every, d) * DIFFER**d * (1 - DIFFER) ** (every - d) for d in range(WIDE_RADIUS + 1)]
    agree = [comb(every - d, bits) / comb(every, bits) for d in range(WIDE_RADIUS + 1)]
    n = 1
    while sum(c * (1 - a) ** n for c, a in zip(chance, agree, strict=True)) > MISS:
        n += 1
    return n


def _masks(bits: int) -> list[list[int]]:
    """For each draw its bits, as masks of the fingerprint's numbers: different bits until all had their turn."""
    rnd, out, left = np.random.default_rng(9), [], np.empty(0, np.int64)
    for _ in range(draws(bits)):
        if len(left) < bits:
            left = rnd.permutation(64 * WIDE)
        own, left = left[:bits].tolist(), left[bits:]
        masks = [sum(1 << (b & 63) for b in own if b >> 6 == k) for k in range(WIDE)]
        out.append([m - (1 << 64) if m >> 63 else m for m in masks])
    return out


def wide_links(nodes: DataFrame, group: int = WIDE_GROUP, split: int = SPLIT) -> DataFrame:
    """Distinct (node, p0..) of wide fingerprints to links (a, b) of nodes, which keep together what pairs within the radius do."""
    bits = max(0, (max(nodes.count(), 1) - 1).bit_length() - group.bit_length() + 1)
    nodes = nodes.select("node", *PRINTS)
    if not bits:
        return nodes.withColumn("key", F.lit(0).cast("long")).coalesce(1).mapInPandas(_links, "a long, b long")
    keys = [F.xxhash64(F.lit(t), *(F.col(p).bitwiseAND(F.lit(m).cast("long")) for p, m in zip(PRINTS, masks, strict=True))) for t, masks in enumerate(_masks(bits))]
    rows = nodes.select("node", *PRINTS, F.explode(F.array(*keys)).alias("key"))
    big = stash(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > split).select(F.col("key").alias("big"), "n"))
    if not big.limit(1).count():
        return _sorted(rows, "key").mapInPandas(_links, "a long, b long")
    on = F.col("key") == F.col("big")
    rest = stash(rows.join(F.broadcast(big), on).drop("big"))
    return _sorted(rows.join(F.broadcast(big), on, "left_anti"), "key").mapInPandas(_links, "a long, b long").unionByName(_around_pivots(rest, group))


def _around_pivots(rest: DataFrame, group: int) -> DataFrame:
    """Links of groups (key, n) that are too large for a task, such as near copies of one text: those within the radius of the
    group's first fingerprint are linked by that; only the others have links to look for, among themselves and to all, in parts."""
    first = stash(rest.groupBy("key").agg(F.min(F.struct("node", *PRINTS)).alias("first")))
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"first.{p}"))) for p in PRINTS), F.lit(0))
    seen = stash(rest.join(F.broadcast(first), "key").select("key", "n", "node", *PRINTS, F.col("first.node").alias("pivot"), (apart <= WIDE_RADIUS).alias("near")))
    core = seen.filter("near").select(F.col("node").alias("a"), F.col("pivot").alias("b"))
    left = stash(seen.filter("not near").groupBy("key").agg(F.count("*").alias("m")))
    rows = seen.join(F.broadcast(left), "key").withColumns({"p": F.ceil(F.col("n") / group).cast("int"), "q": F.ceil(F.col("m") / group).cast("int")})
    own, other = (F.pmod(F.xxhash64("node"), F.col(c)).cast("int") for c in ("p", "q"))
    every = rows.select("node", *PRINTS, "key", own.alias("x"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("y"), F.lit(False).alias("side"))
    open_ = rows.filter("not near").select("node", *PRINTS, "key", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("x"), other.alias("y"), F.lit(True).alias("side"))
    tiles = every.unionByName(open_).withColumn("key", F.xxhash64("key", "x", "y")).drop("x", "y")
    return core.unionByName(_sorted(tiles, "key").mapInPandas(_crossed, "a long, b long"))


def placed(marked: DataFrame) -> DataFrame:
    """(fp, root): the group of each distinct fingerprint, by its least member."""
    nodes = stash(marked.select("fp").distinct())
    roots = stash(components(links(nodes)))
    return nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id among all documents whose fingerprints are linked, step by step."""
    marked = stash(fingerprints(documents))
    groups = stash(placed(marked).join(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fp"))
    least = stash(groups.groupBy("root").agg(F.min("least").alias("component_id")))
    named = stash(spread_join(groups.select("fp", "root"), least, "root").select("fp", "component_id"))
    return spread_join(marked, named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of `documents` with the smallest id of their group (null ids last, equal ids by a hash of the text).

    Groups are those of `shingle_groups`: wide fingerprints linked by `wide_links`, then verified on five words, similarity 0.8.
    """
    from girder.llm import shingle_groups

    keyed = bounded_batches(documents).withColumn("__k", F.xxhash64("doc_id", "text"))
    marked = shingle_groups.marked(keyed)
    named = spread_join(marked.drop(*PRINTS), stash(shingle_groups.placed(keyed, marked)), "node")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__k")).alias("best"))
    kept = keyed.join(best.select(F.col("best.__k").alias("__best")).distinct(), F.col("__k") == F.col("__best"))
    # rows that agree in id and text: the one whose other columns have the least hash
    one = kept.groupBy("__k").agg(F.min_by(F.struct(*documents.columns), F.xxhash64(*(c for c, t in documents.dtypes if "map<" not in t))).alias("__row"))
    return one.select(*(F.col("__row")[c].alias(c) for c in documents.columns))


def digests(documents: DataFrame) -> DataFrame:
    return near_duplicates(documents).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
