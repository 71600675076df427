"""Near-duplicates of the pipeline: five-word shingles with a Jaccard similarity of 0.8 or more, verified exactly.

Candidates are what operator 9's tiles link over wide SimHash fingerprints of these shingles (`simhash_tiles.wide_links`): at a
similarity of 0.8 a pair is missed with a chance of about 0.0004, below that candidates cost time only. Texts that are linked, step
by step, form a candidate group; the shingles of these texts alone are dealt out by group, and links inside it are found by comparing whole shingle sets, breadth
first: a text reached is never compared again as a target, so a large group of like texts costs about one pass.

A group of over LARGE texts is not one task. Its texts are compared with its first one, its pivot, wherever they lie; those that
are like it are linked by that. Only the others have links to look for, among themselves and to all, and do so in parts of
PART texts, every two of which are a task.

Defined results: null and empty texts are like each other; a text of one to four words is its only shingle; similarity is
followed step by step, as operator 9 does with fingerprints; words are those of operator 9.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm import simhash_tiles
from girder.llm.common import holding, spread_join, stash
from girder.llm.components import components

SHINGLE = 5
LARGE, PART = 4_000, 2_000  # texts of a candidate group that one task compares, and of a part of a larger one
_HASH = partial(xxhash.xxh64_intdigest, seed=42)
PRINTS = simhash_tiles.PRINTS


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the text's five-word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    pieces = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else [b" ".join(words)]
    return np.unique(np.fromiter(map(_HASH, pieces), np.uint64))


def node(found: np.ndarray) -> int:
    return int(np.uint64(_HASH(found.tobytes())).view(np.int64))


EMPTY = node(np.empty(0, np.uint64))  # of null and empty texts, which are like no others


def _marked(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    holding("shingles")
    for part in parts:
        found = [shingles(t) for t in part.pop("text")]
        made = np.array([simhash_tiles.wide(x) for x in found], np.uint64).reshape(-1, len(PRINTS)).view(np.int64)
        yield part.assign(node=np.array([node(x) for x in found], np.int64), **dict(zip(PRINTS, made.T, strict=True)))


def _shingled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    holding("shingles")
    for part in parts:
        part = part.drop_duplicates("node")
        yield part[["root", "node"]].assign(shingles=[shingles(t).view(np.int64) for t in part["text"]])


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """For each set the place of the first one that similarities of 0.8 or more lead to, step by step; no set is empty."""
    size, out = np.array(list(map(len, sets))), np.arange(len(sets))
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(size)[:-1])
    mark, left = np.zeros(len(kinds), np.uint8), np.arange(len(sets))
    front: list[int] = []
    while len(left):
        if not front:
            front, flat, left = [int(left[0])], flat[size[left[0]] :], left[1:]
            continue
        one = front.pop()
        mark[own[one]] = 1
        both = np.add.reduceat(mark[flat], np.r_[0, np.cumsum(size[left])[:-1]], dtype=np.int64)
        mark[own[one]] = 0
        near = 9 * both >= 4 * (size[left] + size[one])  # both / (a + b - both) >= 0.8
        if near.any():
            out[left[near]] = out[one]
            front += left[near].tolist()
            flat, left = flat[~np.repeat(near, size[left])], left[~near]
    return out


def _verified(group: pd.DataFrame) -> pd.DataFrame:
    group = group.drop_duplicates("node").sort_values("node")
    nodes = group["node"].to_numpy(np.int64)
    return pd.DataFrame({"node": nodes, "root": nodes[linked(group["shingles"].tolist())]})


def marked(keyed: DataFrame) -> DataFrame:
    """doc_id, __k, and the shingle set's hash and wide fingerprint, of rows with doc_id, __k and text."""
    return stash(keyed.select("doc_id", "__k", "text").mapInPandas(_marked, ", ".join(f"{c} long" for c in ("doc_id", "__k", "node", *PRINTS))))


def _crossed(group: pd.DataFrame) -> pd.DataFrame:
    """Links of two parts of a large group, as (node, root)."""
    return _verified(group)[["node", "root"]]


def large(sets: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, root) of the groups of over LARGE texts; `sizes` has their root and n, and is small beside them."""
    pivots = stash(sets.select("root", "node").join(F.broadcast(sizes), "root").groupBy("root", "n").agg(F.min("node").alias("node")))
    first = stash(sets.join(F.broadcast(pivots), ["root", "node"]).select("root", "n", F.col("node").alias("pivot"), F.col("shingles").alias("__p")))
    both = F.size(F.array_intersect("shingles", "__p"))
    near = 9 * both >= 4 * (F.size("shingles") + F.size("__p"))
    seen = stash(sets.join(F.broadcast(first), "root").select("root", "n", "pivot", "node", "shingles", near.alias("near")))
    core = seen.filter("near").select("node", F.col("pivot").alias("root"))
    left = stash(seen.filter("not near").groupBy("root").agg(F.count("*").alias("m")))
    parts, others = F.ceil(F.col("n") / PART).cast("int"), F.ceil(F.col("m") / PART).cast("int")
    rows = seen.join(F.broadcast(left), "root").select("root", "node", "shingles", "near", parts.alias("p"), others.alias("q"))
    own = F.pmod(F.xxhash64("node"), F.col("p")).cast("int")
    other = F.pmod(F.xxhash64("node"), F.col("q")).cast("int")
    all_ = rows.select("root", "node", "shingles", own.alias("x"), F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("y"))
    open_ = rows.filter("not near").select("root", "node", "shingles", F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("x"), other.alias("y"))
    crossed = all_.unionByName(open_).groupBy("root", "x", "y").applyInPandas(_crossed, "node long, root long")
    roots = stash(components(core.unionByName(crossed).select(F.col("root").alias("a"), F.col("node").alias("b"))))
    return seen.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def placed(keyed: DataFrame, rows: DataFrame, most: int = LARGE) -> DataFrame:
    """(node, root) of all distinct shingle sets, by verified links; `rows` are the `marked` ones of `keyed`."""
    nodes = stash(rows.select("node", *PRINTS).dropDuplicates(["node"]))
    found = stash(components(simhash_tiles.wide_links(nodes.filter(F.col("node") != EMPTY))))
    sizes = stash(found.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") > most))
    one = stash(spread_join(rows.select("node", "__k"), found, "node").groupBy("root", "node").agg(F.min("__k").alias("__one")))
    texts = keyed.select("__k", "text").join(one, F.col("__k") == F.col("__one")).select("root", "node", "text")
    sets = texts.mapInPandas(_shingled, "root long, node long, shingles array<long>")
    if not sizes.limit(1).count():
        links = sets.groupBy("root").applyInPandas(_verified, "node long, root long")
    else:
        sets = stash(sets.dropDuplicates(["node"]))
        links = sets.join(sizes, "root", "left_anti").groupBy("root").applyInPandas(_verified, "node long, root long").unionByName(large(sets.join(F.broadcast(sizes), "root", "left_semi"), sizes))
    return nodes.select("node").join(links, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
