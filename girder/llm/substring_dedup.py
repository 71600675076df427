"""Operator 1: repeated passages by FM-indexes over shards of the corpus.

A window is 35 consecutive words of one document. Windows are dealt to shards by content: a window's key is the least hash
among its 8-word grams, so equal windows always meet, and neighbours that share the key travel as one piece. Only pieces whose
key occurs at least twice can hold a repeated window; the words of those are sent to their shard, equal pieces once with their
number. A shard is an FM-index over its pieces (wavelet matrix over the Burrows-Wheeler transform); the pieces are streamed
through it by backward search, and the matching statistics tell which windows occur again. Intervals go back to their
documents, where the covered words are removed.

A key that very many pieces share (a passage that a third of all documents hold) would make a hot shard: above HOT
occurrences a key's windows are dealt one by one, each by a hash of all its words. Equal windows are added up on their way,
whatever their neighbours, so the shard of a window holds one row, and what is found goes back by salted joins.

Defined results: a null or empty text has no words; windows are judged on the input, in any document, the same included;
rows that agree in id and text count as documents of their own; words are cut at the six white-space bytes and kept
unchanged; a very long document is cut into many pieces, and none of them is longer than 62 words; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.llm.common import bounded_batches, spread_join, stash, text_or_empty
from girder.llm.fm_index import Index

WINDOW, GRAM = 35, 8
SPAN = WINDOW - GRAM + 1  # grams of a window, and the most windows of a piece
HOT = 3_000
SHARD_WORDS = 200_000  # words of one index, unless a single key has more
SALTS = 64  # parts in which the pieces that hold a window of a hot key meet what was found
MOST_SEEN = 500_000  # windows that a task knows to have sent
BATCH_BYTES = 1 << 21

_M64 = (1 << 64) - 1
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd multipliers of the two polynomial hashes
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    got = _powers.get((base, inverse))
    if got is None or len(got) < n:
        size = max(n, 1 << 16) * 5 // 4
        x = pow(base, -1, 1 << 64) if inverse else base
        got = np.ones(size, np.uint64)
        got[1:] = x
        got = _powers[base, inverse] = np.cumprod(got)
    return got[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of the words of some texts and of any run of those words, by prefix sums modulo 2**64."""

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.r_[0, edge]
        begin, end = edge[0::2], edge[1::2]
        n = len(data)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASES[0], n))))
        words = mixed((run[end] - run[begin]) * powers(_BASES[0], n, True)[begin] + (end - begin).astype(np.uint64))
        self.n = len(words)
        self.run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * powers(_BASES[1], self.n))))
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.bounds = np.searchsorted(begin, np.r_[0, np.cumsum(sizes)])  # first word of each text

    def of(self, first: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        """Hashes of runs of `size` words from `first` on."""
        span = np.broadcast_to(np.asarray(size), first.shape)
        value = (self.run[first + size] - self.run[first]) * powers(_BASES[1], self.n + 1, True)[first]
        return mixed(value + span.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def pieces(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of the texts' pieces: text, first window (word in the text), windows, key, hash of all words, places of the key."""
    h = Hashes(texts)
    none = (np.empty(0, np.int64),) * 6
    if h.n < WINDOW:
        return none
    grams = h.of(np.arange(h.n - GRAM + 1), GRAM)
    # the least of SPAN neighbours, by doubling
    least, width = grams.copy(), 1
    while 2 * width <= SPAN:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    n = h.n - WINDOW + 1
    keys = np.minimum(least[:n], least[SPAN - width : SPAN - width + n])
    sizes = np.diff(h.bounds)
    owner = np.repeat(np.arange(len(texts)), sizes)
    start = np.arange(len(keys))
    inside = start + WINDOW <= h.bounds[1:][owner[: len(keys)]]
    start = start[inside]
    if not len(start):
        return none
    keys, text = keys[inside], owner[start]
    new = np.ones(len(start), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    offset = np.arange(len(start)) - np.repeat(at, np.diff(np.r_[at, len(start)]))
    new |= offset % SPAN == 0
    at = np.flatnonzero(new)
    windows = np.diff(np.r_[at, len(start)])
    first = start[at]
    # a piece may hold its key gram more than once, and so one window twice
    size = windows + SPAN - 1
    begin = np.cumsum(size) - size
    own = grams[np.repeat(first - begin, size) + np.arange(size.sum())] == np.repeat(keys[at], size)
    times = np.add.reduceat(own.astype(np.int64), begin)
    return text[at], first - h.bounds[:-1][text[at]], windows, keys[at].view(np.int64), h.of(first, windows + WINDOW - 1).view(np.int64), times


def batches(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    a = size = 0
    for b, t in enumerate(texts):
        if size and size + len(t) > BATCH_BYTES:
            yield a, texts[a:b]
            a, size = b, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, texts[a:]


def encoded(column: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in column]


def _pieces(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        doc = part["k"].to_numpy(np.int64)
        for a, some in batches(encoded(part["text"])):
            text, first, windows, key, whole, times = pieces(some)
            yield pd.DataFrame({"k": doc[a:][text] if len(text) else np.empty(0, np.int64), "first": first.astype(np.int32), "n": windows.astype(np.int32), "times": times.astype(np.int32), "key": key, "whole": whole})


PIECE = "k long, first int, n int, times int, key long, whole long"
SENT = "hot boolean, shard long, sign long, key long, whole long, off int, n int, weight long, words binary"
SEQUENCE = "hot boolean, shard long, whole long, n int, weight long, words binary"
FOUND = "hot boolean, shard long, whole long, a int, b int"


def holds(h: Hashes, first: int, windows: int, whole: int) -> bool:
    """Whether the one text of `h` has this piece there; ids are hashes, and two texts may share one."""
    size = windows + WINDOW - 1
    return first + size <= h.n and int(h.of(np.array([first]), size).view(np.int64)[0]) == whole


def _send(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of the pieces to send from each text: a piece as one, or each window of a hot key on its own, with its words
    where the task has not sent them yet. `sign` is a second hash of a window's words."""
    names, seen = [x.split()[0] for x in SENT.split(", ")], set()
    for part in parts:
        rows = []
        for text, wanted in zip(encoded(part["text"]), part["wanted"], strict=True):
            words, h = text.split(), Hashes([text])
            for x in wanted:
                first, n = x["first"], x["n"]
                if not holds(h, first, n, x["whole"]):
                    continue
                if not x["hot"]:
                    rows.append((False, x["key"], 0, x["key"], x["whole"], 0, n, x["weight"], b" ".join(words[first : first + n + WINDOW - 1])))
                    continue
                for i, own in enumerate(h.of(np.arange(first, first + n), WINDOW).view(np.int64).tolist()):
                    window = b" ".join(words[first + i : first + i + WINDOW])
                    sign = int(np.uint64(xxhash.xxh64_intdigest(window)).view(np.int64))
                    rows.append((True, own, sign, x["key"], x["whole"], i, 1, x["weight"], None if (own, sign) in seen else window))
                    if len(seen) >= MOST_SEEN:
                        seen.clear()
                    seen.add((own, sign))
            if len(rows) > 20_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)


def repeated(words: list[list[bytes]], weights: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(sequence, a, b): its windows from a to b, exclusive, occur again, by the matching statistics of one index."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    symbols = pd.factorize(np.array([w for s in words for w in s], dtype=object))[0].astype(np.int64) + 1
    again = Index(symbols, lengths, weights).statistics() >= WINDOW
    edge = np.diff(np.r_[False, again, False].astype(np.int8))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    starts = np.cumsum(lengths) - lengths
    owner = np.searchsorted(starts, begin, "right") - 1  # a run of windows ends before its sequence does
    return zip(owner.tolist(), (begin - starts[owner]).tolist(), (end - starts[owner]).tolist(), strict=True)


def _search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pieces sorted by shard, indexed some shards at a time; rows of one shard are never parted."""
    held: list[pd.DataFrame] = []

    def run(some: pd.DataFrame) -> pd.DataFrame:
        found = repeated([w.split() for w in some["words"]], some["weight"].to_numpy(np.int64))
        hot, shard, whole = some["hot"].to_numpy(bool), some["shard"].to_numpy(), some["whole"].to_numpy()
        return pd.DataFrame([(hot[i], shard[i], whole[i], a, b) for i, a, b in found], columns=["hot", "shard", "whole", "a", "b"])

    for part in parts:
        held.append(part)
        if sum(map(len, held)) * (WINDOW + SPAN // 2) < SHARD_WORDS:
            continue
        every = pd.concat(held, ignore_index=True)
        shard, words = every["shard"].to_numpy(), np.cumsum(every["n"].to_numpy() + WINDOW - 1)
        cuts = np.flatnonzero(shard[1:] != shard[:-1]) + 1  # where a shard may end
        a = 0
        while len(cuts):
            full = np.searchsorted(words, (words[a - 1] if a else 0) + SHARD_WORDS)
            i = np.searchsorted(cuts, min(full, len(every)), "left")
            if i >= len(cuts):
                break
            b = int(cuts[i])
            if b <= a:
                break
            yield run(every.iloc[a:b])
            a = b
        held = [every.iloc[a:]]
    if held and len(every := pd.concat(held, ignore_index=True)):
        yield run(every)


def shared_pieces(rows: DataFrame) -> DataFrame:
    """The pieces whose key occurs again, with the `total` of the key, from rows with k and text."""
    cut = stash(rows.select("k", "text").mapInPandas(_pieces, PIECE))
    totals = stash(cut.groupBy("key").agg(F.sum("times").alias("total")).filter("total > 1"))
    return stash(spread_join(cut, totals, "key", totals.filter(F.col("total") > HOT)))


def sent(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """What the shards are made of, before equal rows are added up; equal pieces are sent once, with their number."""
    kinds = shared.groupBy("key", "whole").agg(F.count("*").alias("weight"), F.min(F.struct("k", "first")).alias("at"), F.first("n").alias("n"), F.first("total").alias("total"))
    chosen = kinds.select(F.col("at.k").alias("d"), F.struct(F.col("at.first").alias("first"), "n", "key", "whole", "weight", (F.col("total") > HOT).alias("hot")).alias("x")).groupBy("d").agg(F.collect_list("x").alias("wanted"))
    # the same columns as in the last join, so that one exchange of the texts serves both
    return rows.select("doc_id", "k", "text").join(chosen, F.col("k") == F.col("d")).select("doc_id", "text", "wanted").mapInPandas(_send, SENT)


def hot_windows(raw: DataFrame) -> DataFrame:
    """One row for each window of the hot keys; its weight is the number of all pieces that hold it."""
    sums = raw.filter("hot").groupBy("shard", "sign").agg(F.sum("weight").alias("weight"), F.first("words", ignorenulls=True).alias("words"))
    return sums.select(F.lit(True).alias("hot"), "shard", F.col("sign").alias("whole"), F.lit(1).alias("n"), "weight", "words")


def searched(sequences: DataFrame) -> DataFrame:
    return sequences.repartition("shard").sortWithinPartitions("shard").select(*(x.split()[0] for x in SEQUENCE.split(", "))).mapInPandas(_search, FOUND)


def intervals(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): the documents with their key k, and (k, first, n, whole, parts) of the repeated windows; parts are (a, b)."""
    rows = bounded_batches(documents).withColumn("text", text_or_empty()).withColumn("k", F.xxhash64("doc_id", "text"))
    shared = shared_pieces(rows)
    raw = sent(rows, shared)
    any_hot = bool(shared.filter(F.col("total") > HOT).limit(1).count())
    if any_hot:
        raw = stash(raw)
    sequences = raw.filter("not hot").groupBy("hot", "shard", "whole", "n").agg(F.max("weight").alias("weight"), F.first("words").alias("words"))
    cold = shared.filter(F.col("total") <= HOT).withColumnRenamed("key", "shard")
    parts = F.array(F.struct("a", "b")).alias("parts")
    if not any_hot:
        return rows, cold.join(searched(sequences).drop("hot"), ["shard", "whole"]).select("k", "first", "n", "whole", parts)
    found = stash(searched(sequences.unionByName(hot_windows(raw))))
    spans = cold.join(found.filter("not hot").drop("hot"), ["shard", "whole"]).select("k", "first", "n", "whole", parts)
    windows = found.filter("hot").select("shard", F.col("whole").alias("sign"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).distinct()
    holders = raw.filter("hot").withColumn("salt", F.pmod("whole", F.lit(SALTS)).cast("int")).join(windows, ["shard", "sign", "salt"])
    offsets = stash(holders.groupBy(F.struct("key", "whole").alias("piece")).agg(F.array_sort(F.collect_set(F.struct(F.col("off").alias("a"), (F.col("off") + 1).alias("b")))).alias("parts")))
    warm = shared.filter(F.col("total") > HOT).withColumn("piece", F.struct("key", "whole"))
    return rows, spans.unionByName(spread_join(warm, offsets, "piece").select("k", "first", "n", "whole", "parts"))


def _removed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        out = []
        for text, spans in zip(encoded(part["text"]), part["spans"], strict=True):
            words = text.split()
            gone = 0
            kept = words
            if spans is not None and len(spans):
                h, cover = Hashes([text]), np.zeros(len(words) + 1, np.int64)
                good: dict[int, bool] = {}
                for x in spans:
                    first = x["first"]
                    if first not in good:
                        good[first] = holds(h, first, x["n"], x["whole"])
                    for run in x["parts"] if good[first] else ():
                        cover[first + run["a"]] += 1
                        cover[min(first + run["b"] - 1 + WINDOW, len(words))] -= 1
                keep = np.cumsum(cover[:-1]) <= 0
                kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                gone = len(words) - len(kept)
            out.append((len(words), gone, b" ".join(kept)))
        n, gone, kept = zip(*out) if out else ((), (), ())
        yield part.drop(columns=["text", "spans"]).assign(n_words=pd.array(n, "int64"), n_removed=pd.array(gone, "int64"), kept=list(kept))


def dedup(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space, as UTF-8 bytes)."""
    rows, spans = intervals(documents)
    by_row = spans.groupBy("k").agg(F.collect_set(F.struct("first", "n", "whole", "parts")).alias("spans"))
    joined = rows.select("doc_id", "k", "text").join(by_row, "k", "left").select("doc_id", "text", "spans")
    return joined.mapInPandas(_removed, "doc_id long, n_words long, n_removed long, kept binary")


def digests(documents: DataFrame) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _removed(parts):
            yield part.assign(kept_sha256=[hashlib.sha256(x).hexdigest() for x in part.pop("kept")])

    rows, spans = intervals(documents)
    by_row = spans.groupBy("k").agg(F.collect_set(F.struct("first", "n", "whole", "parts")).alias("spans"))
    joined = rows.select("doc_id", "k", "text").join(by_row, "k", "left").select("doc_id", "text", "spans")
    return joined.mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: DuckDB SQL for `digests` over the table documents.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
y AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS piece FROM x),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY piece) AS n FROM y) WHERE n > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM again),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
