"""Operator 10: token ids in coded files.

Texts are encoded with the tokenizers library, an end id follows each document, and the ids are written in ascending order of
document ids: the documents are range-partitioned (into no fewer parts than the input has splits), each partition's ids are cut into frames of whole documents, and a frame
(see `id_coder`) holds blocks that are reset and checksummed on their own. A file is a Parquet part of frames with a table of
their documents, so Spark's writer commits it and any store can hold it. Reading decodes frames independently; the place of a
document follows from the frames' totals, summed over partitions and then within them.

The library encodes each distinct run between single spaces or line ends once a worker (runs are independent under its
pre-tokenizer, and so are a word and the marks behind it), many new runs in one text, since a call of its own costs a run more
than its ids do: only a run's first id begins with a space. Texts with other white space are encoded whole.

Defined results: a null or empty text is the end id alone; null ids come first, equal ids by a hash of the text; repeated rows are
documents of their own; an empty table gives an empty result; special tokens written out in a text become their ids, as in
the library; other columns are not read.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girder.llm import id_coder
from girder.llm.common import bounded_batches, holding, stash, text_or_empty

END = 0
FRAME_IDS = 8_000_000  # the coder takes a step for all blocks of a frame at once, so large frames cost less an id
MOST_BROADCAST = 100_000  # frames whose places are broadcast
MOST_RUNS = 1_500_000  # encoded runs that a worker keeps
JOINED = 200  # new runs that are encoded as one text

FILE = "part int, seq int, n_ids long, doc_ids array<long>, lengths array<int>, frame binary"
ODD = re.compile(r"\s\s|^\s|\s\Z|[\x1c-\x1f]|<\|")  # white space that joins runs, and special tokens
MARKS = frozenset(".,;:!?")
ENDED = re.compile("(\x1c?[A-Za-zÀ-ÖØ-öø-ɏ]++)([.,;:!?]++)")  # letters, which the pre-tokenizer parts from the marks behind them
RARE = re.compile(r"[^\S \n]")  # white space but for the usual kinds


def odd(text: str) -> bool:
    """Whether ODD is found in a text; scans for short strings are several times as fast where all white space is usual."""
    if RARE.search(text):
        return bool(ODD.search(text))
    return any(x in text for x in ("  ", "\n\n", " \n", "\n ", "<|")) or text[:1].isspace() or text[-1:].isspace()


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.end = np.array([END], "<u2").tobytes()
        self.spaced = np.zeros(1 << 16, bool)  # ids that begin with a space, which byte-level vocabularies write as "Ġ"
        self.spaced[[i for x, i in self.library.get_vocab().items() if x[0] == "Ġ"]] = True
        line = self._ids(["\n"])[0]
        self.line = int.from_bytes(line, "little")
        self.fixed = {"\x1c": b"", "\x1d": line}
        self.runs: dict[str, bytes] = {**self.fixed}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _runs(self, runs: list[str], glue: str) -> list[bytes]:
        """The ids of runs, each with a space in front if that is the glue, or as they are if it is a line end."""
        out: list[bytes] = []
        groups = [runs[a : a + JOINED] for a in range(0, len(runs), JOINED)]
        for group, whole in zip(groups, self._ids([glue + glue.join(g) for g in groups]), strict=True):
            ids = np.frombuffer(whole, "<u2")
            at = 2 * np.flatnonzero(self.spaced[ids] if glue == " " else ids == self.line)
            if len(at) == len(group):
                begin = at if glue == " " else at + 2
                out += [whole[a:b] for a, b in zip(begin.tolist(), [*at[1:].tolist(), len(whole)], strict=True)]
            else:  # not expected of this vocabulary
                out += self._ids([" " + x if glue == " " else x for x in group])
        return out

    def _known(self, runs: list[str]) -> list[bytes]:
        """The ids of distinct marked runs; new ones are encoded, and remembered unless they are long or end in marks."""
        known = self.runs
        values = list(map(known.get, runs))
        missing = [j for j, v in enumerate(values) if v is None]
        ended = {j: (m[1], "\x1c" + m[2]) for j in missing if runs[j][-1] in MARKS and (m := ENDED.fullmatch(runs[j]))}
        alone = [j for j in missing if j not in ended]
        fresh = {runs[j] for j in alone}.union(*ended.values()).difference(known)
        first = [x for x in fresh if x[0] == "\x1c"]
        later = list(fresh.difference(first))
        known.update(zip(first, self._runs([x[1:] for x in first], "\n"), strict=True))
        known.update(zip(later, self._runs(later, " "), strict=True))
        for j in alone:
            values[j] = known[runs[j]]
        for j, (word, marks) in ended.items():
            values[j] = known[word] + known[marks]
        for x in fresh:
            if len(x) > 40:
                del known[x]
        return values

    def documents(self, texts: list[str]) -> list[bytes]:
        """The ids of each text with the end id, as 16-bit numbers."""
        out: list[bytes] = [b""] * len(texts)
        known, whole, plain = self.runs, [], []
        for i, t in enumerate(texts):
            (whole if odd(t) else plain).append(i)
        for i, ids in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids + self.end
        if len(known) > MOST_RUNS:
            known.clear()
            known.update(self.fixed)
        if not plain:
            return out
        # a run keeps its space in front; where there is none, at the beginning of a text or line, a mark tells
        marked = pa.array(["\x1c" + texts[i].replace("\n", " \x1d \x1c") for i in plain], pa.large_string())
        lists = pc.split_pattern(marked, " ")
        runs = lists.flatten().dictionary_encode()
        values = self._known(runs.dictionary.to_numpy(zero_copy_only=False).tolist())
        every, sizes = np.frombuffer(b"".join(values), "<u2"), np.fromiter(map(len, values), np.int64, len(values)) >> 1
        which = runs.indices.to_numpy(zero_copy_only=False)
        length, ends = sizes[which], np.zeros(len(which) + 1, np.int64)
        np.cumsum(length, out=ends[1:])
        ids = every[np.repeat((np.cumsum(sizes) - sizes)[which] - ends[:-1], length) + np.arange(ends[-1])]
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()].tolist()
        for i, a, b in zip(plain, bounds, bounds[1:], strict=False):
            out[i] = ids[a:b].tobytes() + self.end
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def partitions(documents: DataFrame) -> int:
    """As many as the session's shuffles have, or as the input's splits, whose number grows with the input."""
    splits = documents.select(F.spark_partition_id().alias("p")).distinct().count()
    return max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), splits)


def write(documents: DataFrame, path: str | None = None) -> DataFrame:
    """The files of the corpus: frames in ascending order (part, seq), written to the shared folder and opened again."""

    def frames(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holding("ids", encoder.cache_clear)
        own, part, seq = encoder(path or vocabulary()), TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        docs: list[int | None] = []

        def frame() -> pd.DataFrame:
            nonlocal seq
            every = np.frombuffer(b"".join(ids), "<u2")
            row = (part, seq, len(every), list(docs), [len(x) // 2 for x in ids], id_coder.encode(every))
            seq += 1
            ids.clear()
            docs.clear()
            return pd.DataFrame([row], columns=[x.split()[0] for x in FILE.split(", ")])

        size = 0
        for batch in parts:
            names = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            texts = batch["text"].tolist()
            for d, x in zip(names, own.documents(texts), strict=True):
                ids.append(x)
                docs.append(d)
                size += len(x) // 2
                if size >= FRAME_IDS:
                    yield frame()
                    size = 0
        if ids:
            yield frame()

    n = partitions(documents)
    rows = bounded_batches(documents).select("doc_id", text_or_empty().alias("text"))
    key = F.xxhash64("text")  # keys are sampled on the driver, so they hold no texts
    return stash(rows.repartitionByRange(n, F.col("doc_id"), key).sortWithinPartitions("doc_id", key, "text").mapInPandas(frames, FILE))


def starts(files: DataFrame) -> DataFrame:
    """(part, seq, before): ids of all frames before."""
    light = files.select("part", "seq", "n_ids")
    parts = light.groupBy("part").agg(F.sum("n_ids").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("b"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return light.withColumn("i", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, F.col("part") == F.col("p")).select("part", "seq", (F.col("b") + F.col("i")).alias("before"))


def placed(files: DataFrame) -> DataFrame:
    """The frames with the place of their first id. The table of places is broadcast while it is small, so frames stay put."""
    table = starts(files)
    small = files.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    return files.join(F.broadcast(table) if small else table, ["part", "seq"]).select("before", "doc_ids", "lengths", "frame")


def read(files: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of all documents, from the files alone."""

    def texts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for doc_ids, begin, ids in _documents(parts):
            yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": begin, "ids": [x.astype(np.int32) for x in ids]})

    return placed(files).mapInPandas(texts, "doc_id long, start long, ids array<int>")


def _documents(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[list, np.ndarray, list[np.ndarray]]]:
    for part in parts:
        for before, doc_ids, lengths, frame in zip(part["before"], part["doc_ids"], part["lengths"], part["frame"], strict=True):
            ids, ends = id_coder.decode(bytes(frame)), np.cumsum(np.asarray(lengths, np.int64))
            yield list(doc_ids), before + ends - lengths, np.split(ids, ends[:-1])


DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for doc_ids, begin, ids in _documents(parts):
            named = pd.array([pd.NA if d is None or d != d else int(d) for d in doc_ids], "Int64")
            yield pd.DataFrame({"doc_id": named, "start": begin, "n_tokens": [len(x) for x in ids], "ids_crc32": [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]})

    files = write(documents, path)
    return placed(files).mapInPandas(run, DIGEST)
