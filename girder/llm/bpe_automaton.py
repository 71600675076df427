"""Operator 5: BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens; a path from its start spells one correct tokenization. It begins as one state with a loop for each
base symbol. Each merge u v -> w, in order, adds one gadget: every arc labelled u is redirected to a copy of its target that
lacks the arc v, and wherever u could be read an arc w is added that ends where v ended. All arcs with one label share their
target at any time, so a state is known by the label that leads to it, and a gadget is three steps on one bit table of states
by labels: the row of w becomes a copy of the row of v, the bit (u, v) is struck, and the column of w becomes a copy of the
column of u. When all merges are in, equal rows and equal columns are folded, which leaves the transition table. Labels that
end a word lead to the accepting state and have no row.

Encoding drives two tables over the symbols of pre-split words, many words a step: the table of a string automaton over all
labels tells the longest label that ends at a place, the transition table whether its arc leaves the state before it; if not,
the next shorter label is tried. Exactly one label leads from a reached state to each place, so no choice is ever undone.
Decoding emits the labels of the arcs. Ids of frequent words are kept in a bounded table of each worker.

Defined results: a null or empty text gives no ids and an empty text, null ids decode to an empty text; very long words are
encoded in time proportional to their length; repeats give equal rows; other columns are kept by `encoded` and `decoded`, and
if the name of the new column is taken, underscores are added to it. Special tokens written out in a text become their ids,
as in the library.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from girder.llm.common import bounded_batches, free_name, holding, text_or_empty

MOST_WORDS = 400_000  # words whose ids a worker keeps
CELLS = 1 << 21  # symbols of one step's grid of words
GROUP_CHARS = 1 << 20  # characters of the texts that are encoded together

#: str.split() also cuts at the four separators U+001C to U+001F, which are not white space.
ODD = regex.compile(r"\p{White_Space}+")
ODD_IN = re.compile("[\x1c-\x1f]").search

# The printable byte alphabet of byte-level vocabularies keeps these bytes; all others follow from U+0100.
KEPT = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))


def byte_alphabet() -> list[str]:
    kept = {b for r in KEPT for b in r}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in kept else chr(next(other)) for b in range(256)]


def transitions(inner: list[int], merges: list[tuple[int, int, int]], n_labels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table, row of each label, column of each label): whether a label's arc leaves the state behind another label.

    `inner` are the labels that end no word, `merges` (u, v, w) in order. The table is packed, eight states a byte, for each
    kind of column. Row 0 is the start. Rows are numbered so that the states that will be copied from a label's state lie
    behind it, by the time of the copy: then a gadget's strike and what later copies inherit of it are one range of rows.
    """
    copies: dict[int, list[tuple[int, int]]] = {}
    inside = np.zeros(n_labels, bool)
    inside[inner] = True
    made = set()
    for born, (_, v, w) in enumerate(merges):
        made.add(w)
        if inside[w]:
            copies.setdefault(v, []).append((born, w))
    row, end = np.zeros(n_labels, np.int64), np.zeros(n_labels, np.int64)
    n = 1
    for base in (x for x in inner if x not in made):
        stack = [(base, False)]
        while stack:
            x, done = stack.pop()
            if done:
                end[x] = n
                continue
            row[x] = n
            n += 1
            stack.append((x, True))
            stack += [(w, False) for _, w in reversed(copies.get(x, ()))]
    width = -(-n // 8)
    bits = np.full((n_labels, width), 255, np.uint8)
    late = dict.fromkeys(copies, 0)  # copies of a label's state made so far
    for born, (u, v, w) in enumerate(merges):
        column, own = bits[v], copies.get(u, ())
        k = late.get(u, 0)
        while k < len(own) and own[k][0] <= born:
            k += 1
        late[u] = k
        first = int(row[u])
        if not column[first >> 3] >> (first & 7) & 1:  # v never follows u, so nothing makes w
            bits[w] = 0
            continue
        column[first >> 3] &= 255 - (1 << (first & 7))
        if k < len(own):
            a, b = int(row[own[k][1]]), int(end[u])
            i, j = a >> 3, b >> 3
            if i == j:
                column[i] &= 255 - ((1 << (b & 7)) - (1 << (a & 7)))
            else:
                column[i] &= (1 << (a & 7)) - 1
                column[i + 1 : j] = 0
                if b & 7:
                    column[j] &= 256 - (1 << (b & 7))
        bits[w] = bits[u]
    kinds: dict[bytes, int] = {}
    column = np.fromiter((kinds.setdefault(x.tobytes(), len(kinds)) for x in bits), np.int32, n_labels)
    return np.frombuffer(b"".join(kinds), np.uint8).reshape(len(kinds), width), row.astype(np.int32), column


class Automaton:
    """Encoder and decoder for a BPE vocabulary whose last symbol of a word carries a suffix."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        labels = {i: t for t, i in vocab.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.labels = [labels.get(i, "") for i in range(max(labels) + 1)]
        self.numbers = [str(i) for i in range(len(self.labels))]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.pieces = regex.compile(split.replace(r"\s", r"\p{White_Space}")).findall
        byte = {c: b for b, c in enumerate(byte_alphabet())}
        spelled = lambda t: bytes(map(byte.__getitem__, t))
        inner = {spelled(t): i for t, i in vocab.items() if not t.endswith(end)}
        final = {spelled(t[: -len(end)]): i for t, i in vocab.items() if t.endswith(end)}
        merges = [(vocab[u], vocab[v], vocab[u + v]) for u, v in model["merges"]]
        self.table, self.row, self.column = transitions(list(inner.values()), merges, len(self.labels))
        self._match(inner, final)
        self.kind = np.dtype("<u2" if len(self.labels) < 1 << 16 else "<u4")  # of ids that are kept
        self.by_word: dict[str, bytes] = {}

    def _match(self, inner: dict[bytes, int], final: dict[bytes, int]) -> None:
        """The string automaton: `step` over symbols; `ends` is the longest label inside a word that ends at a state's
        place, `closes` the longest one that ends the word there with a symbol; `shorter` leads from label to label."""
        children: list[dict[int, int]] = [{}]
        where = {b"": 0}
        for label in [*inner, *(t[:-1] for t in final)]:
            at = 0
            for k, b in enumerate(label):
                if (to := children[at].get(b)) is None:
                    to = children[at][b] = where[label[: k + 1]] = len(children)
                    children.append({})
                at = to
        n = len(children)
        small = lambda most: np.uint16 if most < 1 << 16 else np.int32
        self.step = np.zeros((n, 256), small(n))
        self.ends, self.closes = np.zeros(n, np.int32), np.zeros((n, 256), small(len(self.labels)))
        self.size, self.shorter = np.zeros(len(self.labels), np.int32), np.zeros(len(self.labels), np.int32)
        for labels in (inner, final):
            for t, i in labels.items():
                self.size[i] = len(t)
                self.shorter[i] = next((labels[t[k:]] for k in range(1, len(t)) if t[k:] in labels), -1)
        back = [0] * n
        own = {where[t]: i for t, i in inner.items()}
        ended: dict[int, list[tuple[int, int]]] = {}
        for t, i in final.items():
            ended.setdefault(where[t[:-1]], []).append((t[-1], i))
        queue = [0]
        for s in queue:  # breadth first: a state's fallback is shorter, so it is complete
            fall = back[s]
            if s:
                self.step[s], self.closes[s], self.ends[s] = self.step[fall], self.closes[fall], self.ends[fall]
                if s in own:
                    self.ends[s] = own[s]
            for b, i in ended.get(s, ()):
                self.closes[s, b] = i
            for b, to in children[s].items():
                back[to] = int(self.step[fall, b]) if s else 0
                self.step[s, b] = to
                queue.append(to)

    def run(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-split pieces, by table-driven steps over many pieces at once."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order, out, each = np.argsort(-sizes, kind="stable"), [b""] * len(pieces), self.kind.itemsize
        a = 0
        while a < len(order) and sizes[order[a]]:
            width = int(sizes[order[a]])
            some = order[a : a + max(1, CELLS // width)]
            some = some[sizes[some] > 0]
            a += len(some)
            flat, counts = self._steps([pieces[i] for i in some], sizes[some])
            ids, b = flat.astype(self.kind).tobytes(), 0
            for i, n in zip(some.tolist(), (counts * each).tolist(), strict=True):
                out[i] = ids[b : b + n]
                b += n
        return out

    def _steps(self, pieces: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, the longest first, one after the other, and how many each has."""
        n, width = len(pieces), int(sizes[0])
        inside = np.arange(width) < sizes[:, None]
        symbols = np.zeros((n, width), np.uint8)
        symbols[inside] = np.frombuffer(b"".join(pieces), np.uint8)
        symbols = np.ascontiguousarray(symbols.T)
        last = np.zeros((width, n), np.int32)  # the label that ends after each symbol
        rows = np.zeros((width + 1, n), np.int32)  # and the state behind it; 0 is the start
        at = np.zeros(n, np.int32)
        most = np.searchsorted(-sizes, -np.arange(width + 1), "left")  # pieces longer than k
        for k in range(width):
            open_, longer = int(np.searchsorted(-sizes, -k, "left")), int(most[k + 1])
            now = symbols[k, :open_]
            label = self.closes[at[:open_], now].astype(np.int32)
            at = self.step[at[:longer], now[:longer]]
            label[:longer] = self.ends[at]
            todo = np.arange(open_)
            while len(todo):
                tried = label[todo]
                state = rows[k + 1 - self.size[tried], todo]
                shut = self.table[self.column[tried], state >> 3] >> (state & 7).astype(np.uint8) & 1 == 0
                todo = todo[shut]
                label[todo] = self.shorter[tried[shut]]
            last[k, :open_] = label
            rows[k + 1, :open_] = self.row[label]
        # back from each end over the labels' sizes
        chosen, place, todo = np.zeros((n, width), bool), sizes - 1, np.arange(n)
        while len(todo):
            chosen[todo, place] = True
            place = place - self.size[last[place, todo]]
            todo, place = todo[place >= 0], place[place >= 0]
        return last.T[chosen], chosen.sum(1)

    def learn(self, words: list[str]) -> None:
        """Add the ids of words without white space to the table of results."""
        plain = [w for w in words if w.isascii() and w.isalpha()]
        other = {w: self.pieces(w) for w in words if not (w.isascii() and w.isalpha())}
        kinds = list({*plain, *chain.from_iterable(other.values())})
        ids = dict(zip(kinds, self.run([p.encode("utf-8", "surrogatepass") for p in kinds]), strict=True))
        self.by_word.update((w, ids[w]) for w in plain)
        self.by_word.update((w, b"".join(map(ids.__getitem__, ps))) for w, ps in other.items())

    def normalized(self, text: str) -> str:
        """NFC, then each character lowered on its own."""
        return (text if text.isascii() else unicodedata.normalize("NFC", text).replace("Σ", "σ")).lower()

    def _words(self, text: str) -> list[str]:
        words: list[str] = []
        for k, part in enumerate(self.cut.split(text) if self.cut and "<|" in text else (text,)):
            if k % 2:
                words.append("\0" + part)  # a special token
            else:
                words += (ODD.split if ODD_IN(part) else str.split)(self.normalized(part))
        return words

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; texts are encoded some together, so that their new words share the steps."""
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= GROUP_CHARS):
                size += len(texts[b])
                b += 1
            split = list(map(self._words, texts[a:b]))
            if len(self.by_word) > MOST_WORDS:
                self.by_word.clear()
            known = self.by_word
            known.update(("\0" + t, np.array([i], self.kind).tobytes()) for t, i in self.special.items())
            fresh = list(set(chain.from_iterable(split)).difference(known))
            self.learn(fresh)
            for words in split:
                yield np.frombuffer(b"".join(map(known.__getitem__, words)), self.kind).tolist()
            for w in fresh:
                if len(w) > 40:
                    del known[w]
            a = b

    def encode(self, text: str | None) -> list[int]:
        return next(self.encode_all([text or ""]))

    def decode(self, ids: list[int]) -> str:
        """Labels of the arcs, joined as the library joins them where it has no decoder."""
        return " ".join(map(self.labels.__getitem__, ids))


@cache
def automaton(path: str) -> Automaton:
    return Automaton(path)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoded(documents: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """`documents` with a column `ids`."""
    from pyspark.sql import functions as F

    @F.pandas_udf("array<int>")
    def ids(x: pd.Series) -> pd.Series:
        return pd.Series(list(automaton(path or vocabulary()).encode_all(x.tolist())), index=x.index, dtype=object)

    return bounded_batches(documents).withColumn(free_name(documents, "ids"), ids(text_or_empty(text)))


def decoded(tokens: DataFrame, ids: str = "ids", path: str | None = None) -> DataFrame:
    """`tokens` with a column `decoded`; null ids decode to an empty text."""
    from pyspark.sql import functions as F

    @F.pandas_udf("string")
    def labels(x: pd.Series) -> pd.Series:
        return x.map(lambda i: automaton(path or vocabulary()).decode(i if i is not None else []))

    return tokens.withColumn(free_name(tokens, "decoded"), labels(F.col(ids)))


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Ids and decoded text of each document, as digests."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holding("bpe", automaton.cache_clear)
        own = automaton(path or vocabulary())
        sha = lambda x: hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest()
        for part in parts:
            rows = [(len(ids), sha(" ".join(map(own.numbers.__getitem__, ids))), sha(own.decode(ids))) for ids in own.encode_all(part.pop("text").tolist())]
            n, ids, labels = zip(*rows) if rows else ((), (), ())
            yield part.assign(n_tokens=pd.array(n, "int64"), ids_sha256=list(ids), decoded_sha256=list(labels))

    return bounded_batches(documents).select("doc_id", text_or_empty().alias("text")).mapInPandas(run, DIGEST)
