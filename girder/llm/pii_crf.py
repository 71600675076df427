"""Operator 2: personal data by fixed patterns and a linear-chain conditional random field.

The patterns find e-mail addresses, IPv4 addresses, card and phone numbers. The field adds what patterns miss: secrets such as
access tokens, phone numbers without a country code, and spelled-out addresses. Its features are word shapes (of a word and
its neighbours), its weights are fitted on the driver to a small labelled table by gradient ascent on the likelihood, and
executors decode whole texts by Viterbi over padded numpy batches of lines.

Lines are the field's sequences and are decoded whole, however long they are; scores are made some thousand words at a time.
Words whose features are alike share a class; features are of whole words, and those the field was not fitted to have no
weight, so there are few classes.

Defined results: a null or empty text has no spans; positions are code points, ends exclusive; a span of the field that
overlaps a pattern's is dropped, so the patterns' spans always stay; equal texts get equal spans, however long their lines
and words; other columns pass through `find` and `mask` untouched, and if there is a column `spans`, the new one is `spans_`.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.llm.common import bounded_batches, free_name, holding

KINDS = ("email", "ip", "card", "phone", "secret")
ORDER = {k: i for i, k in enumerate(KINDS)}
LABELS = ("O", "B-phone", "I-phone", "B-secret", "I-secret", "B-email", "I-email")
MOST_LABELLED = 5_000  # sentences of the labelled table that training reads

# -- patterns ----------------------------------------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can only start where a run of digits does, so no place inside a run is tried again
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the run of local characters before an @ that a domain follows."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(free, at + 1))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of what the fixed patterns find, by start and kind."""
    out = [(a, "email", b) for a, b in emails(text)] if "@" in text else []
    out += [(m.start(), "ip", m.end()) for m in IP.finditer(text) if all(len(d := x.lstrip("0")) < 4 and int(d or 0) < 256 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    if "+" in text:
        out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], ORDER[s[1]]))


# -- word shapes -------------------------------------------------------------------------------------------------------

CUES = frozenset("= : token key secret password passwd pwd apikey api_key bearer tel phone call fax mobile".split())
AT, DOT = frozenset(("(at)", "[at]", "{at}")), frozenset(("(dot)", "[dot]", "{dot}"))
HEAD, TAIL = re.compile(r"[0-9A-Za-z(\[]"), re.compile(r".*[0-9A-Za-z)\]]", re.S)
RUNS = ((re.compile(r"[^\W\d_]+"), "x"), (re.compile(r"[0-9]{6,}"), "D"), (re.compile(r"[0-9]"), "d"))


def core_of(word: str) -> tuple[int, int]:
    """Where a word begins and ends without the marks on its ends; empty if there is nothing else."""
    a, b = HEAD.search(word), TAIL.match(word)
    return (a.start(), b.end()) if a and b and a.start() < b.end() else (0, 0)


def features(word: str) -> tuple[str, ...]:
    """Shape, length and cue of a word; the shape of a plain word is x, whatever marks hang on its ends."""
    a, b = core_of(word)
    core = word[a:b]
    low = core.lower()
    if low in AT or low in DOT:
        return ("at" if low in AT else "dot",)
    if not core:
        return ("cue " + word,) if word in CUES else ("mark",)
    if core.isalpha():
        return ("x", "cue " + low) if low in CUES else ("x",)
    if core.isascii() and core.isalnum():
        size = len(core)
        if not core.isdigit():
            turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:], strict=False))
            return ("mixed", f"mixed {min(size // 8, 4)}", f"turns {min(turns // 3, 3)}")
        return ("digits", f"digits {min(size, 12)}")
    shape = core
    for run, mark in RUNS:
        shape = run.sub(mark, shape)
    return ("shape " + shape,)


# -- training ----------------------------------------------------------------------------------------------------------

SYLLABLES = "an the on er in re ou st le de que ment en ch un ver ge ci os ra mi la".split()


def labelled(n: int = 450, seed: int = 5) -> Iterator[tuple[int, list[str], list[str]]]:
    """The labelled table: sentences of invented words, with numbers and marks that are no personal data, and some that are."""
    rnd = random.Random(seed)
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4)))
    hexes = lambda k: "".join(rnd.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rnd.choice("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))
    marks = ("", "", "", ",", ".", "###", "!!", "***", "&&&")

    def word() -> str:
        w = name() + rnd.choice(marks)
        return rnd.choice((w, w, w.capitalize(), w.upper()))

    for i in range(n):
        words, tags = [], []

        def add(text: Iterable[str], tag: str = "", words=words, tags=tags) -> None:
            for k, w in enumerate(text):
                words.append(w)
                tags.append(f"{'I' if k else 'B'}-{tag}" if tag else "O")

        for _ in range(rnd.randint(1, 4)):
            add(word() for _ in range(rnd.randint(1, 7)))
            kind = rnd.randrange(14)
            if kind == 0:
                add((rnd.choice(("token", "key", "secret", "TOKEN", "apikey", "password")), "="))
                add((f'"{rnd.choice((hexes, mixed))(rnd.choice((20, 24, 32, 40, 64)))}"' + rnd.choice(marks),), "secret")
            elif kind == 1:
                add((rnd.choice((hexes, mixed))(rnd.choice((32, 40, 48))),), "secret")
            elif kind == 2:
                add((f"({digits(3)})", f"{digits(3)}-{digits(4)}" + rnd.choice(marks)), "phone")
            elif kind == 3:
                add((f"{digits(3)}-{digits(3)}-{digits(4)}",), "phone")
            elif kind == 4:
                add((name(), rnd.choice(("[at]", "(at)")), name(), rnd.choice(("[dot]", "(dot)")), "com"), "email")
            elif kind == 5:
                add((digits(rnd.choice((1, 2, 3, 4, 5, 8, 12, 16))),))
            elif kind == 6:
                add((".".join(digits(rnd.randint(1, 3)) for _ in range(4)),))
            elif kind == 7:
                add((f"{name()}.{digits(2)}@{name()}.com",))
            elif kind == 8:
                add((rnd.choice(("token", "key", "call", "phone", "=", ":", "|", "at", "dot")),))
            elif kind == 9:
                add((f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}"))
            elif kind == 10:
                add((name() + digits(rnd.randint(1, 3)), f"{digits(1)}.{digits(2)}", f"({name()})"))
            elif kind == 11:
                add(("+" + digits(1), f"({digits(3)})", f"{digits(3)}-{digits(4)}"), "phone")
            elif kind == 12:
                add(("=", '"' + name() + '"', f"({digits(4)})"))
        add((word(),))
        yield i, words, tags


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(labelled()), "sentence long, words array<string>, labels array<string>")


PLACES = (-2, -1, 0, 1)
STEPS = 4096  # words of a line whose scores are made at once


class Field:
    """Weights by feature, place (two before, before, own, next) and label, and the transitions between labels."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray, first: np.ndarray) -> None:
        self.names, self.weights, self.moves, self.first = names, weights, moves, first
        self.classes: dict[tuple[int, ...], int] = {}
        self.words: dict[str, int] = {}
        self.table = np.zeros((1, len(PLACES), len(LABELS)), np.float32)  # class 0: beyond a line's ends

    def class_of(self, word: str) -> int:
        """Words with equal known features share a class, a row of summed weights."""
        known = tuple(self.names[f] for f in features(word) if f in self.names)
        k = self.classes.get(known)
        if k is None:
            k = self.classes[known] = len(self.table)
            row = self.weights[list(known)].sum(0) if known else np.zeros(self.table.shape[1:], np.float32)
            self.table = np.concatenate((self.table, row[None].astype(np.float32)))
        if len(self.words) > 200_000:
            self.words.clear()
        if len(word) <= 40:
            self.words[word] = k
        return k

    def emissions(self, classes: np.ndarray) -> np.ndarray:
        """Classes (lines, words), with two before each line's first and one behind its last, to scores (lines, words, labels)."""
        n = classes.shape[1] - 3
        return sum(self.table[classes[:, 2 + p : 2 + p + n], k] for k, p in enumerate(PLACES))

    def decode(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of lines, the longest first, by Viterbi; what lies beyond a line's end keeps its last state."""
        rows, n = len(classes), classes.shape[1] - 3
        back = np.zeros((n, rows, len(LABELS)), np.int8)
        score = np.zeros((rows, len(LABELS)), np.float32)
        for block in range(0, n, STEPS):
            e = self.emissions(classes[:, block : block + STEPS + 3])
            for t in range(block, min(block + STEPS, n)):
                open_ = int(np.searchsorted(-lengths, -t))
                if not t:
                    score = e[:, 0] + self.first
                    continue
                moved = score[:open_, :, None] + self.moves
                back[t, :open_] = moved.argmax(1)
                score[:open_] = moved.max(1) + e[:open_, t - block]
        out = np.zeros((rows, n), np.int8)
        at = score.argmax(1)
        every = np.arange(rows)
        for t in range(n - 1, -1, -1):
            inside = lengths > t
            out[inside, t] = at[inside]
            if t:
                at = np.where(inside, back[t, every, at], at)
        return out


def fit(table: list[tuple[list[str], list[str]]], steps: int = 70, penalty: float = 0.002) -> Field:
    """Maximum likelihood with a Gaussian prior, by full-batch Adam over padded sentences."""
    names = {f: i for i, f in enumerate(sorted({f for words, _ in table for w in words for f in features(w)}))}
    n, most, k = len(table), max(len(w) for w, _ in table), len(LABELS)
    per_word = np.zeros((n, most + 3, 3), int) - 1
    gold, mask = np.zeros((n, most), int), np.zeros((n, most), bool)
    for i, (words, tags) in enumerate(table):
        for t, (w, tag) in enumerate(zip(words, tags, strict=True)):
            ids = [names[f] for f in features(w)][:3]
            per_word[i, t + 2, : len(ids)] = ids
            gold[i, t], mask[i, t] = LABELS.index(tag), True
    m = len(names)
    per_word[per_word < 0] = m  # one more row, kept at zero
    weights, moves, first = np.zeros((m + 1, len(PLACES), k)), np.zeros((k, k)), np.zeros(k)
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, moves, first)]
    truth = np.eye(k)[gold] * mask[..., None]
    lse = lambda x, axis: (top := x.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(x - top).sum(axis))
    gold_moves = np.einsum("itk,itl->kl", truth[:, :-1] * mask[:, 1:, None], truth[:, 1:])
    for step in range(1, steps + 1):
        e = sum(weights[per_word[:, 2 + p : 2 + p + most], j].sum(2) for j, p in enumerate(PLACES)) * mask[..., None]
        ahead, behind = np.zeros((n, most, k)), np.zeros((n, most, k))
        ahead[:, 0] = e[:, 0] + first
        for t in range(1, most):
            ahead[:, t] = np.where(mask[:, t, None], lse(ahead[:, t - 1, :, None] + moves, 1) + e[:, t], ahead[:, t - 1])
        for t in range(most - 2, -1, -1):
            behind[:, t] = np.where(mask[:, t + 1, None], lse(moves + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
        z = lse(ahead[:, -1], 1)
        p = np.exp(ahead + behind - z[:, None, None]) * mask[..., None]
        pair = np.exp(ahead[:, :-1, :, None] + moves + (e + behind)[:, 1:, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        gap = truth - p
        grads = [np.zeros_like(weights), gold_moves - pair.sum((0, 1)), gap[:, 0].sum(0)]
        for j, q in enumerate(PLACES):
            ids = per_word[:, 2 + q : 2 + q + most]
            for c in range(3):
                np.add.at(grads[0][:, j], ids[..., c], gap)
        for x, g, (a, b) in zip((weights, moves, first), grads, state, strict=True):
            g = g / n - penalty * x
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            x += 0.15 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
        weights[m] = 0
    return Field(names, weights[:m].astype(np.float32), moves.astype(np.float32), first.astype(np.float32))


def trained(spark: SparkSession, table: DataFrame | None = None) -> Field:
    """The field, fitted to a labelled table (words, labels) of which at most MOST_LABELLED sentences are read."""
    rows = (table or labelled_table(spark)).orderBy("sentence").limit(MOST_LABELLED).collect()
    return fit([(list(r["words"]), list(r["labels"])) for r in rows if r["words"]])


# -- spans -------------------------------------------------------------------------------------------------------------

WORDS = re.compile(r"\S+")
TOKENS = 60_000  # words of one grid of lines, unless a single line has more


def field_spans(field: Field, texts: list[str]) -> list[list[tuple[int, str, int]]]:
    """What the field finds in each text."""
    found: list[list[tuple[int, str, int]]] = [[] for _ in texts]
    lines: list[tuple[int, int, str, list[int]]] = []  # text, place, words, their classes and what surrounds them
    size = 0

    def spans_of(doc: int, start: int, line: str, labels: np.ndarray) -> None:
        """The spans of a line, from the labels of its words."""
        spans, run, last = [], "", -2
        marked = dict(zip(at := np.flatnonzero(labels).tolist(), labels[at].tolist(), strict=True))
        for i, m in enumerate(WORDS.finditer(line)):
            if i not in marked:
                continue
            tag, (a, b) = LABELS[marked[i]], core_of(m[0])
            if tag[0] == "I" and run == tag[2:] and last == i - 1:
                spans[-1][2] = start + m.start() + b if a < b else spans[-1][2]
            elif a < b:
                spans.append([start + m.start() + a, tag[2:], start + m.start() + b])
            run, last = tag[2:] if spans else "", i
        found[doc] += [tuple(s) for s in spans if s[0] < s[2]]

    def flush() -> None:
        nonlocal size
        lines.sort(key=lambda x: -len(x[3]))
        i = 0
        while i < len(lines):
            some = lines[i : i + max(1, TOKENS // len(lines[i][3]))]
            i += len(some)
            lengths = np.array([len(x[3]) - 3 for x in some])
            classes = np.zeros((len(some), lengths[0] + 3), np.int32)
            classes[np.arange(lengths[0] + 3) < lengths[:, None] + 3] = np.concatenate([np.array(x[3], np.int32) for x in some])
            labels = field.decode(classes, lengths)
            for r in np.flatnonzero(labels.any(1)):
                spans_of(*some[r][:3], labels[r])
        lines.clear()
        size = 0

    known = field.words.get
    for doc, text in enumerate(texts):
        start = 0
        for line in text.split("\n"):
            if words := line.split():
                lines.append((doc, start, line, [0, 0, *[known(w) or field.class_of(w) for w in words], 0]))
                size += len(words)
            start += len(line) + 1
        if size > 8 * TOKENS:
            flush()
    flush()
    return found


def all_spans(field: Field, texts: list[str]) -> Iterator[tuple[list, list]]:
    """Of each text the patterns' spans, and those with the field's added."""
    for text, more in zip(texts, field_spans(field, texts), strict=True):
        base = base_spans(text)
        new = [s for s in more if not any(s[0] < b[2] and b[0] < s[2] for b in base)] if more else []
        yield base, sorted(base + new, key=lambda s: (s[0], ORDER[s[1]])) if new else base


def written(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def masked(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first counts."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join((*out, text[at:])) if spans else text


SPAN = "array<struct<kind:string,start:int,end:int>>"


def find(documents: DataFrame, text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """`documents` with a column `spans`."""
    field = trained(documents.sparkSession, labelled)

    @F.pandas_udf(SPAN)
    def spans(x: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b} for a, k, b in got] for _, got in all_spans(field, x.fillna("").tolist())], dtype=object)

    return bounded_batches(documents).withColumn(free_name(documents, "spans"), spans(F.col(text)))


def mask(documents: DataFrame, text: str = "text", labelled: DataFrame | None = None) -> DataFrame:
    """`documents` with personal data in `text` replaced; a null text stays null."""
    field = trained(documents.sparkSession, labelled)

    @F.pandas_udf("string")
    def clean(x: pd.Series) -> pd.Series:
        holding("pii")
        texts = x.fillna("").tolist()
        return pd.Series([masked(t, got) for t, (_, got) in zip(texts, all_spans(field, texts), strict=True)], dtype=object).where(x.notna(), None)

    return bounded_batches(documents).withColumn(text, clean(F.col(text)))


DIGEST = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def digests(documents: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    field = trained(documents.sparkSession, labelled)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holding("pii")
        for part in parts:
            texts = part.pop("text").fillna("").tolist()
            rows = [(*(sum(s[1] == k for s in base) for k in KINDS[:4]), hashlib.sha256(written(base).encode()).hexdigest(), written(every)) for base, every in all_spans(field, texts)]
            more = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], index=part.index)
            yield pd.concat((part, more), axis=1).astype({f"n_{k}": "int64" for k in KINDS[:4]})

    return bounded_batches(documents).select("doc_id", "text").mapInPandas(run, DIGEST)
