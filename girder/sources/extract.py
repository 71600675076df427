"""Facts of TypeScript and JavaScript texts, by a tokenizer that runs in Arrow batches.

A partial reader: import and export forms, members of interfaces, classes and type literals, and calls. Facts from another
parser can be read instead (`read_facts`). A text it cannot read yields no facts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.schema import FACTS

TOKEN = re.compile(r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[A-Za-z_$][\w$]*|\d[\w.]*|=>|\.\.\.|[^\s\w]", re.S)
SCRIPT = re.compile(r"<script\b[^>]*>(.*?)</script\s*>", re.S | re.I)
DECLARED = {"function": "function", "class": "class", "const": "variable", "let": "variable", "var": "variable", "type": "type", "interface": "interface", "enum": "enum"}
NOT_CALLED = frozenset("if for while switch catch function return typeof new super import require constructor".split())


def script_of_component(text: str) -> str:
    """A component's script blocks with all other text blanked, so offsets stay."""
    out, at = [], 0
    for m in SCRIPT.finditer(text):
        out += [re.sub(r"[^\n]", " ", text[at : m.start(1)]), m[1]]
        at = m.end(1)
    return "".join((*out, re.sub(r"[^\n]", " ", text[at:])))


def tokens(text: str) -> list[str]:
    return [t for t in TOKEN.findall(text) if not t.startswith(("//", "/*"))]


def literal(token: str) -> str | None:
    return token[1:-1] if token[:1] in "\"'" else token[1:-1] if token[:1] == "`" and "${" not in token else None


class Reader:
    def __init__(self, text: str) -> None:
        self.t = tokens(text)
        self.specifiers: list[str] = []
        self.bindings: list[tuple] = []
        self.members: list[tuple] = []
        self.exports: list[tuple] = []

    def at(self, i: int) -> str:
        return self.t[i] if 0 <= i < len(self.t) else ""

    def edge(self, token: str) -> str | None:
        s = literal(token) if token else None
        if s is not None and s not in self.specifiers:
            self.specifiers.append(s)
        return s

    def names(self, i: int) -> tuple[list[tuple[str, str]], int]:
        """Pairs (imported, local) of a braced list that starts at i, and the place behind it."""
        out, i = [], i + 1
        while i < len(self.t) and self.at(i) != "}":
            if self.at(i) == "type" and self.at(i + 1) not in (",", "}", "as"):
                i += 1
            name = self.at(i)
            if self.at(i + 1) == "as":
                out.append((literal(name) or name, self.at(i + 2)))
                i += 3
            else:
                out.append((literal(name) or name, name))
                i += 1
            if self.at(i) == ",":
                i += 1
        return out, i + 1

    def imported(self, i: int) -> int:
        """An import declaration whose keyword is at i."""
        if self.at(i + 1) == "(" or self.at(i + 1) == ".":
            if self.at(i + 1) == "(" and self.at(i + 3) in (")", ","):
                self.edge(self.at(i + 2))
            return i + 1
        if literal(self.at(i + 1)) is not None:
            self.edge(self.at(i + 1))
            return i + 2
        found, j = [], i + 1
        if self.at(j) == "type" and self.at(j + 1) not in ("from", ",", "="):
            j += 1
        if re.match(r"[A-Za-z_$]", self.at(j)):
            if self.at(j + 1) == "=" and self.at(j + 2) == "require":
                if (s := self.edge(self.at(j + 4))) is not None:
                    self.bindings.append((s, "default", "default", self.at(j)))
                return j + 6
            found.append(("default", "default", self.at(j)))
            j += 1
            if self.at(j) == ",":
                j += 1
        if self.at(j) == "*":
            found.append(("*", "namespace", self.at(j + 2)))
            j += 3
        elif self.at(j) == "{":
            pairs, j = self.names(j)
            found += [("default", "default", b) if a == "default" else (a, "named", b) for a, b in pairs]
        if self.at(j) == "from" and (s := self.edge(self.at(j + 1))) is not None:
            self.bindings += [(s, *x) for x in found]
            return j + 2
        return i + 1

    def exported(self, i: int) -> int:
        j = i + 1
        word = self.at(j)
        if word == "*":
            name = self.at(j + 2) if self.at(j + 1) == "as" else "*"
            k = j + 3 if name != "*" else j + 1
            if self.at(k) == "from" and (s := self.edge(self.at(k + 1))) is not None:
                self.exports.append((name, "namespace" if name == "*" else "named", "other", True))
                self.bindings.append((s, "*", "namespace", None))
            return k + 2
        if word == "{" or word == "type" and self.at(j + 1) == "{":
            pairs, k = self.names(j + (word == "type"))
            again = self.at(k) == "from"
            s = self.edge(self.at(k + 1)) if again else None
            for a, b in pairs:
                self.exports.append((b, "default" if b == "default" else "named", "other", again))
                if s is not None:
                    self.bindings.append((s, a, "default" if a == "default" else "named", None))
            return k + 2 * again
        if word == "default":
            k = j + 1
            while self.at(k) in ("async", "abstract"):
                k += 1
            self.exports.append(("default", "default", DECLARED.get(self.at(k), "expression"), False))
            return k
        while word in ("declare", "async", "abstract") or word == "const" and self.at(j + 1) == "enum":
            j += 1
            word = self.at(j)
        if word in DECLARED:
            k = j + 1 + (self.at(j + 1) == "*")
            self.exports.append((self.at(k), "named", DECLARED[word], False))
            return j
        return i + 1

    def body(self, i: int, name: str, declares: str) -> int:
        """Members of the braces that open at i."""
        depth, start = 0, True
        while i < len(self.t):
            t = self.at(i)
            if t in "{([":
                depth += 1
                start = t == "{" and depth == 1
            elif t in "})]":
                depth -= 1
                if not depth:
                    return i + 1
                start = depth == 1 and t == "}"
            elif depth == 1 and t in (";", ","):
                start = True
            elif depth == 1 and start and re.match(r"[A-Za-z_$\"'#]", t):
                if t in ("readonly", "static", "public", "private", "protected", "abstract", "async", "get", "set", "declare", "override", "accessor") and re.match(r"[A-Za-z_$\"'#\[*]", self.at(i + 1)):
                    i += 1
                    continue
                if t != "constructor" and self.at(i + 1) in ("(", ":", "?", "=", ";", "!", "<", "}", ","):
                    self.members.append(("members", literal(t) or t, name, declares))
                start = False
            i += 1
        return i

    def run(self) -> tuple:
        i, depth = 0, 0
        while i < len(self.t):
            t, before = self.at(i), self.at(i - 1)
            if t in ("{", "("):
                depth += 1
            elif t in ("}", ")"):
                depth -= 1
            elif t == "import" and before != ".":
                i = max(i + 1, self.imported(i))
                continue
            elif t == "export" and depth == 0:
                i = max(i + 1, self.exported(i))
                continue
            elif t == "require" and self.at(i + 1) == "(" and before != "." and self.at(i + 3) == ")":
                self.edge(self.at(i + 2))
            elif t in ("interface", "class") and before != "." and re.match(r"[A-Za-z_$]", self.at(i + 1)) and self.at(i + 1) not in ("extends", "implements"):
                k = i + 2
                while k < len(self.t) and self.at(k) != "{":
                    k += 1
                n = len(self.members)
                self.body(k, self.at(i + 1), t)
                self.members[n:] = sorted(set(self.members[n:]), key=self.members[n:].index)
            elif t == "type" and self.at(i + 2) == "=" and re.match(r"[A-Za-z_$]", self.at(i + 1)):
                k = i + 3
                while k < len(self.t) and self.at(k) not in (";", "{") and self.at(k) not in ("export", "const", "function", "interface", "class", "import"):
                    k += 1
                while self.at(k) == "{":
                    k = self.body(k, self.at(i + 1), "type")
                    if self.at(k) not in ("&", "|"):
                        break
                    k += 1
            if re.match(r"[A-Za-z_$]", t) and self.at(i + 1) == "(" and t not in NOT_CALLED and before not in ("function", "class", "new"):
                self.members.append(("calls", t, None, None))
            i += 1
        return (
            self.specifiers,
            [{"specifier": s, "bind_ord": k, "symbol": y, "kind": d, "local": x or None} for k, (s, y, d, x) in enumerate(self.bindings)],
            [{"site_ord": k, "subject": s, "name": n, "in_decl": d, "declares": c} for k, (s, n, d, c) in enumerate(self.members)],
            [{"site_ord": k, "name": n, "kind": d, "declares": c, "reexport": r} for k, (n, d, c, r) in enumerate(self.exports)],
        )


def facts_of_text(text: str | None, path: str = "") -> tuple:
    try:
        return Reader(script_of_component(text) if path.endswith(".svelte") else text or "").run()
    except (IndexError, ValueError):
        return [], [], [], []


def facts(files: DataFrame) -> DataFrame:
    """files (path, text) to nested facts; filter files by the rules that select them first, this is the costly step."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, *facts_of_text(t, p)) for p, t in zip(part["path"], part["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "specifiers", "bindings", "member_sites", "export_sites"])

    return files.select("path", "text").mapInPandas(run, "path string, " + FACTS)


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, " + FACTS).json(path)


def imports_of(nested: DataFrame) -> DataFrame:
    return nested.select("path", F.posexplode("specifiers").alias("spec_ord", "specifier"))


def exploded(nested: DataFrame, column: str) -> DataFrame:
    return nested.select("path", F.explode(column).alias("x")).select("path", "x.*")
