"""Rules of each family as Python records, and as small tables that queries broadcast.

A policy has tens to hundreds of rules; `rule_table` refuses more than MOST_RULES, which bounds what is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.plans.patterns import compiled, groups_of

MOST_RULES = 10_000
Many = list[str]


@dataclass(frozen=True)
class Allowance:
    node: str
    kind: str  # allow or external
    entry: str
    pattern: str | None = None
    fragment: str | None = None


@dataclass(frozen=True)
class ImportRule:
    name: str
    message: str = ""
    from_: Many = field(default_factory=list)
    from_not: Many = field(default_factory=list)
    to: Many = field(default_factory=list)
    to_not: Many = field(default_factory=list)
    externals: Many = field(default_factory=list)
    dependency_kind: str | None = None
    allowances: list[Allowance] = field(default_factory=list)


@dataclass(frozen=True)
class ExportRule:
    name: str
    message: str = ""
    from_: Many = field(default_factory=list)
    from_not: Many = field(default_factory=list)
    to: Many = field(default_factory=list)
    to_not: Many = field(default_factory=list)
    symbols: Many | None = None
    kinds: Many = field(default_factory=lambda: ["named"])
    fix: str | None = None


@dataclass(frozen=True)
class MemberRule:
    name: str
    message: str = ""
    from_: Many = field(default_factory=list)
    from_not: Many = field(default_factory=list)
    subject: str = "members"
    in_: Many = field(default_factory=list)
    declares: Many | None = None
    match: Many = field(default_factory=list)
    match_not: Many = field(default_factory=list)
    allow: Many = field(default_factory=list)


@dataclass(frozen=True)
class SurfaceRule:
    name: str
    message: str = ""
    from_: Many = field(default_factory=list)
    from_not: Many = field(default_factory=list)
    kinds: Many | None = None
    declares: Many | None = None
    reexport: bool | None = None
    match: Many = field(default_factory=list)
    match_not: Many = field(default_factory=list)
    demand: str = "forbid"  # forbid, allow, convention, count
    allow: Many = field(default_factory=list)
    convention: str | None = None
    least: int | None = None
    most: int | None = None


@dataclass(frozen=True)
class ParityRule:
    name: str
    message: str = ""
    file: Many = field(default_factory=list)
    file_not: Many = field(default_factory=list)
    requires: Many = field(default_factory=list)


@dataclass(frozen=True)
class NamingRule:
    name: str
    message: str = ""
    file: Many = field(default_factory=list)
    file_not: Many = field(default_factory=list)
    subject: int = 1
    same_as: int | None = None
    convention: str | None = None


@dataclass(frozen=True)
class FolderRule:
    name: str
    message: str = ""
    folder: Many = field(default_factory=list)
    files: Many = field(default_factory=list)


@dataclass(frozen=True)
class RootRule:
    name: str
    message: str = ""
    path: Many = field(default_factory=list)


@dataclass(frozen=True)
class GraphRule:
    """cycles and orphans use within, within_not and (orphans) entry; reach uses from_, to and via."""

    name: str
    message: str = ""
    within: Many = field(default_factory=list)
    within_not: Many = field(default_factory=list)
    entry: Many = field(default_factory=list)
    from_: Many = field(default_factory=list)
    to: Many = field(default_factory=list)
    via: Many = field(default_factory=list)


PATTERNS = {"from_", "from_not", "to", "to_not", "in_", "match", "match_not", "allow", "file", "file_not", "folder", "files", "path", "within", "within_not", "entry", "via"}
PLAIN_LISTS = {"externals", "symbols", "kinds", "declares", "requires"}


def rule_table(spark: SparkSession, rules: list) -> DataFrame:
    """Rules of one kind in order; pattern columns in Java's dialect, with the number of groups of `from_` and `file`."""
    if not rules:
        raise ValueError("no rules")
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} are broadcast")
    names = [f.name for f in fields(rules[0]) if f.name != "allowances"]
    kind = {n: "array<string>" if n in PATTERNS | PLAIN_LISTS else "int" if n in ("subject", "same_as", "least", "most") and not (n == "subject" and isinstance(rules[0], MemberRule)) else "boolean" if n == "reexport" else "string" for n in names}
    rows = []
    for ord_, r in enumerate(rules):
        values = {n: compiled(r.name, n, getattr(r, n)) if n in PATTERNS else getattr(r, n) for n in names}
        if values.get("convention"):
            values["convention"] = compiled(r.name, "convention", values["convention"])[0]
        first = values.get("from_", values.get("file", []))
        rows.append((ord_, [groups_of(p) for p in first], *values.values()))
    schema = "ord int, groups array<int>, " + ", ".join(f"`{n}` {kind[n]}" for n in names)
    return spark.createDataFrame(rows, schema)


def allowance_table(spark: SparkSession, rules: list[ImportRule]) -> DataFrame:
    rows = [(i, k, a.node, a.kind, a.entry, compiled(r.name, "allow", a.pattern)[0] if a.pattern else None, a.fragment) for i, r in enumerate(rules) for k, a in enumerate(r.allowances)]
    if len(rows) > MOST_RULES:
        raise ValueError(f"{len(rows)} allowances; at most {MOST_RULES} are broadcast")
    return F.broadcast(spark.createDataFrame(rows, "ord int, allow_ord int, node string, allow_kind string, entry string, pattern string, fragment string"))
