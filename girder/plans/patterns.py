"""Patterns: dialect, globs, conventions, and matching a path against lists of patterns with captures.

Policies are written with JavaScript regexes and globs; Spark evaluates Java's dialect. Patterns are policy metadata and are
translated once on the driver; matching is Column arithmetic over array columns of a small rule table.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from girder.functions.text import escaped

# Naming conventions by name.
CONVENTIONS = {
    "kebab-case": r"^[a-z0-9]+(?:-[a-z0-9]+)*$",
    "camelCase": r"^[a-z][a-zA-Z0-9]*$",
    "PascalCase": r"^[A-Z][a-zA-Z0-9]*$",
    "snake_case": r"^[a-z0-9]+(?:_[a-z0-9]+)*$",
}
BACKREFERENCE = re.compile(r"\$([1-9])")


class PatternError(ValueError):
    """A pattern that cannot be used, with the rule and side that hold it."""


def to_java(pattern: str, multiline: bool = False) -> str:
    """A JavaScript pattern in Java's dialect: `$` means the very end, brackets and && inside classes are plain."""
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if inside:
            if c == "]":
                inside = False
            elif c == "[":
                c = r"\["
            elif c == "&" and pattern[i + 1 : i + 2] == "&":
                c = r"\&"
        elif c == "[":
            inside = True
            if pattern[i + 1 : i + 2] == "]":
                raise PatternError(f"an empty class in {pattern!r}")
        elif c == "$" and not multiline and not BACKREFERENCE.match(pattern, i):
            c = r"\z"
        out.append(c)
        i += 1
    if inside:
        raise PatternError(f"an open class in {pattern!r}")
    return ("(?m)" if multiline else "") + "".join(out)


def groups_of(pattern: str) -> int:
    """Number of capturing groups."""
    n, i, inside = 0, 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 2
            continue
        if c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif c == "(" and not inside and (pattern[i + 1 : i + 2] != "?" or re.match(r"\(\?<(?![=!])", pattern[i:])):
            n += 1
        i += 1
    return n


def compiled(rule: str, side: str, patterns: str | list[str] | None) -> list[str]:
    """A list of patterns in Java's dialect; a bad one is refused with its place."""
    listed = [] if patterns is None else [patterns] if isinstance(patterns, str) else list(patterns)
    out = []
    for p in listed:
        java = to_java(p)
        try:
            re.compile(BACKREFERENCE.sub("x", java).replace(r"\z", r"\Z"))
        except re.error as e:
            raise PatternError(f"{rule}: {side} {p!r}: {e}") from e
        out.append(java)
    return out


def glob_to_regex(glob: str) -> str:
    """A glob as an anchored regex: * and ? stay inside a segment, ** crosses them, a trailing /** also matches the folder
    itself, {name} captures a segment and refers back to it when it comes again."""
    out, seen, i = ["^"], [], 0
    while i < len(glob):
        if glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("(?:/.*)?")
            i += 3
        elif glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("**", i):
            out.append(".*")
            i += 2
        elif glob[i] == "*":
            out.append("[^/]*")
            i += 1
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "{" and (m := re.match(r"\{([A-Za-z_]\w*)\}", glob[i:])):
            if m[1] in seen:
                out.append(f"\\{seen.index(m[1]) + 1}")
            else:
                seen.append(m[1])
                out.append("([^/]+)")
            i += len(m[0])
        elif glob[i] == "[" and (end := glob.find("]", i + 1)) > 0:
            body = glob[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", "\\\\") + "]")
            i = end + 1
        else:
            out.append(re.escape(glob[i]) if glob[i] in r".+^$()|{}[]\\" else glob[i])
            i += 1
    return "".join(out) + "$"


def subtree_glob(glob: str) -> str:
    """A glob anchored at its start only: it also matches all that lies below."""
    return glob_to_regex(glob)[:-1]


def fixed_prefix(glob: str) -> str:
    """What of a glob comes before its first wildcard, whole segments only."""
    head = re.split(r"[*?{\[]", glob, maxsplit=1)[0]
    return head if head == glob else head.rpartition("/")[0]


def any_match(patterns: Column, value: Column) -> Column:
    """Whether any pattern of an array column is found in the value; a null value matches nothing."""
    return F.coalesce(F.exists(patterns, lambda p: F.call_function("rlike", value, p)), F.lit(False))


def captures(patterns: Column, groups: Column, vetoes: Column, value: Column) -> Column:
    """Groups of the first pattern found in the value (element 0 is the whole match), null if none is or a veto is."""
    at = F.array_position(F.transform(patterns, lambda p: F.call_function("rlike", value, p)), F.lit(True)).cast("int")
    pattern, n = F.get(patterns, at - 1), F.get(groups, at - 1)
    found = F.transform(F.sequence(F.lit(0), n), lambda i: F.call_function("regexp_extract", value, pattern, i))
    return F.when((at > 0) & ~any_match(vetoes, value), found)


def substituted(patterns: Column, caught: Column) -> Column:
    """$1 to $9 replaced by escaped captures; a group that does not exist leaves its mark as it stands."""
    safe = F.transform(caught, lambda c: F.replace(escaped(c), F.lit("$"), F.lit("\x01")))
    steps = F.when(F.size(caught) > 1, F.sequence(F.lit(1), F.size(caught) - 1)).otherwise(F.array().cast("array<int>"))
    put = lambda p: F.aggregate(steps, p, lambda acc, i: F.replace(acc, F.concat(F.lit("$"), i.cast("string")), F.get(safe, i)))
    return F.transform(patterns, lambda p: F.replace(put(p), F.lit("\x01"), F.lit("$")))


def reportable(to: Column, to_not: Column, caught: Column, target: Column) -> Column:
    """Whether a target falls under a rule: any of `to` (all if empty) and none of `to_not`."""
    return ((F.size(to) == 0) | any_match(substituted(to, caught), target)) & ~any_match(substituted(to_not, caught), target)
