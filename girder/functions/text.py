"""Scalar functions on paths, texts and instants, as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the regex metacharacters that are escaped when data is spliced into a pattern.
METACHARACTERS = r"[.*+?^${}()|\[\]\\]"


def dirname(path: Column) -> Column:
    """Folder of a path; empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*\z", 1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def base_of(name: Column) -> Column:
    """A file name without its final extension; a name that only starts with a dot keeps it."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*\z", "")


def without_extension(path: Column) -> Column:
    return F.when(dirname(path) == "", base_of(path)).otherwise(F.concat(dirname(path), F.lit("/"), base_of(basename(path))))


def resolved(folder: Column, relative: Column) -> Column:
    """`relative` seen from `folder`, with . and .. taken out."""
    parts = F.concat(F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/")), F.split(relative, "/"))
    step = lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((s == ".") | (s == ""), acc).otherwise(F.concat(acc, F.array(s)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def ancestors(path: Column) -> Column:
    """All folders above a path, topmost first, the root left out."""
    parts = F.split(path, "/")
    many = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(F.size(parts) > 1, many).otherwise(F.array().cast("array<string>"))


def escaped(value: Column) -> Column:
    """A value that matches only itself inside a pattern."""
    return F.regexp_replace(value, METACHARACTERS, r"\\$0")


def npm_package(path: Column) -> Column:
    """Package of a path inside the last node_modules folder; a scope stays with its name."""
    return F.nullif(F.regexp_extract(path, r"^.*(?:^|/)node_modules/((?:@[^/]+/)?[^/]+)", 1), F.lit(""))


def fnv1a(text: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as eight hex digits."""

    @F.pandas_udf("string")
    def digest(column: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            h, units = 0x811C9DC5, t.encode("utf-16-le", "surrogatepass")
            for i in range(0, len(units), 2):
                h = ((h ^ (units[i] | units[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
            return f"{h:08x}"

        return column.map(one, na_action=None)

    return digest(text)


def fnv1a_ascii(text: Column) -> Column:
    """The same for ASCII texts, without leaving the JVM."""
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    h = F.aggregate(units, F.lit(2166136261).cast("long"), lambda a, c: (a.bitwiseXOR(c) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long")))
    return F.lower(F.lpad(F.hex(h), 8, "0"))


def round_measure(value: Column) -> Column:
    """Six decimals, halves toward positive infinity."""
    return F.when(F.isnan(value), value).otherwise(F.floor(value * 1e6 + 0.5) / 1e6)


def non_blank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n"), lambda s: s.rlike(r"\S"))).cast("long")


def duration_ms(text: Column) -> Column:
    """`12d` or `36h` in milliseconds; null for anything else."""
    n = F.regexp_extract(text, r"^(\d+)[dh]$", 1)
    unit = F.when(text.endswith("d"), F.lit(86_400_000)).otherwise(F.lit(3_600_000))
    return F.when(n != "", n.cast("long") * unit)


def instant_ms(text: Column) -> Column:
    return F.unix_millis(F.to_timestamp(text))


def days_between(a: Column, b: Column) -> Column:
    return F.floor((instant_ms(b) - instant_ms(a)) / 86_400_000)


def number_of(text: Column) -> Column:
    """A number printed by a command; NaN where none can be read (hexadecimal notations are not)."""
    return F.coalesce(F.trim(text).try_cast("double"), F.lit(float("nan")))


def singular(name: Column) -> Column:
    """What one of a plural folder is called, by the ending; `name` for what cannot be a word."""
    word = F.regexp_replace(name, "[^A-Za-z0-9]", "")
    one = F.when(word.rlike("ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(ses|xes|zes|shes|ches)$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[^s]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    return F.when((one == "") | one.rlike("^[0-9]"), "name").otherwise(one)


def stereotype(path: Column) -> Column:
    """`*.rest` of a file name with three dot-separated parts or more, else the name itself."""
    name = basename(path)
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) >= 3, F.concat(F.lit("*."), F.array_join(F.slice(parts, 2, F.size(parts) - 1), "."))).otherwise(name)


def floor_percent(share: Column) -> Column:
    return F.floor(share * 100)
