"""Sector records, user functions, and the reports that a campaign's ledgers make."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from girder.functions.text import instant_ms
from girder.operators.campaigns import conceded_measure, measure_standing, windows

MOST_NOTES, MOST_NOTE = 20, 500  # fixed values: what a record holds

# -- user functions ----------------------------------------------------------------------------------------------------

REGISTRY: dict[str, Callable] = {}


def registered(name: str) -> Callable[[Callable], Callable]:
    """Makes a function available to policies as `module#export`."""

    def add(f: Callable) -> Callable:
        REGISTRY[name] = f
        return f

    return add


def function(name: str) -> Callable:
    if name not in REGISTRY:
        raise KeyError(f"no function {name} is registered")
    return REGISTRY[name]


def predicate_hits(files: DataFrame, predicate: Callable[[str, str], bool]) -> DataFrame:
    """Paths for which a predicate over (path, text) holds, in Arrow batches."""

    @F.pandas_udf("boolean")
    def run(path: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([bool(predicate(p, t)) for p, t in zip(path, text, strict=True)])

    return files.withColumn("__hit", run("path", "text")).filter("__hit").select("path")


def predicate_subjects(files: DataFrame, subjects: Callable[[str, str], list[str]]) -> DataFrame:
    """(path, key, anchor): the subjects that a function names in each file, as a detector leaf reads them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(p, s, s) for p, t in zip(part["path"], part["text"], strict=True) for s in subjects(p, t)]
            yield pd.DataFrame(rows, columns=["path", "key", "anchor"])

    return files.select("path", "text").mapInPandas(run, "path string, key string, anchor string")


def measured(files: DataFrame, measure: Callable[[str, str], float]) -> DataFrame:
    """(path, value): a finite number from 0 on, or NaN for what did not measure."""

    @F.pandas_udf("double")
    def run(path: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([float(measure(p, t)) for p, t in zip(path, text, strict=True)], dtype="float64")

    value = run("path", "text")
    out = files.select("path", value.alias("value"))
    fine = (F.col("value") >= 0) & (F.col("value") < float("inf")) & ~F.isnan("value")
    return out.withColumn("value", F.when(fine, F.col("value")).otherwise(float("nan")))


def binding_admits(matches: DataFrame, bindings: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    """Matches (path, key, identifier) whose identifier is imported: the root of a dotted name is looked up among the file's
    local names, the first import wins. bindings: path, spec_ord, bind_ord, symbol, local, target_path."""
    root = F.substring_index("identifier", ".", 1)
    first = bindings.filter("local is not null").groupBy("path", "local").agg(F.min_by(F.struct("symbol", "target_path"), F.struct("spec_ord", "bind_ord")).alias("b"))
    found = matches.withColumn("local", root).join(first, ["path", "local"]).select(*matches.columns, F.col("b.symbol").alias("symbol"), F.col("b.target_path").alias("target_path"))
    return found.filter(F.col("symbol").isin(*symbols)) if symbols else found


# -- markers -----------------------------------------------------------------------------------------------------------


def marker_of(text: str) -> dict | None:
    """An object literal (`export default {...}` or `= {...}`) read without running it; null where it is not plain data."""
    m = re.search(r"(?:export\s+default|=)\s*(\{.*?\})\s*(?:as\s+const|satisfies\s+\w+)?\s*;?\s*$", text, re.S)
    if not m:
        return None
    body = re.sub(r"//[^\n]*|/\*.*?\*/", "", m[1], flags=re.S)
    body = re.sub(r"'((?:[^'\\\n]|\\.)*)'", lambda s: json.dumps(s[1]), body)
    body = re.sub(r"([{,]\s*)([A-Za-z_$][\w$]*)\s*:", r'\1"\2":', body)
    try:
        found = json.loads(re.sub(r",\s*([}\]])", r"\1", body))
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def markers(files: DataFrame, name: str) -> DataFrame:
    """(path, sector) of marker files: the name that the literal states, else the folder's."""

    @F.pandas_udf("string")
    def read(text: pd.Series) -> pd.Series:
        return text.map(lambda t: (marker_of(t) or {}).get("name"), na_action="ignore").astype(object)

    rows = files.filter(F.substring_index("path", "/", -1) == name)
    return rows.select("path", F.coalesce(read("text"), F.element_at(F.split("path", "/"), -2)).alias("sector"))


# -- records -----------------------------------------------------------------------------------------------------------


REVOKED = "struct<at:string,by:string,reason:string>"
ATTESTED = f"array<struct<phase:string,by:string,at:string,reason:string,evidence:string,revoked:{REVOKED}>>"


def live_attestations() -> Column:
    return F.filter("attested", lambda a: a["revoked"].isNull())


def attested(records: DataFrame, positions: DataFrame, phases: DataFrame, phase: str, by: str, at: str, reason: str, evidence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, refused): the step is added, with its reason and evidence, for the sectors of `positions` (sector, phase_at)
    that stand at the phase. Refused with a word why: a phase that is not attested, and sectors that stand elsewhere."""
    found = phases.filter(F.col("phase") == phase).select("ord", F.col("attested").alias("asks"))
    row = found.first()
    at_phase = positions.withColumn("refused", F.when(F.lit(row is None), "no such phase").when(F.lit(row is not None and not row["asks"]), "not an attested phase").when(F.col("phase_at") != (row["ord"] if row else -1), "stands elsewhere"))
    new = F.struct(F.lit(phase).alias("phase"), F.lit(by).alias("by"), F.lit(at).alias("at"), F.lit(reason).alias("reason"), F.lit(evidence).cast("string").alias("evidence"), F.lit(None).cast(REVOKED).alias("revoked"))
    granted = at_phase.filter("refused is null").select("sector", F.lit(True).alias("__granted"))
    out = records.join(granted, "sector", "left").withColumn("attested", F.when(F.col("__granted"), F.concat("attested", F.array(new))).otherwise(F.col("attested")))
    return out.drop("__granted").select(*records.columns), at_phase.filter("refused is not null").select("sector", "refused")


def revoked(records: DataFrame, phases: list[str], at: str, by: str, reason: str) -> DataFrame:
    """Live attestations of the phases that a sector was sent back across are revoked, with who did it and why."""
    mark = F.struct(F.lit(at).alias("at"), F.lit(by).alias("by"), F.lit(reason).alias("reason"))
    return records.withColumn("attested", F.transform("attested", lambda a: F.when(a["revoked"].isNull() & a["phase"].isin(*phases), a.withField("revoked", mark)).otherwise(a)))


def noted(records: DataFrame, text: str, by: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(records, refused): a note of bounded length is added; a record that holds MOST_NOTES refuses it and stays as it is."""
    if len(text) > MOST_NOTE:
        raise ValueError(f"a note has at most {MOST_NOTE} characters")
    full = F.size("notes") >= MOST_NOTES
    note = F.array(F.struct(F.lit(text).alias("text"), F.lit(by).alias("by"), F.lit(at).alias("at")))
    return records.withColumn("notes", F.when(full, F.col("notes")).otherwise(F.concat("notes", note))), records.filter(full).select("sector")


def reached(records: DataFrame, phases: DataFrame, at: str) -> DataFrame:
    """The furthest phase a sector has stood in only advances, and `since` with it; phases: sector, phase_at."""
    out = records.join(phases.select("sector", "phase_at"), "sector", "left")
    moved = F.coalesce(F.col("phase_at") > F.coalesce("reached", F.lit(-1)), F.lit(False))
    return out.withColumns({"reached": F.when(moved, F.col("phase_at")).otherwise(F.col("reached")), "since": F.when(moved, at).otherwise(F.col("since"))}).select(*records.columns)


def sent_back(before: DataFrame, after: DataFrame, phases: DataFrame) -> DataFrame:
    """(sector, was, now, crossed): sectors that a concession moves down, with the attested phases they lose."""
    moved = before.select("sector", F.col("phase_at").alias("was")).join(after.select("sector", F.col("phase_at").alias("now")), "sector").filter("now < was")
    crossed = moved.join(F.broadcast(phases.filter("attested").select("ord", "phase")), F.expr("ord > now and ord < was"), "left")
    return crossed.groupBy("sector", "was", "now").agg(F.array_sort(F.collect_list("phase")).alias("crossed"))


def on_touch(phase: Column, campaign: Column, is_open: Column) -> Column:
    return F.coalesce(phase, campaign, F.when(is_open, "advise").otherwise("ratchet"))


def on_ahead(objective: Column, phase: Column, campaign: Column) -> Column:
    return F.coalesce(objective, phase, campaign, F.lit("advise"))


# -- reports -----------------------------------------------------------------------------------------------------------


def report(states: DataFrame, sectors: DataFrame, holdouts: DataFrame) -> DataFrame:
    """(objective, sector, new, stale, drifted, ledgered, entered, open): what `check` says of each ledgered sector."""
    n = states.groupBy("objective", "sector").pivot("state", ["unrecorded", "stale", "drifted", "ledgered"]).count().na.fill(0)
    held = holdouts.groupBy("objective", "sector").agg(F.count("*").alias("open"))
    out = n.join(sectors.select("objective", "sector", "entered"), ["objective", "sector"], "full").join(held, ["objective", "sector"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.select("objective", "sector", zero("unrecorded").alias("new"), *(zero(c).alias(c) for c in ("stale", "drifted", "ledgered")), F.col("entered").isNotNull().alias("entered"), zero("open").alias("open"))


#: Why a campaign fails, in the order in which a check names it, with the condition on a campaign's report.
REASONS = {
    "drift": "drift > 0",
    "unreceipted": "unreceipted > 0",
    "unmeasured": "unmeasured > 0",
    "stale": "stale > 0",
    "arithmetic": "not arithmetic",
    "missing ledger": "missing",
    "growth": "new > 0 and not missing",
    "complete": "complete and not missing and on_complete = 'remove'",
}


def campaign_report(rows: DataFrame) -> DataFrame:
    """One row a campaign from rows of (campaign, objective, sector) with inside (the window), count, entered, new, stale, holds,
    unmeasured and the campaign's drift, unreceipted and on_complete: what a check reads. A campaign misses a ledger if a sector
    in its window has none, though its objective has hits there or a ledger elsewhere; it is complete with nothing left."""
    known = F.max("entered").over(Window.partitionBy("campaign", "objective"))
    missing = F.col("inside") & ~F.col("entered") & ((F.col("count") > 0) | known)
    counted = F.when(F.col("inside"), F.col("count")).otherwise(0)
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    sums = rows.withColumn("__missing", missing).groupBy("campaign").agg(
        F.sum(counted).alias("count"), F.sum("new").alias("new"), F.sum("stale").alias("stale"), F.bool_and("holds").alias("arithmetic"), F.bool_or("__missing").alias("missing"), F.count_if("unmeasured").alias("unmeasured"), first("drift"), first("unreceipted"), first("on_complete")
    )
    return sums.withColumn("complete", (F.col("count") == 0) & (F.col("stale") == 0) & (F.col("unmeasured") == 0))


def failures(reports: DataFrame) -> DataFrame:
    """(campaign, reasons): the campaigns that fail, each with its reasons in order."""
    picked = [F.when(F.coalesce(F.expr(c), F.lit(False)), F.lit(r)) for r, c in REASONS.items()]
    return reports.select("campaign", F.array_compact(F.array(*picked)).alias("reasons")).filter("size(reasons) > 0")


def unrecorded_sectors(hits: DataFrame, ledger: DataFrame, phases: DataFrame) -> DataFrame:
    """Sectors with hits that no ledger holds yet, with the phase they stand in."""
    new = hits.select("objective", "sector").distinct().join(ledger.select("objective", "sector").distinct(), ["objective", "sector"], "left_anti")
    return new.join(phases.select("sector", "phase_at"), "sector", "left")


def prerequisites(shared: DataFrame, objectives: DataFrame, phases: DataFrame, positions: DataFrame) -> DataFrame:
    """(objective, n, waiting): objectives over shared files that still count, with the sectors that stand at their phase."""
    owed = shared.filter("n > 0").groupBy("objective").agg(F.sum("n").alias("n"))
    at = owed.join(windows(objectives, phases).select("objective", "first"), "objective")
    return at.join(positions.select(F.col("phase_at").alias("first"), "sector"), "first", "left").groupBy("objective", "n").agg(F.array_sort(F.collect_set("sector")).alias("waiting"))


def fresh_concessions(now: DataFrame, head: DataFrame) -> DataFrame:
    """Concessions that the committed state does not hold, compared whole; equal fresh ones all stay."""
    key = lambda df: F.to_json(F.struct(*sorted(df.columns)))
    return now.withColumn("__j", key(now)).join(head.select(key(head).alias("__j")), "__j", "left_anti").drop("__j")


def chosen_holdouts(states: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(granted, unknown): the unrecorded entries that were named, and names that are none."""
    open_ = states.filter("state = 'unrecorded'").select("objective", "sector", "entry")
    keys = ["objective", "sector", "entry"]
    return open_.join(wanted, keys, "left_semi"), wanted.join(open_, keys, "left_anti")


def conceded_measures(rows: DataFrame, tolerance: Column, at: str, by: str, reason: str, keys: tuple[str, ...] = ("objective", "sector")) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, receipts, left): only records that their value breaches are held to it; left are those it does not."""
    breached = measure_standing(rows, tolerance) == "breached"
    out, receipts = conceded_measure(rows.filter(breached), at, by, reason, keys)
    return out.unionByName(rows.filter(~breached)), receipts, rows.filter(~breached).select(*keys)


def measure_stalled(totals: DataFrame, stale_after_ms: int | None, now: str) -> Column:
    """No improvement, attestation or note within the policy's time: created, last_improved and sector_clock; never without one."""
    if stale_after_ms is None:
        return F.lit(False)
    return instant_ms(F.lit(now)) - instant_ms(F.greatest("created", "last_improved", "sector_clock")) > stale_after_ms


def plan_of(phases: DataFrame) -> DataFrame:
    """What a `clear` records of a plan: phase, ord, hash, defined and the number of its concessions."""
    return phases.select("phase", "ord", "hash", (~F.col("open")).alias("defined"), F.size(F.coalesce("concessions", F.array().cast("array<string>"))).alias("concessions"))


def grows(phases: DataFrame, positions: DataFrame) -> DataFrame:
    """(sector, objective): the measures that a sector's phase expects to rise; phases: ord, grows; positions: sector, phase_at."""
    named = phases.select(F.col("ord").alias("phase_at"), F.explode("grows").alias("objective"))
    return positions.join(F.broadcast(named), "phase_at").select("sector", "objective")


def base_side(states: DataFrame) -> DataFrame:
    """States of another commit as they are kept: what did not measure is null."""
    return states.withColumn("value", F.nanvl("value", F.lit(None).cast("double")))


def clock(records: DataFrame) -> DataFrame:
    """(sector, sector_clock): the last instant at which a sector advanced, was attested (revoked since or not) or noted, as text."""
    said = F.array_max(F.concat(F.transform("attested", lambda a: a["at"]), F.transform("notes", lambda n: n["at"])))
    return records.select("sector", F.greatest("since", said).alias("sector_clock"))


def ladder(shares: DataFrame, phases: DataFrame) -> DataFrame:
    """shares: sector, phase_at, objective, paid. (sector, position): the phase, plus the mean share of it that is paid."""
    steps = phases.filter("not open").count()
    named = phases.select(F.col("ord").alias("phase_at"), F.explode("objectives").alias("objective"))
    paid = shares.join(F.broadcast(named), ["phase_at", "objective"]).groupBy("sector").agg(F.avg("paid").alias("paid"))
    at = shares.select("sector", "phase_at").distinct().join(paid, "sector", "left")
    inside = F.col("phase_at") + F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("paid", F.lit(0.0))))
    return at.select("sector", F.when(F.col("phase_at") >= steps, F.lit(float(steps))).otherwise(inside).alias("position"))


def deltas(history: DataFrame, columns: list[str]) -> DataFrame:
    """A history with each column's change since the commit before; commits are in text order, one row each, a few thousand."""
    order = Window.orderBy("commit")
    return history.select("*", *((F.col(c) - F.lag(c).over(order)).alias(f"{c}_delta") for c in columns))
