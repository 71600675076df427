"""A campaign evaluated over its sectors, and the verbs that write its ledgers: clear, concede, and the moves they would make.

An evaluation is two tables. `hits`: objective, sector, path, entry. `states`, one row a sector and objective (the report itself:
sectors by a policy's objectives): n, value, phase_at, reached, first, end, over_shared, measured, inside, behind.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.lineage import settled
from girder.operators import campaigns as C
from girder.operators import records as RC
from girder.operators.measures import distance_to_target
from girder.operators.sectors import LEGACY, SHARED, Sectors

PAIR = ["objective", "sector"]
SECTOR_ENTRY = "~"  # fixed value: the entry of a sector that is a holdout itself


@dataclass
class Plan:
    """phases: ord, phase, objectives, attested, open. objectives: objective, until, over_shared, measured, direction, target."""

    phases: DataFrame
    objectives: DataFrame
    shared: bool = False

    def windows(self) -> DataFrame:
        return C.windows(self.objectives, self.phases)


@dataclass
class Evaluation:
    hits: DataFrame
    states: DataFrame


def sector_hits(sectors: DataFrame, objective: str) -> DataFrame:
    """Hits of an objective that asks something of a whole sector, for the sectors (sector) that fail it."""
    return sectors.select(F.lit(objective).alias("objective"), "sector", F.lit(None).cast("string").alias("path"), F.lit(SECTOR_ENTRY).alias("entry"))


def summed_parts(parts: DataFrame, sectors: Sectors) -> DataFrame:
    """(objective, sector, of, per) from what each file (objective, path, of, per) contributes to the sector it stands in."""
    at = parts.join(sectors.files.select("path", "sector"), "path")
    return at.groupBy(*PAIR).agg(F.sum("of").alias("of"), F.sum("per").alias("per"))


def positions_of(names: DataFrame, records: DataFrame) -> DataFrame:
    """(sector, reached, attested): -1 and nothing where no record is, live attestations only."""
    live = records.select("sector", "reached", F.transform(RC.live_attestations(), lambda a: a["phase"]).alias("attested"))
    none = F.array().cast("array<string>")
    return names.select("sector").join(live, "sector", "left").select("sector", F.coalesce("reached", F.lit(-1)).alias("reached"), F.coalesce("attested", none).alias("attested"))


def evaluated(sectors: Sectors, plan: Plan, hits: DataFrame, records: DataFrame, values: DataFrame | None = None) -> Evaluation:
    """hits: objective, sector, path, entry; values: objective, sector, value of measures (0 where none is, NaN did not measure).

    Both tables are settled once, since every verb reads them several times.

    An objective is read over the shared files or over the sectors, never both, and what the shared files count for one is what
    every sector counts. A sector stands at the first phase that it owes something; legacy files stand at the first of all, and
    the shared ones past the last.
    """
    spark, last = hits.sparkSession, plan.phases.count()
    win = F.broadcast(plan.windows().select("objective", "first", "end", "over_shared", "measured", "direction", "target"))
    kept = settled(hits.join(win.select("objective", "over_shared"), "objective").filter((F.col("sector") == SHARED) == F.col("over_shared")).drop("over_shared"))
    values = values if values is not None else spark.createDataFrame([], "objective string, sector string, value double")
    names = sectors.names.select("sector")
    counted = kept.groupBy(*PAIR).agg(F.count("*").cast("double").alias("count"))
    own = names.crossJoin(win).join(counted, PAIR, "left").join(values.select(*PAIR, "value"), PAIR, "left")  # policy objectives, broadcast
    value = F.when(F.col("measured"), F.coalesce("value", F.lit(0.0)))
    n = F.when(F.col("measured"), distance_to_target(F.col("direction"), F.col("target"), value)).otherwise(F.coalesce("count", F.lit(0.0)))
    own = own.withColumns({"value": value, "n": n}).drop("count")
    if plan.shared:
        there = own.filter((F.col("sector") == SHARED) & F.col("over_shared")).select("objective", F.col("n").alias("__n"), F.col("value").alias("__v"))
        own = own.join(F.broadcast(there), "objective", "left").withColumns({"n": F.coalesce("__n", "n"), "value": F.coalesce("__v", "value")}).drop("__n", "__v")
    positions = positions_of(names, records)
    derived = C.derived_phase(positions, own.select(*PAIR, "n"), plan.phases, plan.objectives)
    special = F.when(F.col("sector") == SHARED, last if plan.shared else None).when(F.col("sector") == LEGACY, 0)
    at = positions.select("sector", "reached").join(derived, "sector").withColumn("phase_at", F.coalesce(special, "phase_at").cast("int"))
    over = F.col("over_shared") | (F.col("measured") & (F.col("first") == -1))
    in_shared = (F.col("sector") == SHARED) & F.lit(plan.shared)
    rows = own.join(at, "sector")
    flags = {"inside": F.when(in_shared, over).otherwise(C.in_window()), "behind": ~in_shared & C.is_behind()}
    return Evaluation(kept, settled(rows.withColumns(flags).select("objective", "sector", "n", "value", "phase_at", "reached", "first", "end", "over_shared", "measured", "inside", "behind")))


def counted(e: Evaluation) -> DataFrame:
    """The hits whose objective is in window for their sector."""
    return e.hits.join(e.states.filter("inside").select(*PAIR), PAIR, "left_semi")


def toward_next(e: Evaluation, plan: Plan) -> DataFrame:
    """(sector, objective, n): what a sector still owes to leave the phase it stands at."""
    named = plan.phases.select(F.col("ord").alias("phase_at"), F.explode("objectives").alias("objective"))
    return e.states.filter("n > 0").join(F.broadcast(named), ["phase_at", "objective"]).select("sector", "objective", "n")


def ledgered(e: Evaluation, holdouts: DataFrame, unit: str = "file") -> DataFrame:
    """The hits in window that a ledger carries, as they are or drifted. holdouts: objective, sector, entry, ord."""
    now = counted(e)
    carried = C.reconcile(holdouts, now.withColumn("ord", F.col("entry")), unit).filter(F.col("state").isin("ledgered", "drifted"))
    return now.join(carried.select(*PAIR, "entry"), [*PAIR, "entry"], "left_semi")


def ledger_phase(records: DataFrame, ledger: DataFrame, plan: Plan, measures: DataFrame | None = None) -> DataFrame:
    """(sector, phase_at) by what the last `clear` wrote, for sectors that have a record; the others stand at the first phase.

    ledger: objective, sector, holdouts (array); measures: objective, sector, recorded, closed. An objective without a row for the
    sector was never entered: past the phase that the sector reached it counts as owed, up to it as met.
    """
    win = F.broadcast(plan.windows().select("objective", "first", "over_shared", "measured", "direction", "target"))
    pairs = positions_of(records, records).crossJoin(win).withColumn("__at", F.when(F.col("over_shared"), F.lit(SHARED)).otherwise(F.col("sector")))
    held = ledger.select("objective", F.col("sector").alias("__at"), F.size("holdouts").cast("double").alias("__held"))
    measures = measures if measures is not None else records.sparkSession.createDataFrame([], "objective string, sector string, recorded double, closed double")
    valued = measures.select("objective", F.col("sector").alias("__at"), "recorded", "closed")
    rows = pairs.join(held, ["objective", "__at"], "left").join(valued, ["objective", "__at"], "left")
    gap = F.when(F.col("closed").isNotNull(), 0.0).when(F.col("recorded").isNotNull(), distance_to_target(F.col("direction"), F.col("target"), F.col("recorded")))
    owed = F.coalesce(F.when(F.col("measured"), gap).otherwise(F.col("__held")), F.when(F.col("first") > F.col("reached"), 1.0).otherwise(0.0))
    at = C.derived_phase(positions_of(records, records), settled(rows.select(*PAIR, owed.alias("n"))), plan.phases, plan.objectives)
    return at.withColumn("phase_at", F.when(F.col("sector") == LEGACY, 0).otherwise(F.col("phase_at")))


def moves(e: Evaluation, records: DataFrame, placed: DataFrame, plan: Plan) -> DataFrame:
    """(sector, was, now, back, passed): placed sectors that a `clear` would move, with the defined phases between."""
    now = e.states.filter(~F.col("sector").isin(LEGACY, SHARED)).select("sector", F.col("phase_at").alias("now")).distinct()
    both = now.join(placed.select("sector", F.col("phase_at").alias("__at")), "sector").join(records.select("sector", "reached"), "sector")
    was = F.when((F.col("__at") == F.col("now")) & (F.col("reached") >= 0), F.least("reached", "__at")).otherwise(F.col("__at"))
    moved = both.select("sector", was.alias("was"), "now").filter("was <> now")
    between = moved.join(F.broadcast(plan.phases.filter("not open").select("ord", "phase")), F.expr("ord > was and ord < now"), "left")
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("ord").isNotNull(), F.struct("ord", "phase")))), lambda p: p["phase"])
    return between.groupBy("sector", "was", "now").agg(listed.alias("passed")).withColumn("back", F.col("now") < F.col("was"))


def cleared(e: Evaluation, ledger: DataFrame, at: str, by: str = "objectives clear", unit: str = "file", receipted: tuple[str, ...] = (), reason: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger, concessions, outcomes) after `clear` of the objectives that are counted, not measured.

    ledger: objective, sector, entered, initial, cleared, closed, last_cleared, holdouts. Inside its window a sector enters or
    loses its stale holdouts, past it what it holds is closed, behind it all stays; sectors that are gone are past every window.
    Objectives of a phase that changed with a receipt are held to what is there now. outcomes: objective, cleared, closed,
    entered, rebaselined, left.
    """
    spark, columns = e.hits.sparkSession, ["entered", "initial", "cleared", "closed", "last_cleared", "holdouts"]
    states = e.states.filter(~F.col("measured") & (~F.col("over_shared") | (F.col("sector") == SHARED)))
    where = states.select(*PAIR, F.when(F.col("inside"), "inside").when(F.col("behind"), "behind").otherwise("past").alias("at"))
    known = ledger.join(where, PAIR, "left").withColumn("at", F.coalesce("at", F.lit("past")))
    fixed = (F.col("at") == "inside") & F.col("objective").isin(*receipted) if receipted else F.lit(False)
    live = known.filter((F.col("at") != "behind") & ~fixed)
    entries = counted(e).join(where.filter("at = 'inside'").select(*PAIR), PAIR, "left_semi").select(*PAIR, "entry").distinct().withColumn("ord", F.col("entry"))
    held = known.filter(fixed)
    open_entries = entries.join(held.select(*PAIR), PAIR, "left_anti") if receipted else entries
    listed = live.filter("at = 'inside'").select(*PAIR, F.posexplode("holdouts").alias("ord", "entry"))
    past = live.filter("at = 'past'").select(*PAIR)
    out = C.cleared(live.drop("at"), C.reconcile(listed, open_entries, unit), past, at).select(*PAIR, *columns)
    empty = where.filter("at = 'inside'").select(*PAIR).join(ledger.select(*PAIR), PAIR, "left_anti").join(entries.select(*PAIR).distinct(), PAIR, "left_anti")
    none = F.array().cast("array<string>")
    new = empty.select(*PAIR, F.lit(at).alias("entered"), F.lit(0.0).alias("initial"), F.lit(0.0).alias("cleared"), F.lit(0.0).alias("closed"), F.lit(at).alias("last_cleared"), none.alias("holdouts"))
    out = out.unionByName(new).unionByName(known.filter("at = 'behind'").select(*PAIR, *columns))
    receipts = spark.createDataFrame([], "objective string, sector string, `from` int, `to` int, at string, by string, reason string")
    if receipted:
        was = held.select(*PAIR, F.explode("holdouts").alias("entry"))
        now = entries.join(held.select(*PAIR), PAIR, "left_semi").select(*PAIR, "entry")
        fresh, receipts = C.rebaselined(was, now, at, by, reason)
        lists = fresh.groupBy(*PAIR).agg(F.array_sort(F.collect_list("entry")).alias("__now"))
        out = out.unionByName(held.join(lists, PAIR, "left").withColumn("holdouts", F.coalesce("__now", none)).select(*PAIR, *columns))
    out = settled(out)
    before = ledger.groupBy("objective").agg(F.sum("cleared").alias("__c"), F.sum("closed").alias("__x"))
    entered = out.join(ledger.select(*PAIR), PAIR, "left_anti").groupBy("objective").agg(F.count("*").alias("entered"))
    moved = receipts.groupBy("objective").agg(F.count("*").alias("rebaselined"))
    sums = out.groupBy("objective").agg(F.sum("cleared").alias("cleared"), F.sum("closed").alias("closed"), F.sum(F.size("holdouts")).alias("left"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    outcomes = sums.join(before, "objective", "left").join(entered, "objective", "left").join(moved, "objective", "left")
    return out, receipts, outcomes.select("objective", (F.col("cleared") - zero("__c")).alias("cleared"), (F.col("closed") - zero("__x")).alias("closed"), zero("entered").alias("entered"), zero("rebaselined").alias("rebaselined"), "left")


def advanced(e: Evaluation, records: DataFrame, at: str) -> DataFrame:
    """Records after `clear`: new sectors get one, and the furthest phase that each has stood at moves on."""
    now = e.states.filter(~F.col("sector").isin(LEGACY, SHARED)).select("sector", "phase_at").distinct()
    fresh = now.join(records.select("sector"), "sector", "left_anti").select("sector")
    empty = {f.name: (F.array() if f.dataType.typeName() == "array" else F.lit(None)).cast(f.dataType) for f in records.schema.fields if f.name != "sector"}
    new = fresh.withColumns({**empty, "since": F.lit(at)}).select(*records.columns)
    return RC.reached(records.unionByName(new), now, at)


def conceded(e: Evaluation, ledger: DataFrame, records: DataFrame, plan: Plan, objective: str, at: str, by: str, reason: str, wanted: DataFrame | None = None, unit: str = "file") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(ledger, receipts, records, sent) after unrecorded entries of an objective are granted, all of them or the wanted ones.

    A sector that the grant sends back loses the attestations it crosses. sent: sector, was, now, crossed. Names that are no
    unrecorded entries are refused with an error; the names are an argument of the user's, read on the driver.
    """
    mine = ledger.filter(F.col("objective") == objective)
    if mine.isEmpty():
        raise ValueError(f"objective {objective} has no ledger yet: clear first")
    now = counted(e).filter(F.col("objective") == objective).select(*PAIR, "entry").withColumn("ord", F.col("entry"))
    states = settled(C.reconcile(mine.select(*PAIR, F.posexplode("holdouts").alias("ord", "entry")), now, unit))
    if wanted is not None:
        states_new, unknown = RC.chosen_holdouts(states, wanted)
        if lost := [r["entry"] for r in unknown.take(5)]:
            raise ValueError(f"not unrecorded: {', '.join(lost)}")
        states = states_new.withColumn("state", F.lit("unrecorded"))
    granted, receipts = C.conceded(mine, states, at, by, reason)
    more = granted.groupBy(*PAIR).agg(F.collect_list("entry").alias("__more"))
    after = ledger.join(more, PAIR, "left").withColumn("holdouts", F.when(F.col("__more").isNotNull(), F.array_sort(F.concat("holdouts", "__more"))).otherwise(F.col("holdouts"))).select(*ledger.columns)
    sent = RC.sent_back(ledger_phase(records, ledger, plan), ledger_phase(records, after, plan), plan.phases)
    crossed = records.join(sent.select("sector", "crossed"), "sector", "left")
    mark = F.struct(F.lit(at).alias("at"), F.lit(by).alias("by"), F.lit(f"conceded {objective}: {reason}").alias("reason"))
    gone = F.transform("attested", lambda a: F.when(a["revoked"].isNull() & F.array_contains("crossed", a["phase"]), a.withField("revoked", mark)).otherwise(a))
    return after, receipts, crossed.withColumn("attested", F.when(F.col("crossed").isNull(), F.col("attested")).otherwise(gone)).select(*records.columns), sent
