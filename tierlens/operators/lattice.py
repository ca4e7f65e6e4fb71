"""Many threshold policies at once, without a row per row and definition.

Definitions that differ only in their two thresholds are points (i, j) of one lattice, i and j numbering the distinct
thresholds in ascending order.  What a row does under all of them is said by two numbers: it goes on to the teacher for
i < a and on to the high level for j < b, where a and b count the thresholds its risks reach.  So

* accuracy, errors and calls are sums over the (a, b) cells of a lattice, a table whose size the definitions bound;
* an operation is bought at (i, j) if some row buys it with i < a and j < b.  These rectangles add up to a staircase,
  the largest b for every i, which one aggregation per operation finds for all definitions;
* pairs are formed inside small decision groups, and counted over an index of the reference intervals that is built once
  per larger one (:mod:`pair_index`); a policy only says which of its rows' predictions are active.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, finite, is_true, settle, stage_operations
from ..plans.lineage import cut_lineage
from .ledger import MONEY, one_price
from .ordered import ROWS_PER_BUCKET
from .pair_index import PAIRED_ROWS, interval_index, policy_pairs, small_group_pairs
from .policy import STAGE_OF_STEP, STEPS

KINDS = ("mlip", "dft", "high_level")


@dataclass(frozen=True)
class Lattice:
    """Definitions that share all but their thresholds; ``points`` are (policy_id, i, j)."""

    mode: str
    stage1: str
    use_screen: bool
    screen_all: bool
    t_screen: float
    first: tuple[float, ...]
    second: tuple[float, ...]
    points: tuple[tuple[int, int, int], ...]

    @property
    def base(self) -> int:
        return len(self.second) + 1

    def kind(self, a: int, b: int, i: int, j: int) -> int:
        """Which prediction a row of cell (a, b) gives at (i, j), as a place in KINDS."""
        if self.mode == "always_high_level":
            return 2
        return 0 if i >= a else 1 if j >= b else 2

    def _reaches(self) -> Column:
        """Whether a row gets as far as the decision to escalate."""
        if self.mode == "always_dft":
            return F.lit(True)
        if self.mode in ("always_mlip", "always_high_level"):
            return F.lit(False)
        return F.col("mlip").isNotNull()

    def _goes_on(self) -> Column:
        """Whether a row that ran the teacher asks for the reference risk."""
        return F.lit(False) if self.mode in ("always_dft", "uq_only") else F.col("dft").isNotNull()

    def cell(self) -> tuple[Column, Column]:
        """(a, b) of a row.  A missing risk reaches every threshold."""
        risk = F.col("risk_surrogate" if self.stage1 == "surrogate" else "risk_total")
        forced = F.lit(self.mode == "always_dft" or self.screen_all) | risk.isNull()
        if self.use_screen:
            forced = forced | is_true(F.col("cheap_screen") >= self.t_screen)
        n1, n2 = F.lit(len(self.first)), F.lit(len(self.second))
        a = F.when(~self._reaches(), 0).when(forced, n1).otherwise(_reached(risk, self.first))
        b = F.when(~self._goes_on(), 0).when(F.col("reference_risk").isNull(), n2).otherwise(_reached(F.col("reference_risk"), self.second))
        return a, b

    def bought(self, a: Column, b: Column, use_diagnostics: bool, use_reference_screen: bool) -> dict[str, Column]:
        """Per step the slot (a', b') of the rectangle i < a', j < b' in which a row buys it; NULL if nowhere."""
        n1, n2 = F.lit(len(self.first)), F.lit(len(self.second))
        only_hl = self.mode == "always_high_level"
        slot = lambda x, y: x * self.base + y
        later = self._goes_on()
        steps = {
            "mlip": F.lit(self.mode not in ("always_high_level", "always_dft")), "screen": self._reaches() & F.lit(self.use_screen),
            "dft": a > 0, "diagnostics": later & F.lit(use_diagnostics), "reference_screen": later & F.lit(use_reference_screen),
            "high_level": F.col("high_level_supported") & F.lit(True),
        }
        where = {
            "mlip": slot(n1, n2), "screen": slot(n1, n2), "dft": slot(a, n2), "diagnostics": slot(a, n2), "reference_screen": slot(a, n2),
            "high_level": slot(n1, n2) if only_hl else slot(a, b),
        }
        return {s: F.when(steps[s], where[s]) for s in STEPS}


def _reached(risk: Column, thresholds: Sequence[float]) -> Column:
    return reduce(lambda x, y: x + y, [(risk >= t).cast("int") for t in thresholds])


def lattices(definitions: Sequence[dict]) -> list[Lattice]:
    """Complete definitions grouped by all but ``t1`` and ``t2``."""
    groups: dict[tuple, list[dict]] = {}
    for d in definitions:
        groups.setdefault(tuple(d[k] for k in ("mode", "stage1", "use_screen", "screen_all", "t_screen")), []).append(d)
    out = []
    for shared, members in groups.items():
        first, second = (tuple(sorted({d[t] for d in members})) for t in ("t1", "t2"))
        out.append(Lattice(*shared, first, second, tuple((d["policy_id"], first.index(d["t1"]), second.index(d["t2"])) for d in members)))
    return out


def _points(spark, grid: Sequence[Lattice]) -> DataFrame:
    """(policy_id, lattice, i, j, always_hl): one row per definition."""
    rows = [(p, n, i, j, g.mode == "always_high_level") for n, g in enumerate(grid) for p, i, j in g.points]
    return F.broadcast(spark.createDataFrame(rows, "policy_id int, lattice int, i int, j int, always_hl boolean"))


def lattice_rows(scored: DataFrame, grid: Sequence[Lattice], extra: Sequence[str]) -> DataFrame:
    """Scored rows with one ``slot_<n>`` = a * base + b per lattice, the high-level value only where it is supported."""
    slots = {}
    for n, g in enumerate(grid):
        a, b = g.cell()
        slots[f"slot_{n}"] = (a * g.base + b).cast("int")
    value = F.when(F.col("high_level_supported"), F.col("high_level_value")).alias("high_level")
    own = ["decision_group", "mlip", "dft", "reference", "reference_uncertainty", "high_level_supported"]
    return scored.select(*extra, *own, value, *[c.alias(n) for n, c in slots.items()])


def lattice_outcomes(rows: DataFrame, grid: Sequence[Lattice], tolerance: float) -> DataFrame:
    """Per policy: n, accepted, correct, error and calls, from one table of cells per lattice."""
    margin = F.coalesce("reference_uncertainty", F.lit(0.0))
    measures = {"n": F.lit(1), "supported": F.col("high_level_supported").cast("int")}
    for k, name in enumerate(KINDS):
        error = F.abs(F.col(name) - F.col("reference"))
        measures |= {f"accepted_{k}": F.col(name).isNotNull().cast("int"), f"correct_{k}": is_true(error + margin <= F.lit(float(tolerance))).cast("int"),
                     f"error_{k}": error, f"errors_{k}": error.isNotNull().cast("int")}
    entries = F.array(*[F.struct(F.lit(n).alias("lattice"), F.floor(F.col(f"slot_{n}") / g.base).cast("int").alias("a"),
                                 F.pmod(f"slot_{n}", F.lit(g.base)).alias("b")) for n, g in enumerate(grid)])
    cells = rows.select(F.explode(entries).alias("_e"), *[c.alias(m) for m, c in measures.items()]).groupBy("_e.lattice", "_e.a", "_e.b").agg(
        *[F.sum(m).alias(m) for m in measures])
    met = cells.join(_points(rows.sparkSession, grid), "lattice")
    escalated, further = F.col("i") < F.col("a"), F.col("j") < F.col("b")
    kind = F.when(F.col("always_hl"), 2).when(~escalated, 0).when(~further, 1).otherwise(2)
    of = lambda m: F.sum(F.when(kind == 0, F.col(f"{m}_0")).when(kind == 1, F.col(f"{m}_1")).otherwise(F.col(f"{m}_2"))).alias(m)
    high = F.col("always_hl") | (escalated & further)
    return met.groupBy("policy_id").agg(
        F.sum("n").alias("n"), of("accepted"), of("correct"), of("error"), of("errors"),
        F.sum(F.when(escalated, F.col("n")).otherwise(0)).alias("dft_calls"), F.sum(F.when(high, F.col("supported")).otherwise(0)).alias("high_level_calls"))


def in_pieces(rows: DataFrame, rows_per_piece: int = ROWS_PER_BUCKET) -> DataFrame:
    """Written rows in at most ``rows_per_piece`` a task or so: most operations are of one row, so a task holds them all."""
    pieces = math.ceil(rows.count() / rows_per_piece)
    return rows.repartition(pieces, "id") if pieces > rows.rdd.getNumPartitions() else rows


def lattice_costs(rows: DataFrame, grid: Sequence[Lattice], use_diagnostics: bool, use_reference_screen: bool) -> DataFrame:
    """(policy_id, total_cost): every operation once per policy, through one staircase per operation and lattice."""
    bought = []
    for n, g in enumerate(grid):
        a, b = F.floor(F.col(f"slot_{n}") / g.base).cast("int"), F.pmod(f"slot_{n}", F.lit(g.base))
        bought.append(g.bought(a, b, use_diagnostics, use_reference_screen))
    slots = [f"at_{n}" for n in range(len(grid))]
    steps = F.array(*[
        F.struct(stage_operations(STAGE_OF_STEP[s]).alias("ops"), *[where[s].cast("int").alias(at) for at, where in zip(slots, bought)]) for s in STEPS])
    lines = settle(rows.select(F.explode(steps).alias("_s")), keep=()).where(F.coalesce(*[F.col(f"_s.{at}") for at in slots]).isNotNull())
    lines = lines.select(*[F.col(f"_s.{at}") for at in slots], F.explode("_s.ops").alias("op", "cost"))
    stairs = []
    for n, (at, g) in enumerate(zip(slots, grid)):
        a, b = F.floor(F.col(at) / g.base), F.pmod(at, F.lit(g.base))
        stairs.append(F.array(*[F.coalesce(F.max(F.when(a > i, b)), F.lit(0)) for i in range(len(g.first))]).alias(f"stairs_{n}"))
    per_op = lines.groupBy("op").agg(one_price(), *stairs)
    entries = F.array(*[F.struct(F.lit(n).alias("lattice"), F.col(f"stairs_{n}").alias("stairs")) for n in range(len(grid))])
    kinds = per_op.select(F.col("cost").cast(MONEY).alias("cost"), F.explode(entries).alias("_e")).groupBy("_e.lattice", "_e.stairs").agg(F.sum("cost").alias("cost"))
    steps_up = kinds.select("lattice", "cost", F.posexplode("stairs").alias("i", "upto")).groupBy("lattice", "i", "upto").agg(F.sum("cost").alias("cost"))
    return steps_up.join(_points(rows.sparkSession, grid), ["lattice", "i"]).where("j < upto").groupBy("policy_id").agg(
        F.sum("cost").cast("double").alias("total_cost"))


def lattice_charges(rows: DataFrame, grid: Sequence[Lattice], order_by: str, use_diagnostics: bool, use_reference_screen: bool) -> DataFrame:
    """(policy_id, row_no, cost): what each row adds to the ledger of each policy, every operation shuffled once for all."""
    points = sorted((p, n, i, j) for n, g in enumerate(grid) for p, i, j in g.points)
    bought = []
    for n, g in enumerate(grid):
        a, b = F.floor(F.col(f"slot_{n}") / g.base).cast("int"), F.pmod(f"slot_{n}", F.lit(g.base))
        bought.append(g.bought(a, b, use_diagnostics, use_reference_screen))

    def buys(step: str, n: int, i: int, j: int) -> Column:
        slot = bought[n][step]
        return is_true((F.floor(slot / grid[n].base) > i) & (F.pmod(slot, F.lit(grid[n].base)) > j))

    marks = [f"by_{p}" for p, *_ in points]
    number = F.col(order_by).cast("long") * 8
    steps = F.array(*[
        F.struct(stage_operations(STAGE_OF_STEP[s]).alias("ops"), (number + k).alias("seq"), *[buys(s, *at).alias(f"by_{p}") for p, *at in points])
        for k, s in enumerate(STEPS, start=1)])
    lines = settle(rows.select(F.explode(steps).alias("_s"))).where(reduce(lambda x, y: x | y, [F.col(f"_s.{m}") for m in marks]))
    lines = lines.select("_s.seq", *[F.col(f"_s.{m}") for m in marks], F.explode("_s.ops").alias("op", "cost"))
    per_op = lines.groupBy("op").agg(*[
        F.struct(F.lit(p).alias("policy_id"), F.min(F.when(F.col(m), F.col("seq"))).alias("seq"), one_price(F.col(m))).alias(m)
        for m, (p, *_) in zip(marks, points)])
    paid = per_op.select(F.inline(F.array(*marks))).where(F.col("seq").isNotNull())
    return paid.groupBy("policy_id", F.expr("seq div 8").alias("row_no")).agg(F.sum(F.col("cost").cast(MONEY)).cast("double").alias("cost"))


def lattice_pairs(rows: DataFrame, grid: Sequence[Lattice], tie_tolerance: float = 0.0, rows_per_bucket: int | None = None) -> DataFrame:
    """(policy_id, pairs_resolved, pairs_unresolved, correct) over all decision groups; rows without one form no pairs."""
    grouped = rows.where(F.col("decision_group").isNotNull())
    slots = [f"slot_{n}" for n in range(len(grid))]
    # per lattice and slot, which kind is active for each of its policies
    active = [[[g.kind(*divmod(slot, g.base), i, j) for _, i, j in g.points] for slot in range((len(g.first) + 1) * g.base)] for g in grid]
    ids = [p for g in grid for p, _, _ in g.points]
    per_group = grouped.groupBy("decision_group").agg(F.count("*").alias("_n"))
    many = cut_lineage(per_group.where(F.col("_n") > min(PAIRED_ROWS, rows_per_bucket or PAIRED_ROWS)).select("decision_group"))
    few = grouped
    if indexed := not many.isEmpty():
        few, grouped_many = (grouped.join(many, "decision_group", how) for how in ("left_anti", "left_semi"))
    counts = small_group_pairs(few, "decision_group", KINDS, slots, active, ids, tie_tolerance=tie_tolerance)
    if indexed:
        index = interval_index(grouped_many, "decision_group", KINDS, slots, tie_tolerance=tie_tolerance, rows_per_bucket=rows_per_bucket)
        counts = counts.unionByName(policy_pairs(index, slots, active, ids)).groupBy("policy_id").agg(
            F.sum("resolved").alias("resolved"), F.sum("correct").alias("correct"))
    pairs = per_group.agg(F.coalesce(F.sum((F.col("_n") * (F.col("_n") - 1) / 2).cast("long")), F.lit(0)).alias("_pairs"))
    points = _points(rows.sparkSession, grid).select("policy_id")
    zero = F.lit(0).cast("long")
    joined = points.join(counts, "policy_id", "left").join(F.broadcast(pairs.withColumn("_k", F.lit(1))), F.lit(1) == F.col("_k"))  # one row
    resolved = F.coalesce("resolved", zero)
    return joined.select("policy_id", resolved.alias("pairs_resolved"), (F.col("_pairs") - resolved).alias("pairs_unresolved"), F.coalesce("correct", zero).alias("pairs_correct"))


def lattice_summary(
    scored: DataFrame, definitions: Sequence[dict], tolerance: float, cost_weight: float, cost_scale: float,
    use_diagnostics: bool, use_reference_screen: bool, pairwise: bool, tie_tolerance: float = 0.0, rows_per_bucket: int | None = None,
) -> DataFrame:
    """One row per policy with the columns of a replay summary."""
    grid = lattices(definitions)
    rows = cut_lineage(lattice_rows(scored, grid, ["id", "operations", "costs"]))
    out = lattice_outcomes(rows, grid, tolerance).join(
        F.broadcast(lattice_costs(in_pieces(rows), grid, use_diagnostics, use_reference_screen)), "policy_id", "left")
    total, n = F.coalesce("total_cost", F.lit(0.0)), F.col("n")
    share = lambda c: F.col(c).cast("double") / n
    mean_cost = total / n
    summary = out.select(
        "policy_id", "n", share("accepted").alias("coverage"), share("correct").alias("accuracy_all_cases"),
        F.try_divide(F.col("correct").cast("double"), F.col("accepted").cast("double")).alias("accuracy_accepted"),
        F.try_divide("error", F.col("errors").cast("double")).alias("mae_accepted"), total.alias("total_cost"), mean_cost.alias("mean_cost"),
        share("dft_calls").alias("dft_call_fraction"), share("high_level_calls").alias("high_level_call_fraction"),
        (1 - share("correct") + F.lit(float(cost_weight)) * mean_cost / F.lit(float(cost_scale))).alias("objective"))
    if not pairwise:
        return summary
    pairs = lattice_pairs(rows, grid, tie_tolerance, rows_per_bucket)
    accuracy = F.try_divide(F.col("pairs_correct").cast("double"), F.col("pairs_resolved").cast("double"))
    return summary.join(F.broadcast(pairs), "policy_id").select(
        *summary.columns, "pairs_resolved", "pairs_unresolved", accuracy.alias("pairwise_ordering_accuracy"))
