"""Charging shared operations once per ledger, with or without a budget.

A purchase table has one row per (ledger keys, row_no, step_no): ``row_no`` orders the rows of a ledger and is
unique in it, ``seq`` = 8 row_no + step_no orders its purchases, ``operations`` maps operation keys to costs.
One number identifies a purchase, so finding the first buyer of an operation is a ``min`` of a long that
combines before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_true, stage_operations
from ..plans.lineage import cut_lineage
from .ordered import ROWS_PER_BUCKET, running, value_edges
from .policy import BUDGET_REASONS, STAGE_OF_STEP, STEPS, with_score

MONEY = "decimal(28,12)"
_SLACK = "cast('0.000000000001' as decimal(28,12))"


def purchases(paths: DataFrame, keys: Sequence[str], order_by: str) -> DataFrame:
    """Purchased steps of replayed rows -> purchase table in row order, then step order."""
    steps = paths.select(*keys, F.col("id"), F.col(order_by).cast("long").alias("row_no"), "operations", "costs",
                         F.explode("purchased").alias("_step"))
    number = F.lit(None).cast("int")
    bought = F.lit(None).cast("map<string,double>")
    for i, name in reversed(list(enumerate(STEPS, start=1))):
        number = F.when(F.col("_step") == name, i).otherwise(number)
        bought = F.when(F.col("_step") == name, stage_operations(STAGE_OF_STEP[name])).otherwise(bought)
    return steps.select(*keys, "row_no", number.alias("step_no"), bought.alias("operations")).withColumn(
        "seq", F.col("row_no") * 8 + F.col("step_no"))


def _lines(bought: DataFrame, keys) -> DataFrame:
    return bought.select(*keys, "seq", F.explode("operations").alias("op", "cost"))


def first_buyers(bought: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each (ledger, operation) with the purchase that pays for it.

    Without a budget nothing a row does depends on the ledger, so the payer is simply the earliest purchase,
    however popular an operation is.
    """
    first = _lines(bought, keys).groupBy(*keys, "op").agg(
        F.min("seq").alias("seq"), F.min("cost").alias("_lo"), F.max("cost").alias("_hi"), F.count("*").alias("uses"))
    return first.select(
        *keys, "op", *_purchase_of(), F.col("_lo").cast(MONEY).alias("cost"), "uses", (F.col("_lo") != F.col("_hi")).alias("inconsistent"))


def _purchase_of() -> list:
    return [F.col("seq"), F.expr("seq div 8").alias("row_no"), F.expr("cast(seq % 8 as int)").alias("step_no")]


def price_conflicts(bought: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Operations offered at more than one price inside a ledger (must be empty)."""
    return first_buyers(bought, keys).where("inconsistent").select(*keys, "op")


def one_price(of: Column | None = None) -> Column:
    """The ``cost`` of a group of offers of one operation (those ``of`` a ledger); more than one price is an error."""
    offer = F.col("cost") if of is None else F.when(of, F.col("cost"))
    lowest, highest = F.min(offer), F.max(offer)
    conflict = F.raise_error(F.lit("one operation is offered at two prices in a ledger"))
    return F.when(lowest == highest, lowest).when(lowest.isNotNull(), conflict).alias("cost")


def refuse_two_prices(bought: DataFrame, keys: Sequence[str]) -> None:
    """An error if a ledger holds an operation at two prices; ledgers are told apart only for operations that have two anywhere."""
    lines = _lines(bought, keys)
    differing = lines.groupBy("op").agg(F.min("cost").alias("_lo"), F.max("cost").alias("_hi")).where("_lo <> _hi").select("op")
    differing = cut_lineage(differing)
    if not differing.isEmpty():
        lines.join(differing, "op", "left_semi").groupBy(*keys, "op").agg(one_price()).agg(F.count("cost")).first()


def charges(bought: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(ledger, row_no, cost): what each row adds to its ledger when nothing is refused."""
    first = _lines(bought, keys).groupBy(*keys, "op").agg(F.min("seq").alias("seq"), one_price())
    return first.select(*keys, *_purchase_of(), F.col("cost").cast(MONEY).alias("cost")).groupBy(*keys, "row_no").agg(F.sum("cost").cast("double").alias("cost"))


def ledger_totals(bought: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(ledger, total_cost) straight from the distinct operations, without attributing them to rows."""
    per_op = _lines(bought, keys).groupBy(*keys, "op").agg(one_price())
    return per_op.groupBy(*keys).agg(F.sum(F.col("cost").cast(MONEY)).cast("double").alias("total_cost"))


def charge_with_budget(
    bought: DataFrame, keys: Sequence[str], budget: float, opening: DataFrame | None = None, rows_per_piece: int = ROWS_PER_BUCKET // 10,
) -> DataFrame:
    """(ledger, row_no, cost, refused_step_no): purchases in ``seq`` order under a budget per ledger.

    A purchase that does not fit is refused whole and ends its row; cheaper ones later may still fit.  ``opening``
    (ledger, op, cost) lists operations that a ledger has already paid for; they count towards the budget, and more of
    them than the budget allows is an error.
    """
    keys = list(keys)
    if budget < 0:
        raise ValueError("budget must be non-negative")
    row_keys = [*keys, "row_no"]
    # rows that pay nothing and are refused nothing belong to the result; the aggregation below makes them one each
    union = bought.select(
        *row_keys, F.lit(None).cast("int").alias("step_no"), F.lit(0).cast(MONEY).alias("price"), F.lit(True).alias("paid"))
    for part in budget_rounds(bought, keys, budget, opening, rows_per_piece):
        union = union.unionByName(part)
    return union.groupBy(*row_keys).agg(
        F.sum(F.when(F.col("paid"), F.col("price"))).cast("double").alias("cost"),
        F.min(F.when(~F.col("paid"), F.col("step_no"))).alias("refused_step_no"))


def budget_rounds(
    bought: DataFrame, keys: Sequence[str], budget: float, opening: DataFrame | None = None, rows_per_piece: int = ROWS_PER_BUCKET // 10,
) -> list[DataFrame]:
    """Verdicts (ledger, row_no, step_no, price, paid), one table per piece of the rows and one per round of it.

    Rows are taken in pieces, the first of ``rows_per_piece`` purchases, later ones some eight times as long as all before: a budget that ends early is settled on a short
    piece, and what the later ones cannot pay for falls in one pass (see :func:`_drop_impossible`), without a round.
    A round is over all ledgers at once.

    Of what a ledger has left, a purchase that costs more than half is *large*, another one *small*; at most one large
    one can be accepted before less than half is left.  A round therefore lets the small ones through in order, up to the
    first large one that fits on top of them or the first small one that does not fit, and refuses every large one before
    that place.  Either event leaves less than half, so the rounds of a ledger grow with the logarithm of its budget over
    its lowest price, not with the number of refusals.

    * Behind the first large step of a row nothing is bought before that step is, so those steps wait.
    * Operations are paid by the first *small* step that needs them, since the large ones before it are refused.  Which
      steps are large is judged by the operations they are the first of all to need, which they pay in any case; a small
      step that turns out large once refused steps no longer pay for it is settled and ends the round (only such rounds,
      which need refused operations that others share, may leave more than half).
    * What lies behind the end and would have to pay more than what is left is refused at once.
    """
    keys = list(keys)
    fine = value_edges(bought, "seq", rows_per_piece)
    edges = fine[9::10]  # later rounds only hold fewer purchases
    # a second price may stand where nothing is bought any more
    refuse_two_prices(bought, keys)
    room = bought.select(*keys).distinct().withColumn("spent", _money(F.lit(0)))
    if opening is not None:
        opening = cut_lineage(opening.groupBy(*keys, "op").agg(one_price()).withColumnRenamed("cost", "_paid"))
        balance = opening.groupBy(*keys).agg(_money(F.sum(_money(F.col("_paid")))).alias("_spent"))
        excess = F.raise_error(F.lit("initial charges exceed the budget"))
        balance = balance.withColumn("_spent", F.when(F.col("_spent") <= _money(F.lit(float(budget))), F.col("_spent")).otherwise(excess))
        room = room.join(balance, keys, "left").select(*keys, F.coalesce("_spent", "spent").alias("spent"))
    room = cut_lineage(room)
    limit = F.expr(f"cast({budget!r}D as {MONEY}) + {_SLACK}")
    left = _money(limit - F.col("spent"))
    # pieces that grow eightfold, cut between rows
    upper = sorted({int(fine[8 ** n - 1] // 8) for n in range(len(fine)) if 8 ** n <= len(fine)})
    row = F.expr("seq div 8")
    verdicts, owned = [], None
    for lower, until in zip([None, *upper], [*upper, None]):
        piece = bought
        if lower is not None:
            piece = piece.where(row > lower)
        if until is not None:
            piece = piece.where(row <= until)
        pending = _lines(piece, keys)
        if opening is not None:
            conflict = F.raise_error(F.lit("one operation is offered at two prices in a ledger"))
            same = F.when(F.col("_paid").isNull(), False).when(F.col("_paid") == F.col("cost"), True).otherwise(conflict)
            pending = pending.join(opening, [*keys, "op"], "left").where(~same).drop("_paid")
        if owned is not None:
            pending = pending.join(owned, [*keys, "op"], "left_anti")
        pending, refused = _drop_impossible(pending, room, keys, left)
        rounds = _rounds(pending, room, keys, left, edges)
        verdicts += [refused, *rounds]
        if until is None or not rounds:
            continue
        paid = rounds[0]
        for part in rounds[1:]:
            paid = paid.unionByName(part)
        paid = cut_lineage(paid.where("paid").withColumn("seq", F.col("row_no") * 8 + F.col("step_no")))
        bought_now = pending.join(paid.select(*keys, "seq"), [*keys, "seq"], "left_semi").select(*keys, "op").distinct()
        owned = cut_lineage(bought_now if owned is None else owned.unionByName(bought_now))
        added = paid.groupBy(*keys).agg(_money(F.sum("price")).alias("added"))
        room = cut_lineage(room.join(added, keys, "left").select(
            *keys, _money(F.col("spent") + F.coalesce("added", _money(F.lit(0)))).alias("spent")))
    return verdicts


def _money(c: Column) -> Column:
    return c.cast(MONEY)


def _drop_impossible(pending: DataFrame, room: DataFrame, keys: list[str], left: Column) -> tuple[DataFrame, DataFrame]:
    """(written rest, verdicts): an operation no one owns that costs more than is left is never bought again, so all
    purchases that need it are refused, whoever was first to need it."""
    row_keys = [*keys, "row_no"]
    placed = pending.join(room, keys).withColumn("row_no", F.expr("seq div 8"))
    dear = is_true(_money(F.col("cost")) > left)
    ended = cut_lineage(placed.where(dear).groupBy(*row_keys).agg(F.min(F.expr("cast(seq % 8 as int)")).alias("step_no")))
    rest = placed.where(~dear).join(ended, row_keys, "left").where("step_no is null or seq % 8 < step_no")
    verdicts = ended.select(*row_keys, "step_no", _money(F.lit(0)).alias("price"), F.lit(False).alias("paid"))
    return cut_lineage(rest.select(*keys, "seq", "op", "cost")), verdicts


def _rounds(pending: DataFrame, room: DataFrame, keys: list[str], left: Column, edges: Sequence[float]) -> list[DataFrame]:
    """Verdicts on one piece of the purchases, one table per round; ``pending`` holds operations that no one owns."""
    row_keys = [*keys, "row_no"]
    row_no, money = F.expr("seq div 8").alias("row_no"), _money
    step_no = F.expr("cast(seq % 8 as int)").alias("step_no")
    verdicts = []
    while not pending.isEmpty():
        first = pending.groupBy(*keys, "op").agg(F.min("seq").alias("seq"), one_price())
        least = cut_lineage(first.groupBy(*keys, "seq").agg(money(F.sum(money(F.col("cost")))).alias("least")).join(room, keys))
        large = least.where(F.col("least") + F.col("least") > left).groupBy(*keys, row_no).agg(F.min("seq").alias("large"))
        lines = pending.withColumn("row_no", row_no).join(large, row_keys, "left")
        is_large = F.coalesce(F.col("seq") == F.col("large"), F.lit(False)).alias("is_large")
        lines = cut_lineage(lines.where("large is null or seq <= large").select(*keys, "seq", "op", money(F.col("cost")).alias("cost"), is_large))
        payers = lines.where("not is_large").groupBy(*keys, "op").agg(F.min("seq").alias("payer"))
        pays = F.col("payer").isNull() | (F.col("payer") >= F.col("seq"))
        priced = lines.join(payers, [*keys, "op"], "left").groupBy(*keys, "seq", "is_large").agg(
            money(F.sum(F.when(pays, F.col("cost")).otherwise(0))).alias("price"))
        priced = cut_lineage(priced.withColumn("small", F.when(F.col("is_large"), money(F.lit(0))).otherwise(F.col("price"))))
        lined = running(priced, "seq", sums={"upto": "small"}, keys=keys, edges=edges).join(room, keys)
        fits = money(F.col("upto")) + F.col("price") - F.col("small") <= left
        ends = F.when(F.col("is_large"), F.col("fits")).otherwise(~F.col("fits") | (F.col("price") + F.col("price") > left))
        lined = cut_lineage(lined.withColumn("fits", fits).withColumn("ends", ends).drop("upto", "small", "spent"))
        stops = lined.groupBy(*keys).agg(F.min(F.when(F.col("ends"), F.col("seq"))).alias("stop"))
        settled = lined.join(stops, keys).where("stop is null or seq <= stop")
        paid = F.when(F.col("seq") == F.col("stop"), F.col("fits")).otherwise(~F.col("is_large")).alias("paid")
        settled = cut_lineage(settled.select(*keys, "seq", "price", paid))
        added = settled.where("paid").groupBy(*keys).agg(money(F.sum("price")).alias("added"))
        room = cut_lineage(stops.where("stop is not null").join(room, keys).join(added, keys, "left").select(
            *keys, "stop", money(F.col("spent") + F.coalesce("added", money(F.lit(0)))).alias("spent")))
        hopeless = least.drop("spent").join(room, keys).where((F.col("seq") > F.col("stop")) & (F.col("least") > left))
        judged = settled.unionByName(hopeless.select(*keys, "seq", F.col("least").alias("price"), F.lit(False).alias("paid"))).select(
            *keys, row_no, step_no, "price", "paid")
        # operations of accepted purchases are owned from now on; rows end at their refused step
        owned = lines.join(settled.where("paid").select(*keys, "seq"), [*keys, "seq"], "left_semi").select(*keys, "op").distinct()
        ended = judged.where("not paid").groupBy(*row_keys).agg(F.min("step_no").alias("refused"))
        after = pending.join(room.select(*keys, "stop"), keys).where("seq > stop").withColumn("row_no", row_no)
        after = after.join(ended, row_keys, "left").where("refused is null or seq % 8 < refused")
        room = room.drop("stop")
        after = cut_lineage(after.join(owned, [*keys, "op"], "left_anti").select(*keys, "seq", "op", "cost"))
        pending, refused = _drop_impossible(after, room, keys, left)
        verdicts.append(judged.unionByName(refused))
    return verdicts


def apply_ledger(paths: DataFrame, charged: DataFrame, keys: Sequence[str], tolerance: float, order_by: str = "ord") -> DataFrame:
    """Replayed rows with their cost; a refused purchase turns the row into an abstention at that step."""
    keys = list(keys)
    charged = charged.withColumnRenamed("row_no", "_row_no")
    same = F.col(order_by).cast("long") == F.col("_row_no")
    for k in keys:
        charged = charged.withColumnRenamed(k, f"_{k}")
        same = same & (F.col(k) == F.col(f"_{k}"))
    joined = paths.join(charged, same, "left").drop("_row_no", *[f"_{k}" for k in keys])
    joined = joined.withColumn("cost", F.coalesce("cost", F.lit(0.0)))
    if "refused_step_no" not in charged.columns:
        return joined
    no = F.col("refused_step_no")
    reason = F.element_at(F.array(*[F.lit(BUDGET_REASONS[s]) for s in STEPS]), no)
    dft, hl = STEPS.index("dft") + 1, STEPS.index("high_level") + 1
    stopped = no.isNotNull()
    cut = joined.withColumns({
        "action": F.when(stopped, F.lit("abstain")).otherwise(F.col("action")),
        "prediction": F.when(~stopped, F.col("prediction")),
        "reason": F.when(stopped, reason).otherwise(F.col("reason")),
        "ran_dft": F.col("ran_dft") & (~stopped | (no > dft)),
        "ran_high_level": F.col("ran_high_level") & (~stopped | (no > hl)),
    })
    return with_score(cut.drop("refused_step_no"), tolerance)
