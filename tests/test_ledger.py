import random

import pytest
from pyspark.sql import functions as F

from tierlens.operators import ledger


def sequential(purchases, budget=None, opening=None):
    """Reference walk over one ledger: purchases = [(row, step, {op: cost})] in order."""
    owned, cost, refused = dict(opening or {}), {}, {}
    spent = sum(owned.values())
    for row, step, ops in purchases:
        cost.setdefault(row, 0.0)
        if row in refused:
            continue
        new = sum(c for o, c in ops.items() if o not in owned)
        if budget is not None and spent + new > budget + 1e-12:
            refused[row] = step
            continue
        owned.update(ops)
        spent += new
        cost[row] += new
    return cost, refused


def make(spark, ledgers):
    rows = []
    for name, purchases in ledgers.items():
        for i, (row, step, ops) in enumerate(purchases):
            rows.append((name, row, step, row * 8 + step, ops))
    return spark.createDataFrame(rows, "book string, row_no long, step_no int, seq long, operations map<string,double>").repartition(4)


def random_ledger(rng, n, ops):
    price = {f"op{i}": rng.choice([0.25, 0.5, 1.0, 3.0, 20.0]) for i in range(ops)}
    out = []
    for row in range(n):
        for step in range(1, rng.randint(1, 4) + 1):
            out.append((row, step, {o: price[o] for o in rng.sample(sorted(price), rng.randint(1, 3))}))
    return out


def test_each_operation_is_paid_once_by_the_first(spark):
    rng = random.Random(1)
    books = {f"b{i}": random_ledger(rng, 12, 15) for i in range(6)}
    got = {(r.book, r.row_no): r.cost for r in ledger.charges(make(spark, books), ["book"]).collect()}
    for name, purchases in books.items():
        want, _ = sequential(purchases)
        for row, cost in want.items():
            assert got.get((name, row), 0.0) == pytest.approx(cost)
    totals = {r.book: r.total_cost for r in ledger.ledger_totals(make(spark, books), ["book"]).collect()}
    assert all(totals[n] == pytest.approx(sum(sequential(p)[0].values())) for n, p in books.items())


def test_price_conflicts(spark):
    df = make(spark, {"b": [(0, 1, {"a": 2.0}), (1, 1, {"a": 1.0, "c": 1.0})]})
    assert [tuple(r) for r in ledger.price_conflicts(df, ["book"]).collect()] == [("b", "a")]


@pytest.mark.parametrize("budget", [3.0, 17.5, 45.0])
def test_budget_matches_the_sequential_walk(spark, budget):
    rng = random.Random(int(budget * 10))
    books = {f"b{i}": random_ledger(rng, 14, 18) for i in range(12)}
    books["tight"] = [(0, 1, {"a": 2.0}), (1, 1, {"a": 2.0}), (2, 1, {"b": 1.0, "c": 1.0}), (3, 1, {"b": 1.0})]
    got = {(r.book, r.row_no): r for r in ledger.charge_with_budget(make(spark, books), ["book"], budget).collect()}
    for name, purchases in books.items():
        cost, refused = sequential(purchases, budget)
        for row in cost:
            assert got[name, row].cost == pytest.approx(cost[row]), (name, row)
            assert got[name, row].refused_step_no == refused.get(row), (name, row)


def walk(spark, books, budget, opening=None):
    """The operator's verdicts must be those of the walk."""
    bought = make(spark, books)
    first = None if opening is None else spark.createDataFrame(
        [(b, o, c) for b, ops in opening.items() for o, c in ops.items()], "book string, op string, cost double")
    got = {(r.book, r.row_no): r for r in ledger.charge_with_budget(bought, ["book"], budget, first).collect()}
    for name, purchases in books.items():
        cost, refused = sequential(purchases, budget, (opening or {}).get(name))
        for row in cost:
            assert got[name, row].cost == pytest.approx(cost[row], abs=1e-9), (name, row)
            assert got[name, row].refused_step_no == refused.get(row), (name, row)


def test_adversarial_prices_take_few_rounds(spark):
    """After every tiny purchase comes one that has just become too dear: a walk refuses 5,000 of 10,000, one by one."""
    tiny = 1 / 1024
    steep = [(2 * i + k, 1, {f"op{i}/{k}": c}) for i in range(5000) for k, c in enumerate((tiny, 64 - (i + 0.5) * tiny))]
    # rows whose cheap later steps wait behind a step that is refused
    waiting = [(i, s, {f"w{i}/{s}": c}) for i in range(300) for s, c in ((1, tiny), (2, 60 - i * tiny / 2), (3, 0.25))]
    books = {"steep": steep, "waiting": waiting}
    walk(spark, books, 64.0)
    assert len(ledger.budget_rounds(make(spark, books), ["book"], 64.0)) < 60


@pytest.mark.parametrize("seed", range(2))
def test_shared_operations_of_refused_purchases(spark, seed):
    """Operations that refused steps were first to need fall to later ones, at every size of price."""
    rng = random.Random(seed)
    books = {}
    for b in range(7):
        price = {f"op{i}": rng.choice([0.0, 0.125, 1.0, 5.0, 9.0, 17.0, 33.0]) for i in range(20)}
        books[f"b{b}"] = [(row, step, {o: price[o] for o in rng.sample(sorted(price), rng.randint(0, 4))})
                          for row in range(25) for step in range(1, rng.randint(1, 6) + 1)]
    opening = {f"b{b}": {o: c for o, c in [("op0", None), ("op1", None), ("other", 3.0)]} for b in range(0, 7, 3)}
    for name, ops in opening.items():
        prices = {o: c for *_, purchase in books[name] for o, c in purchase.items()}
        opening[name] = {o: prices.get(o, 1.0) if c is None else c for o, c in ops.items()}
    walk(spark, books, 40.0, {n: o for n, o in opening.items() if sum(o.values()) <= 40})
    walk(spark, books, 40.0)


def test_opening_balance_is_checked(spark):
    bought = make(spark, {"b": [(0, 1, {"a": 2.0})]})
    for op, cost, match in (("z", 50.0, "exceed the budget"), ("a", 1.0, "two prices")):
        first = spark.createDataFrame([("b", op, cost)], "book string, op string, cost double")
        with pytest.raises(Exception, match=match):
            ledger.charge_with_budget(bought, ["book"], 40.0, first).collect()


def test_two_prices_are_an_error(spark):
    bought = spark.createDataFrame(
        [("l", 1, 1, {"x": 2.0}, 9), ("l", 2, 1, {"x": 1.0}, 17)], "policy_id string, row_no long, step_no int, operations map<string,double>, seq long")
    for run in (ledger.charges, ledger.ledger_totals):
        with pytest.raises(Exception, match="two prices"):
            run(bought, ["policy_id"]).collect()
    with pytest.raises(Exception, match="two prices"):
        ledger.charge_with_budget(bought, ["policy_id"], 5.0).collect()
    assert ledger.price_conflicts(bought, ["policy_id"]).count() == 1
