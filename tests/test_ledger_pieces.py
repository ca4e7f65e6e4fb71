"""Budgets settled on pieces of the rows, and operations that no purchase behind a place can pay."""

import random

import pytest

from tierlens.operators import ledger
from test_ledger import make


def outcome(spark, books, budget, **how):
    return sorted(map(tuple, ledger.charge_with_budget(make(spark, books), ["book"], budget, **how).collect()))


def test_a_popular_operation_that_is_too_dear_is_refused_at_once(spark):
    books = {"b": [(0, 1, {"a": 9.0})] + [(i, 1, {"x": 5.0}) for i in range(1, 31)] + [(31, 1, {"a": 9.0})]}
    assert len(ledger.budget_rounds(make(spark, books), ["book"], 10.0)) < 5
    want = [("b", 0, 9.0, None)] + [("b", i, None, 1) for i in range(1, 31)] + [("b", 31, 0.0, None)]
    assert [(k, r, None if step else c, step) for k, r, c, step in outcome(spark, books, 10.0)] == want


@pytest.mark.parametrize("rows_per_piece", [2, 9])
def test_pieces_do_not_change_the_outcome(spark, rows_per_piece):
    rng = random.Random(rows_per_piece)
    price = {f"op{i}": rng.choice([0.0, 0.125, 1.0, 5.0, 9.0]) for i in range(25)}
    books = {f"b{b}": [(row, step, {o: price[o] for o in rng.sample(sorted(price), rng.randint(1, 3))})
                       for row in range(14) for step in range(1, rng.randint(1, 4) + 1)] for b in range(3)}
    for budget in (20.0, 1000.0):
        assert outcome(spark, books, budget, rows_per_piece=rows_per_piece) == outcome(spark, books, budget)


def test_a_second_price_behind_the_end_is_an_error(spark):
    books = {"b": [(0, 1, {"a": 10.0}), (1, 1, {"x": 5.0}), (2, 1, {"x": 6.0})]}
    with pytest.raises(Exception, match="two prices"):
        outcome(spark, books, 10.0, rows_per_piece=1)
