"""Charges of many policies from one row per case are those of a ledger per policy."""

from catalog import views as S
from catalog.policies import POLICIES, rows_with_operations
from catalog.registry import Tables
from tierlens.operators import ledger, replay


def test_charges_shuffle_an_operation_once(spark, sf_dir):
    rows = rows_with_operations(Tables(spark, sf_dir))
    out = replay.policy_charges(rows, POLICIES, "ord")
    paths = replay.run_policies(rows, POLICIES, S.DECISION_TOL)
    old = ledger.charges(ledger.purchases(paths, ["policy_id"], "ord"), ["policy_id"])
    key = lambda df: sorted((r.policy_id, r.row_no, r.cost) for r in df.collect())
    assert key(out) == key(old)


def test_ledger_dedupe_makes_no_row_per_policy(spark, sf_dir):
    from catalog import QUERIES

    plan = QUERIES["ledger_dedupe"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    # before: every operation once per row and policy
    assert "hashpartitioning(op#" in plan and "hashpartitioning(policy_id" in plan
    assert not [x for x in plan.splitlines() if "hashpartitioning(policy_id" in x and "op#" in x], plan
