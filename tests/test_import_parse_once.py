"""A reaction list is made and parsed once, whatever is then read of it."""

import pytest

from catalog import QUERIES


@pytest.mark.parametrize("name", ["import_subset", "import_subset_structures"])
def test_list_is_parsed_once(spark, sf_dir, name):
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    # before: the line items were read anew for every branch of the result
    assert "l_linestatus" not in plan and "collect_list" not in plan, plan
