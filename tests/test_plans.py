"""Plans: joins whose sides grow with the input are sorted, whatever size Spark supposes; a broadcast one fills the driver."""

from __future__ import annotations

import pytest

from docframe.plans import catalog, office, pages  # noqa: F401  registers the queries
from docframe.registry import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["open_workbook_cells", "word_document_blocks", "workbook_cells", "topic_pairs", "html_table_cells"])
def test_no_side_is_broadcast(spark, name):
    plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
