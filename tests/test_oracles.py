"""Each query of the library itself against its SQL."""

import pytest
from oracle import compare
from studyperf.plans import catalog


#: The report's sections are held against their own tables, all from one report, in test_advice.py.
OWN = sorted(n for n in catalog.ORACLES if not n.startswith("report_"))


@pytest.mark.parametrize("name", [*OWN, "report_consistency", "report_blocks_by_topic"])
def test_query_equals_sql(spark, name):
    assert compare(spark, "/root/testdata/sf0.001", catalog.QUERIES[name], catalog.ORACLES[name]) == ""


def test_queries_without_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"monthly_report"}
