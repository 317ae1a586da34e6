import pytest
from comparison import duck_rows, spark_rows

from sparkloom.plans import code_queries, history_queries, rule_queries, run_queries, store_queries, text_queries
from sparkloom.streaming import event_queries

MODULES = (history_queries, text_queries, run_queries, store_queries, code_queries, rule_queries, event_queries)
NAMES = [(m, n) for m in MODULES for n in m.QUERIES]


@pytest.mark.parametrize(("module", "name"), NAMES, ids=[n for _, n in NAMES])
def test_query_equals_its_sql(spark, data, module, name):
    frame = module.QUERIES[name](spark, data)
    rows = spark_rows(frame)
    assert rows == duck_rows(data, module.SQL[name])
    assert rows or name in ("secret_assignments", "entropy_scan")  # these two tables hold none at this size


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 25
    assert set(e.oracle_sql()) <= set(e.queries())
