"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest

from ledgerline.plans import registry

from .oracle import assert_equal

FOLDER = "/root/testdata/sf0.001"
SLOW = {"walk_forward", "walk_forward_rows", "walk_forward_driven", "surprise_half_life", "ablation_ladder", "bootstrap_lr"}  # test_engine runs their operators on small series


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - SLOW))
def test_query(spark, name):
    frame = registry.queries()[name](spark, FOLDER).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql:
        assert_equal(frame, sql, FOLDER)
    else:
        assert len(frame) > 0


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
