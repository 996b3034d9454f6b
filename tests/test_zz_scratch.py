"""Runs last: removes the scratch tables materialised by this test session."""
import os

from reviewlens.session import drop_scratch_tables, materialize, scratch_path


def test_drop_scratch_tables(spark):
    t = materialize(spark.range(10))
    assert t.count() == 10
    base = os.path.dirname(scratch_path(spark, "x"))
    before = len(os.listdir(base))
    n = drop_scratch_tables(spark)
    assert n >= 1 and len(os.listdir(base)) == before - n
