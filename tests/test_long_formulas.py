"""Formulas over points stay short enough to be compiled."""

from waypath import registry_more  # noqa: F401  (which adds the query)
from waypath.registry import METHOD, QUERIES

SF = "/root/testdata/sf0.001"


def test_rigid_motions_goes_by_steps(spark):
    spark.conf.unset(METHOD)
    plan = QUERIES["rigid_motions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert spark.conf.get(METHOD) == "8000"
    assert len(plan) < 100_000  # 562,160 when the steps were written into one another
    spark.conf.set(METHOD, "20000")
    QUERIES["rigid_motions"](spark, SF)
    assert spark.conf.get(METHOD) == "20000"  # a limit that was given holds
    spark.conf.unset(METHOD)
