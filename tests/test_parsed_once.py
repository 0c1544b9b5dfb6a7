"""Queries that read elements several times parse, and make what they parse, once."""

from foliary.plans import nested


def test_elements_are_written(spark):
    plan = nested.image_owners(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan
