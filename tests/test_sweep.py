"""The sweep over observed thresholds."""

from asofly.operators import survival
from asofly.plans import registry
from asofly.plans.temporal_queries import asof_month_panel

FOLDER = "/root/testdata/sf0.001"


def test_every_observed_threshold(spark):
    want = {r.threshold for r in survival.thresholds(asof_month_panel(spark, FOLDER), "staleness").collect()}
    got = [r.threshold for r in registry.queries()["threshold_sweep_observed"](spark, FOLDER).collect()]
    assert len(want) > 5 and sorted(got) == sorted(want)
