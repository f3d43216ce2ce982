"""Trial records, panels and selections on small cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from asofly.operators import programs as P
from asofly.sources.snapshots import parse_study
from tests.test_operators import body

D = dt.date


def test_summary_and_scope(spark):
    s = spark.createDataFrame([("n1", body(status="TERMINATED", count=7)), ("n2", "not json")], "nct_id string, raw string").withColumn("study", parse_study(F.col("raw")))
    r = {x.nct_id: x for x in P.summarize(s).collect()}
    assert (r["n1"].status, r["n1"].enrollment, r["n1"].primary_completion_date) == ("TERMINATED", 7, D(2020, 1, 1)) and r["n2"].status is None
    d = spark.createDataFrame([(None,), (D(2012, 1, 1),), (D(2011, 12, 31),)], "d date").select(P.in_date_scope(F.col("d")).alias("x")).collect()
    assert [x.x for x in d] == [True, True, False]


def test_best_snapshot(spark):
    index = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "nct_id string, version int")
    bodies = spark.createDataFrame([("a", 1, "old"), ("b", 1, "b1")], "nct_id string, version int, body string")
    current = spark.createDataFrame([("a", "cur"), ("c", "only")], "nct_id string, body string")
    assert {r.nct_id: (r.body, r.origin) for r in P.best_snapshot(index, bodies, current).collect()} == {"a": ("cur", "current_state"), "b": ("b1", "versioned"), "c": ("only", "current_state")}


def test_feature_panel(spark):
    rows = [("t", 1, D(2020, 1, 15), "RECRUITING", ["Contacts/Locations"]), ("t", 2, D(2020, 3, 1), "UNKNOWN", [])]
    v = spark.createDataFrame(rows, "nct_id string, version int, posted_date date, status string, changed_modules array<string>")
    v = v.withColumns({"why_stopped": F.lit(None).cast("string"), "verified": F.lit(None).cast("date"), "completion": F.lit(None).cast("date"), "has_results": F.lit(False), "enrollment_type": F.lit("ACTUAL")})
    p = P.feature_panel(v, spark.createDataFrame([("p", "t")], "program_id string, nct_id string"), F.lit(D(2020, 4, 1))).orderBy("as_of").collect()
    assert [r.as_of.month for r in p] == [1, 2, 3, 4] and p[0].silence_score_asof is None and p[0].contacts_locations_amendment_cadence_asof == 0
    assert p[1].silence_score_asof == 2 and p[2].silence_score_asof == 27 and p[1].contacts_locations_amendment_cadence_asof == pytest.approx(365.25 / 17)


def test_sponsors_and_register(spark):
    s = "array<struct<sponsor:string,last_seen:string>>"
    df = spark.createDataFrame([(1, [("A", "2020"), ("B", "2021"), ("C", None)]), (2, []), (3, None)], f"id int, s {s}")
    assert [r.x for r in df.orderBy("id").select(P.lead_sponsor(F.col("s")).alias("x")).collect()] == ["B", "UNKNOWN", "UNKNOWN"]
    with pytest.raises(ValueError):
        P.assert_registered(df, {"id"})
    assert P.spike(spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int"), "x").first().share == pytest.approx(2 / 3)
    assert P.distinct_tuples(spark.createDataFrame([(1, None), (1, None), (1, 2)], "a int, b int"), ["a", "b"]).first().n == 2
