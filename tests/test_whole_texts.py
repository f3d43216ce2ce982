"""Queries that search whole texts find what lies behind their heads."""

from asofly.plans import registry


def test_behind_the_head(spark, tmp_path):
    far = "plain words " * 40
    spark.createDataFrame([(2, far + "targets HER2 here"), (14, far), (9, far + "stopped for lack of funding")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    run = lambda name: [tuple(r) for r in registry.queries()[name](spark, str(tmp_path)).collect()]
    found = {k: (t, s) for k, t, s in run("target_resolution_whole")}
    assert found[2] == ("ERBB2", "trial_text") and found[14] == (None, "unresolved")
    assert dict(run("reason_classifier_whole")) == {None: 1, "toxicity_safety": 1, "funding_insolvency": 1}
    assert run("confusion_whole") and run("stated_vs_true_whole")[0][0] == 1
