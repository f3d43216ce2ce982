"""Queries over texts on odd ones against their SQL."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from asofly.functions import text as X
from asofly.functions import vocab as V
from asofly.plans import registry


def both(spark, folder, name: str, texts) -> tuple[dict, dict]:
    """Rows of a query by doc_id, as Spark has them and as its SQL has them."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    df = registry.queries()[name](spark, str(folder))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return {r[0]: tuple(r[1:]) for r in df.collect()}, {r[0]: r[1:] for r in want}


def test_truncated_behind_a_line(spark, tmp_path):
    ends = ["alpha beta\n", "alpha beta\r", "alpha \r\n", "alpha beta\x85", "alpha beta ", "alpha\x0bbeta", "alpha beta\x0b", "alpha \x85", "alpha beta", "𝒜 beta 😀"]
    texts = [None, "", "short\n", "w" * 120, *("x" * (99 - len(e)) + " " + e + after for e in ends for after in ("gamma", " gamma", "\n"))]
    got, want = both(spark, tmp_path, "snippet_truncate", texts)
    assert got[4][0] == "x" * 88 + " alpha beta"
    assert got == want


NAMED = [
    "HER2", "her-2/neu", "Human Epidermal Growth Factor Receptor-2", "ErbB2", "HER-3", "trop-2", "TACSTD2", "nectin-4", "tissue factor", "TİſſUE factor", "tıssue factor", "folate receptor alpha", "FR-alpha", "FRALPHA", "FRΑ", "frα",
    "FOLR1", "CD22", "cd33", "CD30", "cd79b", "CD19", "cd70", "CD117", "c-\u212aIT", "ckıt", "CD138", "Syndecan-1", "syndecan1", "BCMA", "cd37", "c-Met", "MET receptor", "c-met receptor", "DLL3", "Mesothelin", "MſLN", "CEACAM5", "Carcinoembryonic antigen",
    "B7-H3", "b7h3", "CD276", "LIV-1", "SLC39A6", "napi2b", "SLC34A2", "ROR1", "AXL", "STEAP1", "steap2", "GPNMB", "PTK7", "integrin beta-6", "ITGB6", "CD166", "ALCAM", "GPA33", "A33 antigen", "CDH6", "CDH17", "PSMA", "FOLH1", "claudin 18.2",
    "Claudin-18.2", "CLDN18.2", "cldn18", "claudin (CLDN) 18", "EGFR", "epidermal growth factor receptor", "epidermal growth factor receptors 2", "epidermal growth factor receptor 25", "MUC16", "mucin-16", "MUC1", "CD319", "SLAMF7", "CD46", "ADAM9",
    "h-e-r2", "c--met", "cd-22", "her 2", "cd2 2", "gpa3 3", "", "-", None,
]


def test_targets_behind_their_sure_parts(spark):
    plain = F.array_compact(F.array(*[F.when(X.any_of([F.col("t").rlike(f"(?iu){a}") for a in aliases]), F.lit(x)) for x, aliases in V.TARGET_ALIASES.items()]))
    texts = [None if n is None else before + n + after for n in NAMED for before, after in (("", ""), ("x", "y"), ("é1", "é"), ("-a b7 ", "-\n"), ("HER2 ", " 2"), ("gpa3", "3 antigen"), ("cd1", "cd1"))]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.targets_in(F.col("t")).alias("got"), plain.alias("want")).collect()
    assert [(r.t, r.got) for r in rows if r.got != r.want] == []
    assert {x for r in rows for x in r.got} == set(V.TARGET_ALIASES)


def test_keys_of_parts_never_end_in_one_another():
    parts = {X.sure_part(a) for aliases in V.TARGET_ALIASES.values() for a in aliases}
    keys = X.digit_keys(parts)
    assert all(k in p for p, k in keys.items()) and not [(j, k) for j in keys.values() for k in keys.values() if j != k and j.endswith(k)]
    assert all(re.search("[a-z][0-9]", p) is None for p in parts - set(keys)) and min(map(len, parts)) >= 3


SEARCHED = [
    "plain words " * 50, "about HER2 " * 3, "her-2/neu and c-Met", "c-Met", "MET receptor and DLL3", "DLL3\nCD22", "cd223 dll33", "ACD22", "AXL", "Cd22-", "no " * 90 + "erbb2", "human epidermal growth factor receptor 2", "", None,
]


@pytest.mark.parametrize("name", ["target_with_residual", "target_resolution", "target_resolution_whole"])
def test_texts_are_searched_once(spark, tmp_path, name):
    texts = SEARCHED * 9
    got, want = both(spark, tmp_path, name, texts)
    assert got == want
    plan = registry.queries()[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("her-?2") == 2, "once for texts, once for names"
