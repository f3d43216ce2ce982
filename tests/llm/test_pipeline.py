"""The pipeline's stages against brute force."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from asofly.llm.exact_dedup import drop_copies
from asofly.llm.quality import keep_good
from asofly.llm.secrets import RULES, redact, secret_scan
from asofly.llm.simhash import drop_near_copies
from tests.llm.test_shingles import brute_similar
from tests.llm.test_text import brute_spans, lower


@pytest.fixture(scope="module")
def staged(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], folder).cache())
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(staged):
    assert [d.columns for d in staged[1:-1]] == [staged[0].columns] * 4


def test_quality(staged):
    from asofly.llm import quality

    assert ids(staged[1]) == ids(quality.quality_rules(staged[0]).where("kept")) != ids(staged[0])


def test_exact(staged):
    best: dict = {}
    for r in staged[1].collect():
        best[lower(r.text)] = max(best.get(lower(r.text), -1), r.doc_id)
    assert ids(staged[2]) == sorted(best.values())


def test_near(staged):
    """The stage is the rule for stages on word shingles: five words, a similarity of 0.8 or more."""
    found = brute_similar({r.doc_id: r.text for r in staged[2].collect()})
    assert ids(staged[3]) == sorted(set(found.values()))


def test_secrets(staged):
    from asofly.llm import secrets

    before = {r.doc_id: r.text for r in staged[3].collect()}
    after = {r.doc_id: r for r in staged[4].collect()}
    assert before.keys() == after.keys()
    for k, t in before.items():
        assert (after[k].text == t) == (not brute_spans(t, secrets.RULES)) and after[k].n_chars == len(after[k].text)


def test_packed(staged):
    assert ids(staged[4]) == sorted(r.doc_id for r in staged[5].where("piece = 0").collect())


def test_entry(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


EDGE = [
    (1, "alpha beta gamma delta"), (1, "alpha beta gamma delta"), (2, "ALPHA beta gamma delta"), (2, "one other text here"), (None, "alpha beta gamma delta"), (None, "a lone text, nothing like it"),
    (3, None), (4, ""), (5, "password = hunter22"), (None, "token: abcdef99"), (5, "secret=qwerty1 and more"), (6, "plain"),
]


def edge(spark, rows=EDGE):
    """Null and repeated keys, repeated rows, and columns with the names that stages use inside."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit("clash") for c in ("key", "_key", "_sha", "_tag", "_spans", "_own", "tag", "kept", "body", "_dropped", "spans")})


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_edges_exact(spark):
    got = kept(drop_copies(edge(spark)))
    assert sorted(lower(t) for _, t in got) == sorted({lower(t) for _, t in EDGE})
    assert (2, "ALPHA beta gamma delta") in got and (2, "one other text here") in got and (None, "a lone text, nothing like it") in got and (4, "") in got
    assert drop_copies(edge(spark, EDGE[:2])).count() == 1
    assert drop_copies(edge(spark, [])).columns == edge(spark).columns


def test_edges_near(spark):
    got = kept(drop_near_copies(edge(spark)))
    assert got.count((1, EDGE[0][1])) == 2 and (None, EDGE[0][1]) not in got and (2, "ALPHA beta gamma delta") not in got
    assert (2, "one other text here") in got and (None, "a lone text, nothing like it") in got and (3, None) in got and (4, "") not in got
    assert drop_near_copies(edge(spark, [])).count() == 0


def test_edges_secrets(spark):
    got = redact(edge(spark, [(4, ""), (5, "password = hunter22"), (6, "plain"), (6, "plain"), (7, None)]))
    assert got.columns == edge(spark).columns
    assert kept(got) == sorted([(4, ""), (5, "[assign]"), (6, "plain"), (6, "plain"), (7, None)], key=str)


def test_secrets_null_and_repeated_keys(spark):
    """Each row is searched for its own text: null keys are redacted, namesakes don't lend their spans."""
    got = redact(edge(spark))
    assert got.columns == edge(spark).columns
    want = Counter(t for _, t in EDGE)
    for t, clean in (("password = hunter22", "[assign]"), ("token: abcdef99", "[assign]"), ("secret=qwerty1 and more", "[assign] and more")):
        want[clean] += want.pop(t)
    assert Counter(r.text for r in got.collect()) == want
    rows = Counter((r.doc_id, r.spans) for r in secret_scan(edge(spark)).collect())
    assert rows == Counter((k, brute_spans(t, RULES)) for k, t in EDGE)
    same = [(None, f"{i} password = hunter{i} x") for i in range(50)] + [(7, "0123456789abcdef01234567"), (7, "nothing in this one, but as long")]
    assert sorted(r.text for r in redact(edge(spark, same)).collect()) == sorted([f"{i} [assign] x" for i in range(50)] + ["[hex]", "nothing in this one, but as long"])
    assert redact(edge(spark, [])).count() == 0 == secret_scan(edge(spark, [])).count()


def test_edges_quality(spark):
    rows = [(None, "the " + " ".join(f"word{i}" for i in range(12))), (1, "the " + " ".join(f"word{i}" for i in range(12))), (1, None), (2, "")]
    assert kept(keep_good(edge(spark, rows))) == sorted(rows[:2], key=str)


def test_stages_on_edge_rows(spark):
    """All stages in a row over very long texts, near copies, null and repeated keys, repeated rows and clashing columns."""
    from asofly.llm.vocab import WORD_BPE, tokenizer_path
    from asofly.llm.words import library_whole

    def text(name, n=40):
        # a function word now and then, as the quality rules ask for
        return "the " + " ".join(f"{name}{i}" + (" the" if i % 20 == 9 else "") for i in range(n))

    long = text("w", 60_000)
    rows = [
        (1, long), (2, long + " end"), (3, text("a")), (3, text("b")), (None, text("c") + " token: abcdef99"), (None, None), (5, ""), (6, text("d")), (6, text("d")), (7, text("E")), (8, text("e")), (None, text("f") + " token: abcdef99 " + text("g")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_chars": F.length("text")} | {c: F.lit("clash") for c in ("key", "piece", "start", "length", "bin", "offset", "part", "underfull", "sequence_id", "_tag", "w0", "rep", "batch", "digest", "lost")})
    columns = docs.columns
    kept_rows = [sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == columns, name
        kept_rows.append(sorted(((r.doc_id, r.text) for r in docs.collect()), key=str))
        assert docs.where("key <> 'clash' or lost <> 'clash'").count() == 0
    hidden = [(k, t.replace("token: abcdef99", "[assign]")) for k, t in rows if k is None and t]
    want = [(1, long), (3, text("a")), (3, text("b")), (6, text("d")), (8, text("e")), *hidden]
    assert kept_rows[-1] == sorted(want, key=str)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    sizes = Counter()
    for r in packed:
        sizes[r.doc_id] += r.length
    ids = library_whole(tokenizer_path(WORD_BPE))
    real = Counter()
    for k, t in want:
        real[k] += len(ids([t])[0]) // 4 + 1
    assert sizes == real and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs.limit(0), "") if "text" in docs.columns else docs
        assert docs.count() == 0
