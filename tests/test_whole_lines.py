"""Queries over every line, against brute force."""

from asofly.plans import registry


def test_entity_components_all(spark, tmp_path):
    """Parts that no filter on number or quantity may lose join the suppliers."""
    lines = [(1, 41, 1), (2, 41, 2), (2, 43, 50), (3, 43, 3), (4, 80, 40), (5, 7, 1), (5, 9, 1), (6, 9, 45)]
    spark.createDataFrame(lines, "l_suppkey long, l_partkey long, l_quantity long").selectExpr("*", "timestamp'1998-01-01' as l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for s, p, _ in lines:
        a, b = find(s), find(1_000_000 + p)
        root[max(a, b)] = min(a, b)
    got = registry.queries()["entity_components_all"](spark, str(tmp_path)).collect()
    assert sorted((r.vertex, r.component) for r in got) == sorted((x, find(x)) for x in list(root))
    shared = {(r.l_suppkey, r.l_partkey): r.shared_with for r in registry.queries()["shared_with_all"](spark, str(tmp_path)).collect()}
    assert shared == {(s, p): ",".join(str(x) for x, q, _ in sorted(lines) if q == p and x != s) for s, p, _ in lines}
