"""Resolution queries against brute force over whole tables."""

from graphloom.queries import all_queries


def test_test_files_of_all_parts(spark, tmp_path):
    spark.createDataFrame([(k,) for k in range(1, 432)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    got = [(r.test, r.tested) for r in all_queries()[0]["rj_test_files"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted((f"src/tests/test_m{k}.py", f"src/m{k}.py") for k in range(1, 432))


def shared(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_all_orders_resolve_by_every_strategy(spark, tmp_path):
    parts = [(k, f"Brand#{b}") for b, ks in ((3, range(1, 60)), (7, range(20, 70)), (12, range(40, 90)), (25, range(64, 72)), (21, (160, 9))) for k in ks]
    orders = [(k, k * 7 % 101) for k in range(1, 700)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    symbols = {f"lib.{b.replace('#', '')}.f{k % 97}" for k, b in parts}
    want = {}
    for order, customer in orders:
        module, name = f"lib.Brand{customer % 30}", f"f{order % 120}"
        named = sorted(q for q in symbols if q.split(".")[-1] == name)
        if f"{module}.{name}" in symbols:
            want[order] = f"{module}.{name}", "same_module", 0.9, "high"
        elif len(named) == 1:
            want[order] = named[0], "unique_name", 0.75, "high"
        elif named:
            c = round(0.55 * min(1, 3 / len(named)), 6)
            want[order] = min(named, key=lambda q: (-shared(q, module), q)), "suffix_match", c, "medium" if c >= 0.45 else "speculative" if c >= 0.25 else ""
    rows = all_queries()[0]["rj_resolve"](spark, str(tmp_path)).collect()
    assert {r.call_id: (r.qualified_name, r.strategy, round(r.confidence, 6), r.band) for r in rows} == want and len(rows) == len(want)
    assert {w[1] for w in want.values()} == {"same_module", "unique_name", "suffix_match"}
