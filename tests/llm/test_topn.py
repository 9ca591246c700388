import math
import random

from pyspark.sql import functions as F

from hushlens.llm import topn

def order():
    return [F.desc_nulls_last("s"), F.desc_nulls_last("t"), F.asc("id")]


def brute(rows, n):
    groups = {}
    for g, s, t, i in rows:
        if g is not None:
            groups.setdefault(g, []).append((-(s if s is not None else -math.inf), -(t if t is not None else -math.inf), i))
    return {(g, i) for g, v in groups.items() for _, _, i in sorted(v)[:n]}


def test_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["hot"] * 6 + ["warm"] * 2 + list("abcdef") + [None]), rng.choice([None, 0.5, 0.25, rng.random()]), rng.choice([None, 0.1, 0.2]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, s double, t double, id long")
    for heavy in (10, 500, 10_000):
        got = topn.top_n(df, "g", order(), 3, salt_by="id", heavy_rows=heavy, slice_rows=50)
        assert {(r.g, r.id) for r in got.collect()} == brute(rows, 3) and got.count() == len(brute(rows, 3))


def test_edges(spark):
    schema = "g string, s double, t double, id long, rank int, _count int, _salt int"
    df = spark.createDataFrame([("a", 1.0, 1.0, 1, 9, 9, 9), ("a", 1.0, 1.0, 1, 9, 9, 9), (None, 2.0, 1.0, 2, 9, 9, 9)], schema)
    got = topn.top_n(df, "g", order(), 3, salt_by="id", heavy_rows=1, slice_rows=1).collect()
    assert len(got) == 2 and {r.asDict()["_rank"] for r in got} == {1, 2} and {r["rank"] for r in got} == {9}
    assert topn.top_n(df.limit(0), "g", order(), 3, salt_by="id").count() == 0


def test_plan_bounds_what_is_broadcast():
    assert topn.MAX_HEAVY <= 10_000
