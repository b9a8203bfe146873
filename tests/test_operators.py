"""DataFrame-level operators."""

import pytest
from pyspark.sql import functions as F

from quillon.operators.relational import duplicate_keys, fixpoint, null_safe_anti, ranked, set_operation, top_k, window_aggregate


@pytest.fixture
def scores(spark):
    return spark.createDataFrame([(1, "A", 10), (2, "A", 10), (3, "A", 8), (4, "B", None), (5, "B", 5)], "id int, team string, score int")


def test_windows(scores):
    whole = window_aggregate(scores, F.sum("score"), "s", ["team"], [F.col("id")])
    assert {r.id: r.s for r in whole.collect()} == {1: 28, 2: 28, 3: 28, 4: 5, 5: 5}
    running = window_aggregate(scores, F.sum("score"), "s", ["team"], [F.col("id")], running=True)
    assert {r.id: r.s for r in running.collect()} == {1: 10, 2: 20, 3: 28, 4: None, 5: 5}
    assert {r.id: r.k for r in ranked(scores, "RANK", "k", ["team"], [F.col("score").desc()]).collect()} == {1: 1, 2: 1, 3: 3, 4: 2, 5: 1}


def test_sets_and_top_k(spark, scores):
    a, b = spark.createDataFrame([(1,), (1,), (None,)], "x int"), spark.createDataFrame([(1,), (2,), (None,)], "y int")
    counts = {op: set_operation(op, a, b).count() for op in ("UNION ALL", "UNION", "INTERSECT", "EXCEPT")}
    assert counts == {"UNION ALL": 6, "UNION": 3, "INTERSECT": 2, "EXCEPT": 0}
    assert null_safe_anti(b, a.toDF("z")).collect()[0][0] == 2
    assert [r.id for r in top_k(scores, [F.col("score").desc(), F.col("id")], 2, 1).collect()] == [2, 3]
    assert duplicate_keys(a, ["x"]).count() == 1


def test_fixpoint(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "u int, v int")
    n = [0]

    def save(df):
        n[0] += 1
        df.write.parquet(str(tmp_path / str(n[0])))
        return spark.read.schema(df.schema).parquet(str(tmp_path / str(n[0])))

    first = spark.createDataFrame([(1,)], "k int")
    out = fixpoint(first, lambda d: d.join(edges, F.col("k") == F.col("u")).select(F.col("v").alias("k")), save)
    assert sorted(r.k for r in out.collect()) == [1, 2, 3]
