"""Every registered query with comparison SQL against DuckDB on the smallest tables; the others must give rows."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tapeloom.operators.metrics import step_weights
from tapeloom.plans.adapters import dealt

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.mark.parametrize("name", sorted(__spark_entry__.PLANS))
def test_query(spark, duck, name):
    query, sql = __spark_entry__.PLANS[name]
    df = query(spark, SF)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*names).collect()), key=repr)
    if sql is None:
        assert rows
        return
    rel = duck.execute(sql)
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == names
    want = sorted((tuple(plain(r[cols.index(n)]) for n in names) for r in rel.fetchall()), key=repr)
    assert rows == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_medians_on_a_half_round_to_even(spark):
    """(26.46 + 30.44) / 2 and (17.72 + 40.98) / 2 are one step beside 28.45 and 29.35 as doubles."""
    rows = [("a", 26.46), ("a", 30.44), ("b", 17.72), ("b", 40.98)]
    got = step_weights(spark.createDataFrame([(n, x, None) for n, x in rows], "name string, duration_sec double, window_total int"))
    assert {r.name: r.weight for r in got.collect()} == {"a": 28.4, "b": 29.4}


def test_steps_of_tasks_without_a_shuffle(spark):
    plan = __spark_entry__.queries()["enabled_steps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_tasks_grow_with_the_table(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 300)
    assert dealt(rows, "k", rows=50).rdd.getNumPartitions() == 20 and dealt(rows, "k").rdd.getNumPartitions() == 4
    assert dealt(rows, "k", rows=50).groupBy("k").count().count() == 300


def test_sentences_are_cut_in_many_tasks(spark):
    """One row group of documents must not be one task."""
    assert __spark_entry__.queries()["chunk_sentences"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4
