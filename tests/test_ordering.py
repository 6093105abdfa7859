import random

from pyspark.sql import functions as F

from colloquy.operators.ordering import ranked


def test_ranks_are_places_in_the_whole_order(spark):
    source = random.Random(3)
    rows = [(i, source.choice([1.5, 2.5, None, 7.0])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, score double").withColumn("rank", F.lit("own")).repartition(5)
    got = {r.id: r.rank for r in ranked(df, F.desc_nulls_last("score"), F.asc("id")).collect()}
    order = sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else float("-inf")), r[0]))
    assert got == {r[0]: i + 1 for i, r in enumerate(order)}


def test_repeated_rows_and_no_rows(spark):
    df = spark.range(400).select(F.lit(1).alias("x"))
    assert sorted(r.rank for r in ranked(df, F.asc("x")).collect()) == list(range(1, 401))
    assert ranked(df.limit(0), F.asc("x")).count() == 0


def test_no_task_gets_the_whole_table(spark):
    plan = ranked(spark.range(100), F.asc("id"))._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
