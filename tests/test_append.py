"""Appends to a growing store: nothing twice, and only what a batch may meet is read."""

import datetime

import pytest
from pyspark.sql import functions as F

from panelforge.sources import files


def _rows_read(df):
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().apply("numOutputRows").value()


def test_growing_ids_read_only_their_range(spark, tmp_path):
    path = str(tmp_path / "store")
    for lo in range(0, 5000, 1000):
        files.append_new(spark.range(lo, lo + 1000).select("id", (F.col("id") * 2).alias("v")), path, "id")
    store = spark.read.parquet(path)
    assert store.count() == 5000
    assert _rows_read(files.keys_to_meet(store, spark.range(4700, 5600).toDF("id"), "id")) <= 1000
    assert _rows_read(files.keys_to_meet(store, spark.range(9000, 9100).toDF("id"), "id")) == 0
    files.append_new(spark.range(4700, 5600).select("id", F.lit(-1).cast("long").alias("v")), path, "id")
    after = spark.read.parquet(path)
    assert after.count() == after.select("id").distinct().count() == 5600
    assert after.where("v = -1").count() == 600  # keys already there keep their first row


KEYS = {
    "string": ["b", "a", "", "zz", "é"],
    "date": [datetime.date(2020, 1, i) for i in (3, 1, 9)],
    "double": [1.5, float("nan"), -0.25, float("inf")],
    "timestamp": [datetime.datetime(2020, 10, 25, h) for h in (0, 1, 2, 3)],
    "decimal(20,3)": None,
}


@pytest.mark.parametrize("kind", KEYS)
def test_replay_adds_nothing(spark, tmp_path, kind):
    values = KEYS[kind] or [__import__("decimal").Decimal(x) for x in ("1.500", "-2.250", "0.000")]
    df = spark.createDataFrame([(v,) for v in [*values, None, *values, None]], f"k {kind}").withColumn("an_key2", F.lit(1))
    path = str(tmp_path / "store")
    for part in (df.limit(0), df.where("k is null"), df, df, df.limit(0), df.where("k is not null")):
        files.append_new(part, path, "k")
    assert spark.read.parquet(path).count() == len(values) + 1


def test_rows_drawn_at_random_meet_their_own_bounds(spark, tmp_path):
    """A batch that is not the same when it is read again is still appended once."""
    path = str(tmp_path / "store")
    draw = spark.range(200).select((F.rand() * 50).cast("long").alias("k"))
    for _ in range(3):
        files.append_new(draw, path, "k")
    store = spark.read.parquet(path)
    assert store.count() == store.distinct().count() <= 50


def test_nothing_is_left_behind(spark, tmp_path):
    from panelforge.storage import shared_dir

    folder = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for _ in range(2):
        files.append_new(spark.range(10), str(tmp_path / "store"), "id")
    assert not [f for f in fs.listStatus(folder) if "append-batch" in f.getPath().getName()]
