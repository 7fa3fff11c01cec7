"""Steps whose tasks stay as large as they are when tables grow."""

from panelforge.plans import fixtures

SF = "/root/testdata/sf0.001"


def test_mentions_partitions_grow_with_lines(spark, monkeypatch):
    want = sorted((r.post_id, tuple(r.tickers)) for r in fixtures.order_mentions(spark, SF).collect())
    monkeypatch.setattr(fixtures, "LINES_A_TASK", 500)
    df = fixtures.order_mentions(spark, SF)
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert df.rdd.getNumPartitions() == -(-lines // 500) > 4
    assert sorted((r.post_id, tuple(r.tickers)) for r in df.collect()) == want
    assert "BroadcastHashJoin [o_orderkey" not in df._jdf.queryExecution().executedPlan().toString()
