"""What the driver's JVM holds back goes to the system while intermediates are written."""

from braidwork.llm import cluster


def test_writing_a_table_trims_the_driver_at_most_once_in_a_while(spark, monkeypatch):
    monkeypatch.setattr(cluster, "_TRIMMED", {})
    assert cluster.trim_driver(spark) is True
    assert cluster.trim_driver(spark) is False
    cluster._TRIMMED.clear()
    df = cluster.materialize(spark.range(10), "trimmed")
    assert df.count() == 10 and cluster._TRIMMED and cluster.trim_driver(spark) is False
    cluster.discard(df)
