"""The state store of the stateful streams."""

from __future__ import annotations

from pyspark.sql import SparkSession

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state_store(spark: SparkSession) -> None:
    """Maps and timers of a stream need RocksDB; its state is checkpointed with the stream, and spills to the executors' disks."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
