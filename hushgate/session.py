"""Session settings the operators were designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Skew handling is left to adaptive execution wherever a join keeps its row
# identity; joins that fan results back to repeated keys salt explicitly
# (operators/skew.py). Broadcasts are never forced: Spark picks them from the
# measured size of a side, and falls back to a shuffled join above the threshold.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# On a cluster shuffles start wide and adaptive execution merges what is small.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "4000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.files.maxPartitionBytes": "256m",
}


def build_session(app: str = "hushgate", master: str | None = None,
                  conf: dict[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    local = (master or "").startswith("local")
    for key, value in {**ENGINE_CONF, **({} if local else CLUSTER_CONF), **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
