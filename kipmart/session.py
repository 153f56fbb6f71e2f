"""Session construction and the shared lineage-cut folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes (this is
# the size check behind every data-dependent broadcast), splits skewed shuffle
# partitions and coalesces small ones. Before it runs the planner only has sizes of
# compressed files: 9 million order keys are 12 MB there and 800 MB as a hash table
# on the driver. So it may broadcast the fixed tables alone (the categories) and
# leaves all others to AQE, which counts the bytes of their rows.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    "spark.sql.autoBroadcastJoinThreshold": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    # a selective filter on orders (one month, one day) becomes a bloom filter
    # on the order-line scan, pruning lines before the shuffle
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
}


# Cluster profile for ~100 TB inputs on ~1000 executors. The largest shuffle is
# the order lines cut to (order_id, product_id, quantity, price): roughly a
# tenth of the line table, ~5-8 TB. 16384 reducers put ~500 MB in each before
# AQE coalesces the smaller shuffles; fewer reducers would spill, many more
# would multiply the map x reduce block count. Scan splits of 512 MB keep the
# task count of a 100 TB scan near 200k.
CLUSTER_CONF = {
    "spark.sql.shuffle.partitions": "16384",
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16384",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1g",
    "spark.sql.files.maxPartitionBytes": "512m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "256m",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "kipmart", extra: dict | None = None,
                  profile: str = "local") -> SparkSession:
    """Create (or reuse) a session with the job settings.

    ``profile="cluster"`` adds :data:`CLUSTER_CONF` (master from spark-submit);
    in tests pass ``master="local[8]"`` and a small partition count.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(SESSION_CONF)
    if profile == "cluster":
        conf.update(CLUSTER_CONF)
    conf["spark.ui.enabled"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def apply_job_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable SQL options to an existing session."""
    for k, v in SESSION_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: keep the cluster's value
            pass


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint folder, honouring the cluster's ``spark.checkpoint.dir``.

    Only when neither the session nor the context names one and the master is
    local (tests) is a scratch folder created; on a cluster a missing setting
    is an error, never a machine-local folder.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no context on the client
        sc = None
    if sc is not None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or (
        sc.getConf().get("spark.checkpoint.dir", None) if sc is not None else None)
    if not configured:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            # a driver-local folder is not visible to executors on a cluster
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS, S3, ...)")
        configured = tempfile.mkdtemp(prefix="kipmart-ckpt-")
    if sc is not None:
        sc.setCheckpointDir(configured)
        # the context uses a folder of its own below the configured one
        return sc._jsc.sc().getCheckpointDir().get()
    else:
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured
