"""Session helpers: local sessions for tests/bench and the shared scratch location."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def local_session(cores: int | str = "*", app: str = "tsengine", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**LOCAL_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used as is; without it this
    raises. Only on a local master (tests) a private temporary folder is created and registered.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="tsengine-ckpt-")
    sc.setCheckpointDir(path)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/{name}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


_scratch: list[str] = []
_tables: list[str] = []


def clear_scratch(spark: SparkSession) -> int:
    """Remove the intermediate tables that this process wrote; returns their number.

    For the end of a job, when its results are written: frames that still read such a table fail
    afterwards. Nothing else in the shared folder is touched.
    """
    jvm, conf, gone = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    while _tables:
        spark.sql(f"DROP TABLE IF EXISTS {_tables.pop()}")
    while _scratch:
        path = jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone



def materialize(df):
    """Reliable checkpoint into the shared checkpoint folder: cuts lineage, survives executor
    loss, and pins partitions so several passes see the same rows in the same partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bucketed(df, by: str, sort: str):
    """Like :func:`materialize`, but what is read back knows its layout: a table in the shared folder, in
    as many buckets of ``by`` as there are shuffle partitions, sorted by ``sort`` within a series. Windows,
    aggregates and joins on ``by`` over it need no shuffle, however often it is read.

    A series lies in one bucket, so a series too large for one task belongs in the blocks layout.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "bucketed")
    name = "tsengine_" + path.rsplit("-", 1)[-1]
    df.write.bucketBy(n, by).sortBy(by, sort).option("path", path).format("parquet").saveAsTable(name)
    _tables.append(name)
    return spark.table(name)


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Starting-point settings for a cluster run, sized from the input volume.

    Shuffle partitions are chosen so an average partition holds ~``target_partition_bytes``
    (and at least 3 waves of tasks); AQE coalesces small ones and splits skewed ones at run time.
    ``spark.checkpoint.dir`` is deliberately not set here: it must name shared storage chosen by
    the cluster.
    """
    parts = max(3 * total_cores, -(-int(input_bytes) // target_partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(min(target_partition_bytes, 512 << 20)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }
