"""Session helpers: recommended settings and the shared folder for materialised tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings the operators are designed around. AQE re-plans joins at run time: a side whose
# measured size is under the broadcast threshold is broadcast, larger sides stay sort-merge,
# and skewed partitions (a hot key, or the null key) are split.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.caseSensitive": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "scorekit",
                  extra: dict | None = None) -> SparkSession:
    """A local session for tests and the benchmark (never used by the operators)."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    conf = dict(RECOMMENDED_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "8g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for materialised tables: the cluster's ``spark.checkpoint.dir``.

    Read from the session. Only a local-mode session without one gets a fresh temporary
    folder; on a cluster a shared folder must be configured, never a machine-local one.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - a Spark Connect session has no SparkContext
        sc = None
    root = (sc.getCheckpointDir() if sc else None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if sc is None or not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a folder shared by all executors")
    if sc.master.startswith("local-cluster"):
        raise RuntimeError("executors of a local cluster are processes of their own: set spark.checkpoint.dir")
    root = tempfile.mkdtemp(prefix="scorekit-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, asked of the file system that holds it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def delete_tables(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, once nothing reads them any more.

    Only folders directly under the checkpoint folder are touched; frames read from elsewhere
    are left alone.
    """
    root = checkpoint_root(spark).rstrip("/")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    inside = jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()
    for frame in frames:
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().toUri().getPath() == inside:
                path.getFileSystem(conf).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet under the checkpoint folder and return a reader of it.

    Cuts lineage: everything downstream reads the same rows even if executors are lost, and
    the read-back plan carries file sizes, so AQE can decide joins on measured bytes. Columns that
    hold nothing but nulls by their type are not written; the reader adds them.
    """
    spark = df.sparkSession
    void = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
    kept = df.drop(*void)
    path = os.path.join(checkpoint_root(spark), f"{label}-{uuid.uuid4().hex}")
    kept.write.mode("errorifexists").parquet(path)
    back = spark.read.schema(kept.schema).parquet(path)
    return back.select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns]) if void else back
