"""Session construction and shared scratch storage.

Intermediate tables (level-loop checkpoints, stream landing folders, round-trip
outputs) go under the folder the cluster names in ``spark.checkpoint.dir``. A
local temporary folder is only made for a ``local`` master without that setting
(tests, a laptop) and goes when the process ends; on a cluster its absence is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql.types import StructField, StructType

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Texts that one task attaches (and mostly tokenizes), about; and the most tasks this makes.
TEXTS_A_TASK = 20_000
MOST_TASKS = 20_000


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "threadlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, setting a local one only if none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = scratch_base(sc.master, sc.getConf().get("spark.checkpoint.dir", None))
    if configured is None:
        configured = tempfile.mkdtemp(prefix="threadlens-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def scratch_base(master: str, configured: str | None) -> str | None:
    """The configured shared folder, or None where a machine-local one will do (a ``local`` master).

    Executors of a cluster would each write to their own disk, so there a missing setting raises.
    """
    if configured or master == "local" or master.startswith("local["):
        return configured or None
    raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/threadlens/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "table", read_as: dict | None = None):
    """Write ``df`` once as Parquet under the checkpoint folder and continue from the files.

    This cuts the lineage (level loops, iterative fits) with a single job:
    ``Dataset.checkpoint`` on an uncached plan computes it twice (once to count,
    once to write). Readers of the result scan files, so a lost executor costs
    a re-read, not a recomputation of every earlier step. ``read_as`` gives columns another type that
    is stored in the same way (a vector's fields, read as a vector).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    if read_as:
        fields = [StructField(f.name, read_as.get(f.name, f.dataType)) for f in df.schema.fields]
        return spark.read.schema(StructType(fields)).parquet(path)
    return spark.read.parquet(path)


def text_tasks(df, n: int) -> int:
    """Tasks for ``n`` texts: no fewer than the session's shuffles have."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(max(least, -(-n // TEXTS_A_TASK)), MOST_TASKS)
