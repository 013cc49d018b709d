"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Vector aggregates keep one buffer per group; let a task hold more of them before it sorts.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "4096",
    # State of streams off the heap; the retention buffer's map state needs it.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}


def build(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``master`` is only given for local runs."""
    builder = SparkSession.builder.appName("strataframe")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings a running session can still take, and ship the package to its executors."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the Python workers, once per context: tasks import it by name."""
    context = spark.sparkContext
    if getattr(context, "_strataframe_shipped", False):
        return spark
    package = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="strataframe-")) / "strataframe.zip"
    with zipfile.ZipFile(bundle, "w") as archive:
        for source in sorted(package.rglob("*.py")):
            archive.write(source, source.relative_to(package.parent))
    context.addPyFile(str(bundle))
    context._strataframe_shipped = True
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; a local folder only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strataframe-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage, so that a lost executor costs no recomputation."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
