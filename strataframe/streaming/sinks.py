"""Runs of a streaming query into files: bounded ones, and live ones that stop by themselves."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import IntegerType, StructField, StructType

from ..session import ensure_checkpoint_dir


def run_to_files(
    stream: DataFrame, name: str, mode: str = "append", timeout: int | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Process everything the sources hold, write the result as Parquet in the shared checkpoint folder and read it back.

    Append results go through the file sink. In complete mode each micro-batch is a new version of the whole result.
    In update mode it holds changed rows only: they replace the rows of the same ``keys`` in the last version. The
    query's own state and the versions before the last are deleted at the end.
    """
    if mode == "update" and not keys:
        raise ValueError("update mode needs the keys by which rows replace each other")
    spark = stream.sparkSession
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/streams/{name}-{uuid.uuid4().hex}"
    versions: list[str] = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{base}/data-{number}"
        if mode == "update" and versions and versions[-1] != path:
            old = batch.sparkSession.read.schema(stream.schema).parquet(versions[-1])
            batch = old.join(batch.select(*keys), list(keys), "left_anti").select(*stream.columns).unionByName(batch)
        batch.write.mode("overwrite").parquet(path)
        versions.append(path)

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        versions.append(f"{base}/data")
        started = writer.format("parquet").option("path", versions[0]).start()
    else:
        started = writer.foreachBatch(keep).start()
    started.awaitTermination(timeout)
    for path in (f"{base}/state", *versions[:-1]):
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if path != versions[-1]:
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    if not versions:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(versions[-1])


class _LastRows(StreamingQueryListener):
    """When rows last came into a query, from its progress events."""

    def __init__(self):
        self.run, self.at = None, time.monotonic()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        if str(event.progress.runId) == self.run and event.progress.numInputRows > 0:
            self.at = time.monotonic()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


class EnoughRows(Exception):
    """A sink has the rows it was asked for."""


class BatchFolders:
    """A sink with a folder for each micro-batch. A batch that runs again after a failure replaces what it had written,
    so every row is there once. ``limit`` ends the output after so many rows, in the order of ``order``; the batch after
    that is refused, so that a later run can go on with it."""

    def __init__(self, spark, path: str, schema, limit: int | None = None, order: Sequence[str] = ()):
        self.spark, self.path, self.schema, self.limit, self.order = spark, path.rstrip("/"), schema, limit, list(order)
        self.counts: dict[int, int] = {}

    def _exists(self, path: str) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def before(self, number: int) -> int:
        """Rows of earlier batches; those of an earlier run of the query are counted in their files."""
        for missing in [n for n in range(number) if n not in self.counts]:
            folder = f"{self.path}/batch={missing}"
            self.counts[missing] = self.spark.read.schema(self.schema).parquet(folder).count() if self._exists(folder) else 0
        return sum(self.counts[n] for n in range(number))

    def write(self, batch: DataFrame, number: int) -> None:
        if self.limit is not None:
            left = self.limit - self.before(number)
            if left <= 0:
                raise EnoughRows(f"{self.limit} rows are written")
            batch = batch.orderBy(*self.order).limit(left)
        target = f"{self.path}/batch={number}"
        batch.write.mode("overwrite").parquet(target)
        self.counts[number] = self.spark.read.schema(self.schema).parquet(target).count()

    def full(self) -> bool:
        return self.limit is not None and sum(self.counts.values()) >= self.limit

    def read(self) -> DataFrame:
        """All rows with the number of their batch."""
        if not self._exists(self.path):
            return self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(0))
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("batch", IntegerType())])).parquet(self.path)


def run_live(
    stream: DataFrame,
    state: str,
    sink: BatchFolders,
    transform: Callable[[DataFrame], DataFrame] | None = None,
    idle: float | None = None,
    trigger: str | None = "0 seconds",
    poll: float = 0.2,
) -> DataFrame:
    """Run a query into ``sink`` until it has its rows, no input has come for ``idle`` seconds, or the input ends.

    ``state`` is the query's checkpoint folder: started again with it, the run goes on where it stopped. ``transform``
    works on each micro-batch as a table, so it may use any batch operator. ``trigger=None`` reads what is there and
    ends. A query that fails raises its error here.
    """
    spark = stream.sparkSession
    listener = _LastRows()
    spark.streams.addListener(listener)

    def step(batch: DataFrame, number: int) -> None:
        sink.write(batch if transform is None else transform(batch), number)

    writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", state)
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    try:
        query = writer.start()
        listener.run = str(query.runId)
        try:
            while not query.awaitTermination(poll):
                if sink.full() or (idle is not None and time.monotonic() - listener.at > idle):
                    query.stop()
                    break
        except StreamingQueryException as error:
            if EnoughRows.__name__ not in str(error):
                raise
    finally:
        spark.streams.removeListener(listener)
    return sink.read()
