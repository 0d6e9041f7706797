"""Running a stream over files to its current end."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of a folder matching ``pattern`` as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def _checkpoint(spark: SparkSession) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")


def drain_updates(stream: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Run an aggregation to the end of the available files; the newest row of each key, open windows included.

    A batch writes the rows that it changed under its own number, so a replayed batch overwrites its folder.
    The bound on late data holds: rows beyond it are dropped and their windows' state is freed.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    run = (
        stream.writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", _checkpoint(spark)).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    rest = [c for c in stream.columns if c not in keys]
    newest = spark.read.schema(schema).parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("_row"))
    return newest.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in stream.columns])


def drain_sessions(stream: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Result of ``windows.session_updates``: the newest row of each session, without those that another one took in."""
    return drain_updates(stream, path, [*keys, "start"]).where("n > 0")


def drain_complete(stream: DataFrame, path: str) -> DataFrame:
    """Run an aggregation to the end of the available files, its whole result in parquet at ``path``.

    For session windows, whose rows cannot be updated in place. Each batch rewrites the result from the distributed state, so late rows and replayed batches
    count once and nothing gathers on the driver.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    run = (
        stream.writeStream.outputMode("complete").foreachBatch(write)
        .option("checkpointLocation", _checkpoint(spark)).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_to_files(stream: DataFrame, path: str) -> DataFrame:
    """Run to the end of the available files into parquet and read it back."""
    spark = stream.sparkSession
    run = (
        stream.writeStream.outputMode("append").format("parquet").option("path", path)
        .option("checkpointLocation", _checkpoint(spark)).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, write: Callable[[DataFrame, int], None]) -> None:
    run = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", _checkpoint(stream.sparkSession))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
