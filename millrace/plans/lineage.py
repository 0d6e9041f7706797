"""Cutting lineage in iterative jobs through reliable storage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.session import ensure_checkpoint_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read on from there; survives executor loss."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def forget_size(df: DataFrame) -> DataFrame:
    """``df`` with Spark's default size estimate, lineage cut.

    A checkpoint keeps the estimate of the plan it was made from, and that of a join is the product of its sides. In a loop whose
    frames are joined with themselves its digits multiply each round, until the driver's memory is full of them. Rows pass through
    Python once, so call it on narrow frames, every few rounds.
    """
    return cut_lineage(df.sparkSession.createDataFrame(df.rdd, df.schema, verifySchema=False))
