"""Trailing-window computations over long ordered groups.

A ``PARTITION BY key ORDER BY t`` window keeps one key in one task. Here rows get their
position first, are cut into blocks of consecutive positions, and the last ``halo`` rows of
a block are repeated in the next one, so every frame of up to ``halo`` preceding rows is
complete inside a block and a hot key runs as many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from millrace.plans.prefix import row_positions

BLOCK_ROWS = 100_000


def blocks_with_halo(
    df: DataFrame,
    order: str,
    halo: int,
    by: Sequence[str] = (),
    tie: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, WindowSpec]:
    """Rows with ``position``, ``total``, ``_block``, ``_repeat`` and the window to compute over.

    Drop rows with ``_repeat`` after taking the window values.
    """
    block_rows = max(block_rows, halo + 1)
    ranked = row_positions(df, order, tie, by)
    place = F.col("position") - 1
    home = F.floor(place / block_rows)
    spilled = (place % block_rows >= block_rows - halo) & (F.col("position") < F.col("total"))
    targets = F.when(spilled, F.array(home, home + 1)).otherwise(F.array(home))
    spread = ranked.select("*", F.posexplode(targets).alias("_copy", "_block")).withColumn("_repeat", F.col("_copy") > 0)
    window = Window.partitionBy(*by, "_block").orderBy("position")
    return spread.drop("_copy"), window


def finish(df: DataFrame) -> DataFrame:
    return df.where(~F.col("_repeat")).drop("_block", "_repeat")
