"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.lineage import cut_lineage, forget_size

#: Rounds after which the labels' size estimate starts anew; it has about four times the digits after each.
ANEW = 4
#: Rows of a task in a round, on average; tasks of fewer rows than that leave files that are mostly empty, anew each round.
TASK_ROWS = 1 << 17


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): smallest vertex id of the component; ``edges`` is (src, dst).

    Each round takes the smallest neighbour label (pre-aggregated per vertex) and then the label
    of the own label, so long chains halve. Labels only fall: an unchanged sum means the end.
    Rounds run in as many tasks as the rows need, one a core at least, however many partitions a shuffle has.
    """
    both = cut_lineage(
        edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    )
    labels = cut_lineage(vertices.select("id", F.col("id").alias("component")))
    tasks = max(both.sparkSession.sparkContext.defaultParallelism, math.ceil(both.count() / TASK_ROWS), math.ceil(labels.count() / TASK_ROWS))
    both, labels = both.coalesce(tasks), labels.coalesce(tasks)
    total, rounds = _total(labels), 0
    while True:
        named = labels.select(F.col("id").alias("dst"), F.col("component").alias("_near"))
        nearest = both.join(named, "dst").coalesce(tasks).groupBy(F.col("src").alias("id")).agg(F.min("_near").alias("_near"))
        lower = labels.join(nearest, "id", "left").select(
            "id", F.least("component", F.coalesce("_near", "component")).alias("component")
        )
        lower = cut_lineage(lower.coalesce(tasks))
        parents = lower.select(F.col("id").alias("component"), F.col("component").alias("_up"))
        rounds += 1
        keep = cut_lineage if rounds % ANEW else forget_size
        labels = keep(lower.join(parents, "component").select("id", F.col("_up").alias("component")).coalesce(tasks))
        fresh = _total(labels)
        if fresh == total:
            return labels
        total = fresh


def _total(labels: DataFrame):
    return labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
