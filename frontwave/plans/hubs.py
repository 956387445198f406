"""Edges dealt for repeated joins by source, hubs apart.

A join by source puts a hub's edges into one task, and adaptive execution cannot split a cached side. So the edges of a
source with more than ``least`` of them are dealt round-robin and meet a broadcast of the hubs' rows. There are fewer hubs
than ``edges / least``, and ``least`` is at least twice the mean of a partition, so the broadcast is smaller than the number of partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUB_LEAST = 65_536


@dataclass(frozen=True)
class Dealt:
    """``light`` is cached by source and sorted by it; ``heavy`` (None without hubs) is cached round-robin, ``hubs`` has its sources."""

    light: DataFrame
    heavy: DataFrame | None
    hubs: DataFrame | None

    def join(self, rows: DataFrame) -> DataFrame:
        """The edges with the rows that have their source, in column src."""
        found = self.light.join(rows, "src")
        if self.heavy is None:
            return found
        few = F.broadcast(rows.join(F.broadcast(self.hubs), "src", "left_semi"))
        return found.unionByName(self.heavy.join(few, "src"))

    def unpersist(self) -> None:
        for part in (self.light, self.heavy, self.hubs):
            if part is not None:
                part.unpersist()


def deal(edges: DataFrame, least: int = HUB_LEAST) -> Dealt:
    tasks = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_source = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    total, top = by_source.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    bound = max(least, 2 * total // tasks)
    keep = lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)
    if top <= bound:
        return Dealt(keep(edges.repartition(tasks, "src").sortWithinPartitions("src")), None, None)
    hubs = keep(by_source.where(F.col("n") > bound).select("src"))
    light = edges.join(F.broadcast(hubs), "src", "left_anti").repartition(tasks, "src").sortWithinPartitions("src")
    return Dealt(keep(light), keep(edges.join(F.broadcast(hubs), "src", "left_semi").repartition(tasks)), hubs)
