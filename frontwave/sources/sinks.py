"""Writers of levels and ranks, as one line of text each row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bfs_lines(distances: DataFrame) -> DataFrame:
    """``id distance`` of reached vertices."""
    return distances.select(F.format_string("%s %s", F.col("id").cast("string"), F.col("distance").cast("string")).alias("value"))


def rank_lines(ranks: DataFrame) -> DataFrame:
    """The id padded to 30 characters, a colon, the rank."""
    return ranks.select(F.concat(F.rpad(F.col("id").cast("string"), 30, " "), F.lit(" :"), F.rpad(F.col("rank").cast("string"), 10, " ")).alias("value"))


def write_levels(distances: DataFrame, path: str) -> None:
    """Nearest first."""
    bfs_lines(distances.orderBy("distance", "id")).write.text(path)


def write_ranks(ranks: DataFrame, path: str) -> None:
    """Highest first."""
    rank_lines(ranks.orderBy(F.desc("rank"), "id")).write.text(path)
