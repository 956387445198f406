"""Iteration: a state DataFrame, a step, a stopping rule.

Each round's state is written to the shared folder and read back, so the plan of round n is as short as that of round 1
and a lost executor costs no recomputation of earlier rounds. What the stopping rule needs is observed while the state is
written: a round is one job.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from ..functions.stats import RunStats


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; on a local master without one, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = getattr(spark.sparkContext, "_frontwave_rounds", None)
    if made is None:
        made = spark.sparkContext._frontwave_rounds = "file://" + tempfile.mkdtemp(prefix="frontwave-rounds-")
    return made


def cut(df: DataFrame, observed: dict[str, Column] | None = None) -> tuple[DataFrame, dict]:
    """The same rows from a written table, and the aggregates ``observed`` on the way (null over no rows)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rounds/{uuid.uuid4().hex}"
    seen = None
    if observed:
        seen = Observation()
        df = df.observe(seen, *[c.alias(n) for n, c in observed.items()])
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._frontwave_path = path
    return back, (seen.get if seen else {})


def drop(df: DataFrame) -> None:
    """Delete a written round that nothing reads any more, so that the disk holds the last ones only."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._frontwave_path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fixpoint(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], observed: dict[str, Column], stop: Callable[[dict, int], bool], most: int, stats: RunStats | None = None) -> tuple[DataFrame, int, bool]:
    """Apply ``step`` until ``stop`` of the observed aggregates, or ``most`` rounds: the state, the number of rounds, whether it stopped by itself."""
    state, _ = cut(state)
    for done in range(1, most + 1):
        following, seen = cut(step(state, done), observed)
        drop(state)
        state = following
        if stop(seen, done):
            return state, done, True
    return state, most, False
