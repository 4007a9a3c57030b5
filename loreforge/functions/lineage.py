"""Cutting lineage in loops: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

#: Rounds of a fixpoint that are kept apart; so many are then written as one.
ROUNDS = 16


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session. A folder of this machine stands in for it on a local master only, as in tests."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loreforge-')}"
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table written in the shared folder: computed once (a checkpoint would compute them twice), with no lineage
    behind it, and whole whatever executor is lost."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fixpoint(start: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], most: int | None = None) -> DataFrame:
    """The start and all that `step` leads to, each key once, as of the round that met it first; `most` bounds the rounds.

    A round writes its own rows only, and is held against all rounds before it.
    """
    rounds = [cut(start)]
    frontier, n = rounds[0], 0
    while (most is None or n < most) and not frontier.isEmpty():
        seen = reduce(DataFrame.unionByName, [r.select(*keys) for r in rounds])
        frontier = cut(step(frontier).join(seen, keys, "left_anti"))
        rounds.append(frontier)
        n += 1
        if len(rounds) > ROUNDS:
            rounds = [cut(reduce(DataFrame.unionByName, rounds))]
    return reduce(DataFrame.unionByName, rounds)
