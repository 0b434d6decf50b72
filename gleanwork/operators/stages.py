"""A sequence of stages, each reading what the one before wrote, that stops at the first failure and goes on from there.

A stage's output is a Parquet table in the run's folder; the mark that Spark's committer leaves when all of a table is written
says that the stage is done. A run that is started again reads the tables of stages that are done and begins with the
first that isn't, whose unfinished output it replaces.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[SparkSession, DataFrame], DataFrame]
DONE = "_SUCCESS"


class StageFailed(RuntimeError):
    """A stage that ended in an error: its name, and the states of all stages."""

    def __init__(self, name: str, states: list[tuple[str, str, str | None]]) -> None:
        super().__init__(f"stage {name} failed: {dict((n, e) for n, _, e in states)[name]}")
        self.name, self.states = name, states


@dataclass(frozen=True)
class Run:
    """``result``: the last stage's table. ``states``: (stage, done, read or run) in order."""

    result: DataFrame
    states: list[tuple[str, str, str | None]]


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def run_stages(spark: SparkSession, folder: str, first: DataFrame, stages: list[tuple[str, Stage]], rerun_from: str | None = None) -> Run:
    """Run ``stages`` (name, function) one after the other on ``first``, in ``folder``.

    ``rerun_from``: this stage and all after it run again, whatever is done. A stage after one that ran is
    never read from an earlier run, since its input is new.
    """
    names = [name for name, _ in stages]
    if len(set(names)) < len(names) or any(not n or "/" in n or n.startswith(("_", ".")) for n in names):
        raise ValueError(f"stages need different names that can be folders: {names}")
    if rerun_from is not None and rerun_from not in names:
        raise ValueError(f"no stage is named {rerun_from}")
    table, states, fresh = first, [], False
    for i, (name, stage) in enumerate(stages):
        path = f"{folder}/{i:02d}-{name}"
        fresh = fresh or name == rerun_from or not exists(spark, f"{path}/{DONE}")
        if fresh:
            try:
                stage(spark, table).write.mode("overwrite").parquet(path)
            except Exception as e:
                states.append((name, "failed", f"{type(e).__name__}: {e}"[:2000]))
                raise StageFailed(name, [*states, *((n, "waiting", None) for n in names[i + 1 :])]) from e
        states.append((name, "run" if fresh else "read", None))
        table = spark.read.parquet(path)
    return Run(table, states)


def states_of(spark: SparkSession, states: list[tuple[str, str, str | None]]) -> DataFrame:
    """The states as rows: place, stage, state, error."""
    return spark.createDataFrame([(i, *s) for i, s in enumerate(states)], "place int, stage string, state string, error string")
