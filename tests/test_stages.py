"""Stage sequences: completion marks, the stop at the first failure, and where a run goes on."""

import os

import pytest
from pyspark.sql import functions as F

from gleanwork.operators.stages import StageFailed, run_stages, states_of


def sequence(calls, broken=()):
    def stage(name, add):
        def run(spark, rows):
            calls.append(name)
            out = rows.withColumn("n", F.col("n") + add)
            return out.withColumn("n", F.raise_error(F.lit("broken")).cast("long")) if name in broken else out

        return name, run

    return [stage("collect", 1), stage("score", 10), stage("write", 100), stage("publish", 1000)]


def test_a_failing_stage_reruns_without_those_before(spark, tmp_path):
    folder, first, calls = f"file://{tmp_path}/run", spark.range(3).withColumnRenamed("id", "n"), []
    with pytest.raises(StageFailed, match="write failed.*broken") as failed:
        run_stages(spark, folder, first, sequence(calls, broken={"write"}))
    assert calls == ["collect", "score", "write"] and failed.value.name == "write"
    assert [(n, s) for n, s, _ in failed.value.states] == [("collect", "run"), ("score", "run"), ("write", "failed"), ("publish", "waiting")]
    assert not os.path.exists(f"{tmp_path}/run/02-write/_SUCCESS")
    calls.clear()
    done = run_stages(spark, folder, first, sequence(calls))
    assert calls == ["write", "publish"] and sorted(r["n"] for r in done.result.collect()) == [1111, 1112, 1113]
    assert [(r["stage"], r["state"]) for r in states_of(spark, done.states).orderBy("place").collect()] == [("collect", "read"), ("score", "read"), ("write", "run"), ("publish", "run")]
    calls.clear()
    assert sorted(r["n"] for r in run_stages(spark, folder, first, sequence(calls)).result.collect()) == [1111, 1112, 1113] and calls == []


def test_a_stage_run_again_renews_those_after(spark, tmp_path):
    folder, calls = f"file://{tmp_path}/run", []
    run_stages(spark, folder, spark.range(1).withColumnRenamed("id", "n"), sequence(calls))
    calls.clear()
    other = sequence(calls)
    other[1] = ("score", lambda spark, rows: rows.withColumn("n", F.col("n") + 20))
    assert [r["n"] for r in run_stages(spark, folder, spark.range(1).withColumnRenamed("id", "n"), other, rerun_from="score").result.collect()] == [1121]
    assert calls == ["write", "publish"]
    os.remove(f"{tmp_path}/run/01-score/_SUCCESS")  # as after a crash while it was written
    calls.clear()
    assert [s for _, s, _ in run_stages(spark, folder, spark.range(1).withColumnRenamed("id", "n"), sequence(calls)).states] == ["read", "run", "run", "run"]
    for bad in ([("a", None), ("a", None)], [("", None)], [("a/b", None)], [("_a", None)]):
        with pytest.raises(ValueError, match="different names"):
            run_stages(spark, folder, spark.range(1), bad)
    with pytest.raises(ValueError, match="no stage is named"):
        run_stages(spark, folder, spark.range(1), sequence([]), rerun_from="nothing")


def test_no_stages(spark, tmp_path):
    assert run_stages(spark, f"file://{tmp_path}/run", spark.range(2), []).result.count() == 2
