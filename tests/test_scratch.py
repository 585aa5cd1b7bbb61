"""Scratch tables: where they may lie, and that they go."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from aerogrid import scratch


def session(master, folder=None):
    return SimpleNamespace(sparkContext=SimpleNamespace(getCheckpointDir=lambda: folder, master=master), conf=SimpleNamespace(get=lambda *_: None))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(ValueError, match="checkpoint"):
            scratch.shared_folder(session(master))
        assert scratch.shared_folder(session(master, "hdfs://here")) == "hdfs://here"


def test_tables_are_read_back_and_deleted(spark):
    df = spark.range(10).withColumn("x", F.rand())
    kept = scratch.cut(df)
    assert kept.collect() == kept.collect() and kept.count() == 10
    path = kept.scratch_table.removeprefix("file:")
    assert os.path.isdir(path)
    scratch.discard(kept, df)
    assert not os.path.exists(path)


def test_only_what_is_small_is_broadcast(spark, monkeypatch):
    plan = lambda df: spark.range(5).join(scratch.small(df), "id")._jdf.queryExecution().toString()
    df = spark.range(100)
    assert "strategy=broadcast" in plan(df)
    monkeypatch.setattr(scratch, "BROADCAST_BYTES", 100 * 32 - 1)
    assert "strategy=broadcast" not in plan(df)
    assert scratch.small(spark.range(0)).count() == 0
