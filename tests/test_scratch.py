"""Tables in the shared folder: written, noted, removed; an error where a cluster names none."""

import os

import pytest

from quillgraph import scratch


def test_noted(spark):
    with scratch.noted() as held:
        a = scratch.materialize(spark.range(3), "a")
        b = scratch.materialize(a.where("id > 0"), "b")
    c = scratch.materialize(spark.range(1), "c")
    assert held == [a, b] and b.count() == 2
    there = lambda df: os.path.exists(df._scratch_path.removeprefix("file://"))
    scratch.discard(a, spark.range(1))
    assert (there(a), there(b), there(c)) == (False, True, True)


class Nothing:
    def get(self, key, default=None):
        return default


class Cluster:
    conf = Nothing()

    class sparkContext:
        master = "spark://host:7077"
        getConf = staticmethod(Nothing)


def test_cluster_without_folder(monkeypatch):
    monkeypatch.setattr(scratch, "_local_dir", None)
    with pytest.raises(RuntimeError):
        scratch.scratch_dir(Cluster())
