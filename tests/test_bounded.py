"""What grows with the tables stays off the driver and out of single tasks."""

import pytest
from pyspark.sql import functions as F

from quillgraph import detector_queries, lookup_queries, store_queries
from quillgraph import queries as core
from quillgraph.operators import graph as G
from quillgraph.operators import matching as M
from quillgraph.sources import ignores, poms

SF = "/root/testdata/sf0.001"


def plan(df):
    """The physical plan before it adapts, and after it has run."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_constants_across_slices_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(M, "SLICE", 16)
    monkeypatch.setattr(M, "BLOCK", 20)
    words = ["abcdefg", "bcdefgh", "cdefgh", "xyzxyzxyz", "überflüssig", "short", "nowhere"]
    filler = "-" * 9
    blobs = spark.createDataFrame([(1, filler + "abcdefgh" + filler), (2, filler * 3 + "xyzxyzxyz"), (3, "abcdef"), (4, None), (5, ""), (6, "\U0001f600" * 13 + "überflüssig")], "subject int, text string")
    constants = spark.createDataFrame([("a", w, 0.5) for w in words] + [("b", "cdefgh", 0.25)], "library string, value string, precision double")
    got = {(r.subject, r.library): (r.hits, r.confidence) for r in M.constant_hits(blobs, constants).collect()}
    assert got == {(1, "a"): (3, 0.85), (1, "b"): (1, 0.25), (2, "a"): (1, 0.5), (6, "a"): (1, 0.5)}


def test_paths_are_not_broadcast(spark):
    files = spark.range(1000).selectExpr("concat('a', id % 3, '/f', id, '.', if(id % 2 = 0, 'log', 'txt')) as path")
    rules = spark.createDataFrame([("", 0, r"^(?:.*/)?[^/]*\.log/?$", False)], ignores.RULES)
    assert "BroadcastHashJoin" not in plan(ignores.unignored(files, rules))


@pytest.mark.parametrize(("module", "query"), [(G, core.paths_to_roots), (G, lookup_queries.range_resolution), (poms, detector_queries.effective_poms)])
def test_steps_are_not_broadcast(spark, monkeypatch, module, query):
    plans, write = [], module.materialize

    def noting(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, tag)

    monkeypatch.setattr(module, "materialize", noting)
    plans.append(query(spark, SF)._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans)
    assert not [p for p in plans if "BroadcastHashJoin" in p]


@pytest.mark.parametrize("query", [detector_queries.manifest_relations, store_queries.canonical_purls])
def test_rows_are_worked_on_by_all_tasks(spark, query):
    assert query(spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() > 4


def test_votes_are_dealt_by_their_pairs(spark, monkeypatch):
    monkeypatch.setattr(M, "PAIRS", 10)
    found = spark.createDataFrame([(s, m) for s in (1, 2, None) for m in range(6)] + [(3, 0), (3, 0)], "subject int, mark int")
    signatures = spark.createDataFrame([(lib, m) for lib in "abcd" for m in range(8)] + [("e", 1), (None, 1)], "library string, mark int")
    hits = M.votes(found, signatures, least=2)
    assert hits.rdd.getNumPartitions() == 8  # 3 subjects, 6 marks, 4 libraries: 72 pairs
    assert sorted(map(tuple, hits.collect()), key=repr) == sorted(((s, lib, 6, 0.75) for s in (1, 2, None) for lib in "abcd"), key=repr)


def test_directories_of_equal_position(spark):
    needed = spark.createDataFrame([("b", "l")], "binary string, soname string")
    directories = spark.createDataFrame([("b", d, 1) for d in ("z", "y", "x", "a")], "binary string, dir string, position int").repartition(4, "dir")
    files = spark.createDataFrame([(d, "l", o) for d in ("z", "y", "x") for o in ("q", "p")], "dir string, soname string, owner string")
    assert [tuple(r) for r in M.resolved_links(needed, directories, files).collect()] == [("b", "l", "x/l", "p")]
