"""Readers of files share their work among tasks and hand it back in bounded batches."""

from pyspark.sql import functions as F

from quillgraph.detector_queries import DECLARED, LOCKS, SPECS, _files
from quillgraph.sources import lockfiles as L
from quillgraph.sources import manifests as M

SF = "/root/testdata/sf0.001"


def tasks(df):
    """How many tasks have rows in their results."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_files_of_all_formats_are_read_by_all_tasks(spark):
    for reader, formats in ((M, LOCKS), (M, DECLARED), (L, SPECS)):
        assert tasks(reader.detect(_files(spark, SF, formats))) > 4


def test_one_file_comes_back_in_batches():
    rows = ((f"n{k}", k, 2 * k) for k in range(2 * L.ROWS + 5))
    got = list(L.batches(rows, "name string, version string, tier int"))
    assert [b.num_rows for b in got] == [L.ROWS, L.ROWS, 5]
    assert got[2].to_pylist()[-1] == {"name": f"n{2 * L.ROWS + 4}", "version": f"{2 * L.ROWS + 4}", "tier": 4 * L.ROWS + 8}


def test_chosen_grammars_are_those_that_fit():
    patterns = [g[1] for g in M.GRAMMARS]
    chosen = M.chooser(patterns)
    for path in [f"/srv/x/{p.replace('*', r)}" for p in patterns for r in ("a", "a/b", "")] + ["", "/", "a.b", "x/METADATA"]:
        assert chosen(path) == [k for k, p in enumerate(patterns) if M.fits(p, path)]
