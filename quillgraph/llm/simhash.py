"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint's bits are taken in segments of two; the bit counts of the segments are
its coordinates. Two fingerprints differ in at least as many bits as the Manhattan
distance of their coordinates. Of 3 differing bits at most 1 lies in one of the two
32-bit halves, so linked fingerprints have, in one half, coordinates that are equal or
one unit step apart. The grid join looks up just these cells (about 26 rows for each
distinct fingerprint) and every candidate is verified by its exact bit distance.

Equal fingerprints are one node. Within a cell only a spanning forest of the verified
links leaves the task, so a group of n near copies costs n rows, not n squared. A cell of
more than HOT rows is split into blocks, any two of which meet in a group of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.arrays import LOWER, run_starts, text_slices
from quillgraph.llm.columns import rows_of
from quillgraph.operators.components import connected_components
from quillgraph.scratch import materialize

#: Groups up to this size are compared by shifted vectors, larger ones in blocks.
SMALL = 24
BLOCK = 2048
#: Rows of a cell that one task compares; of more rows, about half as many are a block.
HOT = 1 << 14
#: Shingles whose bits are unpacked at once.
STRIDE = 1 << 15


def fingerprint(text: bytes, words: int = 3) -> int:
    """64-bit SimHash of the word shingles; no word: 0; fewer words than ``words``: one shingle of all."""
    found = text.translate(LOWER).split()
    if not found:
        return 0
    shingles = [b" ".join(found)] if len(found) < words else list(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))
    digest = xxhash.xxh64_digest
    return bits_of(np.frombuffer(b"".join([digest(s, 42) for s in shingles]), np.uint8).reshape(-1, 8))


def bits_of(hashes: np.ndarray) -> int:
    """The bits set in over half of some hashes (rows of eight bytes, big end first)."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STRIDE):
        counts += np.unpackbits(hashes[at : at + STRIDE], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for each document; fp is the signed form of the 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in text_slices(batch.column(1))], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def segment_counts(fps: np.ndarray) -> np.ndarray:
    """The bit counts of a fingerprint's 32 segments of two bits; two rows' Manhattan distance is at most their fingerprints' distance."""
    bits = np.unpackbits(fps.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return (bits[:, 0::2] + bits[:, 1::2]).astype(np.int8)


def _cells(distinct: DataFrame) -> DataFrame:
    """Grid rows (cell, fp, probe): each half's own cell, and the cells one step up for probes."""
    high, low = F.shiftrightunsigned("fp", 32), F.expr("fp & 4294967295L")
    counts = lambda x: x - F.shiftright(x, 1).bitwiseAND(F.lit(0x55555555).cast("long"))  # noqa: E731  bit counts of all pairs of bits
    rows = distinct.select("fp", F.posexplode(F.array(counts(high), counts(low))).alias("half", "own"))
    steps = F.filter(F.expr("transform(sequence(0, 15), i -> if((shiftright(own, 2 * i) & 3L) < 2L, own + shiftleft(1L, 2 * i), null))"), lambda c: c.isNotNull())
    up = rows.select("fp", "half", F.explode(F.concat(F.array(F.struct(F.col("own").alias("cell"), F.lit(False).alias("probe"))), F.transform(steps, lambda c: F.struct(c.alias("cell"), F.lit(True).alias("probe"))))).alias("x"))
    return up.select((F.shiftleft(F.col("half").cast("long"), 32) + F.col("x.cell")).alias("cell"), "fp", F.col("x.probe").alias("probe"))


def _forest(fps: np.ndarray, probe: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (member, root) of the verified links of one large group, in blocks."""
    label = np.arange(len(fps))
    own = np.flatnonzero(~probe)
    changed = True
    while changed:
        changed = False
        for a in range(0, len(own), BLOCK):
            rows = own[a : a + BLOCK]
            for b in range(0, len(fps), BLOCK):
                near = np.bitwise_count(fps[rows, None] ^ fps[None, b : b + BLOCK]) <= reach
                lab_b = label[b : b + BLOCK]
                best = np.where(near, lab_b[None, :], len(fps)).min(1)
                best = np.minimum(best, label[rows])
                back = np.minimum(np.where(near, best[:, None], len(fps)).min(0), lab_b)
                if (best < label[rows]).any() or (back < lab_b).any():
                    changed = True
                label[rows] = np.minimum(label[rows], best)
                label[b : b + BLOCK] = np.minimum(label[b : b + BLOCK], back)
        label = label[label]
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _links(cell: np.ndarray, fps: np.ndarray, probe: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within the groups of equal cells of sorted rows."""
    starts = run_starts(cell)
    sizes = np.diff(np.append(starts, len(cell)))
    big = sizes > SMALL
    of_big = np.repeat(big, sizes)
    left, right = [], []
    for s in range(1, int(min(SMALL, sizes.max(initial=1)))):
        at = np.flatnonzero((cell[s:] == cell[:-s]) & ~of_big[s:] & ~(probe[s:] & probe[:-s]))
        at = at[np.bitwise_count(fps[at] ^ fps[at + s]) <= reach]
        left.append(fps[at])
        right.append(fps[at + s])
    for k in np.flatnonzero(big):
        part = slice(starts[k], starts[k] + sizes[k])
        a, b = _forest(fps[part], probe[part], reach)
        left.append(a)
        right.append(b)
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def fingerprint_links(distinct: DataFrame, reach: int = 3) -> DataFrame:
    """(src, dst): links of at most ``reach`` (0 to 3) differing bits, enough of them to keep every component whole."""
    if not 0 <= reach <= 3:
        raise ValueError("the grid covers up to 3 differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool)]
        last = False
        stream = iter(batches)
        while not last:
            batch = next(stream, None)
            last = batch is None
            if batch is not None:
                if not batch.num_rows:
                    continue
                new = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)]
                held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            end = len(held[0]) if last else int(np.searchsorted(held[0], held[0][-1]))
            if not end:
                continue
            a, b = _links(*(x[:end] for x in held), reach)
            held = [x[end:] for x in held]
            if len(a):
                yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["src", "dst"])

    cells = _split(_cells(distinct.select("fp"))).repartition("cell").sortWithinPartitions("cell")
    return cells.mapInArrow(run, "src long, dst long")


def _split(cells: DataFrame) -> DataFrame:
    """The rows of cells, those of a cell of more than HOT rows dealt to the groups of its blocks' pairs."""
    hot = materialize(cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(F.col("cell").alias("of"), F.ceil(2 * F.col("n") / HOT).alias("blocks")), "simhash-hot")
    if hot.isEmpty():
        return cells
    dealt = cells.join(hot, F.col("cell") == F.col("of"), "left").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(4)), "blocks"))
    others = F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.col("own"))
    each = dealt.where("blocks is not null").select("cell", "fp", "probe", "own", F.explode(others).alias("other"))
    groups = each.select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp", "probe")
    return dealt.where("blocks is null").select("cell", "fp", "probe").unionByName(groups)


def near_duplicates(docs: DataFrame, words: int = 3, reach: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text); other columns are not read.

    component_id is the smallest doc_id reachable over links of at most ``reach`` bits.
    Null and empty texts have fingerprint 0 and link like any other. Repeated rows are
    kept. An empty table gives an empty one. A row whose doc_id is null stays, with the
    component of its text.
    """
    prints = materialize(fingerprints(docs, words), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    parts = connected_components(materialize(fingerprint_links(distinct, reach), "simhash-links"))
    whole = distinct.join(parts, distinct.fp == parts.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    named = whole.join(whole.groupBy("part").agg(F.min("least").alias("component_id")), "part").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, words: int = 3, reach: int = 3) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group; rows without doc_id stay if no row of the group has one."""
    return rows_of(docs, near_duplicates(docs, words, reach).where("doc_id <=> component_id").select("doc_id"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and component; nulls, repeats and empty tables as in ``near_duplicates``."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
