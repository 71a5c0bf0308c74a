"""SimHash near-duplicates at a similarity of shingle sets, for stages that keep one document of each group.

The steps are those of ``simhash`` with more segments and a wider reach. Sets of similarity
0.8 differ in 15 to 19 % of the bits of their fingerprints, too many for 64 bits to tell them
from sets with nothing in common; so a print has PRINTS times 64 bits, whose first 64 are
``simhash``'s. The bit counts of its segments of two are its coordinates, kept in unary: the
Manhattan distance of two prints' counts is the bit distance of their codes. Pairs whose
counts are within ``reach`` are candidates, verified by the bits and then by the sets.

A grid over prints so far apart leaves nearly all pairs to be compared (``print_links`` does,
by size classes). So the grid is that of portions: a set's shingles are dealt to portions by
a hash, about as many portions for sets of one scale (a power of two of their sizes), each
portion has a fingerprint, and its segment counts are a cell. Similar sets have portions
without a shingle that only one of them has, whose counts are equal; enough portions are
taken that none is with a chance under MISS (``portions`` has the arithmetic). A set has
some dozens of cells however large the table, and only sets that share a cell are compared.

Sets whose prints are linked are verified by the exact sets. Documents of equal sets are one
node. Cells of over GRID_ROWS nodes, and groups of linked ones of many, are split into blocks,
any two of which meet in one group, so no task holds more than two blocks; of a large group's
links only a spanning forest leaves the task. Sets travel only for nodes in a cell, made anew from the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import acos, ceil, comb, exp, log, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.arrays import LOWER, mix64, packed_keys, run_starts, text_slices, unpacked_keys
from quillgraph.llm.columns import rows_of
from quillgraph.llm.simhash import SMALL, bits_of, segment_counts
from quillgraph.operators.components import connected_components
from quillgraph.scratch import discard, free_shuffles, materialize, shuffle_partitions

WORDS = 5
SIMILARITY = 0.8
#: Words of 64 bits of a print, and the chance that the prints of two similar sets are out of reach, or that no portion has them meet.
PRINTS = 4
MISS = 1e-7
#: Portions of sets from SINGLE shingles on, at least; of smaller sets, each shingle is a portion.
PORTIONS, SINGLE = 64, 16
#: Prints of a block of a cell or size class; of many more, it has SPREAD blocks, and more again where they would exceed MOST.
GRID_ROWS, SPREAD, MOST = 8192, 32, 1 << 18
#: Texts whose sets are held at once.
TEXTS = 512
#: Rows and columns compared at once, and links kept before they are joined.
TILE = 64, 4096
PENDING = 1 << 18
#: Nodes of a block of a cell, and their shingles, about.
BLOCK_NODES = 1024
BLOCK_SHINGLES = 1 << 19
#: Fingerprints of sets of LARGE shingles or more that differ in more bits than FAR aren't verified: at similarity 0.8 (9.7 bits, deviation 2.9) that has a chance under 1e-9.
LARGE, FAR = 64, 28
#: Numbers of a dense matrix.
CELLS = 1 << 23

_SALT = np.random.default_rng(11).integers(0, 1 << 63, PRINTS - 1, np.uint64)
_PORTION = np.uint64(0x9E3779B97F4A7C15)
_ODD_BITS = np.uint64(0x5555555555555555)


def shingle_set(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the word shingles; no word: none; fewer words than ``words``: one shingle of all."""
    found = text.translate(LOWER).split()
    if not found:
        return np.empty(0, np.uint64)
    shingles = {b" ".join(found)} if len(found) < words else set(map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)))
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(s, 42) for s in shingles]), ">u8").astype(np.uint64))


def node_of(shingles: np.ndarray) -> int:
    """A hash of the set, as a signed number."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 7)).astype(np.int64))


def prints_of(shingles: np.ndarray) -> list[int]:
    """The SimHash fingerprints of a set under PRINTS hashes of its shingles, the first ``simhash``'s."""
    return [bits_of(x.astype(">u8").view(np.uint8).reshape(-1, 8)) for x in (shingles, *(mix64(shingles ^ k) for k in _SALT))]


def unary(prints: np.ndarray) -> np.ndarray:
    """The counts of segments of two bits, each in unary: codes differ in as many bits as the counts' Manhattan distance."""
    high = prints >> np.uint64(1)
    return ((prints | high) & _ODD_BITS) | ((prints & high & _ODD_BITS) << np.uint64(1))


def _above(n: int) -> np.ndarray:
    """The chance that over 0, 1, … n of n fair bits are set."""
    return 1 - np.cumsum([comb(n, k) / 2**n for k in range(n + 1)])


def _chance(only_a: int, only_b: int, common: int) -> float:
    """The chance that a bit of the fingerprints differs, for sets with so many shingles apart and in common."""
    shared = np.arange(common + 1)
    a, b = (np.where(need < 0, 1.0, _above(n)[np.clip(need, 0, n)]) for n in (only_a, only_b) for need in [(common + n) // 2 - shared])
    return float(np.array([comb(common, k) / 2**common for k in shared.tolist()]) @ (a * (1 - b) + b * (1 - a)))


@cache
def reach(similarity: float, least: int) -> int:
    """Differing bits that prints of sets of ``least`` shingles or more and this similarity exceed with a chance under MISS.

    A bit differs with the chance of the angle between large sets, more often for small
    ones, where votes are close; the dearest way to part a few dozen sizes is taken.
    """
    chance = acos(2 * similarity / (1 + similarity)) / pi
    start = max(1, ceil(least * similarity))
    for common in range(start, start + 32):
        apart = int(common * (1 / similarity - 1) + 1e-9)
        for n in range(max(1, apart - 2), apart + 1):
            chance = max([chance, *(_chance(k, n - k, common) for k in range(n // 2 + 1) if common + k >= least)])
    bits = 64 * PRINTS
    over = 1 - np.cumsum([comb(bits, k) * chance**k * (1 - chance) ** (bits - k) for k in range(bits + 1)])
    return int(np.flatnonzero(over <= MISS)[0])


@cache
def portions(scale: int, similarity: float) -> tuple[int, int]:
    """How many portions sets of 2 ** scale shingles or more have, and how many of them are used; 0: each shingle is one.

    With m shingles of either set to a portion, it is equal and not empty with a chance of
    exp(-(1 - similarity) * m) * (1 - exp(-similarity * m)), m being from ``each`` to twice
    that over the similarity; the worst m decides how many are used. Of few portions all
    are: fewer than all hold a shingle apart, and all shingles in common would have to be
    in those (for 16 shingles of similarity 0.5 or more a chance of 8 ** -8 at most).
    """
    each = 1 << max(0, int(0.5 / max(1 - similarity, 0.01)).bit_length() - 1)
    worst = min(exp(-(1 - similarity) * m) * (1 - exp(-similarity * m)) for m in np.linspace(each, 2 * each / similarity, 64).tolist())
    used = ceil(log(MISS) / log(1 - worst))
    if 1 << scale >= each * max(PORTIONS, used):
        return (1 << scale) // each, used
    return (PORTIONS, PORTIONS) if 1 << scale >= SINGLE and similarity >= 0.5 else (0, 0)


def portion_cells(shingles: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """The cells of a set: segment counts of its portions' fingerprints, for each scale that a similar set of its size or less may have.

    Sets too small for a different one to be similar have none.
    """
    size = len(shingles)
    if size * (1 - similarity) < similarity - 1e-9:
        return np.empty(0, np.int64)
    dealt = mix64(shingles ^ _PORTION)
    out = []
    for scale in range(max(1, ceil(similarity * size - 1e-9)).bit_length() - 1, size.bit_length()):
        n, used = portions(scale, similarity)
        if n:
            portion = dealt & np.uint64(n - 1)
            at = np.flatnonzero(portion < used)
            at = at[np.argsort(portion[at], kind="stable")]
            portion = portion[at]
            starts = run_starts(portion)
            if not len(starts):
                continue
            counts = np.add.reduceat(np.unpackbits(shingles[at].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), starts, axis=0, dtype=np.int64)
            members = np.diff(np.append(starts, len(at)))
            prints = np.packbits(2 * counts > members[:, None], axis=1).view(">u8").ravel().astype(np.uint64)
            of = portion[starts]
        else:
            prints, of = shingles, np.zeros(size, np.uint64)
        out.append(mix64(unary(prints) ^ mix64(of + np.uint64(scale << 32) + np.uint64(1))))
    return np.unique(np.concatenate(out)).view(np.int64) if out else np.empty(0, np.int64)


def _described(docs: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, node, size, fp0, fp1, …, cells)."""
    names = [f"fp{k}" for k in range(PRINTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):  # sets of so many texts are held at once
                batch = whole.slice(at, TEXTS)
                sets = [shingle_set(t) for t in text_slices(batch.column(1))]
                prints = np.array([prints_of(s) for s in sets], np.uint64).reshape(-1, PRINTS).view(np.int64)
                columns = [pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *(pa.array(np.ascontiguousarray(x)) for x in prints.T)]
                columns.append(pa.array([portion_cells(s, similarity) for s in sets], pa.list_(pa.int64())))
                yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "node", "size", *names, "cells"])

    schema = ", ".join(f"{x} long" for x in ["doc_id", "node", "size", *names]) + ", cells array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _sets(texts: DataFrame) -> DataFrame:
    """(node, shingles) of each text, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in text_slices(batch.column(0))]
            yield pa.record_batch([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([packed_keys(s) for s in sets], pa.binary())], names=["node", "shingles"])

    return texts.mapInArrow(run, "node long, shingles binary")


def similar(sets: list[np.ndarray], fps: np.ndarray, similarity: float) -> np.ndarray:
    """The pairs (i, j), i < j, of sets at least so similar."""
    sizes = np.array([len(s) for s in sets])
    counts = segment_counts(fps)
    out = []
    for a in range(0, len(sets), 256):  # rows of the triangle at a time
        part = slice(a, a + 256)
        near = np.minimum(sizes[part, None], sizes[None]) >= similarity * np.maximum(sizes[part, None], sizes[None])
        near &= np.arange(len(sets))[None] > np.arange(len(sets))[part, None]
        bound = near & (np.minimum(sizes[part, None], sizes[None]) >= LARGE)
        i, j = np.nonzero(bound)
        for b in range(0, len(i), 1 << 18):
            x, y = i[b : b + (1 << 18)] + a, j[b : b + (1 << 18)]
            far = np.abs(counts[x] - counts[y]).sum(1) > FAR
            far |= np.bitwise_count(fps[x] ^ fps[y]) > FAR
            near[x[far] - a, y[far]] = False
        i, j = np.nonzero(near)
        out.append(np.stack((i + a, j)))
    i, j = np.concatenate(out, axis=1)
    both = _shared_few(sets, i, j) if len(i) <= 4 * len(sets) else _shared_many(sets)[i, j]
    good = both >= similarity * (sizes[i] + sizes[j] - both)
    return np.stack((i[good], j[good]))


def _shared_few(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(i.tolist(), j.tolist(), strict=True)], np.int64)


def _shared_many(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles any two sets share: products of dense stretches of the incidence matrix."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = n[column] > 1
    row, column = row[some], (np.cumsum(n > 1) - 1)[column[some]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    step = max(1, CELLS // len(sets))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, (at, at + step))
        dense = np.zeros((len(sets), step), np.float32)
        dense[row[a:b], column[a:b] - at] = 1
        out += dense @ dense.T
    return out


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for each of n members that links (i, j) join to one of smaller number."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each group, from batches sorted by their column group."""
    held: pa.Table | None = None
    stream = iter(batches)
    last = False
    while not last:
        batch = next(stream, None)
        last = batch is None
        if batch is not None:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
        if held is None or not held.num_rows:
            continue
        group = held.column("group").to_numpy()
        end = len(group) if last else int(np.searchsorted(group, group[-1]))
        if not end:  # all of one group, which may go on
            continue
        starts = run_starts(group[:end])
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), end], strict=True):
            if b - a > 1:
                yield held.slice(a, b - a)
        held = held.slice(end)


def _edges(nodes: np.ndarray, moved: np.ndarray, root: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(moved):
        yield pa.record_batch([pa.array(nodes[moved]), pa.array(nodes[root])], names=["src", "dst"])


def _links(groups: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): a spanning forest of the links within each group; ``groups`` has group, node, fp, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches):
            nodes = part.column("node").to_numpy()
            sets = [unpacked_keys(x) for x in part.column("shingles").to_pylist()]
            i, j = similar(sets, part.column("fp").to_numpy().view(np.uint64), similarity)
            yield from _edges(nodes, *forest(len(nodes), i, j))

    return groups.repartition("group").sortWithinPartitions("group").mapInArrow(run, "src long, dst long")


def near_prints(prints: np.ndarray, sizes: np.ndarray, rectangles: list[tuple[np.ndarray, np.ndarray]], far: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, root): a forest of the links of at most ``far`` bits, of sets whose sizes allow the similarity, between the rows and columns of rectangles."""
    codes = unary(prints)
    weight = np.bitwise_count(codes).sum(1, dtype=np.int64)
    label = np.arange(len(prints))
    left, right = [label[:0]], [label[:0]]
    waiting = 0
    scratch, bits, total = np.empty(TILE, np.uint64), np.empty(TILE, np.uint8), np.empty(TILE, np.uint16)

    def settle() -> None:
        moved = np.flatnonzero(label != np.arange(len(label)))
        member, root = forest(len(label), np.concatenate([moved, *left]), np.concatenate([label[moved], *right]))
        label[member] = root
        left[1:], right[1:] = [], []

    for rows, columns in rectangles:
        square = rows is columns
        rows, columns = (x[np.argsort(weight[x], kind="stable")] for x in (rows, columns))
        across = np.ascontiguousarray(codes[columns].T)
        weights = weight[columns]
        for a in range(0, len(rows), TILE[0]):
            some = rows[a : a + TILE[0]]
            first, end = np.searchsorted(weights, (weight[some[0]] - far, weight[some[-1]] + far + 1)).tolist()  # total counts within reach
            for b in range(a if square else first, end, TILE[1]):
                shape = len(some), min(TILE[1], end - b)
                x, n, sum_ = (y.reshape(-1)[: shape[0] * shape[1]].reshape(shape) for y in (scratch, bits, total))
                for k in range(PRINTS):
                    np.bitwise_xor(codes[some, k, None], across[k, b : b + shape[1]], out=x)
                    np.bitwise_count(x, out=n)
                    np.add(sum_, n, out=sum_) if k else np.copyto(sum_, n)
                i, j = np.nonzero(sum_ <= far)
                i, j = some[i], columns[b + j]
                new = label[i] != label[j]
                i, j = i[new], j[new]
                good = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j])
                good &= np.bitwise_count(prints[i] ^ prints[j]).sum(1, dtype=np.int64) <= far
                if good.any():
                    left.append(i[good])
                    right.append(j[good])
                    waiting += len(left[-1])
                    if waiting > PENDING:
                        settle()
                        waiting = 0
    settle()
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


def print_links(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(src, dst): links of any nodes (node, size, fp0, …) whose prints are within reach, enough of them to keep every component whole.

    This compares all pairs of a size class, for small tables and to test ``cell_links`` by.
    A node is in the cell of its size class, and in that of the class below for its members
    to be compared with. Sets too small for a different one to be similar have no link.
    """
    names = [f"fp{k}" for k in range(PRINTS)]
    width = -log(similarity) * 1.001 + 1e-9  # a little more than the ratio, so that rounding parts none
    own = nodes.where(F.col("size") * (1 - similarity) >= similarity - 1e-9).withColumn("class", F.floor(F.log("size") / width))
    rows = own.select("node", "size", *names, F.explode(F.array(F.struct(F.col("class").alias("cell"), F.lit(False).alias("above")), F.struct((F.col("class") - 1).alias("cell"), F.lit(True).alias("above")))).alias("x")).select("node", "size", *names, "x.*")
    return _meetings(rows, similarity)


def _reaches(similarity: float) -> tuple[int, int]:
    """Reach for pairs with a set of under LARGE shingles, and for others."""
    least = ceil(similarity / (1 - similarity) - 1e-9) if similarity < 1 else 1
    return reach(similarity, least), reach(similarity, max(least, LARGE))


def _meetings(rows: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): links within cells; ``rows`` has cell, above (not to be compared with each other), node, size, fp0, …"""
    names = [f"fp{k}" for k in range(PRINTS)]
    counted = rows.groupBy("cell").agg(F.count("*").alias("n"), F.count_if(~F.col("above")).alias("own_n")).where("own_n > 0")
    blocks = F.greatest(F.least(F.ceil(F.col("n") / GRID_ROWS), F.lit(SPREAD)), F.ceil(F.col("n") / MOST))
    rows = rows.join(F.broadcast(counted.select(F.col("cell").alias("of"), blocks.alias("blocks"))), F.col("cell") == F.col("of")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(6)), "blocks"))
    other = F.when(F.col("blocks") == 1, F.array("own")).otherwise(F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.col("own")))
    rows = rows.withColumn("other", F.explode(other))
    groups = rows.select(
        F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "node", "size", "above", *names,
        (F.col("own") > F.col("other")).alias("side"), (F.pmod(F.col("own") + 1, "blocks") == F.col("other")).alias("inner"),
    )
    small, large = _reaches(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches):
            sizes = part.column("size").to_numpy()
            above, side, inner = (part.column(x).to_numpy() for x in ("above", "side", "inner"))
            prints = np.stack([part.column(x).to_numpy() for x in names], axis=1).view(np.uint64)
            at = {(s, u): np.flatnonzero((side == s) & (above == u)) for s in (False, True) for u in (False, True)}
            rectangles = [(at[False, False], at[True, False]), (at[False, False], at[True, True]), (at[False, True], at[True, False])]
            for s in (False, True):
                if inner[side == s].any():  # the one group that compares this block with itself
                    rectangles += [(at[s, False], at[s, False]), (at[s, False], at[s, True])]
            far = large if sizes.min() >= LARGE else small
            yield from _edges(part.column("node").to_numpy(), *near_prints(prints, sizes, rectangles, far, similarity))

    return groups.repartition(shuffle_partitions(rows.sparkSession), "group").sortWithinPartitions("group").mapInArrow(run, "src long, dst long")


def near_in_cells(cell: np.ndarray, prints: np.ndarray, sizes: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links within the cells of sorted rows: all of small cells, a forest of large ones."""
    small, large = _reaches(similarity)
    starts = run_starts(cell)
    lengths = np.diff(np.append(starts, len(cell)))
    few = np.repeat(lengths <= SMALL, lengths)
    codes = unary(prints)
    left, right = [starts[:0]], [starts[:0]]
    for s in range(1, int(min(SMALL, lengths.max(initial=1)))):
        i = np.flatnonzero((cell[s:] == cell[:-s]) & few[s:])
        j = i + s
        less = np.minimum(sizes[i], sizes[j])
        far = np.where(less >= LARGE, large, small)
        near = less >= similarity * np.maximum(sizes[i], sizes[j])
        near &= np.bitwise_count(codes[i] ^ codes[j]).sum(1, dtype=np.int64) <= far
        near &= np.bitwise_count(prints[i] ^ prints[j]).sum(1, dtype=np.int64) <= far
        left.append(i[near])
        right.append(j[near])
    for k in np.flatnonzero(lengths > SMALL):
        part = slice(starts[k], starts[k] + lengths[k])
        rows = np.arange(lengths[k])
        member, root = near_prints(prints[part], sizes[part], [(rows, rows)], large if sizes[part].min() >= LARGE else small, similarity)
        left.append(member + starts[k])
        right.append(root + starts[k])
    return np.concatenate(left), np.concatenate(right)


def _in_cells(rows: DataFrame, similarity: float) -> DataFrame:
    """(src, dst): links within cells that fit a task; ``rows`` has cell, node, size, fp0, …"""
    names = [f"fp{k}" for k in range(PRINTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        stream = iter(batches)
        last = False
        while not last:
            batch = next(stream, None)
            last = batch is None
            if batch is not None:
                new = pa.Table.from_batches([batch])
                held = new if held is None else pa.concat_tables([held, new])
            if held is None or not held.num_rows:
                continue
            cell = held.column("cell").to_numpy()
            end = len(cell) if last else int(np.searchsorted(cell, cell[-1]))
            if not end:  # all of one cell, which may go on
                continue
            part, held = held.slice(0, end), held.slice(end)
            node = part.column("node").to_numpy()
            prints = np.stack([part.column(x).to_numpy() for x in names], axis=1).view(np.uint64)
            i, j = near_in_cells(cell[:end], prints, part.column("size").to_numpy(), similarity)
            if len(i):
                found = np.unique(np.stack((np.minimum(node[i], node[j]), np.maximum(node[i], node[j]))), axis=1)
                yield pa.record_batch([pa.array(np.ascontiguousarray(x)) for x in found], names=["src", "dst"])

    dealt = rows.select("cell", "node", "size", *names).repartition(shuffle_partitions(rows.sparkSession), "cell")
    return dealt.sortWithinPartitions("cell").mapInArrow(run, "src long, dst long")


def cell_links(nodes: DataFrame, owned: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(src, dst): links of nodes (node, size, fp0, …) that share a cell (``owned``: node, cells; rows may repeat) and whose prints are within reach, enough of them to keep every component whole.

    Rows are as many as cells, unless one has over GRID_ROWS nodes: it is dealt to blocks.
    """
    spark = nodes.sparkSession
    names = [f"fp{k}" for k in range(PRINTS)]
    each = owned.select("node", F.explode("cells").alias("cell")).repartition(shuffle_partitions(spark), "cell")  # dealt once for all that follows
    shared = each.groupBy("cell").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select(F.col("cell").alias("of"))
    met = materialize(each.join(shared, F.col("cell") == F.col("of")).select("cell", F.col("node").alias("member")).distinct(), "near-met")
    free_shuffles(spark)
    hot = materialize(met.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > GRID_ROWS).select(F.col("cell").alias("of")), "near-hot")
    rows = met.join(nodes.select("node", "size", *names), F.col("member") == F.col("node")).select("cell", "node", "size", *names)
    if hot.isEmpty():
        links = _in_cells(rows, similarity)
    else:
        links = _in_cells(rows.join(hot, F.col("cell") == F.col("of"), "left_anti"), similarity)
        links = links.unionByName(_meetings(rows.join(hot, F.col("cell") == F.col("of"), "left_semi").withColumn("above", F.lit(False)), similarity))
    found = materialize(links.distinct(), "near-prints")
    discard(met, hot)
    return found


def similar_groups(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(least, first): for each distinct shingle set its smallest doc_id, and the smallest of all sets that links of ``similarity`` or more reach."""
    described = materialize(_described(docs, similarity), "near")
    same = [F.first(x).alias(x) for x in described.columns if x not in ("doc_id", "node", "cells")]
    nodes = materialize(described.groupBy("node").agg(F.min("doc_id").alias("least"), *same), "near-nodes")
    linked = cell_links(nodes, described, similarity)
    discard(described)
    free_shuffles(docs.sparkSession)
    near = materialize(connected_components(linked).withColumnRenamed("node", "of"), "near-parts")
    keyed = materialize(nodes.join(near, F.col("node") == F.col("of")).select("node", F.col("fp0").alias("fp"), "size", F.col("component").alias("key")), "near-keys")
    cells = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    cells = materialize(cells.select(F.col("key").alias("cell"), F.ceil(F.greatest(F.col("n") / BLOCK_NODES, F.least(F.col("n") / 2, F.col("shingles") / BLOCK_SHINGLES))).alias("blocks")), "near-cells")
    discard(linked, near)
    shared = keyed.join(cells, F.col("key") == F.col("cell")).withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), "blocks"))
    other = F.when(F.col("blocks") == 1, F.array("own")).otherwise(F.array_remove(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.col("own")))
    shared = shared.select("node", "fp", "cell", "own", F.explode(other).alias("other"))
    shared = materialize(shared.select("node", "fp", F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("group")), "near-groups")
    discard(keyed, cells)
    free_shuffles(docs.sparkSession)
    needed = materialize(shared.select(F.col("node").alias("of")).distinct(), "near-needed")
    wanted = nodes.join(needed, F.col("node") == F.col("of"), "left_semi").select("least")
    texts = rows_of(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), wanted).select("text")
    sets = _sets(texts).join(needed, F.col("node") == F.col("of"), "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets.withColumnRenamed("node", "of"), "near-sets")
    links = materialize(_links(shared.join(sets, F.col("node") == F.col("of")).select("group", "node", "fp", "shingles"), similarity), "near-links")
    discard(shared, needed, sets)
    free_shuffles(docs.sparkSession)
    parts = connected_components(links)
    whole = nodes.join(parts.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("component", "node").alias("part"))
    firsts = whole.groupBy("part").agg(F.min("least").alias("first"))
    found = materialize(whole.join(firsts, "part").select("least", "first"), "near-firsts")
    discard(links, nodes)
    free_shuffles(docs.sparkSession)
    return found


def distinct_documents(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group of near copies.

    A group is all documents that links of shingle sets at least so similar join. Null and
    empty texts have the same, empty set. Repeated rows of a kept doc_id stay, and so do
    rows without doc_id if no row of the group has one. An empty table gives an empty one;
    columns besides doc_id and text, whatever their names, pass as they are.
    """
    return rows_of(docs, similar_groups(docs, similarity).where("least <=> first").select("first"))
