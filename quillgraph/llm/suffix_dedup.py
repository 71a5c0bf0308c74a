"""Removal of long byte strings that a document with a smaller id also holds.

1. Every 50-byte window has an anchor, the 20-byte gram of least hash in it; equal
   windows have equal anchors. Runs of windows with one anchor are the unit of work, so
   about one key for 11 bytes is shuffled instead of one for each byte. A run's key is its
   anchor with the next bytes on the side where its windows reach further.
2. Keys that occur in two documents are found by parts of the key space, whose tasks give
   their stretch of a bit table, sized by the input up to 128 MB. The table only saves
   work: a key that it passes wrongly costs a little sorting.
3. The byte strings of the passing runs are dealt out by anchor in compressed blocks, equal
   strings of a task combined first (smallest and largest doc_id). Each part sorts the suffixes that begin
   a window to depth 50 by deep-shallow sorting: multikey quicksort on eight-byte digits
   to a shallow depth, then blind tries for the groups that still agree. A group of
   suffixes equal to depth 50 is one repeated string; its smallest doc_id is its owner.
4. Owners go back to every occurrence by a join on the run's string (a hot string is one
   row on one side, so Spark may split the other), and spans to the documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.arrays import byte_values, flat_text, mix64, packed, packed_keys, run_starts, unpacked, unpacked_keys
from quillgraph.llm.columns import unused
from quillgraph.scratch import discard, free_shuffles, materialize, shuffle_partitions

LENGTH = 50
GRAM = 20
#: Bytes beside an anchor that a run's key also covers: half of what a window has beside it.
SIDE = (LENGTH - GRAM) // 2
#: Bytes hashed at once; positions within fit 24 bits.
PIECE = 1 << 16
#: Bits of the table of shared keys, at least and at most (16 to 128 MB), and bytes of text for each of them between.
TABLE_BITS = (27, 30)
TEXT_PER_BIT = 8
#: Bytes of text for each part of the key space, about.
PART_BYTES = 64 << 20
#: Depth of the multikey quicksort; deeper groups go to the blind tries.
SHALLOW = 16
#: Bytes of run strings sorted at once, and windows of one anchor sorted at once.
SORT_BYTES = 1 << 20
SORT_WINDOWS = 1 << 20
#: Distinct strings that a map task combines before it sends them on.
COMBINE = 1 << 18
#: Keys of a map task that are sorted and sent on together.
KEYS_AT_ONCE = 1 << 20

_VALUES = byte_values(20)
_BASE = 0x9E3779B97F4A7C15


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each 20-byte gram."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    h1 = _VALUES[data]
    h2 = h1[:-1] * power(1) + h1[1:]
    h4 = h2[:-2] * power(2) + h2[2:]
    h8 = h4[:-4] * power(4) + h4[4:]
    h16 = h8[:-8] * power(8) + h8[8:]
    n = len(data) - GRAM + 1
    return mix64(h16[:n] * power(4) + h4[16 : 16 + n])


def _pieces(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about PIECE bytes; a longer row is cut by itself, so that its runs are the same in every scan."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        begin, end = int(offsets[row]), int(offsets[row + 1])
        if end - begin > PIECE:
            yield from ((at, min(at + PIECE + LENGTH - 1, end)) for at in range(begin, end - LENGTH + 1, PIECE))
            row += 1
        else:
            row = max(row + 1, int(np.searchsorted(offsets, begin + PIECE, "right")) - 1)
            end = int(offsets[row])
            if end - begin >= LENGTH:
                yield begin, end


def window_runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """first window, number of windows, key, anchor hash, row: runs of windows with one anchor and side; windows stay within a row."""
    for begin, end in _pieces(offsets):
        piece = data[begin:end]
        n = len(piece) - LENGTH + 1
        hashes = _gram_hashes(piece)
        key = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(len(hashes), dtype=np.uint64)
        m = np.minimum(key[:-1], key[1:])
        for step in (2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        span = LENGTH - GRAM + 1  # 31 grams in a window: two overlapping stretches of 16
        m = np.minimum(m[:n], m[span - 16 : span - 16 + n])
        anchor = (m & np.uint64(0xFFFFFF)).astype(np.int64)
        row_lo = int(np.searchsorted(offsets, begin, "right")) - 1
        row_hi = int(np.searchsorted(offsets, begin + n - 1, "right"))
        ends = offsets[row_lo + 1 : row_hi + 1]
        cuts = np.diff(np.clip(np.concatenate(([begin], ends)), begin, begin + n))
        places = np.arange(n)
        valid = np.repeat(ends, cuts) - begin - places >= LENGTH
        left = anchor - places >= SIDE  # windows that reach SIDE bytes to the left of the anchor
        change = np.empty(n, bool)
        change[0] = True
        change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (left[1:] != left[:-1])
        starts = np.flatnonzero(change)
        sizes = np.diff(np.append(starts, n))
        keep = valid[starts]
        starts, sizes = starts[keep], sizes[keep]
        at, side = anchor[starts], left[starts]
        other = hashes[np.where(side, at - SIDE, at + SIDE + 1)]
        keys = mix64(hashes[at] + other * np.where(side, np.uint64(3), np.uint64(5)))
        rows = np.searchsorted(offsets, starts + begin, "right") - 1
        yield starts + begin, sizes, keys, hashes[at], rows


def _words(buffer: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, big end first (zeros after the end)."""
    padded = np.concatenate((buffer, np.zeros(8, np.uint8))).astype(np.uint64)
    out = padded[: len(buffer)].copy()
    for k in range(1, 8):
        out <<= np.uint64(8)
        out |= padded[k : k + len(buffer)]
    return out


def _groups(keys: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted positions in groups of two or more equal keys, and each one's group."""
    starts = run_starts(keys)
    sizes = np.diff(np.append(starts, len(keys)))
    many = sizes > 1
    return order[np.repeat(many, sizes)], np.repeat(np.arange(int(many.sum())), sizes[many])


def owners(buffer: np.ndarray, suffixes: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each suffix (all have 50 bytes) the smallest document among those equal to depth 50."""
    least = docs.copy()
    if len(suffixes) < 2:
        return least
    word = _words(buffer)
    # multikey quicksort, eight bytes a digit
    digit = word[suffixes]
    order = np.argsort(digit)
    members, group = _groups(digit[order], order)
    for depth in range(8, SHALLOW, 8):
        if not len(members):
            return least
        digit = word[suffixes[members] + depth]
        order = np.lexsort((digit, group))
        pair = np.stack((group[order], digit[order].view(np.int64)))
        changed = np.concatenate(([True], (pair[:, 1:] != pair[:, :-1]).any(0)))
        members, group = _groups(np.cumsum(changed), members[order])
    # blind tries, all groups' levels at once: a node holds only the depth at which its members part
    while len(members):
        starts = run_starts(group)
        sizes = np.diff(np.append(starts, len(group)))
        at = suffixes[members]
        leader = np.repeat(at[starts], sizes)
        common = np.full(len(members), LENGTH)
        for depth in (LENGTH - 8, *range(((LENGTH - 9) // 8) * 8, SHALLOW - 1, -8)):
            differ = word[at + depth] ^ word[leader + depth]
            where = np.flatnonzero(differ)
            if len(where):
                common[where] = depth + _leading_bytes(differ[where])
        part = np.minimum.reduceat(common, starts)
        leaf = part >= LENGTH
        if leaf.any():
            of_leaf = np.repeat(leaf, sizes)
            low = np.minimum.reduceat(least[members], starts)
            least[members[of_leaf]] = np.repeat(low, sizes)[of_leaf]
            members, group, at, part = members[~of_leaf], group[~of_leaf], at[~of_leaf], np.repeat(part, sizes)[~of_leaf]
        else:
            part = np.repeat(part, sizes)
        if not len(members):
            break
        branch = (group.astype(np.int64) << 8) | buffer[at + part].astype(np.int64)
        order = np.argsort(branch, kind="stable")
        members, group = _groups(branch[order], members[order])
    return least


def _leading_bytes(x: np.ndarray) -> np.ndarray:
    """Number of leading zero bytes of nonzero words."""
    out = np.zeros(len(x), np.int64)
    x = x.copy()
    for shift in (32, 16, 8):
        empty = x >> np.uint64(64 - shift) == 0
        out[empty] += shift // 8
        x[empty] <<= np.uint64(shift)
    return out


def _parts_of(slots: np.ndarray, parts: int, bits: int) -> np.ndarray:
    """The part of the key space that a table word belongs to: equal stretches of the table."""
    return ((slots >> np.uint64(6)) * np.uint64(parts) >> np.uint64(bits - 6)).astype(np.int64)


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return keys >> np.uint64(64 - bits)


def _key_blocks(parts: int, bits: int):
    """Keys with the smallest and largest document of a stretch of input, a block for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys, docs = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if not len(keys):
                return
            order = np.lexsort((docs, keys))
            keys, docs = keys[order], docs[order]
            starts = run_starts(keys)
            last = np.append(starts[1:], len(keys)) - 1
            keys, low, high = keys[starts], docs[starts], docs[last]
            cuts = run_starts(_parts_of(_slots(keys, bits), parts, bits))
            for a, b in zip(cuts, np.append(cuts[1:], len(keys)), strict=True):
                part = int(_parts_of(_slots(keys[a : a + 1], bits), parts, bits)[0])
                row = {"part": part, "keys": packed_keys(keys[a:b]), "low": packed(low[a:b]), "more": packed(high[a:b] - low[a:b])}
                yield pa.RecordBatch.from_pylist([row], _KEYS)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for _, _, keys, _, rows in window_runs(*flat_text(batch.column(1))):
                held.append((keys, ids[rows]))
                if sum(len(x[0]) for x in held) > KEYS_AT_ONCE:
                    yield from flush()
        if held:
            yield from flush()

    return run


_KEYS = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("low", pa.binary()), ("more", pa.binary())])


def _shared_bits(parts: int, bits_of_table: int):
    """The part's stretch of the table: bits of keys that two documents or more have."""

    def run(blocks: pa.Table) -> pa.Table:
        part = blocks.column("part")[0].as_py()
        read = lambda c, f: np.concatenate([f(x) for x in blocks.column(c).to_pylist()])
        keys = read("keys", unpacked_keys)
        low = read("low", lambda x: unpacked(x, np.int64))
        high = low + read("more", lambda x: unpacked(x, np.int64))
        order = np.argsort(keys)
        keys = keys[order]
        starts = run_starts(keys)
        shared = keys[starts][np.minimum.reduceat(low[order], starts) < np.maximum.reduceat(high[order], starts)]
        first = -(-(part << (bits_of_table - 6)) // parts)
        bits = np.zeros(-(-((part + 1) << (bits_of_table - 6)) // parts) - first, np.uint64)
        slot = _slots(shared, bits_of_table)
        np.bitwise_or.at(bits, (slot >> np.uint64(6)).astype(np.int64) - first, np.uint64(1) << (slot & np.uint64(63)))
        return pa.table({"first": pa.array([first], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})

    return run


def _shared_table(docs: DataFrame, parts: int, bits: int) -> np.ndarray:
    """Bits of the keys that occur in two documents or more."""
    blocks = docs.mapInArrow(_key_blocks(parts, bits), "part int, keys binary, low binary, more binary")
    got = blocks.groupBy("part").applyInArrow(_shared_bits(parts, bits), "first long, bits binary").toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    for first, words in zip(got.column("first").to_pylist(), got.column("bits").to_pylist(), strict=True):
        part = np.frombuffer(words, np.uint64)
        table[first : first + len(part)] = part
    return table


def _in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = _slots(keys, len(table).bit_length() + 5)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def _passing(batch: pa.RecordBatch, table: np.ndarray) -> Iterator[tuple]:
    """Row of the batch, position, anchor and string of the runs whose key may be shared."""
    data, offsets = flat_text(batch.column(1))
    raw = data.tobytes()
    for starts, sizes, keys, anchors, rows in window_runs(data, offsets):
        keep = np.flatnonzero(_in_table(table, keys))
        if len(keep):
            starts, sizes, anchors, rows = starts[keep], sizes[keep], anchors[keep], rows[keep]
            # neighbours with one anchor: one string
            fresh = np.flatnonzero(np.concatenate(([True], (starts[1:] != (starts + sizes)[:-1]) | (anchors[1:] != anchors[:-1]))))
            starts, sizes, anchors, rows = starts[fresh], np.add.reduceat(sizes, fresh), anchors[fresh], rows[fresh]
            strings = [raw[a:b] for a, b in zip(starts.tolist(), (starts + sizes + LENGTH - 1).tolist(), strict=True)]
            yield rows, starts - offsets[rows], anchors, strings


def _string_keys(strings: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(s) for s in strings]), np.int64).reshape(-1, 2)


def _combined(table_ref, parts: int):
    """Distinct strings of a stretch of input with their smallest and largest document, a block for each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_ref.value
        held: dict[bytes, list[int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            strings = list(held)
            low, high, anchors = (np.array(x, t) for x, t in zip(zip(*held.values(), strict=True), (np.int64, np.int64, np.uint64), strict=True))
            held.clear()
            part = (anchors % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((anchors, part))
            cuts = run_starts(part[order])
            for a, b in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
                at = order[a:b]
                own = [strings[k] for k in at]
                row = {"part": int(part[at[0]]), "anchors": packed_keys(anchors[at]), "sizes": packed(np.array([len(x) for x in own], np.int32)), "low": packed(low[at]), "more": packed(high[at] - low[at]), "strings": packed(np.frombuffer(b"".join(own), np.uint8))}
                yield pa.RecordBatch.from_pylist([row], _STRINGS)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, _, anchors, strings in _passing(batch, table):
                for d, a, s in zip(ids[rows].tolist(), anchors.tolist(), strings, strict=True):
                    x = held.get(s)
                    if x is None:
                        held[s] = [d, d, a]
                    elif d < x[0]:
                        x[0] = d
                    elif d > x[1]:
                        x[1] = d
                if len(held) > COMBINE:
                    yield from flush()
        if held:
            yield from flush()

    return run


_STRINGS = pa.schema([("part", pa.int32()), ("anchors", pa.binary()), ("sizes", pa.binary()), ("low", pa.binary()), ("more", pa.binary()), ("strings", pa.binary())])


def _places(table_ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, at, _, strings in _passing(batch, table_ref.value):
                keys, rows = _string_keys(strings), pa.array(rows)
                yield pa.record_batch([pa.array(keys[:, 0]), pa.array(keys[:, 1]), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(at, pa.int64())], names=["k1", "k2", "doc_id", "mark", "at"])

    return run


def _part_owners(blocks: pa.Table) -> pa.Table:
    """Owners of the strings of one part: whole anchors are sorted together, about SORT_BYTES at once."""
    read = lambda c, f: np.concatenate([f(x) for x in blocks.column(c).to_pylist()])
    anchors = read("anchors", unpacked_keys)
    sizes = read("sizes", lambda x: unpacked(x, np.int32)).astype(np.int64)
    low = read("low", lambda x: unpacked(x, np.int64))
    high = low + read("more", lambda x: unpacked(x, np.int64))
    buffer = read("strings", lambda x: unpacked(x, np.uint8))
    begins = np.cumsum(sizes) - sizes
    # equal strings of several tasks are one
    raw = buffer.tobytes()
    keys = _string_keys([raw[a:b] for a, b in zip(begins.tolist(), (begins + sizes).tolist(), strict=True)])
    del raw
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    pair = keys[order]
    same = np.flatnonzero(np.concatenate(([True], (pair[1:] != pair[:-1]).any(1))))
    low, high = np.minimum.reduceat(low[order], same), np.maximum.reduceat(high[order], same)
    first = order[same]
    anchors, sizes, begins, keys = anchors[first], sizes[first], begins[first], keys[first]
    order = np.argsort(anchors, kind="stable")
    heads = run_starts(anchors[order])
    reach = np.concatenate(([0], np.cumsum(sizes[order])))
    out, a = [_OWNERS.empty_table()], 0
    while a < len(order):
        k = int(np.searchsorted(heads, max(a + 1, int(np.searchsorted(reach, reach[a] + SORT_BYTES))), "left"))
        b = int(heads[k]) if k < len(heads) else len(order)
        at = order[a:b]
        lengths = sizes[at]
        take = np.repeat(begins[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        out.append(_owner_rows(buffer[take], np.concatenate(([0], np.cumsum(lengths))), low[at], high[at], keys[at]))
        a = b
    return pa.concat_tables(out)


_OWNERS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("offset", pa.int64()), ("windows", pa.int64()), ("owner", pa.int64())])


def _owner_rows(buffer: np.ndarray, offsets: np.ndarray, low: np.ndarray, high: np.ndarray, keys: np.ndarray) -> pa.Table:
    """Of distinct strings: the stretches of windows with one owner that another of the string's documents follows."""
    counts = np.diff(offsets) - (LENGTH - 1)
    firsts = np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)
    within = np.arange(len(row)) - firsts[row]
    suffixes = offsets[:-1][row] + within
    least = np.empty(len(row), np.int64)
    passes = 1 + len(row) // SORT_WINDOWS
    if passes == 1:
        least = owners(buffer, suffixes, low[row])
    else:  # equal strings fall into the same pass
        word = _words(buffer)
        share = mix64(word[suffixes] ^ mix64(word[suffixes + LENGTH - 8])) % np.uint64(passes)
        for p in range(passes):
            at = np.flatnonzero(share == p)
            least[at] = owners(buffer, suffixes[at], low[row[at]])
    wanted = least < high[row]
    change = np.concatenate(([True], (row[1:] != row[:-1]) | (least[1:] != least[:-1]))) if len(row) else np.empty(0, bool)
    starts = np.flatnonzero(change)
    sizes = np.diff(np.append(starts, len(row)))
    keep = wanted[starts]
    starts, sizes = starts[keep], sizes[keep]
    if not len(starts):
        return _OWNERS.empty_table()
    keys = keys[row[starts]]
    return pa.table([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(within[starts]), pa.array(sizes), pa.array(least[starts])], schema=_OWNERS)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, begin, end): stretches of 50-byte strings of a document that also start in one with a smaller id; they may overlap. mark is a hash of the text, for texts that share a doc_id."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("mark")).where("doc_id is not null")
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(shuffle_partitions(spark), -(-size // PART_BYTES))
    bits = min(max(TABLE_BITS[0], (size // TEXT_PER_BIT).bit_length()), TABLE_BITS[1])
    table = spark.sparkContext.broadcast(_shared_table(texts, parts, bits))
    free_shuffles(spark)
    blocks = texts.mapInArrow(_combined(table, parts), "part int, anchors binary, sizes binary, low binary, more binary, strings binary")
    found = blocks.groupBy("part").applyInArrow(_part_owners, "k1 long, k2 long, offset long, windows long, owner long")
    found = materialize(found, "suffix-owners")
    free_shuffles(spark)
    places = texts.mapInArrow(_places(table), "k1 long, k2 long, doc_id long, mark long, at long")
    hits = places.join(found, ["k1", "k2"]).where("owner < doc_id")
    begin = F.col("at") + F.col("offset")
    spans = materialize(hits.select("doc_id", "mark", begin.alias("begin"), (begin + F.col("windows") + LENGTH - 1).alias("end")), "suffix-spans")
    table.destroy()
    discard(found)
    return spans


def merged(spans: list, size: int) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[list[int]] = []
    for a, b in sorted((x["begin"], x["end"]) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    assert not out or out[-1][1] <= size
    return [(a, b) for a, b in out]


def _cut(docs: DataFrame, finish, schema: str | None = None) -> DataFrame:
    """``docs`` with their spans through ``finish(batch without spans, sizes, removed runs of each row, rest of each row)``."""
    held, of, mark = (unused(docs, name) for name in ("spans", "span_id", "span_mark"))
    spans = repeated_spans(docs).groupBy(F.col("doc_id").alias(of), F.col("mark").alias(mark)).agg(F.collect_list(F.struct("begin", "end")).alias(held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat_text(batch.column("text"))
            raw = data.tobytes()
            cuts, rests = [], []
            for i, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                text = raw[offsets[i] : offsets[i + 1]]
                runs = merged(spans, len(text))
                kept, at = [], 0
                for a, b in runs:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                cuts.append(runs)
                rests.append(kept)
            yield from finish(batch.select(range(batch.num_columns - 1)), np.diff(offsets), cuts, rests)

    joined = docs.join(spans, (docs.doc_id.cast("long") == spans[of]) & (F.xxhash64(docs.text) == spans[mark]), "left").drop(of, mark)
    return joined.mapInArrow(run, schema or docs.schema)


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each row of ``docs`` (doc_id, text).

    Texts are judged as UTF-8 bytes, null as empty. A document is compared with smaller
    ids only: rows that repeat a doc_id never remove each other's bytes; a row with a null
    doc_id loses nothing. An empty table gives an empty one; further columns are not read.
    """

    def finish(batch: pa.RecordBatch, sizes: np.ndarray, cuts: list, rests: list) -> Iterator[pa.RecordBatch]:
        columns = {
            "n_bytes": pa.array(sizes, pa.int64()),
            "n_removed": pa.array([sum(b - a for a, b in runs) for runs in cuts], pa.int64()),
            "n_spans": pa.array([len(runs) for runs in cuts], pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(b"".join(kept)).hexdigest() for kept in rests], pa.string()),
        }
        yield pa.record_batch([batch.column("doc_id"), *columns.values()], names=["doc_id", *columns])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _cut(own, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes cut out of text (and n_chars, if there, brought up to date).

    A character that loses some of its bytes goes whole. A text that loses everything goes
    with its row; one that was null or empty before stays. Rows that share a doc_id
    are judged each by itself; a row with a null doc_id loses nothing. An
    empty table gives an empty one; further columns, whatever their names, pass as they are.
    """

    def finish(batch: pa.RecordBatch, sizes: np.ndarray, cuts: list, rests: list) -> Iterator[pa.RecordBatch]:
        texts = ["".join(x.decode("utf-8", "ignore") for x in kept) if runs else None for runs, kept in zip(cuts, rests, strict=True)]
        old = batch.column("text")
        changed = pa.array([bool(runs) for runs in cuts])
        new = pc.if_else(changed, pa.array(texts, old.type), old)
        out = []
        for field in batch.schema:
            if field.name == "text":
                out.append(new)
            elif field.name == "n_chars":
                out.append(pc.if_else(changed, pc.utf8_length(new).cast(field.type), batch.column("n_chars")))
            else:
                out.append(batch.column(field.name))
        keep = pa.array([not runs or bool(t.strip()) for runs, t in zip(cuts, texts, strict=True)])
        yield pa.record_batch(out, names=batch.schema.names).filter(keep)

    return _cut(docs, finish)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document keeps; nulls, repeats and empty tables as in ``suffix_dedup``."""
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
