"""Benchmark decontamination by the q-gram lemma.

Texts are folded first: letters in lower case and without their marks, digits, one blank
for anything between; places and edits count characters of the folded text, of any script.
Each benchmark item is cut into overlapping windows: long ones that bear EDITS, and short
ones so close that every quote of QUOTE characters holds one whole; these bear half the
share of edits. A region within e edits of a window of n characters shares at least
n - q + 1 - q e of its q-grams, all within e diagonals of the region's own. So the q-grams
that a text shares with an item are counted in overlapping bands of diagonals; in a band
that may hold enough, each window's own are counted, and the stretches of text that meet
its bound are verified by banded alignment.

The index of the benchmark goes to every task; a benchmark larger than MAX_CHARS is
applied in blocks, an item larger than that in overlapping pieces, so what is broadcast
has a fixed bound.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.arrays import flat_text, mix64, run_starts
from quillgraph.scratch import materialize

Q = 8
#: Characters of a window, and the step between windows.
WINDOW = 120
STEP = 60
#: Characters of a short window, the step between short windows, and the least quote that is always found.
SHORT = 60
SHORT_STEP = 20
QUOTE = SHORT + SHORT_STEP
#: Share of a window that edits may change; of a short window half as much.
EDITS = 0.10
#: Characters of benchmark items in one broadcast index, at most.
MAX_CHARS = 1_000_000
#: Bits of the prefilter.
FILTER_BITS = 22
#: Bytes of text worked on at once.
PIECE = 1 << 17

_BASE = 0x9E3779B97F4A7C15
_BLANK, _GONE = 32, 0
_PLANES = 1 << 17
_FAR = 1 << 32


def _folding() -> np.ndarray:
    """What each character of the first two planes folds to; _GONE: nothing."""
    out = np.full(_PLANES, _BLANK, np.uint32)
    for k in range(_PLANES):
        c = chr(k)
        if c.isalnum():
            low = c.lower()[0]
            parts = unicodedata.normalize("NFD", low)
            marked = len(parts) > 1 and all(map(unicodedata.combining, parts[1:]))
            out[k] = ord(parts[0] if marked else low)
        elif unicodedata.combining(c):
            out[k] = _GONE
    return out


_FOLD = _folding()


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of rows of UTF-8, the rows' offsets in them, and the byte at which each begins."""
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    first = data[at]
    out = first.astype(np.uint32)
    if len(data) > len(at):
        padded = np.concatenate((data, np.zeros(3, np.uint8)))
        for more, low, high in ((1, 0xC0, 0xE0), (2, 0xE0, 0xF0), (3, 0xF0, 0x100)):
            own = np.flatnonzero((first >= low) & (first < high))
            value = (first[own] & (0x3F >> more)).astype(np.uint32)
            for k in range(1, more + 1):
                value = value << np.uint32(6) | (padded[at[own] + k] & 0x3F)
            out[own] = value
    return out, np.concatenate(([0], np.cumsum(lead)))[offsets], at


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of rows of UTF-8, their offsets, and the byte of ``data`` at which each stood."""
    line, rows, at = characters(data, offsets)
    known = line < _PLANES
    line = _FOLD[line] if known.all() else np.where(known, _FOLD[np.where(known, line, 0)], line)
    gone = line == _GONE
    if gone.any():
        stays = ~gone
        rows = np.concatenate(([0], np.cumsum(stays)))[rows]
        line, at = line[stays], at[stays]
    blank = line == _BLANK
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    starts = rows[:-1][rows[:-1] < len(line)]
    keep[starts] = ~blank[starts]
    return line[keep], np.concatenate(([0], np.cumsum(keep)))[rows], at[keep]


def gram_hashes(line: np.ndarray) -> np.ndarray:
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    if len(line) < Q:
        return np.empty(0, np.uint64)
    h1 = line.astype(np.uint64)
    h2 = h1[:-1] * power(1) + h1[1:]
    h4 = h2[:-2] * power(2) + h2[2:]
    return mix64(h4[:-4] * power(4) + h4[4:])


def budget(n: int, edits: float = EDITS) -> tuple[int, int]:
    """Edits allowed in a window of n characters, and the q-grams a region must share (1 at least)."""
    e = min(int(n * edits), max(0, (n - Q) // Q))
    return e, max(1, n - Q + 1 - Q * e)


def cuts(n: int) -> list[tuple[int, int, float]]:
    """(begin, end, part of the share of edits) of the windows of an item of n folded characters."""
    if n < Q:
        return []
    found = {}
    for at in range(0, n, STEP):
        end = n if n - at < WINDOW + STEP else at + WINDOW
        found[at, end] = 1.0
        if end == n:
            break
    if n > WINDOW:
        found[n - WINDOW, n] = 1.0
    if n > SHORT:
        for at in [*range(0, n - SHORT, SHORT_STEP), n - SHORT]:
            found.setdefault((at, at + SHORT), 0.5)
    return [(*k, v) for k, v in sorted(found.items())]


class Index(NamedTuple):
    """Benchmark texts with their windows, and the index of their q-grams (sorted hashes; text and place of each)."""

    items: list[int]
    texts: list[np.ndarray]
    windows: list[np.ndarray]  # of each text: begin, end, edits, q-grams to share
    least: np.ndarray  # of each text: the fewest q-grams that a window needs
    width: int
    hashes: np.ndarray
    owner: np.ndarray
    place: np.ndarray
    present: np.ndarray


def folded_item(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    line, _, _ = fold(raw, np.array([0, len(raw)]))
    return line[:-1] if len(line) and line[-1] == _BLANK else line


def index_of(rows: list[tuple[int, np.ndarray]], edits: float = EDITS) -> Index:
    items, texts, windows, hashes, owner, place = [], [], [], [], [], []
    for item, line in rows:
        own = [(a, b, *budget(b - a, edits * share)) for a, b, share in cuts(len(line))]
        if own:
            h = gram_hashes(line)
            hashes.append(h)
            owner.append(np.full(len(h), len(texts)))
            place.append(np.arange(len(h)))
            items.append(item)
            texts.append(line)
            windows.append(np.array(own, np.int64))
    present = np.zeros(1 << FILTER_BITS, bool)
    if not texts:
        none = np.empty(0, np.int64)
        return Index([], [], [], none, 1, np.empty(0, np.uint64), none, none, present)
    h, o, p = np.concatenate(hashes), np.concatenate(owner), np.concatenate(place)
    order = np.argsort(h, kind="stable")
    present[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    width = 1 + max(int(w[:, 2].max()) for w in windows)
    return Index(items, texts, windows, np.array([w[:, 3].min() for w in windows]), width, h[order], o[order], p[order], present)


def _shared_grams(index: Index, line: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, text, place in the line, place in the text) of each q-gram that a row and a benchmark text share."""
    hashes = gram_hashes(line)
    at = np.flatnonzero(index.present[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    lo = np.searchsorted(index.hashes, hashes[at], "left")
    some = index.hashes[np.minimum(lo, len(index.hashes) - 1)] == hashes[at]
    at, lo = at[some], lo[some]
    row = np.searchsorted(offsets, at, "right") - 1
    whole = at + Q <= offsets[row + 1]  # a q-gram of one row
    at, lo, row = at[whole], lo[whole], row[whole]
    hits = np.searchsorted(index.hashes, hashes[at], "right") - lo
    each = np.repeat(np.arange(len(at)), hits)
    entry = np.repeat(lo - (np.cumsum(hits) - hits), hits) + np.arange(len(each))
    return row[each], index.owner[entry], at[each], index.place[entry]


def _stretches(index: Index, line: np.ndarray, offsets: np.ndarray) -> dict[tuple[int, int, int], list[tuple[int, int]]]:
    """For each (row, text, window) the disjoint stretches of the line that may hold a region, in order."""
    row, text, at, place = _shared_grams(index, line, offsets)
    found: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    if not len(row):
        return found
    longest = max(map(len, index.texts))
    bands = (len(line) + longest) // (2 * index.width) + 2
    pair = row * len(index.texts) + text
    diagonal = at - place + longest
    # bands [j w, j w + 2 w): every stretch of w diagonals lies in one of them
    for shift in (0, index.width):
        key = pair * bands + (diagonal + shift) // (2 * index.width)
        order = np.argsort(key, kind="stable")
        starts = run_starts(key[order])
        stops = np.append(starts[1:], len(order))
        for k in np.flatnonzero(stops - starts >= index.least[text[order[starts]]]).tolist():
            own = order[starts[k] : stops[k]]
            t, r = int(text[own[0]]), int(row[own[0]])
            where = np.unique(place[own])  # a repeated q-gram counts once
            begin, end, most, needed = index.windows[t].T
            shared = np.searchsorted(where, end - Q, "right") - np.searchsorted(where, begin, "left")
            for w in np.flatnonzero(shared >= needed).tolist():
                inside = own[(place[own] >= begin[w]) & (place[own] <= end[w] - Q)]
                slant = at[inside] - place[inside]
                a = max(int(offsets[r]), int(slant.min() + begin[w] - 2 * most[w]))
                b = min(int(offsets[r + 1]), int(slant.max() + end[w] + 2 * most[w]))
                found.setdefault((r, t, w), []).append((a, b))
    for key, spans in found.items():
        joined: list[list[int]] = []
        for a, b in sorted(spans):
            if joined and a < joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        found[key] = [(a, b) for a, b in joined]
    return found


def aligned(pattern: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(edits, begin, end) of the region of ``text`` nearest to ``pattern`` if at most ``most`` edits; ties: the earliest end, then the latest begin.

    The dynamic programme takes one pattern character at a time with all its text places
    at once; these are a band, as a region begins on a diagonal from 0 to the text's
    surplus and leaves it by ``most`` at most. Edits and begin are one number, so that the
    least is best in both.
    """
    n, m = len(pattern), len(text)
    if m < n - most:
        return None
    size = m - n + 2 * most + 1
    steps = np.arange(size, dtype=np.int64) * _FAR
    never = np.int64(1) << 60
    beyond = np.full(most, -1, np.int64)
    padded = np.concatenate((beyond, text.astype(np.int64), beyond))
    places = np.arange(-most, size - most)
    cost = np.where((places >= 0) & (places <= m), -places, never)
    for i in range(n):
        # the cell of the diagonal before has the same number, the one above the next
        best = cost + np.multiply(padded[i : i + size] != pattern[i], _FAR)
        np.minimum(best[:-1], cost[1:] + _FAR, out=best[:-1])
        low, high = max(0, most - i - 1), min(size, m + most - i)  # the cells inside the text
        best[:low] = never
        best[high:] = never
        best -= steps
        np.minimum.accumulate(best, out=best)
        best += steps
        best[high:] = never
        cost = best
        if i % 8 == 7 and cost.min() > most * _FAR:
            return None
    places += n
    if cost.min() > most * _FAR:
        return None
    edits = -(-cost // _FAR)
    k = int(edits.argmin())
    return int(edits[k]), int(edits[k] * _FAR - cost[k]), int(places[k])


def _string(line: np.ndarray) -> str:
    return line.astype("<u4").tobytes().decode("utf-32-le", "replace")


def _regions(pattern: np.ndarray, line: np.ndarray, text: str, a: int, b: int, most: int) -> Iterator[tuple[int, int, int]]:
    """(begin, end, edits): the nearest region of line[a:b], and those that what is left on either side holds. ``text`` is the line."""
    todo, verbatim = [(a, b)], _string(pattern)
    while todo:
        a, b = todo.pop()
        at = text.find(verbatim, a, b)
        found = (0, at - a, at - a + len(pattern)) if at >= 0 else aligned(pattern, line[a:b], most)
        if found is not None and found[2] > found[1]:
            edits, begin, end = found
            yield a + begin, a + end, edits
            todo += [(a, a + begin), (a + end, b)]


def _leaks_in(index: Index, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(row, item, begin, end, edits, size): verified regions, begin and end in the row's bytes."""
    if not index.texts or not len(data):
        return
    line, folded, where = fold(data, offsets)
    whole = _string(line)
    for (row, text, w), spans in _stretches(index, line, folded).items():
        begin, end, most, _ = index.windows[text][w].tolist()
        for a, b in spans:
            for x, y, edits in _regions(index.texts[text][begin:end], line, whole, a, b, most):
                last = int(where[y - 1])
                after = last + int(np.searchsorted((0x7F, 0xDF, 0xEF), data[last])) + 1  # the bytes of its last character
                yield row, index.items[text], int(where[x] - offsets[row]), after - int(offsets[row]), edits, end - begin


def leaks_in(index: Index, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
    """The regions of a column of texts, PIECE bytes of whole texts at a time."""
    data, offsets = flat_text(column)
    a, n = 0, len(column)
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1))
        for row, *rest in _leaks_in(index, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
            yield a + row, *rest
        a = b


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items, folded, in blocks of at most MAX_CHARS characters; one item at a time reaches the driver."""
    block: list[tuple[int, np.ndarray]] = []
    held = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        line = folded_item(r["text"])
        for at in range(0, max(1, len(line) - WINDOW - STEP), MAX_CHARS - WINDOW - STEP):  # neighbours share more than a window
            piece = line[at : at + MAX_CHARS]
            if block and held + len(piece) > MAX_CHARS:
                yield block
                block, held = [], 0
            block.append((r["item_id"], piece))
            held += len(piece)
    if block:
        yield block


LEAK_SQL = "doc_id long, item_id long, begin long, end long, edits long, size long"


def leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """(doc_id, item_id, begin, end, edits, size): the regions of each document within the edit budget of a benchmark window.

    Of one window the nearest region of a document counts first (ties: the earliest end,
    then the latest begin), then those in what is left on either side of it; windows
    overlap, so regions of several windows do. A quote of QUOTE folded characters of an
    item, word for word, always holds a window. begin and end are bytes of the document's
    UTF-8 text. Items whose folded text is under 8 characters match nothing. Null and
    empty texts have no region; repeated rows give theirs again, rows without doc_id come
    with a null one; further columns are not read. An empty benchmark or table gives an
    empty result.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = spark.createDataFrame([], LEAK_SQL)
    for block in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(index_of(block, edits))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(leaks_in(shared.value, batch.column(1)))
                if found:
                    row, *rest = zip(*found, strict=True)
                    yield pa.record_batch([batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in rest)], names=["doc_id", "item_id", "begin", "end", "edits", "size"])

        out = out.unionByName(materialize(own.mapInArrow(run, LEAK_SQL), "leaks"))
        shared.destroy()
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """Of each document with a leak: doc_id, its number of regions and items, and the nearest region (ties: least item, begin)."""
    nearest = F.struct((F.col("edits") / F.col("size")).alias("share"), "item_id", "begin", "end", "edits")
    return leaks(docs, benchmark, edits).groupBy("doc_id").agg(F.count("*").alias("n_regions"), F.countDistinct("item_id").alias("n_items"), F.min(nearest).alias("x")).select("doc_id", "n_regions", "n_items", F.col("x.item_id").alias("item_id"), F.col("x.begin").alias("begin"), F.col("x.end").alias("end"), F.col("x.edits").alias("edits"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, edits: float = EDITS) -> DataFrame:
    """The rows of ``docs``, all columns, whose own text has no leak; what other rows of that doc_id hold doesn't matter.

    Rows with null or empty text stay. Repeated rows stay or go alike. Column names may be
    any; an empty benchmark takes nothing away, an empty table gives an empty one.
    """
    for block in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index_of(block, edits))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for found in leaks_in(shared.value, batch.column(batch.schema.get_field_index("text"))):
                    clean[found[0]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a passage of the benchmark, each with its nearest region; nulls, repeats and empty tables as in ``leaks``."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
