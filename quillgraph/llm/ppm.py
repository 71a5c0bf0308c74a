"""Language-model scores by prediction by partial matching (PPM) over bytes.

The trie of byte contexts up to order 5 is held as one table of (context, symbol) grams
with the counts of all training documents: its levels are the suffixes of that table.
Escapes are estimated by method D; symbols of a longer context are excluded from the
shorter ones, and from order 4 down to 2 a gram counts once for each longer context
(update exclusion). The model is pretrained, so a position's code length depends on its
gram alone: each distinct gram is evaluated once, where its trie branch lies, and a
document sums its grams.

Nothing of corpus size is broadcast. Documents are dealt into buckets. A bucket sends its
distinct words and grams with their counts, as one compressed block for each part of the
key space; the part sums them over all buckets and answers each block with the corpus
counts and code lengths, in the block's own order. Only the two lowest levels of the trie
(at most 257 x 256 entries) go to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.arrays import LOWER, byte_values, flat_text, mix64, packed, packed_keys, run_starts, unpacked, unpacked_keys
from quillgraph.scratch import discard, free_shuffles, materialize, shuffle_partitions

ORDER = 5
#: Bytes that UTF-8 never holds: what stands before a text, and its end.
START, END = 0xFE, 0xFF
#: 256 byte values and the end are never more than this many symbols.
SYMBOLS = 257
#: Text bytes of a bucket, about.
BUCKET = 64 << 20
#: Text bytes worked on at once.
STRIDE = 4 << 20
WORD, GRAM, PAIR = 0, 1, 2

_LOW = np.frombuffer(LOWER, np.uint8)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_VALUES = byte_values(7)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit key of each lower-cased word, and the words of each row."""
    blank = _BLANK[data]
    first = ~blank
    begins = first.copy()
    begins[1:] &= blank[:-1]
    at = offsets[:-1][offsets[:-1] < len(data)]
    begins[at] = first[at]  # a row's first byte begins a word of its own
    starts = np.flatnonzero(begins)
    words_before = np.concatenate(([0], np.cumsum(begins)))[offsets]
    per_row = np.diff(words_before)
    if not len(starts):
        return np.empty(0, np.uint64), per_row
    reach = np.diff(np.append(starts, len(data)))
    place = np.zeros(len(data), np.int64)
    place[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, reach)
    powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, np.uint64))
    value = _VALUES[_LOW[data]] * powers[place]
    value[blank] = 0
    keys = np.add.reduceat(value, starts)
    lengths = np.add.reduceat((~blank).astype(np.uint64), starts)
    return mix64(keys ^ mix64(lengths)), per_row


def _word_line(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' words, lower-cased, with one blank between two."""
    blank = _BLANK[data]
    at = offsets[:-1][offsets[:-1] < len(data)]
    single = blank.copy()
    single[1:] &= ~blank[:-1]
    single[at] = False  # a blank after a word of its own row
    keep = ~blank | single
    last = offsets[1:][np.diff(offsets) > 0] - 1  # rows that end in blanks lose the one kept
    starts = np.flatnonzero(~blank)
    if len(last):
        ends = np.searchsorted(starts, last, "right") - 1
        tail = np.where(ends >= 0, starts[np.maximum(ends, 0)] + 1 if len(starts) else 0, 0)
        tail = np.maximum(tail, offsets[:-1][np.diff(offsets) > 0])
        drop = tail[tail <= last]
        keep[drop[blank[drop]]] = False
    line = _LOW[np.where(blank, 32, data)[keep]]
    return line, np.concatenate(([0], np.cumsum(keep)))[offsets]


def gram_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 48-bit grams (five bytes of context, the symbol) of each row with its end, and the grams of each row."""
    data, offsets = _word_line(data, offsets)
    n_rows = len(offsets) - 1
    lengths = np.diff(offsets)
    out_at = offsets[:-1] + (ORDER + 1) * np.arange(n_rows)
    line = np.full(len(data) + (ORDER + 1) * n_rows, START, np.uint8)
    where = np.arange(len(data)) + np.repeat((ORDER + 1) * np.arange(n_rows) + ORDER, lengths)
    line[where] = data
    ends = out_at + ORDER + lengths
    line[ends] = END
    wide = line.astype(np.uint64)
    keys = wide[ORDER:].copy()
    for k in range(1, ORDER + 1):
        keys |= wide[ORDER - k : len(wide) - k] << np.uint64(8 * k)
    symbol = np.ones(len(line), bool)
    for k in range(ORDER):
        symbol[out_at + k] = False
    return keys[symbol[ORDER:]], lengths + 1


def _counted(keys: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and how often each occurs (or the sum of its weights)."""
    if weight is None:
        keys = np.sort(keys)
        starts = run_starts(keys)
        return keys[starts], np.diff(np.append(starts, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = run_starts(keys)
    return keys[starts], np.add.reduceat(weight[order], starts) if len(starts) else np.empty(0, np.int64)


def _looked_up(table: np.ndarray, values: np.ndarray, keys: np.ndarray, default: float = 0) -> np.ndarray:
    if not len(table):
        return np.full(len(keys), default, values.dtype)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, values[at], default)


def _places_of(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands in the sorted ``table`` (it is there); looked up in sorted pieces, which stay in the cache."""
    out = np.empty(len(keys), np.int64)
    narrow = ORDER < 6 and (not len(table) or int(table[-1]) < 1 << 48)
    for at in range(0, len(keys), 1 << 16):
        part = keys[at : at + (1 << 16)]
        if narrow:  # key and position fit one word
            line = np.sort(part << np.uint64(16) | np.arange(len(part), dtype=np.uint64))
            order = (line & np.uint64(0xFFFF)).astype(np.int64)
            line >>= np.uint64(16)
        else:
            order = np.argsort(part)
            line = part[order]
        starts = run_starts(line)
        found = np.searchsorted(table, line[starts])
        out[at + order] = np.repeat(found, np.diff(np.append(starts, len(line))))
    return out


def _strides(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about STRIDE bytes."""
    a = 0
    n = len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STRIDE, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def _split(keys: np.ndarray, kind: int, parts: int) -> np.ndarray:
    """The part of each key; grams of one two-byte context stay together."""
    branch = keys if kind == WORD else mix64(keys >> np.uint64(8) & np.uint64(0xFFFF))
    return (branch % np.uint64(parts)).astype(np.int64)


def _merge(store: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    return _counted(np.concatenate([x[0] for x in store]), np.concatenate([x[1] for x in store]))


def _distinct(data: np.ndarray, offsets: np.ndarray, train: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct words and grams of some rows, sorted, with their training counts (0 for those of other rows only)."""
    stores: list[list] = [[], []]
    for a, b in _strides(data, offsets):
        part, at, learn = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], train[a:b]
        for kind, keys_of in ((WORD, word_keys), (GRAM, gram_keys)):
            keys, per_row = keys_of(part, at)
            mark = np.repeat(learn, per_row)
            seen, n = _counted(keys[mark])
            other, _ = _counted(keys[~mark])
            stores[kind].append((np.concatenate((seen, other)), np.concatenate((n, np.zeros(len(other), np.int64)))))
            if len(stores[kind]) > 8:
                stores[kind][:] = [_merge(stores[kind])]
    return [_merge(x) if x else (np.empty(0, np.uint64), np.empty(0, np.int64)) for x in stores]


def _bucket_blocks(parts: int):
    def run(docs: pa.Table) -> pa.Table:
        bucket = docs.column("bucket")[0].as_py()
        data, offsets = flat_text(_one(docs.column("text")))
        words, grams = _distinct(data, offsets, docs.column("train").to_numpy(zero_copy_only=False))
        rows: list[tuple] = []
        for kind, (keys, n) in enumerate((words, grams)):
            part = _split(keys, kind, parts)
            order = np.argsort(part, kind="stable")
            starts = run_starts(part[order])
            for a, b in zip(starts, np.append(starts[1:], len(order))[: len(starts)], strict=True):
                at = order[a:b]
                rows.append((int(part[at[0]]), bucket, kind, packed_keys(keys[at]), packed(n[at]), int(n[at].sum()), None))
        pair, n = _counted(grams[0] & np.uint64(0xFFFF), grams[1])
        some = n > 0
        rows.append((0, bucket, PAIR, b"", b"", 0, [{"pair": int(p), "n": int(c)} for p, c in zip(pair[some], n[some], strict=True)]))
        return pa.Table.from_pylist([dict(zip(_BLOCK.names, r, strict=True)) for r in rows], _BLOCK)

    return run


_BLOCK = pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("kind", pa.int8()), ("keys", pa.binary()), ("counts", pa.binary()), ("total", pa.int64()), ("pairs", pa.list_(pa.struct([("pair", pa.int32()), ("n", pa.int64())])))])
_BLOCK_SQL = "part int, bucket int, kind tinyint, keys binary, counts binary, total long, pairs array<struct<pair:int,n:long>>"


def _one(column: pa.ChunkedArray) -> pa.Array:
    column = column.combine_chunks()
    return column if not isinstance(column, pa.ChunkedArray) else (column.chunk(0) if column.num_chunks else pa.array([], column.type))


def code_lengths(grams: np.ndarray, counts: np.ndarray, pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the PPM probability of each distinct sorted gram.

    ``counts`` are training counts (0: only asked for). The grams of any context of two
    bytes must be here whole; ``pairs`` has the counts of all (one byte, symbol) grams.
    """
    mask = lambda k: np.uint64((1 << (8 * (k + 1))) - 1)
    seen = counts > 0
    level: list[tuple[np.ndarray, np.ndarray]] = [None] * (ORDER + 1)
    level[ORDER] = (grams[seen], counts[seen].astype(np.int64))
    for k in range(ORDER - 1, 1, -1):
        level[k] = _counted(level[k + 1][0] & mask(k))
    level[1] = pairs
    level[0] = _counted(pairs[0] & mask(0), pairs[1])
    # of each context: all counts, distinct symbols, and what its symbols count one level lower
    context = []
    for k in range(ORDER + 1):
        keys, n = level[k]
        names = keys >> np.uint64(8)
        starts = run_starts(names)
        if not len(starts):
            context.append((names, n, n, n))
            continue
        lower = _looked_up(*level[k - 1], keys & mask(k - 1)) if k else n
        context.append((names[starts], np.add.reduceat(n, starts), np.diff(np.append(starts, len(names))), np.add.reduceat(lower, starts)))
    out = np.zeros(len(grams))
    active = np.arange(len(grams))
    gone_n, gone_q = np.zeros(len(grams)), np.zeros(len(grams))  # excluded counts and symbols
    for k in range(ORDER, -1, -1):
        names, total, distinct, lower = context[k]
        key = grams[active] & mask(k)
        name = key >> np.uint64(8)
        n_c = _looked_up(names, total, name)
        q_c = _looked_up(names, distinct, name)
        n_s = _looked_up(*level[k], key)
        fresh = q_c - gone_q[active]
        whole = 2 * (n_c - gone_n[active])
        here = n_s > 0
        out[active[here]] += np.log10((2 * n_s[here] - 1) / whole[here])
        away = ~here & (fresh > 0)
        out[active[away]] += np.log10(fresh[away] / whole[away])
        known = q_c > 0
        gone_q[active[known]] = q_c[known]
        gone_n[active[known]] = _looked_up(names, lower, name)[known]
        active = active[~here]
    out[active] += -np.log10(np.maximum(SYMBOLS - gone_q[active], 1))
    return out


_ANSWER = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("part", pa.int32()), ("values", pa.binary()), ("known", pa.int64())])
_ANSWER_SQL = "bucket int, kind tinyint, part int, values binary, known long"


def _answers(pairs: tuple[np.ndarray, np.ndarray]):
    """Of one part of the key space: the corpus counts and code lengths for every bucket's block."""

    def run(blocks: pa.Table) -> pa.Table:
        rows = blocks.select(["part", "bucket", "kind", "keys", "counts"]).to_pylist()
        out: list[dict] = []
        for kind in (WORD, GRAM):
            own = [r for r in rows if r["kind"] == kind]
            if not own:
                continue
            keys = [unpacked_keys(r["keys"]) for r in own]
            all_keys, n = _counted(np.concatenate(keys), np.concatenate([unpacked(r["counts"], np.int64) for r in own]))
            values = n if kind == WORD else code_lengths(all_keys, n, pairs).astype(np.float32)
            for i, (r, k) in enumerate(zip(own, keys, strict=True)):
                out.append({"bucket": r["bucket"], "kind": kind, "part": r["part"], "values": packed(values[np.searchsorted(all_keys, k)]), "known": int((n > 0).sum()) if i == 0 and kind == WORD else 0})
        return pa.Table.from_pylist(out, _ANSWER)

    return run


def _scored(n_train: int, n_tokens: int, n_distinct: int, parts: int):
    scale = n_tokens + 0.5 * (n_distinct + 1)
    empty = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()

    def run(docs: pa.Table, model: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return empty
        data, offsets = flat_text(_one(docs.column("text")))
        train = docs.column("train").to_numpy(zero_copy_only=False)
        blocks = {(r["kind"], r["part"]): r["values"] for r in model.select(["kind", "part", "values"]).to_pylist()}
        tables = []
        for kind, (keys, _) in enumerate(_distinct(data, offsets, train)):
            part = _split(keys, kind, parts)
            order = np.argsort(part, kind="stable")
            starts = run_starts(part[order])
            got = [unpacked(blocks[kind, int(part[order[a]])], np.int64 if kind == WORD else np.float32) for a in starts]
            values = np.empty(len(keys))
            values[order] = np.concatenate(got) if got else np.empty(0)
            tables.append((keys, values))
        n_words, known, base, score = [], [], [], []
        for a, b in _strides(data, offsets):
            part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            keys, per_row = word_keys(part, at)
            c = tables[WORD][1][_places_of(tables[WORD][0], keys)]
            some = np.flatnonzero(per_row)
            begins = (np.cumsum(per_row) - per_row)[some]
            sums, hits = np.zeros(len(per_row)), np.zeros(len(per_row), np.int64)
            if len(some):
                sums[some] = np.add.reduceat(np.log10((c + 0.5) / scale), begins)
                hits[some] = np.add.reduceat((c > 0).astype(np.int64), begins)
            keys, grams = gram_keys(part, at)
            found = tables[GRAM][1][_places_of(tables[GRAM][0], keys)]
            n_words.append(per_row)
            known.append(hits)
            base.append(sums)
            score.append(np.add.reduceat(found, np.cumsum(grams) - grams))
        n = np.concatenate(n_words) + 1  # the end is a token too
        columns = [pa.array(~train), pa.array(n), pa.array(np.concatenate(known) + (n_train > 0)), pa.array(np.full(len(n), n_tokens)), pa.array(np.concatenate(base) + np.log10((n_train + 0.5) / scale)), pa.array(np.concatenate(score))]
        return pa.table([docs.column("doc_id"), *columns], names=empty.schema.names)

    return run


def ppm_scores(docs: DataFrame, train: str | None = None) -> DataFrame:
    """Score each row of ``docs`` (doc_id, text) by the model learnt from the rows where the SQL condition ``train`` holds.

    A text is its words, A-Z lower-cased, with one blank between two, and an end. Null,
    empty and blank texts are the end alone. Repeated rows count each; a null doc_id
    stays null. Without training rows every symbol has the uniform probability. Further
    columns are not read; an empty table gives an empty one. Words are told apart by a
    64-bit hash.
    """
    spark = docs.sparkSession
    rule = F.coalesce(F.expr(train), F.lit(False)) if train else F.lit(True)
    n_train, size = docs.agg(F.count_if(rule), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(shuffle_partitions(spark), -(-size // BUCKET))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), rule.alias("train"), "text")
    blocks = materialize(dealt.select("bucket", "train", "text").groupBy("bucket").applyInArrow(_bucket_blocks(parts), _BLOCK_SQL), "ppm-blocks")
    free_shuffles(spark)
    pairs = blocks.where(f"kind = {PAIR}").select(F.inline("pairs")).groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").toArrow()
    pairs = (pairs.column("pair").to_numpy().astype(np.uint64), pairs.column("n").to_numpy())
    answers = materialize(blocks.where(f"kind <> {PAIR}").drop("pairs", "total").groupBy("part").applyInArrow(_answers(pairs), _ANSWER_SQL), "ppm-answers")
    n_words = blocks.where(f"kind = {WORD}").agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    n_distinct = answers.agg(F.coalesce(F.sum("known"), F.lit(0))).first()[0]
    discard(blocks)
    free_shuffles(spark)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    score = _scored(n_train, int(n_words) + n_train, int(n_distinct) + (n_train > 0), parts)
    return dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(score, schema)


def op7_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log10 probability, learnt from those that aren't held out; nulls, repeats and empty tables as in ``ppm_scores``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ppm_scores(docs, "crc32(cast(doc_id as string)) % 5 <> 1")
