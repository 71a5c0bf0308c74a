"""Token counts of whole texts, long documents by overlapping chunks.

A text up to ``chunk`` characters is counted at once; where the tokenizer's definition
proves that no token reaches over a blank, as the sum over its words. A longer one is
encoded in chunks that overlap; each chunk gives its tokens' offsets. Two neighbours are
spliced at a position of their overlap where both have a token boundary and around which,
for a third of the overlap, both give the same tokens at the same offsets: the encoder has
resynchronised there. A boundary counts as proven only if it lies at a blank, which these
tokenizers never join to what stands before it. Where no such boundary exists the overlap
is doubled, up to the whole chunk, and then the chunks are.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.arrays import flat_text

#: Characters of a chunk, and of the overlap of two.
CHUNK = 1 << 14
OVERLAP = 1 << 9
BLANKS = " \n"
#: Characters of a batch that the encoder gets at once.
GROUP = 4 << 20

#: Distinct words that a worker remembers.
MEMO = 400_000
#: Times that a word comes in a batch before it is remembered.
AGAIN = 5

_loaded: dict[str, object] = {}
_alone: dict[str, bool] = {}
_memo: dict[str, dict[str, int]] = {}


def _encoder(name: str):
    """The tokenizer of a worker, loaded once."""
    if name not in _loaded:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        path = public_tokenizers.path(name)
        if name.endswith(".model"):
            import sentencepiece

            _loaded[name] = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            _loaded[name] = Tokenizer.from_file(path)
            _loaded[name].no_truncation()
            _loaded[name].no_padding()
    return _loaded[name]


def words_stand_alone(name: str) -> bool:
    """Whether the tokenizer's own definition drops white space and works character by character before it splits.

    Then a blank or line feed is a proven boundary: no token and no merge reaches over it.
    """
    if not name.endswith(".json"):
        return False
    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        rules = json.load(f)
    steps = (rules["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = steps[0] if steps else {}
    dropped = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and "^\\s" in str(split.get("pattern", {}).get("Regex"))
    normal = {x["type"] for x in (rules["normalizer"] or {}).get("normalizers", [])} <= {"NFC", "Lowercase", "Replace"}
    added = all(not re.search(r"\s", x["content"]) and not x["lstrip"] and not x["rstrip"] for x in rules["added_tokens"])
    return bool(dropped and normal and added)


def _count_words(name: str, texts: list[str]) -> list[int]:
    """Token counts as sums over words: words that come again are remembered, a text's other words are encoded as one line."""
    known = _memo.setdefault(name, {})
    if len(known) > MEMO:
        known.clear()
    encode = lambda x: [len(e.ids) for e in _encoder(name).encode_batch_fast(x, add_special_tokens=False)]
    parts = [t.replace("\n", " ").split(" ") for t in texts]
    rest = [[w for w in p if w not in known] for p in parts]
    again = [w for w, n in Counter(chain.from_iterable(rest)).items() if n >= AGAIN]
    known.update(zip(again, encode(again), strict=True))
    lines = encode([" ".join(w for w in r if w not in known) for r in rest])
    return [n + sum(known[w] for w in p if w in known) for n, p in zip(lines, parts, strict=True)]


def _count_batch(name: str, texts: list[str]) -> list[int]:
    if name not in _alone:
        _alone[name] = words_stand_alone(name)
    if _alone[name]:
        return _count_words(name, texts)
    model = _encoder(name)
    if name.endswith(".model"):
        return [len(x) for x in model.encode(texts, num_threads=1)]
    return [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]


def _with_offsets(name: str, text: str, at: int) -> np.ndarray:
    """Rows start, end, id of each token; places count characters, the text's first one being ``at``."""
    if name.endswith(".model"):
        found = _encoder(name).encode(text, return_type="proto").pieces
        raw = np.frombuffer(text.encode(), np.uint8)
        before = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # this library's places are bytes
        rows = [(before[x.begin], before[x.end], x.id) for x in found]
    else:
        found = _encoder(name).encode(text, add_special_tokens=False)
        rows = [(a, b, i) for (a, b), i in zip(found.offsets, found.ids, strict=True)]
    return np.array(rows, np.int64).reshape(-1, 3).T + np.array([[at], [at], [0]])


def count_long(name: str, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int, int]:
    """Tokens of a long text by overlapping chunks, spliced where both agree; how many chunks, how often an overlap was widened."""
    if len(text) <= chunk:
        return _count_batch(name, [text])[0], 1, 0
    total, chunks, widened = 0, 1, 0
    at, end, keep_from = 0, chunk, 0  # tokens that begin at keep_from or later aren't counted yet
    left = _with_offsets(name, text[:chunk], 0)
    while end < len(text):
        wide = overlap
        while True:
            begin = max(at, end - wide)
            right_end = min(len(text), begin + chunk + wide)
            right = _with_offsets(name, text[begin:right_end], begin)
            splice = _boundary(text, left, right, max(begin, keep_from), end)
            if splice is not None:
                break
            widened += 1
            if begin == at:  # no boundary in the whole chunk: the text anew, in larger chunks
                n, chunks, wider = count_long(name, text, chunk * 2, overlap)
                return n, chunks, widened + wider
            wide *= 2
        total += int(((left[0] >= keep_from) & (left[0] < splice)).sum())
        keep_from, at, left, end, chunks = splice, begin, right, right_end, chunks + 1
    return total + int((left[0] >= keep_from).sum()), chunks, widened


def _boundary(text: str, left: np.ndarray, right: np.ndarray, lo: int, hi: int) -> int | None:
    """Where a token begins at or after a blank, in the middle of [lo, hi), where both chunks give the same tokens."""
    third = (hi - lo) // 3
    near = [x[:, np.searchsorted(x[0], lo + third) : np.searchsorted(x[0], hi - third)] for x in (left, right)]
    if near[0].shape != near[1].shape or (near[0] != near[1]).any():
        return None
    starts, ends, _ = near[0]
    for k in range(max(1, int(np.searchsorted(starts, (lo + hi) // 2))), len(starts)):
        p = int(starts[k])
        if starts[k - 1] < p and ends[:k].max() <= p and (text[p - 1] in BLANKS and ends[:k].max() < p or text[p] in BLANKS and text[p - 1] not in BLANKS):
            return p
    return None


def token_counts(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_chunks, n_widened) for each row of ``docs``.

    Null and empty texts have no bytes and no tokens. Texts of more than ``chunk``
    characters are encoded in n_chunks chunks; others have 1. Repeated rows are kept, a
    null doc_id stays; other columns are not read; an empty table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            _, offsets = flat_text(batch.column(1))
            counts, chunks, widened = [0] * len(texts), [1] * len(texts), [0] * len(texts)
            group, held = [], 0
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    counts[i], chunks[i], widened[i] = count_long(tokenizer, t, chunk, overlap)
                    continue
                group.append(i)
                held += len(t)
                if held > GROUP:
                    for k, n in zip(group, _count_batch(tokenizer, [texts[k] for k in group]), strict=True):
                        counts[k] = n
                    group, held = [], 0
            if group:
                for k, n in zip(group, _count_batch(tokenizer, [texts[k] for k in group]), strict=True):
                    counts[k] = n
            yield pa.record_batch([batch.column(0), *(pa.array(x, pa.int64()) for x in (np.diff(offsets), counts, chunks, widened))], names=["doc_id", "n_bytes", "n_tokens", "n_chunks", "n_widened"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_chunks long, n_widened long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document by word_bpe_49k.json; nulls, repeats and empty tables as in ``token_counts``."""
    counts = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"), "n_chunks", "n_widened")
