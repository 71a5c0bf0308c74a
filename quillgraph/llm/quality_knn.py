"""Quality by nearest-neighbour voting in a latent-semantic space.

A text's terms are its byte pairs (hashed) and a few marks of its shape: how much of it
repeats, how long its words are. Their damped, idf-weighted frequencies are projected
onto the leading singular vectors of a bounded sample of labelled documents. The sample's
vectors are broadcast (at most 2 * per_class of them); every document takes the exact
cosine with all of them, a block of documents at a time, and its nearest neighbours vote
with their similarity. A class's votes are scaled to its share of all labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.arrays import text_slices
from quillgraph.llm.labelled import labelled_sample

#: Documents of each class that the space and the votes are learnt from, at most.
PER_CLASS = 1500
PAIR_TERMS = 1024
SHAPE_LEVELS = 8
SHAPES = 5
TERMS = PAIR_TERMS + SHAPE_LEVELS * SHAPES
DIMENSIONS = 48
NEIGHBOURS = 15
#: Documents whose cosines are taken at once.
BLOCK = 1024
#: Weight of a shape mark; the byte pairs together have weight 1.
SHAPE_WEIGHT = 0.25
#: Similarities no further apart are equal.
TIE = 1e-6
#: Votes that the classes' shares add.
PRIOR_VOTES = 0.5

_SLOT = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)


def _level(share: float) -> int:
    return min(SHAPE_LEVELS - 1, int(share * SHAPE_LEVELS))


def terms(text: bytes) -> np.ndarray:
    """Damped term frequencies of a whole text."""
    out = np.zeros(TERMS, np.float32)
    raw = np.frombuffer(text, np.uint8)
    if len(raw) > 1:
        pairs = raw[:-1].astype(np.int32) << 8 | raw[1:]
        counts = np.bincount(_SLOT[pairs], minlength=PAIR_TERMS)[:PAIR_TERMS]
        out[:PAIR_TERMS] = np.sqrt(counts / len(pairs))
    words = text.split()
    if words:
        lines = [x for x in text.split(b"\n") if x.strip()]
        neighbours = sum(map(bytes.__eq__, words, words[1:])) / len(words)
        letters = len(raw) - text.count(b" ")
        marks = (
            _level(1 - len(set(words)) / len(words)),
            _level(neighbours),
            _level(1 - len(set(lines)) / max(len(lines), 1)),
            _level(np.log2(1 + letters / len(words)) / 8),
            _level(np.log2(1 + len(words)) / 16),
        )
        for k, level in enumerate(marks):
            out[PAIR_TERMS + k * SHAPE_LEVELS + level] = SHAPE_WEIGHT
    return out


class Space(NamedTuple):
    """What is broadcast: the projection, the neighbours' unit vectors, and each one's votes for class 0 and 1."""

    project: np.ndarray
    vectors: np.ndarray
    votes: np.ndarray
    prior: float


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(rows: np.ndarray, labels: np.ndarray, sizes: dict[int, int]) -> Space:
    """The latent space of the sample; without labels every score is one half."""
    if not len(rows):
        return Space(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros((0, 2), np.float32), 0.5)
    present = (rows > 0).mean(0)
    idf = np.log((1 + len(rows)) / (1 + present * len(rows))) + 1
    weighted = rows * idf
    gram = weighted.T.astype(np.float64) @ weighted
    _, vectors = np.linalg.eigh(gram)
    project = (idf[:, None] * vectors[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
    whole = sum(sizes.values())
    votes = np.zeros((len(rows), 2), np.float32)
    for k in (0, 1):
        own = labels == k
        votes[own, k] = sizes.get(k, 0) / max(int(own.sum()), 1)
    votes /= votes.max()
    return Space(project, _unit(rows @ project), votes, sizes.get(1, 0) / max(whole, 1))


def vote(space: Space, rows: np.ndarray) -> np.ndarray:
    """The weighted share of class 1 among each row's nearest neighbours."""
    if not len(space.vectors):
        return np.full(len(rows), space.prior)
    cosine = _unit(rows @ space.project) @ space.vectors.T
    k = min(NEIGHBOURS, len(space.vectors))
    near = np.argpartition(cosine, -k, axis=1)[:, -k:]
    similar = np.take_along_axis(cosine, near, 1)
    weight = np.maximum(similar, 0) ** 8
    for_0 = (weight * space.votes[near, 0]).sum(1)
    for_1 = (weight * space.votes[near, 1]).sum(1)
    last = similar.min(1)
    for i in np.flatnonzero((cosine >= last[:, None] - TIE).sum(1) > k):  # the last places are shared by all who tie for them
        above, level = cosine[i] > last[i] + TIE, np.abs(cosine[i] - last[i]) <= TIE
        share = (above + level * (k - above.sum()) / level.sum()) * np.maximum(cosine[i], 0) ** 8
        for_0[i], for_1[i] = share @ space.votes
    unit = PRIOR_VOTES * space.votes.max(0).min()
    return (for_1 + unit * space.prior) / (for_0 + for_1 + unit)


def _term_rows(batch: pa.RecordBatch, at: int) -> np.ndarray:
    found = [terms(t) for t in text_slices(batch.column(at))]
    return np.stack(found) if found else np.empty((0, TERMS), np.float32)


def quality_space(docs: DataFrame, labels: DataFrame, label: str = "quality", train: str | None = None, per_class: int = PER_CLASS) -> Space:
    """Learns the space from at most ``per_class`` documents of each label whose doc_id meets the SQL condition ``train``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _term_rows(batch, 2).astype(np.float16)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], names=["doc_id", "label", "terms"])

    sample, sizes = labelled_sample(docs, labels, label, train, per_class, "text")
    got = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, terms binary").toArrow().sort_by([("doc_id", "ascending"), ("terms", "ascending")])
    rows = np.frombuffer(b"".join(got.column("terms").to_pylist()), np.float16).reshape(-1, TERMS).astype(np.float32)
    return fit(rows, got.column("label").to_numpy(), sizes)


def quality_scores(docs: DataFrame, space: Space) -> DataFrame:
    """(doc_id, score) for each row of ``docs`` (doc_id, text); score is the share of votes for label 1.

    Null and empty texts have no direction and get the labels' share. Neighbours that tie
    for the last places share them. Repeated rows are kept, a null doc_id stays; further
    columns are not read; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield pa.record_batch([part.column(0), pa.array(vote(shared.value, _term_rows(part, 1)).astype(np.float64))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def good_documents(docs: DataFrame, space: Space, cutoff: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, whose score is at least ``cutoff``; nulls, ties, repeats and empty tables as in ``quality_scores``."""
    shared = docs.sparkSession.sparkContext.broadcast(space)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.schema.get_field_index("text")
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield part.filter(pa.array(vote(shared.value, _term_rows(part, text)) >= cutoff))

    return docs.mapInArrow(run, docs.schema)


HELD_OUT = "crc32(cast(doc_id as string)) % 5 = 0"


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality, learnt from the labelled ones that aren't held out; nulls, repeats and empty tables as in ``quality_scores``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space = quality_space(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train=f"not ({HELD_OUT})")
    scores = quality_scores(docs, space)
    return scores.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
