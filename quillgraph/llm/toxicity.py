"""Toxic passages by maximum-scoring segments of token log-odds.

A token scores the difference of its log-odds in toxic and other documents, smoothed by
an informative Dirichlet prior (its frequency in the whole sample). Tokens are words and
their beginnings: a word scores as the longest of its beginnings, itself first, whose
likelihood ratio isn't what chance gives the best of all tokens tested. All maximal segments of a text are found in
one pass (linear time); their scores follow an extreme-value law in clean text, which
turns the best segments into a probability. Token counts are a Spark aggregation over the
sample; a third of its clean documents isn't counted, and the law is fitted on these. The
driver gets the tokens that score and the law's two moments, never a text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.arrays import LOWER, text_slices
from quillgraph.llm.labelled import labelled_sample
from quillgraph.scratch import discard, materialize

#: Documents of each class that is learnt from, at most.
PER_CLASS = 3000
#: One clean document of so many tells the extreme-value law.
LAW_SHARE = 3
#: Words whose scores a worker remembers.
MEMO = 400_000
#: Mass of the Dirichlet prior, in documents.
PRIOR_DOCS = 20.0
#: Characters of the beginnings that stand for words too rare to score themselves.
STEMS = (8, 7, 6, 5, 4)
#: Documents that a token must occur in, at least.
MIN_DOCS = 3
#: A token's root likelihood ratio must be this far above the largest of as many normal draws as tokens are tested.
MARGIN = 1.0
#: Cost of a background token, and of leaving a segment.
BACKGROUND = -0.05
#: Least tail of the extreme-value law that counts as significant.
SIGNIFICANT = 0.01

_TRIM = b".,;:!?\"'()[]{}<>|*#%&$-_"


def tokens(text: bytes) -> list[bytes]:
    return [w.strip(_TRIM) for w in text.translate(LOWER).split()]


def units(word: bytes) -> list[bytes]:
    """The word and its beginnings, longest first; a beginning is marked by a zero byte, which no token holds."""
    if len(word) <= STEMS[-1]:
        return [word]
    text = word.decode("utf-8", "ignore")
    return [word, *(text[:k].encode() + b"\0" for k in STEMS if len(text) > k)]


class Odds(NamedTuple):
    """What is broadcast: the scores of the tokens that pass the test in the bounded sample, the extreme-value law and the labels' share."""

    scores: dict[bytes, float]
    location: float
    scale: float
    prior: float


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """(begin, end, score) of all maximal-scoring segments, left to right, in linear time."""
    stack: list[list] = []  # begin, end, total before, total after
    total = 0.0
    for i, x in enumerate(scores):
        if x <= 0:
            total += x
            continue
        item = [i, i + 1, total, total + x]
        total += x
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= item[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= item[3]:
                item.append(j)
                stack.append(item)
                break
            item = [stack[j][0], item[1], stack[j][2], item[3]]
            del stack[j:]
    return [(a, b, after - before) for a, b, before, after, _ in stack]


def segments(odds: Odds, words: list[bytes], known: dict[bytes, float | None]) -> list[tuple[int, int, float]]:
    """Maximal segments of a text; stretches of background are one step each, and a token that repeats the one before is background. ``known`` remembers words."""
    get = odds.scores.get
    if len(known) > MEMO:
        known.clear()
    for w in set(words):
        if w not in known:
            known[w] = next((s for s in map(get, units(w)) if s is not None), None)
    marked = [(i, s) for i, s in enumerate(map(known.get, words)) if s is not None and not (i and words[i] == words[i - 1])]
    if not any(s > 0 for _, s in marked):
        return []
    steps, where, at = [], [], 0
    for i, s in marked:
        if i > at:
            steps.append(BACKGROUND * (i - at))
            where.append(at)
        steps.append(s)
        where.append(i)
        at = i + 1
    where.append(at)
    return [(where[a], where[b - 1] + 1, s) for a, b, s in maximal_segments(steps)]


def tail(odds: Odds, score: float, length: int) -> float:
    """Probability that a clean text of this length has a segment of this score."""
    if score <= 0:
        return 1.0
    expected = np.exp(-(score - odds.location) / odds.scale) * max(length, 1) / 100
    return float(-np.expm1(-expected))


def probability(odds: Odds, p: float) -> float:
    """From the tail to a posterior: the Bayes factor -e p ln p at the labels' share."""
    p = max(p, 1e-12)
    against = -np.e * p * np.log(p) if p < 1 / np.e else 1.0 + 4 * (p - 1 / np.e)
    prior = min(max(odds.prior, 0.01), 0.5)
    return float(prior / (prior + (1 - prior) * against))


def root_ratio(c0: int, c1: int, n: list[int]) -> float:
    """Root of twice the log-likelihood ratio of a token's document counts in the two classes against one common rate."""
    whole, size = c0 + c1, n[0] + n[1]
    cells = ((c0, n[0] * whole / size), (c1, n[1] * whole / size), (n[0] - c0, n[0] * (size - whole) / size), (n[1] - c1, n[1] * (size - whole) / size))
    return math.sqrt(max(2 * sum(o * math.log(o / e) for o, e in cells if o > 0 and e > 0), 0.0))


def token_scores(counts: dict[bytes, tuple[int, int]], n: list[int], n_tested: int) -> dict[bytes, float]:
    """Log-odds of the tokens whose likelihood ratio stands out; ``counts`` are documents of class 0 and 1."""
    least = math.sqrt(2 * math.log(max(n_tested, 2))) + MARGIN
    scores = {}
    for u, (c0, c1) in sorted(counts.items()):
        if root_ratio(c0, c1, n) >= least:
            a = PRIOR_DOCS * (c0 + c1 + 0.5) / (n[0] + n[1] + 1)
            y1, y0 = c1 + a, c0 + a
            scores[u] = math.log(y1 / (n[1] + PRIOR_DOCS - y1)) - math.log(y0 / (n[0] + PRIOR_DOCS - y0))
    return scores


def _units(sample: DataFrame) -> DataFrame:
    """(shape, label, unit): the distinct tokens of each document; shape is a hash of its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), text_slices(batch.column(1)), strict=True):
                words = {w for w in tokens(text) if w}
                shape = xxhash.xxh3_64_intdigest(b" ".join(sorted(words))) >> 1
                found = list({u for w in words for u in units(w)}) or [b""]
                yield pa.record_batch([pa.array([shape] * len(found), pa.int64()), pa.array([label] * len(found), pa.int32()), pa.array(found, pa.binary())], names=["shape", "label", "unit"])

    return sample.select("label", "text").mapInArrow(run, "shape long, label int, unit binary")


def _clean_maxima(clean: DataFrame, odds: Odds) -> DataFrame:
    """(best): the best segment's score of each text, less what its length gives."""
    shared = clean.sparkSession.sparkContext.broadcast(odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, float | None] = {}
        for batch in batches:
            found = [tokens(t) for t in text_slices(batch.column(0))]
            best = [max((s for _, _, s in segments(shared.value, w, known)), default=0.0) - math.log(max(len(w), 1) / 100) for w in found]
            yield pa.record_batch([pa.array(best, pa.float64())], names=["best"])

    return clean.select("text").mapInArrow(run, "best double")


def toxic_odds(docs: DataFrame, labels: DataFrame, label: str = "toxic", train: str | None = None, per_class: int = PER_CLASS) -> Odds:
    """Learns from at most ``per_class`` documents of each label whose doc_id meets the SQL condition ``train``.

    Copies of one text are one witness, of the smaller label. Without documents of both
    labels no token scores.
    """
    sample, sizes = labelled_sample(docs, labels, label, train, per_class, "text")
    sample = materialize(sample.select("doc_id", "label", "text"), "toxic-sample")
    prior = sizes.get(1, 0) / max(sum(sizes.values()), 1)
    law = (F.col("label") == 0) & (F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(LAW_SHARE)) == 0)
    units_of = materialize(_units(sample.where(~law)), "toxic-units")
    firsts = units_of.groupBy("shape").agg(F.min("label").alias("first"))
    n = [0, 0]
    for r in firsts.groupBy("first").count().collect():
        n[r["first"]] = r["count"]
    odds = Odds({}, 1.0, 1.0, prior)
    if all(n):
        seen = units_of.join(firsts, "shape").where("label = first and unit <> X''").select("shape", "label", "unit").distinct()
        counts = seen.groupBy("unit").agg(F.count_if(F.col("label") == 0).alias("c0"), F.count_if(F.col("label") == 1).alias("c1"))
        counts = materialize(counts.where(F.col("c0") + F.col("c1") >= MIN_DOCS), "toxic-counts")
        n_tested = counts.count()
        of = lambda o, e: F.when(o > 0, o * F.log(o / e)).otherwise(0.0)
        c0, c1, size = F.col("c0"), F.col("c1"), n[0] + n[1]
        ratio = of(c0, (c0 + c1) * (n[0] / size)) + of(c1, (c0 + c1) * (n[1] / size)) + of(n[0] - c0, (size - c0 - c1) * (n[0] / size)) + of(n[1] - c1, (size - c0 - c1) * (n[1] / size))
        near = (math.sqrt(2 * math.log(max(n_tested, 2))) + MARGIN) ** 2 / 2
        passing = counts.where(ratio >= near * (1 - 1e-9)).toArrow()  # those that score; a token in chance's reach stays
        got = zip(passing.column("unit").to_pylist(), zip(passing.column("c0").to_pylist(), passing.column("c1").to_pylist(), strict=True), strict=True)
        odds = odds._replace(scores=token_scores(dict(got), n, n_tested))
        discard(counts)
        # method of moments of the Gumbel law of clean maxima, over texts of 100 tokens
        mean, deviation = _clean_maxima(sample.where(law), odds).agg(F.avg("best"), F.stddev_pop("best")).first()
        if mean is not None:
            scale = max(deviation * math.sqrt(6) / math.pi, 0.25)
            odds = odds._replace(location=mean - 0.5772 * scale, scale=scale)
    discard(sample, units_of)
    return odds


def toxic_passages(docs: DataFrame, odds: Odds) -> DataFrame:
    """(doc_id, score, n_passages, passages) for each row of ``docs``; passages are (begin, end, score) in words, the significant ones.

    Null and empty texts have no passage and the least score. Repeated rows are kept;
    further columns are not read; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(odds)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, known = shared.value, {}
        for batch in batches:
            scores, passages = [], []
            for text in text_slices(batch.column(1)):
                words = tokens(text)
                found = segments(odds, words, known)
                best = max((s for _, _, s in found), default=0.0)
                scores.append(probability(odds, tail(odds, best, len(words))))
                passages.append([{"begin": a, "end": b, "score": s} for a, b, s in found if tail(odds, s, len(words)) <= SIGNIFICANT])
            yield pa.record_batch([batch.column(0), pa.array(scores, pa.float64()), pa.array([len(x) for x in passages], pa.int64()), pa.array(passages, kind)], names=["doc_id", "score", "n_passages", "passages"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, n_passages long, passages array<struct<begin:long,end:long,score:double>>")


HELD_OUT = "crc32(cast(doc_id as string)) % 4 = 2"


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity, learnt from the labelled ones that aren't held out; nulls, repeats and empty tables as in ``toxic_passages``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odds = toxic_odds(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train=f"not ({HELD_OUT})")
    found = toxic_passages(docs, odds)
    return found.select("doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_passages")
