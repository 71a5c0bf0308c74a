"""Mixing sources to target weights by temperature; DataFrame functions only.

A source's weight is its token share to the power of an exponent between 0 (all alike)
and 1 (as they are), normalised. The exponent is found by bisection, sixteen parts a
round: the largest that reaches the target entropy, raised if need be until no source is
repeated more than the limit. Each round is one aggregate over the table of sources.

The weights are realised as whole epochs and one partial epoch of each source. A source
is dealt into blocks by hash; an epoch visits the blocks in an order of its own. The
partial epoch takes blocks in that order while the budget lasts, and of the block that
crosses it the documents in hash order. Running sums go over the blocks of a source (at
most BLOCKS rows) and the documents of one block, never over a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.scratch import materialize

#: Share of the highest entropy that the mixture reaches, and the most repetitions of a source.
ENTROPY = 0.9999
MAX_REPEAT = 4.0
BLOCKS = 4096
BLOCK_DOCS = 256
ROUNDS = 6
SEED = 10


def tokens_of(text: str = "text") -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _measured(shares: DataFrame, exponents: list[float], repeat: float) -> list[tuple[float, float]]:
    """(entropy, highest repetition) for each exponent; ``repeat`` is the budget over all tokens."""
    x = F.col("share")
    sums = []
    for k, a in enumerate(exponents):
        power = F.pow(x, F.lit(a))
        sums += [F.sum(power).alias(f"s{k}"), F.sum(power * F.log(x)).alias(f"l{k}"), F.max(F.pow(x, F.lit(a - 1))).alias(f"m{k}")]
    r = shares.agg(*sums).first()
    return [(math.log(r[f"s{k}"]) - a * r[f"l{k}"] / r[f"s{k}"], r[f"m{k}"] / r[f"s{k}"] * repeat) for k, a in enumerate(exponents)]


def _bisected(shares: DataFrame, repeat: float, holds, largest: bool) -> float:
    """The largest (or smallest) exponent in [0, 1] at which ``holds``, monotone in it; the bound where none does."""
    lo, hi = 0.0, 1.0
    ends = _measured(shares, [lo, hi], repeat)
    if largest and holds(*ends[1]):
        return 1.0
    if not largest and holds(*ends[0]):
        return 0.0
    if largest and not holds(*ends[0]) or not largest and not holds(*ends[1]):
        return 0.0 if largest else 1.0
    for _ in range(ROUNDS):
        points = [lo + (hi - lo) * k / 16 for k in range(17)]
        good = [True, *(holds(*m) for m in _measured(shares, points[1:16], repeat)), False] if largest else [False, *(holds(*m) for m in _measured(shares, points[1:16], repeat)), True]
        k = good.index(False) if largest else good.index(True)
        lo, hi = points[k - 1], points[k]
    return lo if largest else hi


def source_weights(sized: DataFrame, entropy: float | None, max_repeat: float | None, budget: float | None) -> DataFrame:
    """(source, n_docs, tokens, weight, exponent, target) of the sources that have tokens."""
    spark = sized.sparkSession
    totals = materialize(sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs")).where("tokens > 0"), "sources")
    whole, n = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count("*")).first()
    if not n:
        return spark.createDataFrame([], "source string, n_docs long, tokens long, weight double, exponent double, target double")
    budget = float(whole) if budget is None else float(budget)
    repeat = budget / whole
    shares = totals.withColumn("share", F.col("tokens") / F.lit(float(whole)))
    exponent = 1.0
    if entropy is not None:
        exponent = _bisected(shares, repeat, lambda h, _: h >= entropy * math.log(n) - 1e-12, largest=True)
    if max_repeat is not None and n > 1:
        least = _bisected(shares, repeat, lambda _, r: r <= max(max_repeat, repeat) + 1e-12, largest=False)
        exponent = max(exponent, least) if entropy is not None else least
    scale = shares.agg(F.sum(F.pow("share", F.lit(exponent)))).first()[0]
    weight = F.pow("share", F.lit(exponent)) / F.lit(scale)
    return shares.select("source", "n_docs", "tokens", weight.alias("weight"), F.lit(exponent).alias("exponent"), (weight * F.lit(budget)).alias("target"))


def mixed(docs: DataFrame, entropy: float | None = ENTROPY, max_repeat: float | None = MAX_REPEAT, budget: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, weight, copies, block, place) for each row of ``docs`` (doc_id, source, text).

    ``entropy`` is a share of the highest possible one; ``budget`` counts tokens (None: as
    many as there are). copies is how often the document is in the mixture, 0 included;
    place orders a source's blocks in the partial epoch. A null source is a source of its
    own; texts without words have no tokens and come with the whole epochs only; sources
    without tokens get weight and copies 0. Rows are dealt by doc_id and text, so rows that
    share a doc_id or have none don't meet in one block; repeated rows count each. An
    empty table gives an empty one; further columns are not read.
    """
    key = F.xxhash64("doc_id", "text", F.lit(SEED)).alias("key")
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), tokens_of().alias("n_tokens"), key), "sized")
    weights = source_weights(sized, entropy, max_repeat, budget)
    repeat = F.col("target") / F.col("tokens")
    plan = materialize(weights.select(F.col("source").alias("of"), "weight", F.floor(repeat).alias("whole"), ((repeat - F.floor(repeat)) * F.col("tokens")).alias("rest"), F.least(F.lit(BLOCKS), F.ceil(F.col("n_docs") / BLOCK_DOCS)).alias("blocks")), "mix-plan")
    dealt = sized.join(plan, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    dealt = dealt.withColumn("block", F.coalesce(F.pmod("key", "blocks"), F.lit(0)).cast("int"))
    dealt = dealt.withColumn("place", F.xxhash64("source", "whole", "block", F.lit(SEED)))
    turn = Window.partitionBy("source").orderBy("place", "block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = dealt.where("rest > 0").groupBy("source", "block", "place", "rest").agg(F.sum("n_tokens").alias("size"))
    blocks = blocks.withColumn("end", F.sum("size").over(turn)).withColumn("begin", F.col("end") - F.col("size"))
    blocks = materialize(blocks.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("begin"), (F.col("end") <= F.col("rest")).alias("inside"), ((F.col("begin") < F.col("rest")) & (F.col("end") > F.col("rest"))).alias("crosses")), "mix-blocks")
    placed = dealt.join(blocks, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b")), "left").drop("s", "b")
    inner = Window.partitionBy("source", "block").orderBy(F.xxhash64("key", "whole"), "key", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = placed.where("crosses").withColumn("run", F.sum("n_tokens").over(inner)).withColumn("more", ((F.col("begin") + F.col("run") <= F.col("rest")) & (F.col("n_tokens") > 0)).cast("long")).drop("run")
    rest = placed.where("crosses is null or not crosses").withColumn("more", F.coalesce((F.col("inside") & (F.col("n_tokens") > 0)).cast("long"), F.lit(0)))
    both = cut.unionByName(rest)
    return both.select("doc_id", "source", "n_tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), (F.coalesce("whole", F.lit(0)) + F.col("more")).alias("copies"), "block", "place")


def realised(mix: DataFrame) -> DataFrame:
    """A row for each copy: (doc_id, source, n_tokens, epoch, place), place ordering the blocks of every epoch."""
    copies = mix.where("copies > 0").select("doc_id", "source", "n_tokens", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch"))
    return copies.select("doc_id", "source", "n_tokens", "epoch", F.xxhash64("source", "epoch", "block", F.lit(SEED)).alias("place"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's copies in the mixture of sources; nulls, repeats and empty tables as in ``mixed``."""
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
