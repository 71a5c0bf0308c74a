"""Quality rules with adaptive thresholds.

Per document the counts of the fixed base rule and the ratios that the adaptive rules
judge are taken once. Per language and source a mergeable quantile sketch (KLL) of each
ratio gives the median and the upper decile; the cutoff is the upper decile plus a
multiple of their distance, never over a ceiling that no prose reaches, so a source full
of junk cannot raise it without bound. There is no lower bound: where nine documents of
ten have none of a thing, the cutoff is 0. A document may have one event above its
cutoff, as one tells nothing of it. The cutoffs are joined to the documents and filter them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.arrays import text_slices
from quillgraph.scratch import materialize

#: Fixed values of the base rule.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Ratio: (count, of what, ceiling of its cutoff, count of one event). Three words said twice are six repeated words.
RATIOS = {
    "symbol_ratio": ("n_symbols", "word_chars", 0.05, 1),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 0.40, 1),
    "repeat_ratio": ("n_repeat_words", "n_words", 0.30, 6),
    "upper_ratio": ("n_upper", "word_chars", 0.30, 1),
    "bang_ratio": ("n_bang", "n_words", 0.10, 1),
}
SPREAD = 3.0

_MULTI = re.compile(rb"[\x80-\xbf]")


def measure(text: bytes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_bang."""
    words = text.split()
    n = len(words)
    if not n:
        return 0, 0, sum(map(text.count, [SYMBOLS[i : i + 1] for i in range(8)])), 0, 0, 0, 0, 0
    joined = b"".join(words)
    chars = len(joined) - (0 if joined.isascii() else len(_MULTI.findall(joined)))
    symbols = sum(joined.count(SYMBOLS[i : i + 1]) for i in range(8))
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    dups = len(lines) - len(set(lines))
    repeats = _repeat_words(words)
    letters = joined.decode("utf-8", "ignore")
    upper = sum(1 for w in letters if w.isupper()) if not joined.islower() else 0
    bang = joined.count(b"!") + joined.count(b"?")
    return n, chars, symbols, dups, repeats, len(lines), upper, bang


def _repeat_words(words: list[bytes]) -> int:
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    twice = np.fromiter((seen[w] > 1 for w in windows), bool, len(windows))
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(windows)] |= twice
    return int(covered.sum())


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_bang")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t) for t in text_slices(batch.column(3))], np.int64).reshape(-1, len(COLUMNS))
            yield pa.record_batch([*(batch.column(i) for i in range(3)), *(pa.array(rows[:, i]) for i in range(len(COLUMNS)))], names=["doc_id", "lang", "source", *COLUMNS])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return picked.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COLUMNS))


def quality_rules(docs: DataFrame, spread: float = SPREAD) -> DataFrame:
    """The counts, the ratios, their cutoffs, base_failed and kept, one row per row of ``docs``.

    Null and empty texts have no words and fail the base rule. Null languages or sources
    form a group of their own. Ties at a cutoff are kept. Repeated rows count each; an
    empty table gives an empty one; further columns are not read.
    """
    counts = materialize(measured(docs), "rules")
    of = {r: F.greatest(F.col(whole), F.lit(1)) for r, (_, whole, _, _) in RATIOS.items()}
    rated = counts.select("*", *((F.col(n) / of[r]).alias(r) for r, (n, _, _, _) in RATIOS.items()))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rated = rated.withColumn("base_failed", base_failed)
    sketches = rated.where(~F.col("base_failed")).groupBy("lang", "source").agg(*(F.kll_sketch_agg_double(r).alias(r) for r in RATIOS))
    at = lambda r, q: F.kll_sketch_get_quantile_double(r, F.lit(q))
    cutoffs = sketches.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(F.least(F.lit(top), at(r, 0.9) + spread * (at(r, 0.9) - at(r, 0.5))).alias(f"max_{r}") for r, (_, _, top, _) in RATIOS.items()))
    joined = rated.join(cutoffs, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left").drop("g_lang", "g_source")
    passes = F.lit(True)
    for r, (n, _, _, one) in RATIOS.items():
        within = (F.col(r) <= F.col(f"max_{r}")) | (F.col(n) <= F.col(f"max_{r}") * of[r] + one)
        passes = passes & F.coalesce(within, F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & passes)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of each document; nulls, ties, repeats and empty tables as in ``quality_rules``."""
    ruled = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return ruled.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *RATIOS)
