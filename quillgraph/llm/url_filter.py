"""URL filtering by fixed host rules and mined association rules; DataFrame functions only.

Fixed rules (host and path prefix, longest wins) decide first. Their decisions, or a table
of labels, are what FP-growth learns from: each labelled URL is a basket of its tokens and
its label, and an undecided URL counts with its tokens alone, so that confidence is a
share of all URLs, not only of those that a rule's author looked at. Rules whose conclusion is a label are pruned by support, confidence and lift,
and where a shorter rule says the same as surely. A URL finds its rules by an inverted
index from each rule's rarest token; the surest rule that holds whole decides.

Every basket has at most BASKET tokens, so at most 2 ** BASKET / min_support rules exist.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.scratch import materialize

#: (host/path, verdict)
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
MIN_SUPPORT = 0.02
MIN_CONFIDENCE = 0.7
DEFAULT = "allow"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)\A.*?://([^/?#]*)([^?#]*)"


def parsed(pages: DataFrame) -> DataFrame:
    """pages with host (A-Z lower-cased) and path; null or no ``://``: both empty."""
    part = lambda k: F.coalesce(F.regexp_extract("url", _SPLIT, k), F.lit(""))
    return pages.withColumn("host", F.translate(part(1), _UPPER, _LOWER)).withColumn("path", part(2))


def fixed_rule(rules: list[tuple[str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # a longer one overrides
        host, path = text[: text.index("/")], text[text.index("/") :]
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def url_tokens() -> Column:
    """Tokens of the whole url: every host label and its words, the last two labels, every path part and its words, extension, query keys and arguments."""
    words = lambda parts: F.flatten(F.transform(parts, lambda x: F.split(x, "[-_.]")))
    tagged = lambda name, values: F.transform(F.filter(values, lambda x: x != ""), lambda x: F.concat(F.lit(name + "="), x))
    labels, parts = F.split("host", r"\."), F.split("path", "/")
    query = F.coalesce(F.regexp_extract("url", r"(?s)\A[^?#]*\?([^#]*)", 1), F.lit(""))
    arguments = F.split(query, "[&;]")
    domain = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, F.size(labels) - 1, 2), ".")).otherwise("")
    extension = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})\z", 1)
    found = [
        tagged("label", labels),
        tagged("word", words(labels)),
        tagged("domain", F.array(domain)),
        tagged("part", parts),
        tagged("path", words(parts)),
        tagged("ext", F.array(extension)),
        tagged("key", F.transform(arguments, lambda x: F.substring_index(x, "=", 1))),
        tagged("argument", arguments),
    ]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def token_items(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> DataFrame:
    """(token, item) of the tokens that are frequent in rows (tokens, label); those that occur in just the same rows are one item, named by the least.

    Such tokens say the same, and together they would make 2 ** n sets. At most tokens of
    a row / min_support are frequent.
    """
    least = min_support * labelled.count()
    seen = labelled.select(F.xxhash64("tokens").cast("decimal(38,0)").alias("row"), F.explode("tokens").alias("token"))
    alike = seen.groupBy("token").agg(F.count("*").alias("n"), F.sum("row").alias("rows")).where(F.col("n") >= least)
    alike = alike.groupBy("n", "rows").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    return materialize(alike.select("item", F.explode("tokens").alias("token")), "url-tokens")


def itemised(baskets: DataFrame, named: DataFrame) -> DataFrame:
    """(basket, items) of each distinct array of tokens that has an item; any token of an item stands for it."""
    parts = baskets.select("tokens").distinct().select(F.col("tokens").alias("basket"), F.explode("tokens").alias("token")).join(named, "token")
    return materialize(parts.groupBy("basket").agg(F.sort_array(F.collect_set("item")).alias("items")), "url-items")


def mined_rules(labelled: DataFrame, named: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(tokens, label, confidence, support) from rows (tokens, label or null); tokens are items of ``named``. Empty without labels."""
    says = F.array_compact(F.array(F.concat(F.lit("says="), "label")))
    rows = labelled.join(itemised(labelled, named), F.col("tokens") == F.col("basket"), "left")
    baskets = rows.select(F.concat(F.coalesce("items", F.array().cast("array<string>")), says).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    says = F.element_at("consequent", 1)
    none = F.forall("antecedent", lambda t: ~t.startswith("says="))
    found = model.associationRules.where(says.startswith("says=") & none & (F.col("lift") > 1)).select(F.array_sort("antecedent").alias("tokens"), F.substring(says, 6, 1 << 20).alias("label"), "confidence", "support")
    found = materialize(found, "url-rules")
    # a rule that leaves out one token and is as sure makes the longer one needless
    shorter = found.where("size(tokens) > 1").select("tokens", "label", "confidence", F.explode("tokens").alias("out")).select(F.col("tokens").alias("long"), F.col("label").alias("l"), F.col("confidence").alias("c"), F.array_remove("tokens", F.col("out")).alias("short"))
    needless = shorter.join(found, (F.col("short") == found.tokens) & (F.col("l") == found.label) & (found.confidence >= F.col("c"))).select("long", "l").distinct()
    return found.join(needless, (found.tokens == F.col("long")) & (found.label == F.col("l")), "left_anti")


def matched(baskets: DataFrame, rules: DataFrame, named: DataFrame) -> DataFrame:
    """(basket, found): the surest mined verdict of each distinct basket that a rule fits (ties: support, fewest items, label, items)."""
    use = rules.select(F.explode("tokens").alias("item")).groupBy("item").count()
    keyed = rules.select(F.explode("tokens").alias("item"), F.struct("tokens", "label", "confidence", "support").alias("rule")).join(use, "item")
    index = keyed.groupBy("rule").agg(F.min(F.struct("count", "item")).alias("x")).select(F.col("x.item").alias("item"), "rule")
    asked = itemised(baskets, named).select("basket", "items", F.explode("items").alias("item"))
    hits = asked.join(index, "item").where(F.size(F.array_except("rule.tokens", "items")) == 0)
    rank = F.struct(-F.col("rule.confidence"), -F.col("rule.support"), F.size("rule.tokens"), F.col("rule.label").alias("label"), F.col("rule.tokens"))
    return hits.groupBy("basket").agg(F.min(rank).alias("best")).select("basket", F.col("best.label").alias("found"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES, labels: DataFrame | None = None, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, by) for each row of ``pages``; by is rule, mined or default.

    ``labels`` (url, label) replaces the fixed rules' own decisions as what is learnt
    from. A null or relative url has neither host nor path and gets the default, unless a
    mined rule fits its query. Repeated rows are kept; without labels nothing is mined; an
    empty table gives an empty one; further columns are not read.
    """
    name, verdict = fixed_rule(rules)
    seen = materialize(parsed(pages.select("page_id", "url")).select("page_id", "host", "path", name.alias("rule"), verdict.alias("ruled"), url_tokens().alias("tokens")), "urls")
    if labels is None:
        labelled = seen.select("tokens", F.col("ruled").alias("label"))
    else:
        labelled = parsed(labels.select("url", "label")).select(url_tokens().alias("tokens"), F.col("label").cast("string").alias("label"))
    named = token_items(labelled, min_support)
    mined = mined_rules(labelled, named, min_support, min_confidence)
    open_ones = seen.where("rule is null and size(tokens) > 0")
    best = materialize(matched(open_ones, mined, named), "url-verdicts")  # a table of its own, so that Spark may split a hot basket of the other side
    joined = seen.join(best, seen.rule.isNull() & (seen.tokens == best.basket), "left")
    by = F.when(F.col("rule").isNotNull(), "rule").when(F.col("found").isNotNull(), "mined").otherwise("default")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", "found", F.lit(DEFAULT)).alias("verdict"), by.alias("by"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on each page's url; nulls, repeats and empty tables as in ``url_verdicts``."""
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
