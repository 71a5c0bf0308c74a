"""Ignore rules of directory trees, applied by joins on the folders that hold them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RULES = "folder string, place long, pattern string, keeps boolean"


def pattern_of(line: str) -> tuple[str, bool] | None:
    """(regular expression of a path below the rule's folder, whether it keeps) of one line; None for none.

    A folder is written with a slash at its end, so a rule for folders only ends in one.
    """
    text = line.rstrip("\n\r")
    text = text if text.endswith("\\ ") else text.rstrip(" ")
    if not text or text.startswith("#"):
        return None
    keeps = text.startswith("!")
    text = text[1:] if keeps else text.removeprefix("\\")
    folder, body = text.endswith("/"), text.strip("/")
    if not body:
        return None
    anchored = "/" in text.rstrip("/")
    out, at = "", 0
    while at < len(body):
        if body.startswith("**/", at) and (at == 0 or body[at - 1] == "/"):
            out, at = out + "(?:[^/]+/)*", at + 3
        elif body[at:] == "**" and at and body[at - 1] == "/":
            out, at = out + ".+", at + 2
        elif m := re.compile(r"\[!?\]?[^\]/]*\]").match(body, at):
            out, at = out + m[0].replace("[!", "[^"), m.end()
        else:
            c = body[at]
            out += {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c))
            at += 1 + (c == "*" and body.startswith("**", at))
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/' if folder else '/?'}$", keeps


def rules_of(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """RULES of the ignore files among ``files`` (path, content), in the order of their lines."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                folder = path.rpartition("/")[0]
                for place, line in enumerate(bytes(content).decode("utf-8", "replace").split("\n")):
                    found = pattern_of(line)
                    if found:
                        rows.append((folder, place, *found))
            yield pd.DataFrame(rows, columns=["folder", "place", "pattern", "keeps"])

    return files.where(F.element_at(F.split("path", "/"), -1) == name).select("path", "content").mapInPandas(run, RULES)


@F.pandas_udf(T.StringType())
def composed(names: pd.Series) -> pd.Series:
    """Names with their marks composed, so that one name has one spelling."""
    return names.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def _ancestors(path: Column) -> Column:
    """Folders above a path, "" first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))


def unignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The files (path, relative and without a slash at the beginning) that no rule ignores.

    Of the rules that fit a path, the one of the nearest folder counts, of these the last.
    What lies in an ignored folder stays ignored, whatever keeps it. Paths meet rules by
    an equi-join on the folder, so a rule is tried on what lies below its folder only.
    What grows with the paths is never broadcast: a path makes many rows, which no estimate knows.
    """
    each = files.select("path").distinct()
    prefixes = F.concat(F.transform(F.filter(_ancestors(F.col("path")), lambda a: a != ""), lambda a: F.concat(a, F.lit("/"))), F.array("path"))
    asked = each.select("path", F.explode(prefixes).alias("prefix"))
    asked = asked.select("path", "prefix", F.explode(_ancestors(F.regexp_replace("prefix", "/$", ""))).alias("folder"))
    below = F.when(F.col("folder") == "", F.col("prefix")).otherwise(F.expr("substring(prefix, length(folder) + 2)"))
    hits = asked.hint("merge").join(rules, "folder").withColumn("below", below).where(F.expr("below rlike pattern"))
    last = hits.groupBy("path", "prefix").agg(F.max_by("keeps", F.struct(F.length("folder"), "place")).alias("keeps"))
    gone = last.where("not keeps").select("path").distinct()
    return files.hint("merge").join(gone.hint("merge"), "path", "left_anti")
