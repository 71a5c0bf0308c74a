"""Licence expressions in one spelling."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

_ATOM = r"[A-Za-z0-9][A-Za-z0-9.+:-]*"
_TOKENS = re.compile(rf"\s*({_ATOM}|[()])")
_WORDS = ("AND", "OR", "WITH")


def normal_expression(text: str) -> str | None:
    """Operators in capitals, single blanks, none inside parentheses; None for what is no licence expression.

    The token line is shortened until it is one operand: exceptions first, then each
    innermost parenthesis.
    """
    tokens, at = [], 0
    for m in _TOKENS.finditer(text):
        if m.start() != at:
            return None
        at = m.end()
        tokens.append(m[1].upper() if m[1].upper() in _WORDS else m[1])
    if text[at:].strip():
        return None
    shape = "".join({"AND": "o", "OR": "o", "WITH": "w"}.get(t, t if t in "()" else "a") for t in tokens)
    if "awaw" in shape:
        return None
    shape, before = shape.replace("awa", "a"), None
    while shape != before:
        before = shape
        shape = re.sub(r"\(a(?:oa)*\)", "a", shape)
    if not re.fullmatch(r"a(?:oa)*", shape):
        return None
    return " ".join(tokens).replace("( ", "(").replace(" )", ")")


@pandas_udf(StringType())
def license_expression(texts: pd.Series) -> pd.Series:
    """The normal form of each expression, null where there is none; each distinct text is read once."""
    known = {t: normal_expression(t) for t in texts.dropna().unique()}
    return texts.map(known).astype(object).where(lambda x: x.notna(), None)
