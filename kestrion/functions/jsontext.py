"""JSON inside prose."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def first_balanced(text: str | None) -> str | None:
    """The first balanced {...} of a text, with braces inside of strings not counted; null if there is none."""
    if not text:
        return None
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted, at = 0, False, start
    while at < len(text):
        c = text[at]
        if quoted:
            if c == "\\":
                at += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : at + 1]
        at += 1
    return None


@F.pandas_udf(StringType())
def first_object(texts: pd.Series) -> pd.Series:
    return texts.map(first_balanced)
