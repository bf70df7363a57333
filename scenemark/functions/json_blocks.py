"""JSON found inside free text.

Matching brackets need a depth counter, which no regular expression has, so this is the
one Arrow UDF of the text operators: a small scan per text, batched by Arrow.  The scan
ignores string quoting.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = T.StructType([T.StructField(n, T.StringType()) for n in ("block", "rest", "error")])
BRACKETS = re.compile(r"[\[\]{}]")
SQUARE = re.compile(r"[\[\]]")
PAIR = {"]": "[", "}": "{"}


def block_of(text: str | None) -> tuple[str | None, str | None, str | None]:
    """(block, rest, error): the first complete {} or [] block of a text."""
    if text is None:
        return None, None, "no text"
    open_, start = [], 0
    for m in BRACKETS.finditer(text):
        c = m.group()
        if c in "[{":
            start = start if open_ else m.start()
            open_.append(c)
        elif not open_:
            return None, None, "unmatched closing bracket"
        elif open_.pop() != PAIR[c]:
            return None, None, "mismatched brackets"
        elif not open_:
            return text[start : m.end()], text[m.end() :], None
    return None, None, "unclosed brackets" if open_ else "no block"


def array_of(text: str | None) -> str | None:
    """The first top-level [..] of a text that is valid JSON."""
    starts: list[int] = []
    for m in SQUARE.finditer(text or ""):
        if m.group() == "[":
            starts.append(m.start())
        elif starts:
            at = starts.pop()
            if not starts:
                piece = text[at : m.end()]
                try:
                    json.loads(piece)
                except ValueError:
                    continue
                return piece
    return None


@F.pandas_udf(BLOCK)
def first_json_block(texts: pd.Series) -> pd.DataFrame:
    """TXT-3: struct(block, rest, error); the error is a column, never an exception."""
    return pd.DataFrame([block_of(t) for t in texts], columns=["block", "rest", "error"])


@F.pandas_udf(T.StringType())
def first_json_array(texts: pd.Series) -> pd.Series:
    """TXT-2: JSON text of the array, NULL if there is none."""
    return texts.map(array_of)


def parse_score(reply):
    """TXT-7: struct(reason, score) from a judge's reply; NULL fields if it has none."""
    return F.from_json(first_json_block(reply)["block"], "reason string, score double")
