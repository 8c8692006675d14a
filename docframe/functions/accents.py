"""Accents that stand beside their letters, as some extractions leave them."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Spacing accents and the combining marks they stand for.
ACCENTS = {"´": "́", "`": "̀", "^": "̂", "ˆ": "̂", "¨": "̈", "~": "̃", "˜": "̃", "¸": "̧", "ˇ": "̌", "˘": "̆", "˙": "̇", "˚": "̊", "˝": "̋", "˛": "̨", "¯": "̄"}
_SET = re.escape("".join(ACCENTS))
_PAIR = re.compile(rf"([^\W\d_]) ?([{_SET}])|([{_SET}]) ?([^\W\d_])")


def _compose(m: re.Match) -> str:
    letter, accent = (m[1], m[2]) if m[1] else (m[4], m[3])
    joined = unicodedata.normalize("NFC", letter.replace("ı", "i") + ACCENTS[accent])
    return joined if len(joined) == 1 else m[0]


def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _PAIR.sub(_compose, t))


def normalize_diacritics(text: Column) -> Column:
    """An accent joins the letter before it, else the one after, across one blank at most. Plain ASCII passes without leaving the JVM."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), text).otherwise(F.pandas_udf(_fold, StringType())(text))
