"""Names with compatibility characters: full-width forms, ligatures, letters with separate marks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freightspark.functions.scalars import normalize_name

#: Characters that are their own compatibility form whatever stands beside them, and spaces and dashes that normalize_name folds itself.
PLAIN = (
    r"\u0009-\u000D\u0020-\u007E\u00A0-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u00FF\u0401\u0410-\u044F\u0451"
    r"\u2000-\u200A\u2010-\u2015\u2018-\u201E\u2020-\u2022\u202F\u20BD\u2212"
)


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def with_normal_name(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds normalize_name of a column after NFKC. Only rows with characters other than PLAIN go through Python, in batches."""
    plain = F.coalesce(F.col(column).rlike(f"^[{PLAIN}]*$"), F.lit(True))
    own = df.where(plain).withColumn(name, normalize_name(F.col(column)))
    odd = df.where(~plain).withColumn(name, normalize_name(F.pandas_udf(_nfkc, "string")(column)))
    return own.unionByName(odd)
