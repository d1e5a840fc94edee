"""Unicode normalisation, which Spark's own functions lack."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """NFKC form; ASCII texts and null pass as they are."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))
