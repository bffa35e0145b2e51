"""Functions of the library under names that SQL can call."""

from __future__ import annotations

import unicodedata

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def bare(text: str | None) -> str | None:
    """NFKD without combining marks."""
    return None if text is None else "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def register(spark: SparkSession) -> None:
    """strip_diacritics_exact(text) for every script, over Arrow batches."""
    import pandas as pd

    def stripped(s):  # noqa: ANN001, ANN202
        return pd.Series([bare(x) if isinstance(x, str) else None for x in s])

    spark.udf.register("strip_diacritics_exact", F.pandas_udf(stripped, "string", F.PandasUDFType.SCALAR))
