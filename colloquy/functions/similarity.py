"""Text similarity as Arrow-batched UDFs over the helpers of ``matching``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from colloquy.functions.matching import containment_of, fingerprint_text, similarity_of

_FINGERPRINTS = StructType([
    StructField("fp", ArrayType(LongType())),
    StructField("start", ArrayType(IntegerType())),
    StructField("stop", ArrayType(IntegerType())),
])


@F.pandas_udf(_FINGERPRINTS)
def fingerprints(texts: pd.Series) -> pd.DataFrame:
    """Parallel arrays per text: fingerprint, start and stop of what it covers."""
    return pd.DataFrame([fingerprint_text(t) for t in texts], columns=["fp", "start", "stop"])


@F.pandas_udf(DoubleType())
def passage_containment(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([containment_of(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def text_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity_of(x or "", y or "") for x, y in zip(a, b)], dtype="float64")
