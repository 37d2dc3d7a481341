"""Batch scoring with a user function over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def score_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``fn`` to each Arrow batch of ``df`` with ``mapInPandas``.

    This is the one place where Python runs per batch: an externally trained
    model (embedding or score extractor) is a black box to Spark.  Batches
    stream through the Python worker; nothing is collected.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)

    return df.mapInPandas(run, schema)
