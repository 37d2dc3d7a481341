"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hourglass.session import cut_lineage

#: Rows and bytes of one Arrow batch sent to a Python worker.  A worker holds a few batches at
#: a time, so its memory does not depend on the partition's size.
BATCH_ROWS = 2_000
BATCH_BYTES = 16 << 20


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Limit Arrow batches by rows and bytes unless the session already limits them further."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows),
                      ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        try:
            now = int(spark.conf.get(key).removesuffix("b"))  # Spark's own default is told in bytes, "b" behind it
        except ValueError:  # a size with another unit: the user's own choice
            continue
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the session's shared checkpoint folder and read back."""
    return cut_lineage(df, name=f"llm-{name}")


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column used inside a higher-order function's lambda is evaluated again for every
    element; the variable of an outer one-element ``transform`` is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
