"""hourglass — entity-timeline analytics on Spark DataFrames.

Every public operator is a plain ``DataFrame -> DataFrame`` (or ``Column ->
Column``) function that stays lazy, so it composes with ``df.transform`` and
leaves physical planning to Catalyst and AQE.
"""

from hourglass.session import get_spark, scratch_path

__all__ = ["get_spark", "scratch_path"]
