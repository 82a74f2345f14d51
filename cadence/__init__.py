"""cadence: recurring-pattern analytics on Spark DataFrames.

Every operator is a function ``(DataFrame, *, cols=Cols(), **params) -> DataFrame``
that only builds a lazy plan; Catalyst and AQE choose the physical strategy.
"""

from cadence.schema import Cols

__all__ = ["Cols"]
