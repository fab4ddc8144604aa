"""Cross products by unit as streaming state.

A Gram row is a sum over rows, so it can be kept up as rows arrive. Averages
over units cannot: a late row changes its period's mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.ols import gram


def streaming_gram(stream: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """The running ``gram`` of a stream; write it with output mode ``complete`` or ``update``."""
    return gram(stream, keys, y, xs)
