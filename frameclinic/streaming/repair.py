"""Apply fitted cleaning to rows that arrive later.

Statistics are learned on a batch and stay fixed, so cleaning a stream is the
same stateless projection as cleaning a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.cleaning import FittedCleaning


def repair_stream(
    stream: DataFrame, fitted: FittedCleaning, method: str, keep: Sequence[str] = ()
) -> DataFrame:
    """The model-ready matrix of ``method`` for each arriving row."""
    if not stream.isStreaming:
        raise ValueError("repair_stream needs a streaming DataFrame; use FittedCleaning.transform for tables")
    return fitted.transform(stream, method, keep)
