"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from placelens.session import stored


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table of its own in the shared folder.

    An executor that is lost later costs nothing, and Spark knows the size of what it joins next.
    """
    return stored(df, name)
