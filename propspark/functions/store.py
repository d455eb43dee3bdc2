"""Intermediate results that are written once."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import NullType

from propspark.session import checkpoint_dir


def stored(df: DataFrame, by: Sequence[str] = (), codec: str | None = None) -> DataFrame:
    """``df`` written as Parquet beside the checkpoints and read back, so that every later reader gets the same rows and
    reads only the columns it needs. Rows survive lost executors. A folder for each value of the columns ``by``.
    ``codec`` is Parquet's compression, the session's own by default."""
    void = [f.name for f in df.schema if f.dataType == NullType()]  # no file holds them
    if void:
        return stored(df.drop(*void), by, codec).select(*[F.lit(None).alias(c) if c in void else F.col(f"`{c}`") for c in df.columns])
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
