"""Forward fill in file order without sorting a whole file in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def forward_fill(df: DataFrame, cols: Sequence[str], position: str, by: Sequence[str] = (), tie: Sequence[str] = (),
                 block_rows: int = 1_000_000) -> DataFrame:
    """Replace NULLs by the last value before them in ``position`` order, within ``by``.

    Positions are cut into blocks of ``block_rows``. Each block is filled on its own; what a block inherits is the last
    known value of the blocks before it, taken from one summary row per block. A single huge file is therefore spread
    over as many tasks as it has blocks.
    """
    cols, by, tie = list(cols), list(by), list(tie)
    order = F.struct(F.col(position), *[F.col(t) for t in tie])
    blocked = df.withColumn("__block", F.floor(F.col(position) / block_rows))
    ends = blocked.groupBy(*by, "__block").agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(f"__last_{c}") for c in cols])
    before = Window.partitionBy(*by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "__block", *[
        F.last(f"__last_{c}", ignorenulls=True).over(before).alias(f"__in_{c}") for c in cols])
    inside = (Window.partitionBy(*by, "__block").orderBy(position, *tie)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    filled = blocked.withColumns({f"__own_{c}": F.last(c, ignorenulls=True).over(inside) for c in cols})
    joined = filled.join(carried, by + ["__block"], "left")
    out = {c: F.coalesce(f"__own_{c}", f"__in_{c}") for c in cols}
    return joined.withColumns(out).select(*df.columns)
