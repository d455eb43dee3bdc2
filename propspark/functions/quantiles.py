"""Exact quantiles without gathering a column in one task.

Selection by counting: values are counted in logarithmic buckets (about 1,000 per power of two), then the buckets
holding the wanted ranks are counted in up to 2**20 equal slices, then the distinct values of the chosen slices are
counted. Each step is a map-side combined hash aggregate with a bounded number of groups; no step sorts or moves rows. The
second and third only read the rows where a bucket or slice with a wanted rank holds different values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

_PER_OCTAVE = 1024
_SLICES = 1 << 20


def _bucket(v: Column) -> Column:
    """Bucket number that never falls when the value rises; zero has a bucket of its own."""
    finite = F.abs(v) <= F.lit(1.7976931348623157e308)
    magnitude = F.when(finite, F.floor((F.log2(F.abs(v)) + F.lit(1100.0)) * _PER_OCTAVE) + 1).otherwise(F.lit(1 << 30))
    return F.when(v == 0, F.lit(0)).when(v > 0, magnitude).otherwise(-magnitude).cast("long")


def _slice(v: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi > lo, F.floor((v - lo) / (hi - lo) * F.lit(float(_SLICES)))).otherwise(F.lit(0)).cast("long")


def long_values(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by…, column, value) rows of the non-null numbers."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    return (
        df.select(*by, F.inline(pairs))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
        .withColumn("value", F.when(F.col("value") == 0, F.lit(0.0)).otherwise(F.col("value")))
    )


def _picked(counts: DataFrame, within: Sequence[str], along: str, base: Column, ranks: Column, keep: Sequence[str]) -> DataFrame:
    """The cells of ``counts`` that hold a wanted rank: ``base`` rows come before the first cell of ``within``."""
    running = Window.partitionBy(*within).orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    upto = base + F.sum("n").over(running)
    cells = counts.select(*within, along, *keep, upto.alias("upto"), (upto - F.col("n")).alias("base"), ranks.alias("hits"))
    hits = F.filter("hits", lambda r: (r < F.col("upto")) & (r >= F.col("base")))
    return cells.select(*within, along, *keep, "base", hits.alias("hits")).where(F.size("hits") > 0)


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = ()) -> DataFrame:
    """Rows (by…, column, prob, value): quantiles with linear interpolation between neighbouring ranks."""
    by = list(by)
    group = by + ["column"]
    values = long_values(df, cols, by).withColumn("b1", _bucket(F.col("value")))
    zero = F.lit(0).cast("bigint")

    total = F.sum("n").over(Window.partitionBy(*group))
    level1 = values.groupBy(*group, "b1").agg(
        F.count("*").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).withColumn("total", total)
    ranks = F.array_distinct(F.flatten(F.array(*[
        F.array(F.floor(F.lit(float(p)) * (F.col("total") - 1)), F.ceil(F.lit(float(p)) * (F.col("total") - 1)))
        for p in probs])))
    pick1 = _picked(level1, group, "b1", zero, ranks, ["lo", "hi", "total"])

    # A cell whose values are all the same needs no further step; where every picked cell is such a one, the rows are not read
    # again. Both kinds are cut from the same columns of the counts, so that these are taken once.
    ended1 = pick1.where("lo = hi").select(*group, F.col("lo").alias("value"), "hits", "total")
    open1 = _small(pick1.where("lo < hi"), by)

    # Everything known about a picked cell travels with its rows, so that later steps need no further join. These are plain
    # numbers: an array among them (the ranks, which ``total`` gives again) would have every row sorted before it is counted.
    carried = [F.any_value(c).alias(c) for c in ("lo", "hi", "total", "base")]
    slice_of = _slice(F.col("value"), F.col("lo"), F.col("hi"))
    level2 = (values.join(open1, group + ["b1"])
              .groupBy(*group, "b1", slice_of.alias("b2")).agg(
                  F.count("*").alias("n"), F.min("value").alias("first"), F.max("value").alias("last"), *carried))
    pick2 = _picked(level2, group + ["b1"], "b2", F.col("base"), ranks, ["first", "last", "lo", "hi", "total"])
    ended2 = pick2.where("lo < hi AND first = last").select(*group, F.col("first").alias("value"), "hits", "total")
    open2 = _small(pick2.where("first < last").drop("first", "last"), by)

    level3 = (values.join(open2, group + ["b1"]).where(slice_of == F.col("b2"))
              .groupBy(*group, "b1", "b2", "value").agg(F.count("*").alias("n"), *carried[2:]))
    pick3 = _picked(level3, group + ["b1", "b2"], "value", F.col("base"), ranks, ["total"])
    ended = ended1.unionByName(ended2).unionByName(pick3.select(*group, "value", "hits", "total"))

    wanted = F.array(*[F.struct(F.lit(float(p)).alias("prob"), (F.lit(float(p)) * (F.col("total") - 1)).alias("pos"))
                       for p in probs])
    found = ended.select(*group, "value", "hits", F.inline(wanted))
    low = F.max(F.when(F.array_contains("hits", F.floor("pos")), F.col("value")))
    high = F.max(F.when(F.array_contains("hits", F.ceil("pos")), F.col("value")))
    ends = found.groupBy(*group, "prob").agg(low.alias("l"), high.alias("h"), F.max(F.col("pos") - F.floor("pos")).alias("f"))
    between = F.when(F.col("l") == F.col("h"), F.col("l")).otherwise(F.col("l") + (F.col("h") - F.col("l")) * F.col("f"))
    return ends.select(*group, "prob", between.alias("value"))


def _small(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Without groups the picked cells are at most 2 x columns x probabilities rows: safe to broadcast."""
    return df if by else F.broadcast(df)


def quantile_name(col: str, prob: float) -> str:
    return f"{col}_p{prob * 100:g}".replace(".", "_")


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """One row with a column per (column, probability), named by :func:`quantile_name`; NULL where a column is empty."""
    long = exact_quantiles(df, cols, probs)
    return long.agg(*[
        F.max(F.when((F.col("column") == c) & (F.col("prob") == float(p)), F.col("value"))).alias(quantile_name(c, p))
        for c in cols for p in probs])


def scalar_row(row: DataFrame) -> Column:
    """A one-row frame as a struct-valued scalar subquery: usable in any expression, without a join."""
    return row.select(F.struct(*row.columns).alias("s")).scalar()


def with_row(df: DataFrame, row: DataFrame, name: str = "__row") -> DataFrame:
    """``df`` with the one-row frame as a struct column, for expressions that use several of its fields."""
    return df.withColumn(name, scalar_row(row))
