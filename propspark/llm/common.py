"""Shared pieces of the corpus operators: text forms, stored intermediate tables, connected components."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from propspark.session import checkpoint_dir

# The characters between tokens, \x09 to \x0D and the space, as a Java character class.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; pure ASCII texts take the fast built-in."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[text], F.lit(""))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared checkpoint folder and read back: cuts the lineage, survives lost
    executors, and gives every later reader the same rows."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b; both long): root is the smallest node it can reach.

    Minimum labels spread along the edges and then jump to their label's label, so the number of rounds grows with the
    logarithm of the longest path. Only the edges' nodes take part; labels are stored after every round. Raises if
    ``max_rounds`` do not settle the labels, never returns unfinished ones.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")))
    for _ in range(max_rounds):
        near = (both.join(labels.select(F.col("node").alias("b"), "root"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near")))
        spread = labels.join(near, "node").select("node", F.least("root", "near").alias("to"), F.col("root").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("root").alias("onward"))
        after = stored(spread.join(jump, "to", "left").select("node", F.coalesce("onward", "to").alias("root"), "was"))
        moved = after.where("root < was").limit(1).count()
        labels = after.select("node", "root")
        if not moved:
            return labels
    raise RuntimeError("components did not settle")
