"""Sharding by a hierarchical weighted hash tree, with DataFrame operations only.

A document descends from the root to a region, a rack and a shard. At every level each child draws an exponential
number from the document's id and the child's name, divided by the child's weight; the smallest draw wins. A change of
weights moves documents only between the subtrees whose weights change. A new shard joins as a region of its own, so
the only draw that is new is its own: it takes documents, and none moves between the others.

Defined results: a null id is a value of its own; rows that repeat an id go to the same shard in neighbouring slots; a
null text has no bytes; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from propspark.llm.common import stored, text_of

SLOT_ROWS = 2_000


@dataclass(frozen=True)
class Leaf:
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def tree(regions: int = 2, racks: int = 2, shards: int = 4) -> list[Leaf]:
    """Equal weights; shards are numbered from 0 in the order of their region and rack."""
    return [Leaf(f"region{r}", f"region{r}/rack{k}", (r * racks + k) * shards + s)
            for r in range(regions) for k in range(racks) for s in range(shards)]


def grown(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """``leaves`` with one more shard, in a region of its own."""
    new = max((x.shard for x in leaves), default=-1) + 1
    return [*leaves, Leaf(f"own{new}", f"own{new}/rack", new, weight)]


def _drawn(key: Column, weights: dict) -> Column:
    """The child with the smallest draw; of equal draws, which are unlikely, the smallest name."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    draws = []
    for name, weight in weights.items():
        unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(str(name))), 11).cast("double") + F.lit(0.5)) / F.lit(2.0 ** 53)
        draws.append(F.struct((-F.log(unit) / F.lit(float(weight))).alias("draw"), F.lit(name).alias("name")))
    return F.array_min(F.array(*draws))["name"]


def _pick(key: Column, parent: Column, children: dict[str, dict]) -> Column:
    chosen = F.lit(None)
    for name, weights in children.items():
        chosen = F.when(parent == F.lit(name), _drawn(key, weights)).otherwise(chosen)
    return chosen


def with_shard(df: DataFrame, key: Column, leaves: list[Leaf], name: str) -> DataFrame:
    """``df`` with the shard of ``key`` as the column ``name``."""
    regions: dict[str, float] = {}
    racks: dict[str, dict[str, float]] = {}
    shards: dict[str, dict[int, float]] = {}
    for x in leaves:
        regions[x.region] = regions.get(x.region, 0.0) + x.weight
        racks.setdefault(x.region, {}).setdefault(x.rack, 0.0)
        racks[x.region][x.rack] += x.weight
        shards.setdefault(x.rack, {})[x.shard] = x.weight
    keyed = df.withColumn("__key", F.xxhash64(key)).withColumn("__region", _drawn(F.col("__key"), regions))
    racked = keyed.withColumn("__rack", _pick(F.col("__key"), F.col("__region"), racks))
    return racked.withColumn(name, _pick(F.col("__key"), F.col("__rack"), shards).cast("int")).drop("__key", "__region", "__rack")


def assign(docs: DataFrame, leaves: list[Leaf] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (0, 1, … in every shard) and grown_shard (with one more shard).

    Slots are numbered in two steps, inside hash parts of a shard and then by the parts' counts, so no shard is
    gathered in one task.
    """
    leaves = leaves or tree()
    parts = max(1, math.ceil(docs.count() / len(leaves) / SLOT_ROWS))
    text = text_of(docs)
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    placed = with_shard(with_shard(sized, F.col("doc_id"), leaves, "shard"), F.col("doc_id"), grown(leaves), "grown_shard")
    rows = stored(placed.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(parts)).cast("int")))
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("first"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("at", inside).join(first, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("at")).alias("slot"), "grown_shard")
