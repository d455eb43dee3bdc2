"""A Merkle manifest of a data set by time-forward processing, with one proof a row.

Rows become leaf digests. In every tree (one a source, and one over the sources' roots) the leaves stand in order, and
every three neighbours, the last ones fewer, become one node. A node is labelled by its last leaf and its level, so labels
ascend as children do before their parents. Rows sorted by label are the external queue that Spark's sort keeps; inside a
block of ``3 ** LEVELS`` leaves a heap delivers the children's digests to their parent, which is made as soon as its label
is the smallest one. A block leaves one digest, a leaf of the next round, so rounds grow with the logarithm of the largest
tree. The reversed sweep takes the rounds and the labels downwards and delivers to every child its siblings and its
parent's proof, until the leaves have theirs. Ranks come from range partitions and their counts, so a source with a third
of all rows, or one doc_id, is spread over many tasks.

Defined results: nulls are written as ``-``; a null doc_id or source comes first; rows that repeat a doc_id stand in the order
of their digests, and each has a proof; equal rows have places of their own; other columns are ignored; an empty table
gives an empty result; a null doc_id has no decimal form and is not tampered with.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from propspark.llm.common import stored

ARITY = 3
LEVELS = 5  # of one round; a block has 3 ** LEVELS leaves
# A proof is a list of steps from a leaf upwards: the siblings' digests to the left and to the right, one string each.
_STEPS = "array<struct<left: string, right: string>>"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_digest(columns: list[Column]) -> Column:
    """Digest of a row: every value as its number of bytes, a colon and itself; a null as a dash."""
    def written(value: Column) -> Column:
        text = value.cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(written, columns)).cast("binary"), 256)


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` (stored) with ``tree_no`` (0, 1, … in the order of the column ``tree``, null first), ``pos`` (the place in the
    tree, by ``order``) and ``size`` (rows of the tree). Sorted range partitions are numbered by their counts."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = object(), 0
        for b in batches:
            places = []
            for value in b.column(tree).to_pylist():
                at = at + 1 if value == last else 0
                last = value
                places.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(places, pa.int64())], [*b.schema.names, "__at"])

    dealt = rows.repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order).withColumn("__part", F.spark_partition_id())
    placed = stored(dealt.mapInArrow(numbered, T.StructType([*dealt.schema, T.StructField("__at", T.LongType())])))
    runs = stored(placed.groupBy("__part", tree).agg(F.count(F.lit(1)).alias("n")))
    whole = runs.groupBy(tree).agg(F.min("__part").alias("first_part"), F.sum("n").alias("size"))
    # One row a partition: the number of trees that begin in the partitions before it.
    begun = whole.groupBy("first_part").agg(F.count(F.lit(1)).alias("k")).select(
        "first_part", (F.sum("k").over(Window.orderBy("first_part")) - F.col("k")).alias("base"))
    trees = whole.join(begun, "first_part").select(
        F.col(tree).alias("__tree"), "size",
        (F.col("base") + F.row_number().over(Window.partitionBy("first_part").orderBy(tree)) - 1).alias("tree_no"))
    starts = runs.withColumn("__from", F.sum("n").over(Window.partitionBy(tree).orderBy("__part")) - F.col("n"))
    starts = starts.join(trees, F.col(tree).eqNullSafe(F.col("__tree"))).select(
        F.col("__part").alias("__p"), "__tree", "__from", "tree_no", "size")
    return placed.join(starts, (F.col("__part") == F.col("__p")) & F.col(tree).eqNullSafe(F.col("__tree"))).select(
        *rows.columns, "tree_no", (F.col("__from") + F.col("__at")).alias("pos"), "size")


def forward(digests: list[str], first: int, size: int, levels: int = LEVELS) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """Time-forward sweep over the consecutive leaves of one block, from place ``first`` on, of a tree with ``size`` leaves:
    the block's digest and its inner nodes (label, level, children's digests) in the order of their labels."""
    queue: list[tuple[int, int, int, str]] = []  # (label, level, place of the child, its digest)
    made: list[tuple[int, int, list[str]]] = []
    last = first + len(digests) - 1
    height = 0
    while height < levels and ARITY ** height < size:
        height += 1

    def deliver(level: int, place: int, value: str) -> None:
        span = ARITY ** (level + 1)
        label = min((place // ARITY + 1) * span, size) - 1  # the parent's last leaf
        heapq.heappush(queue, (label, level + 1, place, value))

    top = digests[0] if height == 0 else ""
    for at, value in enumerate(digests, first):
        if height:
            deliver(0, at, value)
        while queue and queue[0][0] == at:
            label, level = queue[0][:2]
            children, place = [], 0
            while queue and queue[0][:2] == (label, level):
                _, _, place, child = heapq.heappop(queue)
                children.append(child)
            made.append((label, level, children))
            value = digest(*children)
            if level < height:
                deliver(level, place // ARITY, value)
            else:
                top = value
    assert not queue and (not made or made[-1][0] == last)
    return top, made


def backward(made: list[tuple[int, int, list[str]]], first: int, above: list[dict]) -> list[list[dict]]:
    """Reversed sweep: the proofs of a block's leaves from its inner nodes and the proof of its top."""
    if not made:
        return [above]
    queue: list[tuple[int, int, int, list[dict]]] = []  # (-label, -level, ., proof of that node)
    found: dict[int, list[dict]] = {}
    ties = itertools.count()
    heapq.heappush(queue, (-made[-1][0], -made[-1][1], next(ties), above))
    for label, level, children in reversed(made):
        key = heapq.heappop(queue)
        assert key[:2] == (-label, -level)
        span = ARITY ** (level - 1)
        start = label // (span * ARITY) * ARITY  # the place of the first child on its level
        for k, _ in enumerate(children):
            proof = [{"left": "".join(children[:k]), "right": "".join(children[k + 1:])}, *key[3]]
            if level == 1:
                found[start + k] = proof
            else:
                child_label = min((start + k + 1) * span - 1, label)
                heapq.heappush(queue, (-child_label, 1 - level, next(ties), proof))
    assert not queue
    return [found[first + k] for k in range(len(found))]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """(tree_no, block, size) and rows of every block of batches sorted by tree_no, block and pos."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        keys = list(zip(b.column("tree_no").to_pylist(), b.column("block").to_pylist(), b.column("size").to_pylist()))
        at = 0
        for key, run in itertools.groupby(keys):
            n = len(list(run))
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(b.slice(at, n))
            at += n
    if held:
        yield now, pa.Table.from_batches(held)


def _by_block(nodes: DataFrame) -> DataFrame:
    block = F.floor(F.col("pos") / ARITY ** LEVELS).cast("long")
    return nodes.withColumn("block", block).repartition("tree_no", "block").sortWithinPartitions("tree_no", "block", "pos")


def climb(nodes: DataFrame) -> list[DataFrame]:
    """The rounds upwards from ``nodes`` (tree_no, pos, size, digest): each holds one row a block of the round before, the last
    one row a tree."""
    levels = LEVELS
    reach = ARITY ** levels

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block, size), rows in _blocks(batches):
            top, _ = forward(rows.column("digest").to_pylist(), block * reach, size, levels)
            shrunk = -(-size // reach)
            yield pa.RecordBatch.from_arrays([pa.array([tree]), pa.array([block]), pa.array([shrunk]), pa.array([top])],
                                             ["tree_no", "pos", "size", "digest"])

    rounds = [nodes.select("tree_no", "pos", "size", "digest")]
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        rounds.append(stored(_by_block(rounds[-1]).mapInArrow(up, "tree_no long, pos long, size long, digest string")))
        largest = -(-largest // reach)
    return rounds


def descend(rounds: list[DataFrame], tops: DataFrame, leaves: DataFrame | None = None) -> DataFrame:
    """The lowest round's rows (or ``leaves``, the same with more columns) with ``proof``. ``tops`` (tree_no, proof): the proof
    of every tree's root."""
    levels = LEVELS
    reach = ARITY ** levels
    above = tops.select("tree_no", F.lit(0).cast("long").alias("block"), "proof")
    for at in range(len(rounds) - 2, -1, -1):
        nodes = leaves if at == 0 and leaves is not None else rounds[at]
        names = nodes.columns

        def down(batches: Iterator[pa.RecordBatch], names=names) -> Iterator[pa.RecordBatch]:
            for (_, block, size), rows in _blocks(batches):
                first = block * reach
                _, made = forward(rows.column("digest").to_pylist(), first, size, levels)
                # A block's rows come with its top's proof on the first of them.
                proofs = backward(made, first, rows.column("proof")[0].as_py())
                for b in rows.select(names).append_column("proof", pa.array(proofs, _PATH)).combine_chunks().to_batches():
                    yield b

        blocked = nodes.withColumn("block", F.floor(F.col("pos") / reach).cast("long"))
        first_rows = blocked.where(F.col("pos") % reach == 0).join(above, ["tree_no", "block"])
        others = blocked.where(F.col("pos") % reach != 0).withColumn("proof", F.lit(None).cast(_STEPS))
        joined = others.unionByName(first_rows)
        sorted_rows = joined.repartition("tree_no", "block").sortWithinPartitions("tree_no", "block", "pos")
        found = sorted_rows.mapInArrow(down, T.StructType([*nodes.schema, others.schema["proof"]]))
        if at == 0:
            return found
        found = stored(found)
        above = found.select("tree_no", F.col("pos").alias("block"), "proof")
    nodes = leaves if leaves is not None else rounds[0]
    return nodes.join(tops, "tree_no")  # every tree is a lone leaf


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered, subroot, root and proof of every row of ``docs`` (doc_id, source, lang, n_chars, text). ``tampered``
    is the leaf of the row without its line feeds, where 2 divides the crc32 of its id."""
    def leaf(text: Column) -> Column:
        return leaf_digest([docs["doc_id"], docs["source"], docs["lang"], docs["n_chars"], text])

    hit = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 2 == 0, F.lit(False))
    changed = hit & docs["text"].contains("\n")
    leaves = stored(docs.select(
        docs["doc_id"], docs["source"], leaf(docs["text"]).alias("digest"),
        F.when(changed, leaf(F.replace(docs["text"], F.lit("\n"), F.lit("")))).alias("tampered"),
        F.monotonically_increasing_id().alias("row")))
    placed = stored(ranked(leaves, "source", ["doc_id", "digest", "row"]).drop("row"))
    rounds = climb(placed)
    # The sources' roots are the leaves of one more tree, in the order of the sources.
    subroots = rounds[-1].select("tree_no", F.col("digest").alias("subroot"))
    n_trees = subroots.count()
    over = climb(subroots.select(F.lit(0).cast("long").alias("tree_no"), F.col("tree_no").alias("pos"),
                                 F.lit(n_trees).cast("long").alias("size"), F.col("subroot").alias("digest")))
    root = over[-1].select(F.col("digest").alias("root"))
    none = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("tree_no"), F.array().cast(_STEPS).alias("proof"))
    tops = stored(descend(over, none).select(F.col("pos").alias("tree_no"), F.col("digest").alias("subroot"), "proof"))
    proven = descend(rounds, tops.select("tree_no", "proof"), placed)
    return (proven.join(tops.select("tree_no", "subroot"), "tree_no")
            .withColumn("root", F.lit((root.first() or [None])[0]).cast("string"))  # one digest
            .select("doc_id", F.col("digest").alias("leaf"), F.coalesce("tampered", "digest").alias("tampered"), "subroot", "root", "proof"))


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), "").cast("binary"), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda value, s: F.sha2(F.concat(s["left"], value, s["right"]).cast("binary"), 256))


def verified(proven: DataFrame) -> DataFrame:
    """The rows of a manifest with proof_sha256, the root that the row leads to as it is now, and whether that is the root."""
    return proven.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                         folded(F.col("tampered"), F.col("proof")).alias("folded_root")).withColumn("verified", F.expr("folded_root = root"))
