"""SimHash near-duplicate detection: tiled exact comparison with exclusive-or and bit counts.

Fingerprints come from word shingles hashed with XXH64. Fingerprints that can be close share a tile key; the rows of a
key are cut into tiles of bounded size in the order of their population counts, and tile pairs whose population counts
differ by more than the radius are never formed. Inside a tile pair every remaining pair is compared exactly.

:func:`keep_one` takes those links as candidates only: inside their components the sets of distinct shingles are compared,
again in tiles of bounded size, and documents are near duplicates if the Jaccard similarity of their sets is high enough.

Defined results: a null text is empty; a text without words has fingerprint zero and is linked like any other; rows
that repeat a doc_id each get a row; a null doc_id takes part but never names a component that has other ids; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from propspark.llm.common import components, stored, text_of

TILE_ROWS = 1024
SEED = 42
HELD_LINKS = 1_000_000
TILE_SHINGLES = 1 << 20
LEVELS = 50  # levels of set size; one is 2 % above the one before


def shingles(text: str, size: int) -> list[bytes]:
    """Word shingles of an ASCII-lower-cased text, repeats included; a shorter text is one shingle, an empty one none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(t) for t in zip(*(words[i:] for i in range(size)))]


def mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent 64-bit hash derived from ``h``; the 0th is ``h`` itself."""
    if k == 0:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * k) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(h: np.ndarray, lanes: int = 1) -> bytes:
    """Big-endian bytes; a bit is 1 if it is set in over half of the hashes. Long texts are summed in blocks."""
    out = b""
    for k in range(lanes):
        total = np.zeros(64, np.int64)
        for at in range(0, len(h), 65536):
            part = mixed(h[at:at + 65536], k).astype(">u8").view(np.uint8)
            total += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int32)
        out += np.packbits(2 * total > len(h)).tobytes()
    return out


def block_keys(radius: int) -> Callable[[np.ndarray, bytes], list[int]]:
    """Tile keys under which any two 64-bit fingerprints within ``radius`` meet: of radius + 2 blocks at least two are
    equal, so every pair of blocks is a key."""
    n = radius + 2
    ends = [64 * i // n for i in range(n + 1)]

    def keys(_: np.ndarray, fp: bytes) -> list[int]:
        value = int.from_bytes(fp, "big")
        part = [(value >> ends[i]) & ((1 << (ends[i + 1] - ends[i])) - 1) for i in range(n)]
        return [hash((i, j, part[i], part[j])) for i, j in combinations(range(n), 2)]

    return keys


def minima_keys(n: int) -> Callable[[np.ndarray, bytes], list[int]]:
    """Tile keys for wide radii: the smallest of ``n`` mixed shingle hashes each. Two texts of similarity s share none
    with probability (1 - s) ** n. Texts without words share one key."""

    def keys(h: np.ndarray, _: bytes) -> list[int]:
        return [int(mixed(h, 16 + k).view(np.int64).min()) ^ k for k in range(n)] if len(h) else [0]

    return keys


def with_fingerprints(docs: DataFrame, keys: Callable[[np.ndarray, bytes], list[int]], shingle: int = 3,
                      lanes: int = 1) -> DataFrame:
    """doc_id with ``fp`` (8 x ``lanes`` bytes), ``pop`` (its one bits) and ``keys`` (its tile keys)."""
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, pops, key_lists = [], [], []
            for text in batch.column(1):
                parts = shingles(text.as_py(), shingle)
                h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64, len(parts))
                fp = fingerprint(h, lanes)
                fps.append(fp)
                pops.append(int.from_bytes(fp, "big").bit_count())
                key_lists.append(keys(h, fp))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fps, pa.binary()), pa.array(pops, pa.int32()),
                 pa.array(key_lists, pa.list_(pa.int64()))], ["doc_id", "fp", "pop", "keys"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.BinaryType()),
                           T.StructField("pop", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, schema)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest connected index of every index below ``n``."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def tile_roots(pair: np.ndarray, fp: np.ndarray, pop: np.ndarray, radius: int) -> np.ndarray:
    """Root index of every row. Rows are sorted by tile pair and population count; row i is compared with i + 1, i + 2, …
    until its tile pair ends or the population counts are too far apart."""
    n = len(pair)
    end = np.searchsorted(pair, pair, side="right")
    label, found, held = np.arange(n), [], 0

    def fold() -> np.ndarray:
        a, b = (np.concatenate(x) for x in zip((np.arange(n), label), *found))
        return _roots(n, a, b)

    at, step = np.arange(n), 1
    while len(at):
        at = at[at + step < end[at]]
        at = at[pop[at + step] - pop[at] <= radius]
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]).sum(axis=1, dtype=np.int16) <= radius]
        if len(near):
            found.append((near, near + step))
            held += len(near)
        if held > HELD_LINKS:  # bounds the memory that the links of a dense tile take
            label, found, held = fold(), [], 0
        step += 1
    return fold() if found else label


def _by_pair(batches: Iterator[pa.RecordBatch], forest: Callable[[pa.Table], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``forest`` of whole tile pairs; the rows are sorted by ``pair``."""
    rest: pa.Table | None = None  # the last tile pair, which may go on in the next batch
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        if not t.num_rows:
            continue
        pair = t.column("pair").to_numpy()
        cut = int(np.searchsorted(pair, pair[-1]))
        rest = t.slice(cut)
        if cut:
            yield forest(t.slice(0, cut))
    if rest is not None:
        yield forest(rest)


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """Edges (a, b) that connect all ``nodes`` (node long, fp, pop, keys) whose fingerprints share a key and differ in
    at most ``radius`` bits. A tile pair gives a spanning forest, never all its pairs, so a dense group of n
    fingerprints costs O(n) rows. No group is gathered: a tile holds at most 2 x ``TILE_ROWS`` rows."""
    rows = nodes.select("node", "fp", "pop", F.explode(F.array_distinct("keys")).alias("key"))
    sizes = rows.groupBy("key", "pop").agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("key")  # at most one row per population count
    bands = stored(
        sizes.withColumn("all", F.sum("n").over(whole)).where("all > 1")
        .withColumn("before", F.sum("n").over(whole.orderBy("pop")) - F.col("n"))
        .select("key", "pop", F.floor(F.col("before") / TILE_ROWS).alias("band"),
                F.ceil(F.col("n") / TILE_ROWS).alias("parts")))
    tiles = (bands.select("key", "pop", "band", F.explode(F.sequence(F.lit(1), F.col("parts").cast("int"))).alias("part"))
             .groupBy("key", F.struct("band", "part").alias("tile"))
             .agg(F.min("pop").alias("low"), F.max("pop").alias("high")))
    others = tiles.toDF("key", "tile2", "low2", "high2")
    pairs = (tiles.join(others, "key")
             .where((F.col("tile") <= F.col("tile2")) & (F.greatest("low", "low2") - F.least("high", "high2") <= radius))
             .select("key", F.explode(F.array_distinct(F.array("tile", "tile2"))).alias("tile"),
                     F.xxhash64("key", "tile", "tile2").alias("pair")))
    placed = (rows.join(bands, ["key", "pop"])
              .withColumn("tile", F.struct("band", (F.pmod(F.xxhash64("node"), F.col("parts")) + 1).cast("int").alias("part"))))
    work = (placed.join(pairs, ["key", "tile"]).select("pair", "pop", "node", "fp")
            .repartition("pair").sortWithinPartitions("pair", "pop", "node"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(t: pa.Table) -> pa.RecordBatch:
            fp = np.frombuffer(b"".join(t.column("fp").to_pylist()), np.uint64).reshape(t.num_rows, -1)
            node = t.column("node").to_numpy()
            root = tile_roots(t.column("pair").to_numpy(), fp, t.column("pop").to_numpy().astype(np.int64), radius)
            off = node[root] != node
            return pa.RecordBatch.from_arrays([pa.array(node[off]), pa.array(node[root][off])], ["a", "b"])

        return _by_pair(batches, forest)

    return work.mapInArrow(compare, "a long, b long").distinct()


def near_components(prints: DataFrame, radius: int) -> DataFrame:
    """(fp, component_id): component_id is the smallest doc_id reachable over links. ``prints`` is stored output of
    :func:`with_fingerprints`; equal fingerprints become one node first, so copies cost nothing."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.min("pop").alias("pop"),
                                            F.first("keys").alias("keys")).withColumn("node", F.xxhash64("fp")))
    labels = components(links(nodes, radius))
    rooted = nodes.join(labels, "node", "left").select("fp", "low", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(lowest, "root").select("fp", "component_id")


def simhash_groups(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``docs`` (doc_id, text). Exact: every two
    fingerprints within ``radius`` bits are linked."""
    prints = stored(with_fingerprints(docs, block_keys(radius), shingle))
    found = near_components(prints, radius)
    return prints.join(found, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct word shingles."""
    parts = set(shingles(text, size))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64, len(parts)))


def with_sets(docs: DataFrame, minima: int, shingle: int, lanes: int) -> DataFrame:
    """doc_id with ``set_id`` (equal for equal shingle sets), ``size`` of the set, and ``fp``, ``pop`` and ``keys`` of its
    distinct shingles."""
    keys = minima_keys(minima)
    schema = T.StructType([
        T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("set_id", T.BinaryType()), T.StructField("size", T.IntegerType()),
        T.StructField("fp", T.BinaryType()), T.StructField("pop", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema.names[1:]]
            for text in batch.column(1):
                h = shingle_set(text.as_py(), shingle)
                fp = fingerprint(h, lanes)
                row = xxhash.xxh3_128_digest(h.tobytes(), SEED), len(h), fp, int.from_bytes(fp, "big").bit_count(), keys(h, fp)
                for to, value in zip(out, row):
                    to.append(value)
            kinds = pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out, kinds)], schema.names)

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, schema)


def set_roots(sets: list[np.ndarray], least: float) -> np.ndarray:
    """Root index of every set (none empty): sets with a Jaccard similarity of at least ``least`` are linked. Each set is
    compared with all that are not reached yet, so a dense group takes few passes."""
    size = np.array([len(x) for x in sets])
    token = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.split(token, np.cumsum(size)[:-1])
    mark = np.zeros(len(token), bool)
    root = np.full(len(sets), -1)
    rest, flat, start = np.arange(len(sets)), token, np.cumsum(size) - size
    for first in range(len(sets)):
        if root[first] >= 0:
            continue
        root[first], queue = first, [first]
        while queue:
            open_ = rest[root[rest] < 0]
            if not len(open_):
                return root
            if 2 * len(open_) < len(rest):
                rest, flat = open_, np.concatenate([own[j] for j in open_])
                start = np.cumsum(size[rest]) - size[rest]
            i = queue.pop()
            mark[own[i]] = True
            shared = np.add.reduceat(mark[flat], start, dtype=np.int64)
            mark[own[i]] = False
            near = rest[(root[rest] < 0) & (shared / (size[rest] + size[i] - shared) >= least)]
            root[near] = first
            queue.extend(near.tolist())
    return root


def set_links(docs: DataFrame, members: DataFrame, shingle: int, least: float) -> DataFrame:
    """Edges (a, b) that connect all ``members`` (node, group, size, row) of one group whose shingle sets have a Jaccard
    similarity of at least ``least``. ``docs`` has row and text. Groups are cut into tiles in the order of set sizes; tile
    pairs whose sizes rule the similarity out are never formed, and each tile pair gives a spanning forest."""
    placed = members.withColumn("level", F.floor(F.log("size") * LEVELS))
    order = Window.partitionBy("group").orderBy("level")  # at most one row per level
    need = F.greatest(F.count(F.lit(1)) / TILE_ROWS, F.sum("size") / TILE_SHINGLES)
    bands = stored(placed.groupBy("group", "level").agg(need.alias("need"))
                   .select("group", "level", F.floor(F.sum("need").over(order) - F.col("need")).alias("band"),
                           F.ceil("need").cast("int").alias("parts")))
    tiles = (bands.select("group", "level", "band", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
             .groupBy("group", F.struct("band", "part").alias("tile"))
             .agg(F.min("level").alias("low"), F.max("level").alias("high")))
    others = tiles.toDF("group", "tile2", "low2", "high2")
    apart = int(np.ceil(-np.log(least) * LEVELS))
    pairs = (tiles.join(others, "group")
             .where((F.col("tile") <= F.col("tile2")) & (F.greatest("low", "low2") - F.least("high", "high2") <= apart))
             .select("group", F.explode(F.array_distinct(F.array("tile", "tile2"))).alias("tile"),
                     F.xxhash64("group", "tile", "tile2").alias("pair")))
    tile = F.struct("band", (F.pmod(F.xxhash64("node"), F.col("parts")) + 1).cast("int").alias("part"))
    asked = (placed.join(bands, ["group", "level"]).withColumn("tile", tile).join(pairs, ["group", "tile"])
             .groupBy("row", "node").agg(F.collect_list("pair").alias("pairs")))  # as many as its group has tiles

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(text.as_py(), shingle).tobytes() for text in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("pairs"), pa.array(sets, pa.binary())], ["node", "pairs", "hashes"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def forest(t: pa.Table) -> pa.RecordBatch:
            pair, node = t.column("pair").to_numpy(), t.column("node").to_numpy()
            ends = [*(np.flatnonzero(np.diff(pair)) + 1).tolist(), len(pair)]
            hashes, root, at = t.column("hashes"), [], 0
            for end in ends:
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in hashes.slice(at, end - at)]
                root.append(at + set_roots(sets, least))
                at = end
            root = np.concatenate(root)
            off = root != np.arange(len(root))
            return pa.RecordBatch.from_arrays([pa.array(node[off]), pa.array(node[root][off])], ["a", "b"])

        return _by_pair(batches, forest)

    return (docs.join(asked, "row").select("node", "pairs", text_of(docs).alias("text"))
            .mapInArrow(hashed, "node long, pairs array<long>, hashes binary")
            .select("node", "hashes", F.explode("pairs").alias("pair"))
            .repartition("pair").sortWithinPartitions("pair")
            .mapInArrow(compare, "a long, b long").distinct())


def keep_one(docs: DataFrame, shingle: int = 5, lanes: int = 16, radius: int = 256, minima: int = 8, least: float = 0.8) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, the one with the smallest doc_id; all columns stay.

    Two documents are near duplicates if the Jaccard similarity of their sets of distinct five-word shingles is at least
    ``least``, and so are documents that others connect; texts without words are alike. Candidates share one of ``minima``
    smallest shingle hashes (a pair at 0.8 shares none with probability 3e-6) and differ in at most ``radius`` of 1024
    bits; what counts is the comparison of the sets, by 64-bit hashes of the shingles. Rows with a null doc_id stay only
    where nothing else does; of rows that repeat a doc_id in one group one stays.
    """
    keyed = docs.withColumn("__row", F.monotonically_increasing_id())
    held = stored(keyed)
    named = held.select(F.col("__row").alias("doc_id"), F.col("text"))
    prints = stored(with_sets(named, minima, shingle, lanes))
    nodes = stored(prints.groupBy("set_id").agg(
        F.min("doc_id").alias("row"), *(F.first(c).alias(c) for c in ("size", "fp", "pop", "keys"))).withColumn("node", F.xxhash64("set_id")))
    loose = components(links(nodes, radius)).withColumnRenamed("root", "group")
    members = stored(nodes.where("size > 0").select("node", "size", "row").join(loose, "node"))
    near = components(set_links(named.withColumnRenamed("doc_id", "row"), members, shingle, least))
    groups = nodes.select("set_id", "node").join(near, "node", "left").select("set_id", F.coalesce("root", "node").alias("group"))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))
    rows = prints.select(F.col("doc_id").alias("__row"), "set_id").join(groups, "set_id").select("__row", "group")
    best = (rows.join(held.select("__row", "doc_id"), "__row").groupBy("group")
            .agg(F.min(rank).alias("best")).select(F.col("best.__row").alias("__row")))
    return held.join(best, "__row", "left_semi").select(*docs.columns)
