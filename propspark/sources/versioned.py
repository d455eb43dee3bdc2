"""A stored table that updates change: files by key bucket, and a manifest of which version holds each bucket.

A table is a folder. ``data/version=V/bucket=B`` holds the rows of bucket B as version V wrote them; nothing is ever
overwritten. ``manifest`` holds one row a bucket for every version that finished, in one file, which appears as the last
step of a write; so a write that dies leaves files that no manifest names, and the table as it was. An update reads and writes
only the buckets that its keys fall into, and a repeated update of a dead one starts from the same state.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from propspark.functions.store import stored
from propspark.operators.enrich import upsert

_MANIFEST = "version long, bucket int, path string, buckets int, key string, schema string, write string"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def _state(spark: SparkSession, root: str) -> list:
    """The newest manifest, one row a bucket."""
    rows = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    newest = rows.where(F.col("version") == rows.agg(F.max("version")).scalar()).collect()  # one row a bucket
    if len({r["write"] for r in newest}) > 1:
        raise RuntimeError(f"{root}: two writes finished as version {newest[0]['version']} at the same time")
    return newest


def _write(df: DataFrame, key: str, buckets: int, path: str, files: int) -> None:
    """A folder a bucket; ``files`` splits a bucket further, for tables whose buckets are larger than a task should be."""
    split = F.pmod(F.xxhash64(F.col(key), F.lit("file")), F.lit(files))
    df.withColumn("bucket", _bucket(key, buckets)).repartition("bucket", split).write.partitionBy("bucket").parquet(path)


def _commit(spark: SparkSession, root: str, version: int, paths: dict[int, str | None], buckets: int, key: str, schema: T.StructType) -> None:
    write = uuid.uuid4().hex
    rows = [(version, b, paths.get(b), buckets, key, schema.json(), write) for b in range(buckets)]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/manifest")


def create(df: DataFrame, root: str, key: str, buckets: int = 64, files: int = 1) -> None:
    """A new table of ``df`` (unique on ``key``) as version 1."""
    path = f"{root}/data/{uuid.uuid4().hex}"
    _write(df, key, buckets, path, files)
    used = _written(df.sparkSession, path)
    _commit(df.sparkSession, root, 1, {b: f"{path}/bucket={b}" for b in used}, buckets, key, df.schema)


def _buckets_of(df: DataFrame, key: str, buckets: int) -> list:
    return df.select(_bucket(key, buckets).alias("bucket")).distinct().collect()  # at most one row a bucket


def read(spark: SparkSession, root: str) -> DataFrame:
    """The newest finished version."""
    return _read(spark, _state(spark, root))


def _read(spark: SparkSession, rows: Sequence) -> DataFrame:
    # A version's column may be missing in buckets that were written before it.
    schema = T.StructType.fromJson(json.loads(rows[0]["schema"]))
    paths = [r["path"] for r in rows if r["path"] is not None]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def version(spark: SparkSession, root: str) -> int:
    return _state(spark, root)[0]["version"]


def bucket_files(spark: SparkSession, root: str) -> dict[int, str | None]:
    """Where each bucket of the newest version is."""
    return {r["bucket"]: r["path"] for r in _state(spark, root)}


def update(updates: DataFrame, root: str, order: Sequence[str] = (), insert: bool = True, files: int = 1) -> int:
    """SNK-5: known new values replace old ones; the new version's number.

    Of updates with the same key the last by ``order`` counts as a whole. Without ``insert`` only rows that the table has are
    changed. Updates without a key are left out; new columns are added to the table and are NULL elsewhere.
    """
    spark = updates.sparkSession
    state = _state(spark, root)
    key, buckets, now = state[0]["key"], state[0]["buckets"], state[0]["version"]
    fresh = updates.where(F.col(key).isNotNull())
    types = {f.name: f.dataType for f in T.StructType.fromJson(json.loads(state[0]["schema"]))}
    fresh = fresh.select(*[F.col(c).cast(types[c]).alias(c) if c in types else F.col(c) for c in updates.columns])
    if order:
        whole = F.struct(*fresh.columns)
        fresh = fresh.groupBy(F.col(key).alias("__key")).agg(F.max_by(whole, F.struct(*order)).alias("__row")).select("__row.*")
    fresh = stored(fresh)
    touched = {r["bucket"] for r in _buckets_of(fresh, key, buckets)}
    if not touched:
        return now
    base = _read(spark, [r for r in state if r["bucket"] in touched])
    if not insert:
        fresh = fresh.join(base.select(key), key, "left_semi")
    merged = upsert(base, fresh, key)  # rows without a key match nothing and stay
    path = f"{root}/data/{uuid.uuid4().hex}"
    _write(merged, key, buckets, path, files)
    held = {b: f"{path}/bucket={b}" for b in _written(spark, path)}
    paths = {r["bucket"]: r["path"] for r in state} | {b: held.get(b) for b in touched}
    _commit(spark, root, now + 1, paths, buckets, key, merged.schema)
    return now + 1


def _written(spark: SparkSession, path: str) -> set[int]:
    """The buckets that a write has made, from the names of its files."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    bucket = F.regexp_extract("path", r"/bucket=(\d+)/", 1)
    return {int(r[0]) for r in names.select(bucket).distinct().collect() if r[0]}
