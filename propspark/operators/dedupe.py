"""De-duplication, duplicate analysis and unions.

Choosing one row per key is an aggregate, not a window: every map task first reduces its own rows to one per key, so a
key that fills a third of the table costs one row per task in the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from propspark.functions.skew import with_group_count
from propspark.functions.store import stored
from propspark.functions.text import normalize_address

KEY = "duplicate_key"
DEFAULT_FIELDS = ("address", "city", "state")


def key_part(c: Column, is_address: bool, case_sensitive: bool = False) -> Column:
    t = F.coalesce(c.cast("string"), F.lit(""))
    if not case_sensitive:
        t = F.lower(t)
    t = F.regexp_replace(F.trim(t), r"\s+", " ")
    return normalize_address(t) if is_address else t


def dup_key(df: DataFrame, fields: Sequence[str] = DEFAULT_FIELDS, name: str = KEY,
            case_sensitive: bool = False) -> DataFrame:
    """WIN-1: normalised fields joined by ``|``; absent fields count as empty."""
    parts = [key_part(F.col(f) if f in df.columns else F.lit(""), "address" in f.lower(), case_sensitive)
             for f in fields]
    return df.withColumn(name, F.concat_ws("|", *parts))


def _blank(fields: Sequence[str]) -> str:
    return "|" * (len(fields) - 1)


def keep_one(df: DataFrame, keys: Sequence[str], order: Column, keep_all: Column | None = None,
             keep: Sequence[str] | None = None) -> DataFrame:
    """The row with the smallest ``order`` per key. Rows where ``keep_all`` holds are all kept. ``keep``: the columns to return,
    all by default; no others are moved.

    Kept rows form groups of equal rows (the whole row is part of the key) that are unfolded again afterwards.
    """
    row = F.struct(*[F.col(c) for c in (keep or df.columns)])
    group = {f"__g{i}": F.col(k) for i, k in enumerate(keys)}
    if keep_all is not None:
        group["__own"] = F.when(keep_all, row)
    tagged = df.select(*[c.alias(n) for n, c in group.items()], row.alias("__row"), order.alias("__order"))
    picked = tagged.groupBy(*group).agg(F.min_by("__row", "__order").alias("__row"), F.count("*").alias("__n"))
    if keep_all is None:
        return picked.select("__row.*")
    copies = F.when(F.col("__own").isNotNull(), F.col("__n")).otherwise(F.lit(1).cast("bigint"))
    # Unfolded in two steps, so that no list is longer than the root of the number of copies.
    one, step = F.lit(1).cast("bigint"), F.ceil(F.sqrt("__copies"))
    runs = picked.select("__row", copies.alias("__copies")).select("__row", "__copies", F.explode(F.sequence(one, F.ceil(F.col("__copies") / step))).alias("__run"))
    left = F.least(step, F.col("__copies") - (F.col("__run") - 1) * step)
    return runs.select("__row", F.explode(F.sequence(one, left)).alias("__i")).select("__row.*")


def dedupe_best(df: DataFrame, fields: Sequence[str] = DEFAULT_FIELDS, score: str = "flex_score",
                tie: Sequence[str] = ("parcel_id", "rid"), strict_reference: bool = False,
                keep: Sequence[str] | None = None) -> DataFrame:
    """WIN-2: the highest score per duplicate key.

    Rows whose key is entirely blank are kept as they are; ``strict_reference`` collapses them into one. Where a caller needs
    few columns, ``keep`` names them and spares the others the shuffle.
    """
    keyed = dup_key(df, fields)
    ties = [F.col(c) for c in tie if c in df.columns]
    order = F.struct(F.col(score).isNull(), -F.col(score), *ties)
    own = None if strict_reference else F.col(KEY) == _blank(fields)
    return keep_one(keyed, [KEY], order, own, keep or df.columns)


def dedupe_first(df: DataFrame, order: Sequence[str], fields: Sequence[str] = DEFAULT_FIELDS,
                 strict_reference: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """WIN-3: the first row per key in the given ingest order."""
    keyed = dup_key(df, fields)
    own = None if strict_reference else F.col(KEY) == _blank(fields)
    return keep_one(keyed, [KEY], F.struct(*[F.col(c) for c in order]), own, keep or df.columns)


def dedupe_raw(df: DataFrame, score: str = "flex_score", tie: Sequence[str] = ("parcel_id", "rid")) -> DataFrame:
    """WIN-4: best row per raw address, city and state, columns found by name."""
    keys = []
    for term in ("address", "city", "state"):
        hit = next((c for c in df.columns if term in c.lower()), None)
        if hit:
            keys.append(hit)
    ties = [F.col(c) for c in tie if c in df.columns]
    return keep_one(df, keys, F.struct(F.col(score).isNull(), -F.col(score), *ties)) if keys else df


def _groups(keyed: DataFrame, fields: Sequence[str], strict_reference: bool) -> DataFrame:
    counts = keyed.groupBy(KEY).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return counts if strict_reference else counts.where(F.col(KEY) != _blank(fields))


def dup_summary(df: DataFrame, fields: Sequence[str] = DEFAULT_FIELDS, strict_reference: bool = False) -> DataFrame:
    """WIN-5: groups with more than one row, the rows that could go, and the largest group."""
    total = df.agg(F.count("*").alias("t")).scalar()
    return _groups(dup_key(df, fields), fields, strict_reference).agg(
        F.coalesce(F.sum("n") - F.count("*"), F.lit(0)).alias("potential_duplicates"),
        F.count("*").alias("duplicate_groups_count"),
        F.coalesce(F.max("n"), F.lit(0)).alias("largest_duplicate_group"),
    ).withColumn("total_properties", total)


def dup_members(df: DataFrame, n: int = 10, fields: Sequence[str] = DEFAULT_FIELDS,
                keep: Sequence[str] = ("rid", "address", "city", "state", "flex_score", "source_file"),
                strict_reference: bool = False) -> DataFrame:
    """WIN-5: the member rows of the first ``n`` groups by key; ``n`` bounds the broadcast key list. The columns and keys are
    computed once and stored, as the groups and their members both read them."""
    columns = [c for c in keep if c in df.columns]
    keyed = stored(dup_key(df, fields).select(KEY, *columns))
    first = _groups(keyed, fields, strict_reference).orderBy(KEY).limit(n).withColumnRenamed("n", "group_size")
    return keyed.join(F.broadcast(first), KEY).select(KEY, "group_size", *columns)


def mark_dups(df: DataFrame, cols: Sequence[str], name: str = "is_duplicate",
              salt_by: Sequence[str] | None = None, min_rows: int | None = None) -> DataFrame:
    """WIN-6: true for every member of a group with more than one row; NULLs are equal to each other."""
    counted = with_group_count(df, cols, "__n", salt_by=salt_by, min_rows=min_rows)
    return counted.withColumn(name, F.col("__n") > 1).drop("__n")


def distinct(df: DataFrame) -> DataFrame:
    """WIN-7."""
    return df.dropDuplicates()


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """SET-1: rows of all frames; absent columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def column_sets(left: DataFrame, right: DataFrame) -> DataFrame:
    """SET-2: names shared by, or only in one of, two (column) tables."""
    a, b = left.select("column"), right.select("column")
    return (a.intersect(b).withColumn("where", F.lit("both"))
            .unionByName(a.exceptAll(b).distinct().withColumn("where", F.lit("left")))
            .unionByName(b.exceptAll(a).distinct().withColumn("where", F.lit("right"))))


def with_required(df: DataFrame, fields: Sequence[str] = DEFAULT_FIELDS) -> DataFrame:
    """Absent score becomes 0, absent key fields become empty text."""
    missing = {f: F.lit("") for f in fields if f not in df.columns}
    if "flex_score" not in df.columns:
        missing["flex_score"] = F.lit(0.0)
    return df.withColumns(missing) if missing else df


def aggregate(dfs: Sequence[DataFrame], fields: Sequence[str] = DEFAULT_FIELDS, preserve_highest: bool = True,
              order: Sequence[str] = ("source_file", "row_pos"), tie: Sequence[str] = ("parcel_id", "rid"),
              keep: Sequence[str] | None = None) -> DataFrame:
    """SET-3: union, defaults, one row per key, best first. ``keep``: the columns to return, all by default."""
    rows = union_all([with_required(d, fields) for d in dfs])
    ties = [c for c in tie if c in rows.columns]
    kept = list(dict.fromkeys([*keep, "flex_score", *ties])) if keep else rows.columns
    one = dedupe_best(rows, fields, tie=tie, keep=kept) if preserve_highest else dedupe_first(
        rows, [c for c in order if c in rows.columns], fields, keep=kept)
    return one.orderBy(F.desc_nulls_last("flex_score"), *ties).select(*(keep or rows.columns))


def aggregate_stats(before: DataFrame, after: DataFrame, address: str = "address") -> DataFrame:
    """SET-3: rows before and after, the removal rate, distinct places and the score bands."""
    s = F.col("flex_score")
    n_before = before.agg(F.count("*").alias("n")).scalar()
    return after.agg(
        F.count("*").alias("total_after"), F.count_distinct(address).alias("unique_addresses"),
        F.count_distinct("city").alias("unique_cities"), F.count_distinct("state").alias("unique_states"),
        F.count_if(s.between(8, 10)).alias("score_8_to_10"), F.count_if((s >= 6) & (s < 8)).alias("score_6_to_8"),
        F.count_if((s >= 4) & (s < 6)).alias("score_4_to_6"), F.count_if(s < 4).alias("score_below_4"),
    ).withColumn("total_before", n_before).withColumns({
        "duplicates_removed": F.col("total_before") - F.col("total_after"),
        "deduplication_rate": F.try_divide((F.col("total_before") - F.col("total_after")).cast("double"),
                                           F.col("total_before")) * 100})
