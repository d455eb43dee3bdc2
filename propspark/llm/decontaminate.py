"""Benchmark decontamination by a prefix-filtered set join, with DataFrame operations only.

An item's windows (``window`` consecutive words, or the whole item when it has fewer) are looked for in every document.
For exact containment the necessary prefix of a window, its words ordered by rarity in the corpus, is its rarest word:
a document that lacks it cannot contain the window. Occurrences of that word give candidates; the position of the word
in the window and the length of the document bound where the window can lie, and the words there are compared.

Defined results: a null text has no words; an item without words has no windows; an item without an id marks words but
is not listed; rows that repeat a doc_id and its text are searched once, and each has its row; a null doc_id is a value of its own; other
columns are ignored; without documents the result is empty, without items no word is hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from propspark.llm.common import ascii_lower, stored, text_of

# The characters that separate words.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WINDOW = 10
# A table of item words or windows is broadcast up to this many rows (some 100 bytes each); larger ones are shuffled.
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), BETWEEN), "")


def _small(df: DataFrame) -> bool:
    return df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, win): every window of every item."""
    words = items.select("item_id", words_of(text_of(items)).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    return words.select("item_id", "words", F.explode(F.sequence(F.lit(0), last)).alias("at")).select(
        "item_id", F.expr(f"slice(words, at + 1, {window})").alias("win"))


def rarest_words(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows`` (window_id, win) with ``word``, the one with the fewest occurrences in ``docs`` (doc_id, words), and
    ``off``, its place in the window."""
    places = windows.select("window_id", F.posexplode("win").alias("off", "word"))
    vocabulary = stored(places.select("word").distinct())
    listed = F.broadcast(vocabulary) if _small(vocabulary) else vocabulary
    counts = docs.select(F.explode("words").alias("word")).join(listed, "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = places.join(counts, "word", "left").select(
        "window_id", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "off").alias("rank"))
    best = ranked.groupBy("window_id").agg(F.min("rank").alias("rank"))
    return windows.join(best, "window_id").select("window_id", "win", "rank.word", "rank.off")


def occurrences(docs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, window_id, start, stop): one row per occurrence of a window, and one row per
    document with null in the last three. ``docs`` has doc_id, text_hash and words."""
    start = F.col("pos") - F.col("off")
    stop = start + F.size("win")
    fits = (start >= 0) & (stop <= F.size("words"))
    same = fits & (F.expr("slice(words, pos - off + 1, size(win))") == F.col("win"))
    if _small(prefixes):
        # The empty word ends every document and meets the one prefix row without a window.
        marks = prefixes.unionByName(prefixes.sparkSession.range(1).select(
            F.lit(None).cast("long").alias("window_id"), F.array().cast("array<string>").alias("win"),
            F.lit("").alias("word"), F.lit(0).alias("off")))
        spread = docs.select("doc_id", "text_hash", "words",
                             F.posexplode(F.concat("words", F.array(F.lit("")))).alias("pos", "word"))
        return (spread.join(F.broadcast(marks), "word").where(F.col("window_id").isNull() | same)
                .select("doc_id", "text_hash", F.size("words").alias("n_words"), "window_id",
                        F.when(F.col("window_id").isNotNull(), start).alias("start"),
                        F.when(F.col("window_id").isNotNull(), stop).alias("stop")))
    spread = docs.select("doc_id", "text_hash", F.posexplode("words").alias("pos", "word"))
    candidates = (spread.join(prefixes.select("word", "off", "window_id"), "word").where(start >= 0)
                  .select("doc_id", "text_hash", "window_id", "pos", "off"))
    d, c = docs.alias("d"), candidates.alias("c")
    found = (c.join(d, F.col("c.doc_id").eqNullSafe(F.col("d.doc_id")) & (F.col("c.text_hash") == F.col("d.text_hash")))
             .select("d.doc_id", "d.text_hash", "words", "window_id", "pos", "off")
             .join(prefixes.select("window_id", "win"), "window_id").where(same)
             .select("doc_id", "text_hash", F.size("words").alias("n_words"), "window_id", start.alias("start"), stop.alias("stop")))
    none = F.lit(None)
    return found.unionByName(docs.select("doc_id", "text_hash", F.size("words").alias("n_words"), none.cast("long").alias("window_id"),
                                         none.cast("int").alias("start"), none.cast("int").alias("stop")))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_hit (words inside occurrences), items (sorted ids of the
    items found, as strings) and contaminated."""
    raw = text_of(docs)
    parts = docs.select("doc_id", F.xxhash64(raw).alias("text_hash"), words_of(raw).alias("words"))
    listed = item_windows(items, window)
    windows = stored(listed.groupBy("win").agg(F.lit(1).alias("one")).select(F.monotonically_increasing_id().alias("window_id"), "win"))
    members = stored(listed.join(windows, "win").select("window_id", "item_id").distinct())
    prefixes = stored(rarest_words(parts, windows))
    key = ["doc_id", "text_hash"]
    # Every row of a document brings one row without a window, so their number is that of its copies.
    hits = stored(occurrences(parts, prefixes).groupBy(*key, "n_words", "window_id", "start", "stop").agg(F.count(F.lit(1)).alias("copies")))
    # Sorted spans of one document: a word is counted where a span goes beyond the end of those before it.
    spans = F.array_sort(F.collect_list(F.when(F.col("window_id").isNotNull(), F.struct("start", "stop"))))
    counted = F.aggregate(
        spans, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a["n"] + F.greatest(s["stop"] - F.greatest(s["start"], a["end"]), F.lit(0))).alias("n"),
                              F.greatest(s["stop"], a["end"]).alias("end")),
        lambda a: a["n"])
    per_doc = hits.groupBy(*key).agg(F.max("n_words").cast("long").alias("n_words"), counted.cast("long").alias("n_hit"),
                                     F.max(F.when(F.col("window_id").isNull(), F.col("copies"))).alias("copies"))
    found = hits.where("window_id is not null").select(*key, "window_id").distinct()
    named = (found.join(F.broadcast(members) if _small(members) else members, "window_id")
             .groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
             .withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}))
    both = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash"))
    rows = per_doc.join(named, both, "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        *key, "n_words", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.col("n_hit") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents that contain a window of an item; all columns stay."""
    bad = contamination(docs, items, window).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    # The columns are named by their frames, as documents may have columns of any name.
    same = docs["doc_id"].eqNullSafe(bad["__id"]) & (F.xxhash64(text_of(docs)) == bad["__hash"])
    return docs.join(bad, same, "left_anti")
