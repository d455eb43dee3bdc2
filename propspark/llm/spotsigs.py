"""SpotSigs document fingerprints, with DataFrame operations only.

After every common word (the anchor) the next content words form a chain; where a stretch of text has no common word,
words chosen by their hash are anchors instead. Anchor and chain are one signature, and a document's fingerprint is the set of its signatures. Sets are compared by Jaccard similarity; a pair whose set lengths
alone rule the wanted similarity out is pruned without looking at the sets.

Defined results: a null text is empty; a text without words has the empty set, and two empty sets have likeness 1; rows
that repeat a doc_id and its text are one document, and each has its row; null ids come last; a single document is its own successor; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from propspark.llm.common import stored, text_of

# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be but by for from had has have he his in is it not of on or that the this to was were which with "
    "als auf bei das dem den der des die ein eine einer es für im ist mit nicht sich sie sind und von war zu zum zur "
    "au aux avec ce dans des du elle en est et il la le les ne par pas pour que qui se sur un une "
    "al con de del el ella ellas ellos este la las lo los no para por se su sus una uno y"
).split()
CHAIN = 2
REACH = 6
BARE = 12  # words without a common one, on both sides of a word that can be an anchor by its hash
EACH = 4  # one in so many of those words is an anchor
BETWEEN = "[^\\p{L}\\p{N}]+"


def signatures(text: Column, anchors: list[str] | None = None, chain: int = CHAIN, reach: int = REACH) -> Column:
    """Sorted distinct 32-bit signatures. A chain is the first ``chain`` content words among the ``reach`` words after
    the anchor. Where no common word is within ``BARE`` words, one word in ``EACH`` is an anchor, so that every part of a
    text in any language counts; the rule looks at neighbours only, so an edit changes the signatures around it alone. The
    start of the text is an anchor too."""
    words = F.array_remove(F.split(F.lower(text), BETWEEN), "")
    common = sorted(set(anchors or ANCHORS))

    def spot(words: Column) -> Column:
        def one(word: Column, at: Column) -> Column:
            near = F.filter(F.slice(words, at + 2, F.lit(reach)), lambda w: ~w.isin(common))
            links = F.slice(near, 1, chain)
            around = F.slice(words, F.greatest(at + 1 - BARE, F.lit(1)), F.lit(2 * BARE))
            chosen = (F.pmod(F.hash(word), F.lit(EACH)) == 0) & ~F.exists(around, lambda w: w.isin(common))
            return F.when((word.isin(common) | chosen) & (F.size(links) == chain), F.hash(word, links))

        spots = F.filter(F.transform(words, one), lambda h: h.isNotNull())
        start = F.when(F.size(words) > 0, F.array(F.hash(F.lit("^"), F.slice(words, 1, chain + 1)))).otherwise(F.array().cast("array<int>"))
        return F.array_sort(F.array_distinct(F.concat(start, spots)))

    # transform over a one-element array evaluates the word list once
    return F.element_at(F.transform(F.array(words), spot), 1)


def fingerprint(sigs: Column) -> Column:
    """The set as 32 hex digits: equal sets have equal fingerprints."""
    return F.md5(F.array_join(sigs, ",").cast("binary"))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two sets, 0 where their lengths alone keep it below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b)).cast("double")
    return (F.when(large == 0, 1.0).when((small == 0) | (small / large < least), 0.0)
            .otherwise(shared / (F.size(a) + F.size(b) - shared)))


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, text_hash, next_id, next_hash): the next document in descending order of doc_id; after the last comes the
    first. Range partitions are numbered each on its own and joined at their borders, so nothing is sorted in one task."""
    parts = stored(ids.repartitionByRange(F.col("doc_id").desc_nulls_last(), F.col("text_hash"))
                   .withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("part").orderBy(F.col("doc_id").desc_nulls_last(), "text_hash")
    me = F.struct("doc_id", "text_hash")
    led = parts.select("*", F.lead(me).over(order).alias("next"), F.row_number().over(order).alias("at"))
    firsts = led.where("at = 1").select("part", me.alias("first"))  # one row per range partition
    wrap = Window.orderBy("part")
    after = firsts.select("part", F.coalesce(F.lead("first").over(wrap),
                                             F.first("first").over(wrap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("border"))
    following = F.coalesce("next", "border")
    return led.join(after, "part").select("doc_id", "text_hash", following["doc_id"].alias("next_id"), following["text_hash"].alias("next_hash"))


def _key(doc_id: str, text_hash: str) -> Column:
    return F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("~")), F.hex(text_hash))


def edited_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, next_id, n_chars, edited_sha256, and the signature sets sigs, edited_sigs and next_sigs of a document's text, of its
    edited text and of the next document's text. The edited text has its last half replaced by the next text's start.

    The texts are shuffled once, by document; what each gives to the one before it is shuffled once more.
    """
    text = text_of(docs)
    base = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    order = stored(successors(base.select("doc_id", "text_hash").distinct()).select(
        _key("doc_id", "text_hash").alias("key"), _key("next_id", "next_hash").alias("next_key")))
    texts = base.groupBy(_key("doc_id", "text_hash").alias("key")).agg(
        F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    sizes = stored(base.select(_key("doc_id", "text_hash").alias("key"), F.length("text").alias("n_chars")).distinct())
    asks = order.join(sizes, "key").select(F.col("next_key").alias("key"), F.col("key").alias("to"), F.floor(F.col("n_chars") / 2).cast("int").alias("half"))
    # The id and the copies (1 at least) are read so that both uses of the texts read the same columns and thus share one shuffle.
    given = texts.where("copies > 0").join(asks, "key").select(F.col("to").alias("key"), F.col("doc_id").alias("next_id"), F.substring(F.col("text"), F.lit(1), F.col("half")).alias("start"),
                                           signatures(F.col("text")).alias("next_sigs"))
    n = F.length("text")
    whole = texts.join(given, "key").select(
        "doc_id", "next_id", n.cast("long").alias("n_chars"), "text", "next_sigs", "copies",
        F.concat(F.substring(F.col("text"), F.lit(1), n - F.floor(n / 2).cast("int")), "start").alias("edited"))
    signed = whole.select("doc_id", "next_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
                          signatures(F.col("text")).alias("sigs"), signatures(F.col("edited")).alias("edited_sigs"), "next_sigs", "copies")
    return signed.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies", "copy")
