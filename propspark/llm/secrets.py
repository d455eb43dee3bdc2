"""Secret scanning with multipart credential linking, with DataFrame operations only.

Spans of every kind come from one regular expression each. Strong kinds are always reported. Weak candidates (bare
identifiers, bare tokens, endpoints) are reported only where the parts that complete them lie in the same scope: an
interval join over scope-sized cells of a document brings the parts together.

Defined results: a null text is empty; rows that repeat a doc_id and its text are one document in the span tables and
all stay in :func:`redact`; a null doc_id is a value of its own; an empty table gives an empty result; other columns
are ignored by the scan and kept by :func:`redact`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from propspark.llm.common import stored, text_of

# Parts that are at most this many code points apart belong to one scope.
SCOPE = 256
MARK = "[SECRET]"


@dataclass(frozen=True)
class Kind:
    """``least`` is the smallest length of ``group`` for a match to count; weak kinds need all roles in ``needs``."""

    name: str
    pattern: str
    role: str
    group: int = 0
    least: int = 0
    needs: tuple[str, ...] = ()


# The three base patterns. A run of hex digits below the least length never counts and never overlaps
# another run, so its length is part of the pattern; the same holds for the access ids.
KINDS = (
    Kind("assign", r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", "secret", 1, 12),
    Kind("access", r"AKIA[A-Z0-9]{14,}", "id"),
    Kind("hex", r"[0-9a-f]{16,}", "secret"),
    Kind("weak_id", r"(?i:(?<![A-Za-z0-9])(?:client|account|user|access)_?(?:id|name))[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@-]{4,}", "id", needs=("secret",)),
    Kind("weak_secret", r"(?<![A-Za-z0-9+/])(?=[A-Za-z+/]*[0-9])[A-Za-z0-9+/]{32,}={0,2}", "secret", needs=("id",)),
    Kind("endpoint", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D\"'<>]+", "endpoint", needs=("id", "secret")),
)


def _matches(text: Column, kind: Kind) -> Column:
    """Array of (gap, size, counts): what lies between a match and the one before it, its length, and whether it is
    long enough, in code points."""
    hits = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    gaps = F.split(text, kind.pattern, -1)
    found = F.transform(
        F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit")),
        lambda m: F.struct(
            F.length(m["gap"]).alias("gap"), F.length(m["hit"]).alias("size"),
            (F.length(F.regexp_extract(m["hit"], kind.pattern, kind.group)) >= kind.least if kind.least else F.lit(True)).alias("counts")))
    return F.when(text.rlike(kind.pattern), found).otherwise(F.array().cast("array<struct<gap:int,size:int,counts:boolean>>"))


def candidates(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(doc_id, text_hash, kind, start, stop, copies) of every match, and one row with a null kind per document. ``copies``: the
    number of rows that the document has.

    Positions are running sums over a document's matches, so the work is linear in the number of matches.
    """
    text = text_of(docs)
    base = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))
    every = F.array(*[F.struct(F.lit(k.name).alias("kind"), _matches(F.col("text"), k).alias("found")) for k in kinds],
                    F.struct(F.lit(None).cast("string").alias("kind"),
                             F.array(F.struct(F.lit(0).alias("gap"), F.lit(0).alias("size"), F.lit(True).alias("counts"))).alias("found")))
    listed = base.select("doc_id", "text_hash", F.inline(every)).select(
        "doc_id", "text_hash", "kind", F.posexplode("found").alias("at", "m")).select("doc_id", "text_hash", "kind", "at", "m.*")
    before = Window.partitionBy("doc_id", "text_hash", "kind").orderBy("at")
    stop = F.sum(F.col("gap") + F.col("size")).over(before)
    once = listed.groupBy(*listed.columns).agg(F.count(F.lit(1)).alias("copies"))  # rows that repeat a document
    return (once.withColumn("stop", stop.cast("long")).where("counts")
            .select("doc_id", "text_hash", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop", "copies"))


def spans(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, scope: int = SCOPE) -> DataFrame:
    """(doc_id, text_hash, kind, start, stop, copies): strong spans and linked weak ones, and one row with a null kind
    per document, which alone has its copies. Code points, stop exclusive."""
    found = stored(candidates(docs, kinds))
    weak = [k.name for k in kinds if k.needs]
    role = F.lit(None)
    for k in kinds:
        role = F.when(F.col("kind") == k.name, k.role).otherwise(role)
    key = ["doc_id", "text_hash"]
    parts = found.where("kind is not null").withColumn("role", role)
    cell = lambda at: F.floor(at / scope)
    mine = parts.where(F.col("kind").isin(weak)).withColumn(
        "cell", F.explode(F.sequence(cell(F.greatest(F.col("start") - scope, F.lit(0))), cell(F.col("stop") + scope))))
    others = parts.select(F.col("doc_id").alias("o_id"), F.col("text_hash").alias("o_hash"), F.col("start").alias("o_start"),
                          F.col("stop").alias("o_stop"), F.col("role").alias("o_role"),
                          F.explode(F.sequence(cell(F.col("start")), cell(F.col("stop")))).alias("o_cell"))
    near = (mine.join(others, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("text_hash") == F.col("o_hash")) & (F.col("cell") == F.col("o_cell")))
            .where((F.col("o_start") <= F.col("stop") + scope) & (F.col("o_stop") >= F.col("start") - scope) & (F.col("role") != F.col("o_role")))
            .groupBy(*key, "kind", "start", "stop").agg(F.collect_set("o_role").alias("roles")))
    complete = F.lit(False)
    for k in kinds:
        if k.needs:
            complete = complete | ((F.col("kind") == k.name) & (F.size(F.array_except(F.array(*map(F.lit, k.needs)), F.col("roles"))) == 0))
    linked = near.where(complete).select(*key, "kind", "start", "stop", F.lit(None).cast("long").alias("copies"))
    return found.where(F.col("kind").isNull() | ~F.col("kind").isin(weak)).unionByName(linked)


def report(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, text_hash and spans, an array of (start, rank, kind, stop) in the order of start and of ``kinds``."""
    rank = F.lit(None)
    for i, k in enumerate(kinds):
        rank = F.when(F.col("kind") == k.name, i).otherwise(rank)
    span = F.when(F.col("kind").isNotNull(), F.struct("start", rank.alias("rank"), "kind", "stop"))
    copies = F.max(F.when(F.col("kind").isNull(), F.col("copies")))
    one = spans(docs, kinds, scope).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(span)).alias("spans"), copies.alias("copies"))
    return one.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc_id", "text_hash", "spans")


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, scope: int = SCOPE, mark: str = MARK) -> DataFrame:
    """``docs`` with every run of overlapping or touching spans of its texts replaced by ``mark``; n_chars, where there
    is one, is counted again for changed texts. All rows and columns stay."""
    order = Window.partitionBy("doc_id", "text_hash").orderBy("start", "stop")
    seen = F.coalesce(F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A span that begins after all earlier ones keeps the text before it and leaves a mark; any other one only extends.
    cuts = (spans(docs, kinds, scope).where("kind is not null").withColumn("seen", seen)
            .groupBy("doc_id", "text_hash")
            .agg(F.array_sort(F.collect_list(F.when((F.col("start") > F.col("seen")) | (F.col("start") == 0) & (F.col("seen") == 0),
                                                    F.struct("start", F.col("seen").alias("begin"))))).alias("cuts"),
                 F.max("stop").alias("tail"))
            .withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}))
    # The columns are named by their frames, as documents may have columns of any name.
    same = docs["doc_id"].eqNullSafe(cuts["__id"]) & (F.xxhash64(text_of(docs)) == cuts["__hash"])
    text, changed = docs["text"], cuts["cuts"].isNotNull()
    kept = F.transform(cuts["cuts"], lambda c: F.concat(text.substr((c["begin"] + 1).cast("int"), (c["start"] - c["begin"]).cast("int")), F.lit(mark)))
    clean = F.concat(F.array_join(kept, ""), text.substr((cuts["tail"] + 1).cast("int"), F.length(text)))
    new = {"text": F.when(changed, clean).otherwise(text)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length(clean).cast(docs.schema["n_chars"].dataType)).otherwise(docs["n_chars"])
    return docs.join(cuts, same, "left").select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])
