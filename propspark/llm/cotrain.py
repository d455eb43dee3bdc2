"""Quality classification by co-training.

Two logistic classifiers see different views of a document: its text (shape measures, marker words and how many words
begin like a marker) and its metadata
(source, language, length). Both are fitted to the labelled documents; then, in every round, each labels the unlabelled
documents that it is sure of for the other, and both are fitted again. At the end a third logistic model, fitted on
labelled documents that neither saw, calibrates and combines the two, and every document is scored. A document is good
if its label has quality 1 and toxic 0.

The classifiers are fitted on all labelled and all unlabelled documents: every Newton step is one pass over the stored
features (some 130 bytes a document), of which each task returns sums of a fixed size. Only the choice of marker words
looks at a sample, of at most ``LABELLED`` labelled documents, chosen by a hash of their ids.

Defined results: a null text is empty; null metadata are a value of their own; a document with several labels is good
if all of them say so, null labels are left out; without both good and bad labels every document has the score 1 and is
kept; rows that repeat a doc_id each get a row and each count; an empty table gives an empty result. Each row is kept or
rejected for its own text and metadata, also where others have its doc_id or none.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from propspark.llm.common import stored, text_of

LABELLED = 20_000
ROUNDS = 3
SURE = 0.98
MARKERS = 400
MARKER_LEAST = 5
STEMS = range(3, 8)  # lengths of the word beginnings that can be markers
HELD_MARKS = 500_000
META_BUCKETS = 128
SHAPE = 12
SUMS = 16  # tasks that add up the sums of all others; one more adds up theirs
STEPS = 25

_WORD = re.compile(r"\w+")
_SYMBOL = re.compile(r"[^\w\s.,;:'\"()-]")


def marks_of(words: Iterable[str]) -> set[str]:
    """Distinct words, and their beginnings with one, two and three stars where as many of the words begin so."""
    marks = set(words)
    begins = Counter(word[:k] for word in marks for k in STEMS if len(word) > k)
    for stem, n in begins.items():
        marks.update(stem + "*" * stars for stars in range(1, min(n, 3) + 1))
    return marks


def text_features(text: str, markers: dict[str, int], heads: set[str]) -> tuple[bytes, bytes]:
    """Shape measures, and one presence bit per marker. ``heads`` are the first letters of the markers with stars."""
    tokens = text.split()
    n = max(1, len(tokens))
    words = _WORD.findall(text.lower())
    distinct = set(words)
    lines = [x for x in text.split("\n") if x.strip()]
    shape = (
        1.0, np.log1p(len(tokens)) / 10, len(set(tokens)) / n, sum(a == b for a, b in zip(tokens, tokens[1:])) / n,
        min(5.0, len(text) / n / 10), len(_SYMBOL.findall(text)) / n, sum(map(str.isupper, text)) / max(1, sum(map(len, words))),
        sum(map(str.isdigit, text)) / max(1, len(text)), text.count("|") / n, 1 - len(set(lines)) / max(1, len(lines)),
        len(distinct) / max(1, len(words)), len(lines) / n)
    marks = np.zeros(MARKERS, np.uint8)
    found = marks_of(word for word in distinct if word[:STEMS[0]] in heads)
    marks[[markers[mark] for mark in markers.keys() & (distinct | found)]] = 1
    return np.asarray(shape, np.float32).tobytes(), np.packbits(marks).tobytes()


def meta_features(source: str | None, lang: str | None, n_chars: int) -> bytes:
    """The buckets of source, language and order of length."""
    return bytes(zlib.crc32(part.encode("utf-8", "surrogatepass")) % META_BUCKETS
                 for part in (f"s{source}", f"l{lang}", f"n{int(np.log2(n_chars + 1))}"))


def views(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Both views of stored features as matrices; the first columns are the constant."""
    n = batch.num_rows
    shape, marks, meta = (b"".join(batch.column(c).to_pylist()) for c in ("shape", "marks", "meta"))
    bits = np.unpackbits(np.frombuffer(marks, np.uint8).reshape(n, -1), axis=1)[:, :MARKERS]
    one = np.concatenate([np.frombuffer(shape, np.float32).reshape(n, SHAPE), bits.astype(np.float32)], axis=1)
    two = np.zeros((n, 1 + META_BUCKETS), np.float32)
    two[:, 0] = 1.0
    two[np.arange(n)[:, None], 1 + np.frombuffer(meta, np.uint8).reshape(n, 3).astype(int)] = 1.0
    return [one, two]


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _meta(docs: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in docs.columns else F.lit(None).cast("string")


def _inputs(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_of(docs).alias("text"), *(_meta(docs, name).alias(name) for name in ("source", "lang")))


def _content(docs: DataFrame) -> Column:
    """Hash of all that a decision depends on; a null and its neighbour's value are told apart."""
    meta = [_meta(docs, name) for name in ("source", "lang")]
    return F.xxhash64(text_of(docs), *(part for m in meta for part in (m.isNull(), m)))


def with_features(docs: DataFrame, markers: dict[str, int]) -> DataFrame:
    """doc_id and content (:func:`_content`) with shape, marks and meta: one pass over the texts."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("content", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("shape", "marks", "meta"))])
    heads = {mark[:STEMS[0]] for mark in markers if mark.endswith("*")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shape, marks, meta = [], [], []
            for text, source, lang in zip(b.column("text"), b.column("source"), b.column("lang")):
                t = text.as_py()
                for to, data in zip((shape, marks), text_features(t, markers, heads)):
                    to.append(data)
                meta.append(meta_features(source.as_py(), lang.as_py(), len(t)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("content"), *(pa.array(x, pa.binary()) for x in (shape, marks, meta))], schema.names)

    ins = _inputs(docs)
    return ins.withColumn("content", _content(ins)).mapInArrow(run, schema)


def fit_logistic(rows: DataFrame, cases: Callable[[pa.RecordBatch], list[tuple[np.ndarray, np.ndarray]]], widths: list[int],
                 ridge: float = 1.0) -> list[np.ndarray]:
    """Weights of several ridge logistic regressions by Newton steps; ``cases`` gives each one's matrix and targets in a
    batch. The first columns are the constants and are not shrunk. Tasks return sums, never rows."""
    weights, shrink = [np.zeros(n) for n in widths], [np.where(np.arange(n) == 0, 1e-6, ridge) for n in widths]
    cut = np.cumsum([n + n * n for n in widths])
    kind = "sums binary"

    def slopes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [(np.zeros(n), np.zeros((n, n))) for n in widths]
        for b in batches:
            for (slope, bend), w, (x, y) in zip(sums, weights, cases(b)):
                p = squash(x @ w.astype(np.float32))
                slope += (p - y) @ x
                half = x * np.sqrt(p * (1 - p) + 1e-6)[:, None].astype(np.float32)
                bend += half.T @ half
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(a.tobytes() for s in sums for a in s)], pa.binary())], ["sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(cut[-1])
        for b in batches:
            for part in b.column(0):
                out += np.frombuffer(part.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    for _ in range(STEPS):
        found = rows.mapInArrow(slopes, kind).repartition(SUMS).mapInArrow(total, kind).repartition(1).mapInArrow(total, kind).collect()  # one row of fixed size
        moved = 0.0
        for i, part in enumerate(np.split(sum(np.frombuffer(r["sums"]) for r in found), cut[:-1])):
            n = widths[i]
            step = np.linalg.solve(part[n:].reshape(n, n) + np.diag(shrink[i]), part[:n] + shrink[i] * weights[i])
            weights[i] = weights[i] - step
            moved = max(moved, np.abs(step).max())
        if moved < 1e-4:
            break
    return weights


def marker_words(docs: DataFrame, good: DataFrame) -> dict[str, int]:
    """The words and beginnings of words (:func:`marks_of`) whose presence tells good from bad labelled documents best,
    numbered. Of those that start and count alike one is taken."""
    rank = F.xxhash64(F.col("doc_id"), F.lit("sample"))
    chosen = stored(docs.select("doc_id").join(good.where("fold > 0"), "doc_id").select("doc_id", "good").distinct()
                    .orderBy(rank, "doc_id").limit(LABELLED))
    sizes = {r["good"]: r["n"] for r in chosen.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(), Counter()

        def out() -> pa.RecordBatch:
            found = list(held[0].keys() | held[1].keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(found, pa.string()), *(pa.array([held[good][mark] for mark in found], pa.int64()) for good in (1, 0))], ["word", "pos", "neg"])

        for b in batches:
            for good, text in zip(b.column("good").to_pylist(), b.column("text")):
                held[good].update(marks_of(_WORD.findall(text.as_py().lower())))
                if sum(map(len, held)) > HELD_MARKS:
                    yield out()
                    held = Counter(), Counter()
        yield out()

    words = (_inputs(docs).join(F.broadcast(chosen), "doc_id").select("good", "text")  # at most LABELLED ids
             .mapInArrow(counted, "word string, pos long, neg long"))
    rate = lambda c, n: F.log((F.col(c) + 0.5) / F.lit(n + 1.0))
    odds = (words.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .where(F.col("pos") + F.col("neg") >= MARKER_LEAST)
            .groupBy("pos", "neg", F.substring("word", 1, STEMS[0])).agg(F.min("word").alias("word"))
            .select("word", (F.abs(rate("pos", sizes.get(1, 0)) - rate("neg", sizes.get(0, 0))) * F.sqrt(F.col("pos") + F.col("neg"))).alias("gain")))
    return {r["word"]: i for i, r in enumerate(odds.orderBy(F.desc("gain"), "word").limit(MARKERS).collect())}


def train(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, list[np.ndarray], np.ndarray] | None:
    """The stored features of all documents, the weights of both views and those of their combination, or None where the
    labels have only one class."""
    good = (labels.where("doc_id is not null and quality is not null").groupBy("doc_id")
            .agg(F.min(F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)).alias("good"))
            .withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)).cast("int")))
    marked = with_features(docs, marker_words(docs, good))
    rows = stored(marked.join(good, "doc_id", "left"))
    seen = {(r["held"], r["good"]) for r in rows.where("good is not null").select((F.col("fold") == 0).alias("held"), "good").distinct().collect()}
    if {(False, 0), (False, 1)} - seen:
        return None
    names, widths = ["shape", "marks", "meta", "good", "fold"], [SHAPE + MARKERS, 1 + META_BUCKETS]

    def labelled(b: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        y = b.column("good").to_numpy(zero_copy_only=False).astype(np.float64)
        return [(x, y) for x in views(b)]

    weights = fit_logistic(rows.where("good is not null and fold > 0").select(*names), labelled, widths)
    for _ in range(ROUNDS):
        teachers = [w.copy() for w in weights]

        def taught(b: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
            """Labelled rows, and those that the other view's classifier was sure of."""
            y, xs = b.column("good").to_numpy(zero_copy_only=False).astype(np.float64), views(b)
            out = []
            for v in range(2):
                p = squash(xs[1 - v] @ teachers[1 - v])
                use = ~np.isnan(y) | (p >= SURE) | (p <= 1 - SURE)
                out.append((xs[v][use], np.where(np.isnan(y), p >= 0.5, y)[use]))
            return out

        weights = fit_logistic(rows.where("good is null or fold > 0").select(*names), taught, widths)

    def held(b: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
        z = [np.clip(x @ w, -15, 15) for x, w in zip(views(b), weights)]
        return [(np.stack([np.ones(b.num_rows), *z], axis=1).astype(np.float32), b.column("good").to_numpy(zero_copy_only=False).astype(np.float64))]

    check = "fold = 0" if {(True, 0), (True, 1)} <= seen else "fold > 0"
    return rows, weights, fit_logistic(rows.where(f"good is not null and {check}").select(*names), held, [3], 0.1)[0]


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """The rows of :func:`classify` with their content, or None where the labels have only one class."""
    model = train(docs, labels)
    if model is None:
        return None
    rows, weights, mix = model
    schema = T.StructType([docs.schema["doc_id"], T.StructField("content", T.LongType()),
                           *(T.StructField(c, T.DoubleType()) for c in ("text_score", "meta_score", "score")), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.stack([np.clip(x @ w, -15, 15) for x, w in zip(views(b), weights)], axis=1)
            score = squash(mix[0] + z @ mix[1:])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("content"),
                                              *map(pa.array, (squash(z[:, 0]), squash(z[:, 1]), score, score >= 0.5))], schema.names)

    return rows.select("doc_id", "content", "shape", "marks", "meta").mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text_score and meta_score (of one view each), score (combined; all are probabilities of being good) and
    keep (score of 0.5 or more) of every document."""
    found = scored(docs, labels)
    if found is None:
        return docs.select("doc_id", *(F.lit(1.0).alias(c) for c in ("text_score", "meta_score", "score")), F.lit(True).alias("keep"))
    return found.drop("content")


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`classify` rejects; all columns stay. Rows of one doc_id and content have one
    decision, all others have their own."""
    found = scored(docs, labels)
    if found is None:
        return docs
    bad = found.where("not keep").select(F.col("doc_id").alias("__id"), F.col("content").alias("__content")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__id")) & (_content(docs) == F.col("__content")), "left_anti")
