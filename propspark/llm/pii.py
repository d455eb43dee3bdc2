"""Personal data by candidate gradient boosting.

Fixed patterns with checks find the certain spans, the base; they always stay. Wide generators propose many more spans,
which overlap: windows of up to nineteen digits in runs of digit groups with other separators, and addresses whose signs are
spelled out. The checks label them: proposed spans that are certain are positive, all others count as negative, although some
are personal data that the fixed patterns miss. Boosted trees learn from the spans' format and context, never from the check
itself (no checksum, no leading plus, spelled signs read as signs), so what looks in every respect like certain spans scores
like them. On held-out texts the scores are calibrated, kind by kind, by the least-squares rising step function; a kind adds
spans from the score on at which the calibrated precision of all that is above it reaches ``PRECISION``, and adds none where no
score does. Of overlapping additions the highest score wins, and none overlaps a base span.

Texts are read once, whole, and only their spans are kept. Equal spans are counted before the trees see them, so a text
that is copied a thousand times is one weighted row. All spans are used; what reaches the driver is a table of fixed size.

Defined results: a null text is empty; rows that repeat a doc_id each have a result; a null doc_id stays null; without spans
of both labels nothing is added; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from propspark.llm.common import stored, text_of

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
HELD_OUT = 5  # one text of so many calibrates
LEAST = 20  # held-out spans above a threshold
BINS = 100
NEAR = 32  # characters of context on either side
# Words that announce a kind.
CUES = {"email": ("mail", "contact", "write", "address"), "ip": ("ip", "host", "server", "addr", "ping"),
        "card": ("card", "visa", "credit", "pay", "iban"), "phone": ("phone", "tel", "call", "fax", "mobile")}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_ANY = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]", re.IGNORECASE)
# Digit groups with at most three separators between them; a group's digits and its separators take one step each.
_RUN = re.compile(r"\(?[0-9]+(?:[\x20()./_: –-]{1,3}[0-9]+)*")
_SPELLED = re.compile(r"[\[({]\x20?at\x20?[\])}]|@", re.IGNORECASE)
_SPELLED_DOMAIN = re.compile(r"\x20?[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63}){0,5}", re.IGNORECASE)
_SIGN = re.compile(r"\x20?[\[({]\x20?(at|dot)\x20?[\])}]\x20?", re.IGNORECASE)
_SPELLED_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?\Z")
Span = tuple[int, int]


def luhn(digits: str) -> bool:
    doubled = [int(c) for c in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(2 * v - 9 * (v > 4) for v in doubled)) % 10 == 0


def emails(text: str) -> list[Span]:
    """Leftmost matches of the address pattern. Each is looked for from its at-sign, so long words cost nothing."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and (text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-")):
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            end = host.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def ips(text: str) -> list[Span]:
    found = []
    for m in _DOTTED.finditer(text):
        parts = [p.span() for p in _DIGITS.finditer(text, *m.span())]
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            values = [text[s:e].lstrip("0") for s, e in four]
            if all(len(v) < 4 and int(v or 0) <= 255 for v in values):
                found.append((four[0][0], four[3][1]))
    return found


def cards(text: str) -> list[Span]:
    found = []
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 40:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all certain spans, by start and then kind."""
    if not _ANY.search(text):
        return []
    return sorted((s, k, e) for k, spans in enumerate((emails(text), ips(text), cards(text), phones(text))) for s, e in spans)


def proposals(text: str) -> Iterator[tuple[int, int, int]]:
    """(kind, start, end) of what the generators propose."""
    for m in _SPELLED.finditer(text):
        head = _SPELLED_LOCAL.search(text, max(0, m.start() - 65), m.start())
        tail = _SPELLED_DOMAIN.match(text, m.end())
        if head and tail:
            yield 0, head.start(), tail.end()
    for run in _RUN.finditer(text):
        groups = [g.span() for g in _DIGITS.finditer(text, *run.span())]
        for i, (start, _) in enumerate(groups):
            digits = 0
            for j in range(i, len(groups)):
                digits += groups[j][1] - groups[j][0]
                if digits > 19:
                    break
                end = groups[j][1]
                if j == i + 3:
                    yield 1, start, end
                if digits >= 12:
                    yield 2, start, end
                if 7 <= digits <= 15:
                    # A bracket belongs to the number that it opens.
                    yield 3, start - (start > run.start() and text[start - 1] == "("), end


def label(kind: int, start: int, end: int, base: list[tuple[int, int, int]]) -> int:
    """1 for a certain span, else 0. A phone number also counts without its first groups. ``base``: certain spans near by."""
    return int(any(k == kind and e == end and (s == start or kind == 3 and s <= start) for s, k, e in base))


def features(kind: int, start: int, end: int, text: str) -> list[float]:
    """Format and context of a span."""
    piece = _SIGN.sub(lambda m: "@" if m.group(1).lower() == "at" else ".", text[start:end]) if kind == 0 else text[start:end]
    groups = [g.end() - g.start() for g in _DIGITS.finditer(piece)] or [0]
    before, after = text[max(0, start - NEAR):start], text[end:end + NEAR]
    # The sign before a number is part of the phone pattern's check.
    last = before.rstrip("+")[-1:] if kind == 3 else before[-1:]
    words = before.lower()
    rest = text[max(0, start - 8):start], text[end:end + 8]
    return [
        *(float(kind == k) for k in range(len(KINDS))), float(len(piece)), float(sum(groups)), float(len(groups)), float(min(groups)), float(max(groups)),
        float(groups[0]), float(groups[-1]), *(float(piece.count(c)) for c in " -.()/:_"), float(sum(c.isalpha() for c in piece)),
        float(len({c for c in piece if c.isdigit()})), float(piece[:1] == "0"), float(not last), float(last.isspace()), float(last.isalpha()), float(last.isdigit()),
        float(last in "\"'=:#"), float(not after), float(after[:1].isspace()), float(after[:1].isalnum()), float(after[:1] in ".,;!?"),
        float(sum(c.isdigit() for c in rest[0])), float(sum(c.isdigit() for c in rest[1])),
        *(float(any(c in words for c in CUES[k])) for k in KINDS)]


_CANDIDATE = "struct<kind: int, start: int, stop: int, label: int, features: array<double>>"
_SPAN = "struct<start: int, kind: int, stop: int, score: double>"


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id, fold, base and found (candidates) of every document; the text is not kept."""
    ids = docs.schema["doc_id"].dataType
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of(docs).alias("text"))
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("doc_id", ids), T.StructField("fold", T.LongType()),
                           T.StructField("base", T._parse_datatype_string(f"array<{_SPAN}>")), T.StructField("found", T._parse_datatype_string(f"array<{_CANDIDATE}>"))])
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())])
    candidate = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("label", pa.int32()), ("features", pa.list_(pa.float64()))])

    def look(text: str) -> tuple[list[dict], list[dict]]:
        base = base_spans(text)
        if not base and not _ANY.search(text):
            return [], []
        found, at = [], 0
        for kind, start, end in proposals(text):
            while at < len(base) and base[at][2] + 100 <= start:
                at += 1
            near = []
            for k in range(at, len(base)):
                if base[k][0] >= end:
                    break
                near.append(base[k])
            found.append({"kind": kind, "start": start, "stop": end, "label": label(kind, start, end, near),
                          "features": features(kind, start, end, text)})
        return [{"start": s, "kind": k, "stop": e, "score": None} for s, k, e in base], found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                made = [look(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("fold"), pa.array([m[0] for m in made], pa.list_(span)),
                                                  pa.array([m[1] for m in made], pa.list_(candidate))], schema.names)

    folded = rows.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)))
    return folded.mapInArrow(run, schema)


def fit(labelled: DataFrame, rounds: int = 15, depth: int = 4) -> GBTClassificationModel | None:
    """Boosted trees of (features, label); None unless there are both labels. Equal rows are one row with a weight."""
    weighted = stored(labelled.groupBy("features", "label").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    sides = weighted.agg(F.count_if(F.col("label") == 1).alias("yes"), F.count_if(F.col("label") == 0).alias("no")).first()
    if not sides["yes"] or not sides["no"]:
        return None
    # The square root of a weight: copies count for more than one, but do not outvote the other spans.
    rows = weighted.select(array_to_vector("features").alias("vector"), F.col("label").cast("double").alias("label"), F.sqrt("weight").alias("weight"))
    return GBTClassifier(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, maxBins=64, stepSize=0.3, seed=11).fit(rows)


def rising(bins: list[tuple[float, float]]) -> list[float]:
    """The rising step function closest to the shares of (positives, all) in consecutive bins."""
    steps: list[list[float]] = []  # positives, all, number of bins
    for yes, n in bins:
        steps.append([yes, n, 1])
        while len(steps) > 1 and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]:
            last = steps.pop()
            steps[-1] = [a + b for a, b in zip(steps[-1], last)]
    return [yes / n if n else 0.0 for yes, n, width in steps for _ in range(int(width))]


def thresholds(counts: list[tuple[int, int, float, float]], precision: float = PRECISION, least: int = LEAST) -> dict[int, float]:
    """The least score of every kind from which on the calibrated precision is enough. ``counts``: kind, bin, positives, all."""
    found = {}
    for kind in {c[0] for c in counts}:
        bins = [(0.0, 0.0)] * BINS
        for k, at, yes, n in counts:
            if k == kind:
                bins[at] = (yes, n)
        level = rising(bins)
        held = right = 0.0
        for at in range(BINS - 1, -1, -1):
            if not bins[at][1]:
                continue
            held, right = held + bins[at][1], right + level[at] * bins[at][1]
            if right < precision * held or level[at] < precision / 2:
                break
            if held >= least:
                found[kind] = at / BINS
    return found


def detect(docs: DataFrame) -> DataFrame:
    """doc_id and spans (start, kind, stop, score) of every document, by start and then kind; base spans have no score."""
    found = stored(candidates(docs))
    spans = found.select("row", "fold", F.explode("found").alias("c")).select("row", "fold", "c.*")
    model = fit(spans.where("fold != 0").select("features", "label"))
    empty = F.array().cast(f"array<{_SPAN}>")
    if model is None:
        chosen = found.withColumn("more", empty)
    else:
        score = F.element_at(vector_to_array("probability"), 2)
        plain = spans.withColumn("vector", array_to_vector("features"))
        scored = stored(model.transform(plain).select("row", "fold", "kind", "start", "stop", "label", score.alias("score")))
        at = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
        counts = scored.where("fold = 0").groupBy("kind", at.alias("bin")).agg(
            F.sum("label").cast("double").alias("yes"), F.count(F.lit(1)).cast("double").alias("n")).collect()  # kinds x bins at most
        least = thresholds([tuple(r) for r in counts])
        enough = F.lit(False)
        for kind, value in least.items():
            enough = enough | ((F.col("kind") == kind) & (F.col("score") >= value))
        # What lies on a base span is known already; the rest is chosen in its document.
        kept = scored.where(enough & (F.col("label") < 1)).groupBy("row").agg(F.collect_list(F.struct("start", "kind", "stop", "score")).alias("more"))
        chosen = found.join(kept, "row", "left").withColumn("more", F.coalesce("more", empty))
    schema = T.StructType([found.schema["doc_id"], T.StructField("spans", T._parse_datatype_string(f"array<{_SPAN}>"))])
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = []
            for base, more in zip(b.column("base").to_pylist(), b.column("more").to_pylist()):
                every.append(merged(base, more))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(every, pa.list_(span))], ["doc_id", "spans"])

    return chosen.select("doc_id", "base", "more").mapInArrow(pick, schema)


def merged(base: list[dict], more: list[dict]) -> list[dict]:
    """The base and the best of the additions that overlap neither it nor each other."""
    if more:
        taken = np.zeros(max(s["stop"] for s in [*base, *more]) + 1, bool)
        for s in base:
            taken[s["start"]:s["stop"]] = True
        base = list(base)
        for s in sorted(more, key=lambda s: (-s["score"], s["start"] - s["stop"], s["start"], s["kind"])):
            if not taken[s["start"]:s["stop"]].any():
                taken[s["start"]:s["stop"]] = True
                base.append(s)
    return sorted(base, key=lambda s: (s["start"], s["kind"], s["stop"]))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in square brackets; spans that overlap become one, named by the first.
    ``n_chars``, where there is one, is the new length."""
    key = "__pii_row"
    rows = stored(docs.withColumn(key, F.monotonically_increasing_id()))
    ids = rows.select(F.col(key).alias("doc_id"), "text")
    spans = detect(ids).where(F.size("spans") > 0).select(F.col("doc_id").alias("__pii_at"), F.col("spans").alias("__pii_spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for text, found in zip(b.column("text").to_pylist(), b.column("__pii_spans").to_pylist()):
                if found:
                    parts, end = [], 0
                    for s in found:
                        if s["start"] >= end:
                            parts += [text[end:s["start"]], f"[{KINDS[s['kind']].upper()}]"]
                        end = max(end, s["stop"])
                    text = "".join(parts) + text[end:]
                made.append(text)
            yield b.set_column(b.schema.get_field_index("text"), b.schema.field("text"), pa.array(made, b.schema.field("text").type))

    joined = rows.join(spans, F.col(key) == F.col("__pii_at"), "left")
    clean = joined.mapInArrow(run, joined.schema).select(*docs.columns)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean
