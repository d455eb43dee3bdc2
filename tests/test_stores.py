"""Stored tables that change, live lockouts, counting by slices, pages, headers, similarity and the JSON of existing logs."""

import difflib
import hashlib
import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from propspark.functions import blocks, pyjson
from propspark.operators import analytics, enrich, events, schema
from propspark.sources import io, versioned
from propspark.streaming import ingest


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_update_writes_only_touched_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    base = spark.createDataFrame([(i, f"n{i}", float(i)) for i in range(200)] + [(None, "nobody", 0.0)], "k long, s string, v double")
    versioned.create(base, root, "k", buckets=8)
    before = versioned.bucket_files(spark, root)
    assert versioned.version(spark, root) == 1 and rows_of(versioned.read(spark, root)) == rows_of(base)
    assert versioned.update(spark.createDataFrame([(3, -1.0, "x"), (None, 9.0, "y")], "k long, v double, extra string"), root) == 2
    after = versioned.bucket_files(spark, root)
    assert sum(before[b] != after[b] for b in before) == 1
    got = {r.k: tuple(r) for r in versioned.read(spark, root).collect()}
    assert got[3] == (3, "n3", -1.0, "x") and got[4] == (4, "n4", 4.0, None) and got[None] == (None, "nobody", 0.0, None) and len(got) == 201
    # the last of several updates counts, strangers are added or not
    many = spark.createDataFrame([(5, 1.0, 1), (5, 2.0, 3), (5, None, 2), (900, 7.0, 1)], "k int, v double, at int")
    versioned.update(many, root, order=["at"], insert=False)
    got = {r.k: r.v for r in versioned.read(spark, root).collect()}
    assert got[5] == 2.0 and 900 not in got
    versioned.update(many, root, order=["at"])
    assert {r.k: r.v for r in versioned.read(spark, root).collect()}[900] == 7.0
    assert versioned.update(many.where("false"), root) == 4


def test_aborted_update_leaves_the_table(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    versioned.create(spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("v")), root, "k", buckets=4)
    new = spark.range(50).select(F.col("id").alias("k"), F.lit(2).alias("v"))

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(versioned, "_commit", dies)
        with pytest.raises(RuntimeError):
            versioned.update(new, root)
    assert versioned.version(spark, root) == 1 and versioned.read(spark, root).where("v = 1").count() == 50
    versioned.update(new, root)
    assert versioned.version(spark, root) == 2 and versioned.read(spark, root).where("v = 2").count() == 50
    empty = str(tmp_path / "e")
    versioned.create(new.where("false"), empty, "k")
    assert versioned.read(spark, empty).count() == 0
    versioned.update(new, empty)
    assert versioned.read(spark, empty).count() == 50


def test_spelling_decides_before_column(spark):
    props = spark.createDataFrame([("123",), ("12-34-56-78-90-123-4567",), ("9" * 17,)], "parcel_id string")
    roll = spark.createDataFrame([("00000000000000123", None, 1), (None, "123", 2), ("12345678901234567", "", 3), (None, "12-34-56-78-90-123-4567", 4),
                                  (None, "99-99-99-99-99-999-9999", 5), (" " + "9" * 17, None, 6)], "PARID string, PCN string, no int")
    got = {r.parcel_id: r.no for r in enrich.cama_join(props, roll, ["no"]).collect()}
    assert got == {"123": 2, "12-34-56-78-90-123-4567": 4, "9" * 17: 5}


def test_lockouts_without_a_failure(spark, tmp_path):
    made = spark.createDataFrame([(1, datetime(2024, 1, 1), "a", True)], "event_id long, ts timestamp, user_id string, success boolean")
    made.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
    ingest.lockout_stream(live, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination()
    assert ingest.live_lockouts(spark, str(tmp_path / "out")).count() == 0


def test_lockout_state_is_dropped(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rng = random.Random(3)
    made = [(i, start + timedelta(seconds=20 * i + rng.random()), rng.choice("aab"), rng.random() < 0.2) for i in range(600)]
    every = spark.createDataFrame(made, "event_id long, ts timestamp, user_id string, success boolean")
    kept = []
    for part in range(3):
        every.where(f"event_id div 200 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(every.schema).parquet(str(tmp_path / "in"))
        q = ingest.lockout_stream(live, str(tmp_path / "out"), str(tmp_path / "ckpt"), 5, 4, late="1 minute")
        q.awaitTermination()
        kept.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    want = rows_of(events.lockouts(every, 5, 4).select("event_id", "user_id", "failures"))
    assert want and rows_of(ingest.live_lockouts(spark, str(tmp_path / "out")).select("event_id", "user_id", "failures")) == want
    assert kept[-1] < 150  # of about 480 failures


def test_sliced_failures(spark, monkeypatch):
    rng = random.Random(11)
    made = [(i, rng.choice([1, 1, 1, 2, None]), rng.choice([rng.randrange(0, 3 * 3600) * 1_000_000, rng.randrange(3600_000_000, 3601_000_000), 3600_500_000]), rng.random() < 0.3)
            for i in range(900)]
    df = spark.createDataFrame(made, "event_id int, user_id int, at long, success boolean").withColumn("ts", F.timestamp_micros("at"))
    fails = [r for r in made if not r[3]]
    want = {i: sum(1 for _, v, t, _ in fails if v == u and s - 900_000_000 < t <= s) for i, u, s, _ in fails}
    for slices in (1, 7, 900):
        found = events.sliced_failures(df, 15, slices)
        assert found.columns == [*df.columns, "failures"] and {r.event_id: r.failures for r in found.collect()} == want
    assert {r.event_id: r.failures for r in events.trailing_failures(df, 15).collect()} == want
    assert {r.event_id: r.failures for r in events.trailing_failures(df, 15, most=10).collect()} == want
    assert events.trailing_failures(df.where("false"), 15).count() == 0


def test_pages(spark):
    df = spark.range(5000).select("id", (F.col("id") % 700).alias("day"), F.when(F.col("id") % 9 > 0, F.col("id") % 5).alias("x"))
    order = [F.desc("day"), F.asc("id")]
    want = [r.id for r in df.orderBy(*order).collect()]
    pages = analytics.Pages(df, order, 7)
    assert pages.total == 5000 and pages.rows.columns[:3] == df.columns
    for at, n in ((0, 10), (690, 40), (4990, 50), (2500, 0), (6000, 5), (0, 5000)):
        assert [r.id for r in pages.page(at, n).collect()] == want[at:at + n]
    assert [r.id for r in analytics.page(df, "day", 3000, 5, ["id"], shallow=100).collect()] == want[3000:3005]
    assert "PartitionFilters: [(__part" in pages.page(2500, 10)._jdf.queryExecution().toString() or len(pages.page(2500, 10).inputFiles()) == 7
    assert analytics.Pages(df.where("false"), order).page(0, 5).count() == 0


def test_headers_in_one_job(spark, tmp_path):
    texts = {"a.csv": "x,\"y, z\"\n1,2\n" + "5,6\n" * 50_000, "b.csv": "x,\"y, z\"\n", "c.csv": "﻿q\n1", "d.csv": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    paths = [str(tmp_path / n) for n in texts]
    heads = {r.path.rsplit("/", 1)[1]: r.columns for r in io.csv_headers(spark, paths).collect()}
    assert heads == {"a.csv": ["x", "y, z"], "b.csv": ["x", "y, z"], "c.csv": ["q"]}
    assert [[p.rsplit("/", 1)[1] for p in g] for _, g in io.csv_groups(spark, paths)] == [["c.csv"], ["a.csv", "b.csv"]]
    cat = {(r.source_file, r.column, r.position) for r in schema.csv_catalog(spark, paths).collect()}
    assert cat == {("a.csv", "x", 0), ("a.csv", "y, z", 1), ("b.csv", "x", 0), ("b.csv", "y, z", 1), ("c.csv", "q", 0)}


NAMES = ["prop_id", "street_address", "municipality", "sqft", "construction_year", "Property Type", "citty", "", "a", "é😀x", "abcabc", "cabcab", "aaaa", "zip_code", "adress"]


def test_block_ratio_is_that_of_longest_matching_blocks(spark):
    rng = random.Random(1)
    words = NAMES + ["".join(rng.choice("abc_") for _ in range(rng.randrange(0, 14))) for _ in range(30)]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    x, y = blocks.characters(F.col("a")), blocks.characters(F.col("b"))
    for r in pairs.select("a", "b", blocks.block_ratio(x, y).alias("ratio"), blocks.shared_bound(x, y).alias("bound")).collect():
        want = difflib.SequenceMatcher(None, r.a, r.b)
        assert r.ratio == pytest.approx(want.ratio(), abs=1e-12) and r.bound == pytest.approx(want.quick_ratio(), abs=1e-12)


def test_suggestions_as_by_difflib(spark):
    cat = spark.createDataFrame([("f", n, i) for i, n in enumerate(NAMES + [f"{n.title()} " for n in NAMES])], "source_file string, column string, position int")
    got = {r.column: (r.suggested, round(r.confidence, 9), r.mapping_type) for r in schema.suggest_mapping(cat).collect()}
    want = {}
    for name in {r.column for r in cat.collect()}:
        low, best = name.lower().strip(), None
        for std, spellings in schema.PROCESSOR_ALIASES.items():
            for s in spellings:
                ratio = difflib.SequenceMatcher(None, low, s.lower()).ratio()
                if low == s.lower() and (best is None or best[2] != "exact"):
                    best = (std, 1.0, "exact")
                elif ratio > 0.6 and (best is None or best[2] != "exact" and ratio > best[1]):
                    best = (std, ratio, "fuzzy")
        if best:
            want[name] = (best[0], round(best[1], 9), best[2])
    assert got == want and got["prop_id"][0] == "property_id" and got["street_address"][0] == "address"


def test_python_json(spark):
    rng = random.Random(9)
    letters = "ab \"\\/\n\t\x00\x1f\x7f\x80é漢\u2028😀"

    def text():
        return "".join(rng.choice(letters) for _ in range(rng.randrange(0, 12)))

    def number():
        return rng.choice([0.0, -1.5, 1e16, 1e-7, rng.random(), rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300), float(rng.randrange(-10**9, 10**9))])

    made = []
    for i in range(300):
        tags = {text(): [rng.choice([None, text()]) for _ in range(rng.randrange(3))] for _ in range(rng.randrange(4))}
        made.append((i, (number(), tags, (rng.randrange(-2**63, 2**63), rng.random() < 0.5, text()), [number() for _ in range(rng.randrange(3))])))
    df = spark.createDataFrame(made, "i int, v struct<a: double, b: map<string, array<string>>, c: struct<z: long, `é`: boolean, s: string>, d: array<double>>")
    got = {r.i: r.t for r in df.select("i", pyjson.python_json(F.col("v"), df.schema["v"].dataType).alias("t")).collect()}
    for i, (a, b, (z, t, s), d) in made:
        assert got[i] == json.dumps({"a": a, "b": b, "c": {"z": z, "é": t, "s": s}, "d": d}, sort_keys=True)


def test_float_json(spark):
    values = [0.1, 1e15, 1e16, 123456789012345680.0, 1e-4, 1e-5, 5e-324, 1.7976931348623157e308, 2.0**-44, 1e22, 1e23, -0.0, 100.0, 6.55, 2e-3, 9007199254740993.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.t for r in df.select(pyjson.float_json(F.col("v")).alias("t")).collect()] == [json.dumps(v) for v in values]


def test_stored_checksums_of_a_log(spark):
    logged, stored = [], []
    for i in range(60):
        when = datetime(2024, 1, 1, 10, 0, i, 250_000 if i % 2 else 0)
        details = {"value": i / 7, "why": f"é\n{i}", "nested": {"b": i, "a": [i, i + 1]}}
        if i % 3 == 0:
            del details["why"]
        user = f"u{i}" if i % 5 else None
        text = json.dumps({"id": f"AE_{i}", "event_type": "user_login", "timestamp": when.isoformat(), "user_id": user, "action": "in", "details": details}, sort_keys=True)
        stored.append(hashlib.sha256(text.encode()).hexdigest())
        logged.append((f"AE_{i}", "user_login", when, user, "in", json.dumps(details), stored[-1]))
    log = spark.createDataFrame(logged, "id string, event_type string, timestamp timestamp, user_id string, action string, details string, checksum string")
    kind = "value double, why string, nested struct<b: long, a: array<long>>"
    assert events.verify(log, expected=events.log_checksum(log, kind)).first().integrity_percentage == 100.0
    bad = log.withColumn("details", F.when(F.col("id") == "AE_7", F.replace("details", F.lit("7"), F.lit("8"))).otherwise(F.col("details")))
    assert [r.id for r in events.corrupted(bad, expected=events.log_checksum(bad, kind)).collect()] == ["AE_7"]
