"""Schemas, quality, models, IO and streams on small inline tables."""

import os
import shutil
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from propspark.operators import clean, ml, quality as dq, schema, udf
from propspark.sources import io
from propspark.streaming import ingest


def test_normalize_columns(spark):
    df = spark.createDataFrame([(1, "a", "t")], "ID int, ` Address ` string, Municipality string")
    out = schema.normalize_columns(df)
    assert {"parcel_id", "site_address", "city", "acres", "zip_code"} <= set(out.columns)
    assert out.first()["acres"] == 0.0 and out.first()["zip_code"] == ""
    with pytest.raises(ValueError):
        schema.normalize_columns(spark.createDataFrame([(1,)], "x int"))


def test_find_column_priority():
    assert schema.find_column(["Capacity", "City"], ["city"]) == "Capacity"
    assert schema.find_column(["Type", "Property Type"], ["property type", "type"]) == "Property Type"
    assert schema.find_column(["a"], ["b"]) is None


def test_clean_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "`A  b!` int, `__c__` int, `###` int")
    assert schema.clean_names(df).columns == ["a_b", "c", "column_2"]


def test_catalogue_checks(spark):
    files = {"f1": spark.createDataFrame([("x", "1")], "`Property Type` string, price string"), "f2": spark.createDataFrame([(1,)], "adress int")}
    cat = schema.schema_catalog(spark, files)
    got = {(r["source_file"], r["column"]): (r["suggested"], r["mapping_type"]) for r in schema.suggest_mapping(cat).collect()}
    assert got[("f2", "adress")] == ("address", "fuzzy") and got[("f1", "price")] == ("sold_price", "exact")
    assert [(r["column"]) for r in schema.check_types(cat).collect()] == ["price"]
    missing = {(r["source_file"], r["missing_column"]) for r in schema.schema_diff(cat).collect()}
    assert missing == {("f1", "adress"), ("f2", "price"), ("f2", "property type")}


def test_pipeline_record_takes_first_value(spark):
    df = spark.createDataFrame([("p", None, "$1,000", "1750", 5.0), ("q", "2", "bad", "1999.0", None)],
                               "`Parcel ID` string, `Market Value` string, `Sold Price` string, `Year Built` string, Acres double")
    got = [(r["market_value"], r["year_built"], r["acres"]) for r in schema.to_pipeline_record(df).orderBy("parcel_id").collect()]
    assert got == [(1000.0, None, 5.0), (2.0, 1999, 0.0)]


def test_detect_numeric_threshold(spark):
    df = spark.createDataFrame([("1", "red"), ("100.50", "1"), ("$1,000.00", "2"), ("85%", "x"), ("N/A", "y")], "a string, b string")
    got = {r["column"]: (r["confidence"], r["conversion_feasible"], r["target_type"]) for r in clean.detect_numeric(df).collect()}
    assert got["a"] == (0.8, True, "float64") and got["b"][1] is False


def test_impute_strategies(spark):
    rows = [(i, "f", float(i) if i % 10 else None, None if i % 2 else float(i), "a" if i % 10 else None, "z" if i % 3 == 0 else None) for i in range(1, 41)]
    df = spark.createDataFrame(rows, "pos int, file string, few double, many double, word string, rare string")
    out = {r["pos"]: r for r in clean.impute(df, "pos", ["file"], block_rows=7).collect()}
    assert out[10]["few"] == 20.0 and out[1]["many"] == 0.0 and out[5]["many"] == 4.0
    assert out[10]["word"] == "a" and out[1]["rare"] == "Unknown"


def test_winsorize_leaves_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0)] * 30 + [(1000.0, 5.0)], "a double, b double")
    out = clean.winsorize(df).agg(F.max("a"), F.max("b")).first()
    assert out[0] < 1000 and out[1] == 5.0


def test_types_last_group_wins(spark):
    df = spark.createDataFrame([("Flex Office",), ("Industrial Warehouse",), ("Land",), (None,)], "property_type string")
    assert [r[0] for r in clean.normalize_types(df).collect()] == ["office", "warehouse", "Land", None]


def test_quality_of_empty_table(spark):
    df = spark.createDataFrame([], "address string, city string, state string")
    assert dq.cell_completeness(df).first()["overall_completeness"] is None
    assert dq.assess_quality(df).first()["total_records"] == 0


def test_validation_scores(spark):
    df = spark.createDataFrame([("f", "n", "a", "c", "FL", "Flex", "x")], "source_file string, `Property Name` string, Address string, City string, State string, `Property Type` string, `Building SqFt` string")
    r = dq.validate(df).first()
    assert r["is_valid"] and r["warning_count"] == 1
    assert r["quality_score"] == pytest.approx((100 + 100 + 5 / 6 * 100 + 60) / 4)


def test_plausibility_can_fail(spark):
    df = spark.createDataFrame([("C4", 2.0, 100.0), ("C4", 4.0, 200.0)], "z string, tax double, mv double")
    assert dq.plausibility(df, "z", "tax", "mv").first()["single_zoning"]
    with pytest.raises(Exception, match="implausible"):
        dq.plausibility(df, "z", "tax", "mv", fail=True).collect()


def test_fingerprint_ignores_order(spark):
    rows = [(i, str(i)) for i in range(20)]
    a, b = spark.createDataFrame(rows, "i int, s string"), spark.createDataFrame(rows[::-1], "i int, s string").repartition(3)
    assert dq.fingerprint(a).collect() == dq.fingerprint(b).collect()
    assert dq.fingerprint(a.where("i < 19")).collect() != dq.fingerprint(a).collect()


def test_quarantine_splits(spark):
    df = spark.createDataFrame([("1",), ("bad",), (None,), ("N/A",)], "acres string")
    good, bad = dq.split_quarantine(df, ["acres"])
    assert good.count() == 2 and bad.count() == 2


def test_forest_finds_planted_outliers(spark):
    rows = [(i, 30000.0 + i % 97, 2.0 + (i % 13) / 10) for i in range(400)] + [(1000 + i, 9e6 + i * 1e5, 900.0) for i in range(20)]
    df = spark.createDataFrame(rows, "rid int, building_sqft double, lot_size_acres double")
    kept = ml.drop_anomalies(df, ["rid"], contamination=0.1, trees=40)
    ids = {r["rid"] for r in kept.collect()}
    assert not any(i >= 1000 for i in ids) and abs(len(ids) - 378) <= 6
    assert ids == {r["rid"] for r in ml.drop_anomalies(df, ["rid"], contamination=0.1, trees=40).collect()}


def test_segments_cover_all_rows(spark):
    rows = [(i, float(i % 2) * 1000 + i % 7, float(i % 2) * 5 + i % 3) for i in range(200)]
    out, inertia = ml.segment(spark.createDataFrame(rows, "rid int, building_sqft double, lot_size_acres double"), k=2, n_init=2)
    sizes = ml.segment_sizes(out).collect()
    assert sorted(r["n"] for r in sizes) == [100, 100] and inertia > 0


def test_all_starts_step_together(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 1.0, (150, 2)) for c in ((0, 0), (9, 1), (4, 8))])
    points = spark.createDataFrame(x.tolist(), "a double, b double").repartition(3)
    starts = np.stack([x[rng.choice(len(x), 3, replace=False)] for _ in range(6)])
    calls, real = [], ml._lloyd_pass
    monkeypatch.setattr(ml, "_lloyd_pass", lambda p, c: calls.append(len(c)) or real(p, c))
    centres, inertia, passes = ml.lloyd(points, starts)
    slowest = 0
    for s in range(6):
        c, steps = starts[s].copy(), 0
        while True:
            own = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            after = np.array([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(3)])
            steps, moved, c = steps + 1, np.sqrt(((after - c) ** 2).sum(axis=1)).max(), after
            if moved <= 1e-4:
                break
        slowest = max(slowest, steps)
        assert np.allclose(centres[s], c) and np.isclose(inertia[s], ((x - c[((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)]) ** 2).sum())
    assert passes == len(calls) == slowest + 1 and calls[0] == 6


def test_user_functions(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    assert [r["s"] for r in udf.score_with(df, lambda x: x * 2, ["x"], "s").collect()] == [2.0, 4.0]
    assert udf.map_chunks(df, lambda p: p[p.x > 1], "x double").count() == 1


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="propspark-test-")


def test_csv_files_with_different_headers(spark, folder):
    for name, text in (("a.csv", "city,x\nTampa,1\n"), ("b.csv", "x,city\n2,Miami\n"), ("c.csv", "city,x\nOcala,3\n")):
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    paths = [os.path.join(folder, n) for n in ("a.csv", "b.csv", "c.csv")]
    rows = {(r["source_file"], r["city"], r["x"]) for r in io.read_properties(spark, io.csv_groups(spark, paths)).collect()}
    assert rows == {("a.csv", "Tampa", "1"), ("b.csv", "Miami", "2"), ("c.csv", "Ocala", "3")}
    assert [os.path.basename(r["path"]) for r in io.scan(spark, folder, "*.csv").collect()] == ["a.csv", "b.csv", "c.csv"]
    assert {r["extension"] for r in io.file_metadata(spark, paths, "csv").collect()} == {".csv"}


def test_bad_csv_lines_are_dropped(spark, folder):
    path = os.path.join(folder, "cama.csv")
    with open(path, "w") as f:
        f.write("PARID,JV\n1,10\n2,20,extra\n3,30\n")
    assert [(r["PARID"], r["JV"]) for r in io.read_cama_csv(spark, path).orderBy("PARID").collect()] == [("1", "10"), ("3", "30")]


def test_versioned_export_counts_rows(spark, folder):
    res = io.export_versioned(spark.range(37), f"{folder}/out", "t1", ["parquet", "json"])
    assert [(r["format"], r["record_count"]) for r in res.collect()] == [("parquet", 37), ("json", 37)]
    assert spark.read.parquet(f"{folder}/out/parquet").count() == 37


def test_stream_takes_only_new_files(spark, folder):
    src, out, ck = f"{folder}/src", f"{folder}/out", f"{folder}/ck"
    one = spark.range(5).selectExpr("id", "id % 2 AS v")
    one.coalesce(1).write.parquet(f"{folder}/p1")
    os.makedirs(src)
    part = next(p for p in os.listdir(f"{folder}/p1") if p.endswith(".parquet"))
    shutil.copy(f"{folder}/p1/{part}", f"{src}/a.parquet")
    for want in (5, 5):
        ingest.ingest_stream(spark, src, one.schema, out, ck).awaitTermination()
        assert spark.read.parquet(out).count() == want
    shutil.copy(f"{folder}/p1/{part}", f"{src}/b.parquet")
    ingest.ingest_stream(spark, src, one.schema, out, ck).awaitTermination()
    assert spark.read.parquet(out).groupBy("source_file").count().count() == 2


def test_cama_csv_skips_the_same_lines_for_any_columns(spark, tmp_path):
    from propspark.sources.io import read_cama_csv

    (tmp_path / "roll.csv").write_text('a,b,c\n1,2,3\n4,5\n6,7,8,9\n"x,y",1,2\n')
    rows = read_cama_csv(spark, str(tmp_path))
    assert rows.count() == rows.select("a").count() == len(rows.collect()) == len(rows.select("c").collect()) == 2


def test_cama_join_blank_ids_precedence_and_clashes(spark):
    from propspark.operators import enrich

    props = spark.createDataFrame([("", 1.0), ("N/A", 1.0), ("0", 1.0), ("12-3", 1.0), (None, 1.0)], "parcel_id string, ACREAGE double")
    roll = spark.createDataFrame([("", "", 9.0, 1), ("N/A", None, 9.0, 2), ("77", "123", 8.0, 3), ("123", None, 7.0, 4)],
                                 "PARID string, PCN string, ACREAGE double, row_no int")
    got = {r.parcel_id: r for r in enrich.cama_join(props, roll, ["row_no"]).collect()}
    assert len(got) == 5 and [i for i, r in got.items() if r.status is None] == ["12-3"]
    assert got["12-3"].roll_ACREAGE == 7.0 and got["12-3"].ACREAGE == 1.0


def test_live_lockouts_across_batches(spark, tmp_path):
    from propspark.operators import events as ev
    from propspark.streaming import ingest

    rows = [(i, f"2024-01-01 10:{m:02d}:00", u, ok) for i, (m, u, ok) in enumerate(
        [(4, "a", False), (8, "a", False), (10, "a", False), (13, "a", False), (17, "a", False), (18, "a", True), (40, "b", False), (50, "a", False)])]
    made = spark.createDataFrame(rows, "event_id long, ts string, user_id string, success boolean").withColumn("ts", F.to_timestamp("ts"))
    want = sorted(ev.lockouts(made, 15, 5).select("event_id", "failures").collect())
    assert [tuple(r) for r in want] == [(4, 5)]
    for part in ("event_id in (0, 1, 4)", "event_id in (2, 5, 6)", "event_id in (3, 7)"):  # the one in the middle comes last
        made.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        live = spark.readStream.schema(made.schema).parquet(str(tmp_path / "in"))
        ingest.lockout_stream(live, str(tmp_path / "out"), str(tmp_path / "ckpt"), 15, 5).awaitTermination()
    assert sorted(ingest.live_lockouts(spark, str(tmp_path / "out")).select("event_id", "failures").collect()) == want


def test_lookup_join_refuses_joins_that_keep_right_rows(spark):
    from propspark.functions.skew import lookup_join

    one = spark.range(3)
    with pytest.raises(ValueError):
        lookup_join(one, one, ["id"], "full_outer")


def test_clean_and_transform_computes_its_rows_once(spark, monkeypatch):
    from propspark.plans import catalogue, queries_clean

    schema = """rid string, zoning string, occupancy double, year_built int, row_pos bigint, source_file string, parcel_id string,
        property_name string, property_type string, building_sqft double, lot_size_acres double, address string, city string,
        state string, county string, owner_name string, sale_date timestamp, sold_price double"""
    own = [(f"r{i // 2 if i < 8 else i}", [None, "IL", " IG ", "IL"][i % 4], None if i % 7 == 3 else 60.0 + i % 5, None if i == 11 else 1960 + i % 9, i, f"file_{i % 3}")
           for i in range(40)] + [(None, "IL", 1.0, 1990, 99, "file_0"), ("r9", "IP", 9000.0, 1990, 98, None)]
    frame = spark.createDataFrame([r + (None,) * 12 for r in own], schema)
    calls = []
    monkeypatch.setattr(queries_clean, "props", lambda spark, d: calls.append(d) or frame)
    got = catalogue.QUERIES["cln16_clean_and_transform"](spark, "")
    assert len(calls) == 1
    # The rows are those of the table joined with itself by id.
    joined = frame.select("rid", F.col("rid").alias("Row Tie"), F.col("zoning").alias("Zoning Code"), F.col("occupancy").alias("Occupancy"),
                          F.col("year_built").alias("Year Built")).join(
        frame.select("rid", F.col("row_pos").alias("Row Pos"), F.col("source_file").alias("Source File")), "rid")
    want = clean.clean_and_transform(joined, 2001, "row_pos", ["source_file"], ["rid"]).select(
        "rid", "zoning_code", F.round("occupancy", 6), F.round("building_age", 6))
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(got) == rows(want) and got.count() > 40
