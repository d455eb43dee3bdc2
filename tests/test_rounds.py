"""Steps that read all rows as seldom as they can, and columns that nobody asked for."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from propspark.llm import lm, spotsigs, toolcalls
from propspark.operators import dedupe, enrich, ml, recommend
from propspark.plans import catalogue, pipelines
from tests.test_plans import plan


@pytest.mark.parametrize("most", [800_000, 40])
def test_steps_between_reads_are_those_of_reading_all_rows(spark, monkeypatch, most):
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 1, (3000, 2))  # no clusters: many small steps
    points = spark.createDataFrame(x.tolist(), "a double, b double").repartition(3)
    starts = np.stack([x[rng.choice(len(x), 4, replace=False)] for _ in range(3)])
    monkeypatch.setattr(ml, "PLAIN", 3)
    monkeypatch.setattr(ml, "BORDER_ROWS", most)
    centres, inertia, reads = ml.lloyd(points, starts)
    slowest = 0
    for s in range(3):
        c, steps = starts[s].copy(), 0
        while True:
            own = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            after = np.array([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(4)])
            steps, moved, c = steps + 1, np.sqrt(((after - c) ** 2).sum(axis=1)).max(), after
            if moved <= 1e-4 or steps == 300:
                break
        slowest = max(slowest, steps)
        assert np.allclose(centres[s], c, atol=1e-12)
    assert reads <= slowest + 1 and (most < 1000 or reads < slowest)


def test_laid_out_trees_have_the_same_path_lengths():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    x[::7, 1] = np.nan
    tree = tuple(np.asarray(v) for v in ml._grow(x[:256][~np.isnan(x[:256]).any(axis=1)], np.random.default_rng(1)))
    want = []
    for row in x:
        node, depth = 0, 0
        while tree[0][node] >= 0:
            node, depth = int(tree[2][node] if row[tree[0][node]] <= tree[1][node] else tree[3][node]), depth + 1
        want.append(depth + tree[4][node])
    assert ml._path_lengths(ml._laid_out(tree), np.ascontiguousarray(x.T)).tolist() == want


def test_features_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def touched(v):
        seen.add(1)
        return v

    slow = F.udf(touched, "double").asNondeterministic()
    df = spark.range(50).select(F.col("id").alias("rid"), slow(F.col("id").cast("double")).alias("rent"))
    ml.fit_features(df)
    assert seen.value == 50
    assert ml.fit_features(df.withColumn("noi", F.lit(None))).names == ["rent"]
    seen.value = 50
    assert ml.drop_anomalies(df, ["rid"], trees=5).count() == 45
    assert seen.value == 100


def test_only_wanted_columns_are_moved(spark):
    df = spark.createDataFrame([("a", "1 Main Street", "X", "FL", 5.0, "p", "unwanted"), ("b", "1 main st", "X", "FL", 7.0, "q", "unwanted"),
                                ("c", "", "", "", 1.0, "r", "unwanted"), ("c", "", "", "", 1.0, "r", "other")],
                               "rid string, address string, city string, state string, flex_score double, parcel_id string, extra string")
    got = dedupe.dedupe_best(df, keep=["rid", "flex_score"])
    assert got.columns == ["rid", "flex_score"]
    assert sorted(tuple(r) for r in got.collect()) == [("b", 7.0), ("c", 1.0), ("c", 1.0)]
    both = dedupe.aggregate([df.where("rid = 'a'"), df.where("rid <> 'a'")], keep=["rid"])
    assert [r[0] for r in both.collect()] == ["b", "c", "c"]
    exchange = next(line for line in plan(got).splitlines() if "partial_min_by" in line)
    assert "extra" not in exchange


def block_of(words):
    size = np.array([len(w) for w in words])
    return lm.Block(np.frombuffer(b"".join(words), np.uint8), size, np.arange(len(words)), np.zeros(len(words), np.int64), np.full(len(words), 5))


def test_long_words_are_learned_to_their_ends():
    """Two words that differ after the bytes of a row: the tables and the weights learn what follows there too."""
    start = b"a" * lm.REACH
    bits = lm.table_bits(10)
    none = np.zeros((lm.DEPTHS, lm.KINDS), np.int64)
    learned = []
    for end in (b"bcdefghij" * 8, b""):
        block, tables = block_of([start + end]), lm.empty_tables(bits, np.int64)
        block.add(tables, bits)
        model = lm.Model([lm.squeezed(t) for t in tables], bits)
        shape = (lm.GATES, lm.PREDICTORS + 1, lm.PREDICTORS + 1)
        mass = np.zeros(lm.GATES)
        model.learn_block(block, none, none, np.zeros(shape), np.zeros_like(model.followed), mass, 0)
        assert np.isfinite(model.weights).all()
        learned.append((mass.sum(), tables[0].sum(), model.word_costs(block_of([start + b"bcdefghij" * 8]), none, none).sum()))
    # 5 occurrences of 8 bits for each byte beyond
    assert learned[0][0] - learned[1][0] == 5 * 8 * 72 and learned[0][1] - learned[1][1] == 5 * 8 * 72
    assert learned[0][2] < learned[1][2] / 2


def test_texts_of_edited_pairs_are_shuffled_once(spark):
    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("the quick fox "), F.col("id").cast("string")).alias("text"))
    out = spotsigs.edited_pairs(docs)
    out.collect()
    text = plan(out)
    moved = [line for line in text.split("Initial Plan")[0].splitlines() if "first(text" in line and "partial_first(text" in line]
    assert "ReusedExchange" in text and len(moved) == 1


def brute_levels(calls):
    """Depth and latest turn of calls {id: (turn, needs, answer)}; None in and behind cycles."""
    out = {}
    for _ in range(len(calls) + 1):
        for c, (turn, needs, _) in calls.items():
            if c not in out and all(n in out for n in needs):
                due = [max(out[n][1], calls[n][2] if calls[n][2] is not None else out[n][1]) for n in needs]
                out[c] = (max([out[n][0] + 1 for n in needs], default=0), max([turn, *due]))
    return out


def test_levels_of_chains_branches_and_cycles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    calls = {f"c{i}": (i, [f"c{i - 1}"] if i else [], i + 3 if i % 4 else None) for i in range(40)}
    calls |= {f"d{i}": (int(rng.integers(90)), sorted({f"d{int(j)}" for j in rng.integers(0, i, 2)} | ({f"c{i}"} if i % 3 == 0 else set())) if i else [],
                        int(rng.integers(90)) if i % 2 else None) for i in range(12)}
    calls |= {"x0": (1, ["x2"], None), "x1": (2, ["x0"], 9), "x2": (3, ["x1"], None), "y": (4, ["x1"], None), "z": (5, ["c3", "y"], 7), "own": (6, ["own"], None)}
    rows = [(1, t, c, "f", json.dumps({"needs": [f"${n}" for n in needs]})) for c, (t, needs, _) in calls.items()]
    given = spark.createDataFrame(rows, "conv_id int, turn int, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, a, c, "") for c, (_, _, a) in calls.items() if a is not None], "conv_id int, turn int, call_id string, content string")
    written, real = [], toolcalls.stored
    monkeypatch.setattr(toolcalls, "stored", lambda df: written.append(1) or real(df))
    out = toolcalls.link(given, results, []).where("kind = 'call'").collect()
    want = brute_levels(calls)
    assert {r["call_id"]: (r["level"] // 2, r["order_turn"]) for r in out if r["level"] is not None} == want
    assert {r["call_id"] for r in out if r["level"] is None} == {"x0", "x1", "x2", "y", "z", "own"}
    assert all("waits for itself" in r["problems"] for r in out if r["level"] is None)
    assert len(written) < 40  # before: two for each of the 40 calls in a row


def counted(spark, df, column):
    """``df`` with a counter of how often the rows' ``column`` is computed."""
    seen = spark.sparkContext.accumulator(0)

    def touched(v):
        seen.add(1)
        return v

    return df.withColumn(column, F.udf(touched, df.schema[column].dataType).asNondeterministic()(column)), seen


def test_rows_are_computed_once(spark):
    rows = [(f"r{i}", f"{i // 3} Main Street", "X", "FL", float(i)) for i in range(30)]
    base = spark.createDataFrame(rows, "rid string, address string, city string, state string, flex_score double")
    df, seen = counted(spark, base, "address")
    assert dedupe.dup_members(df).count() == 30 and seen.value == 30
    df, seen = counted(spark, base, "city")
    assert recommend.quality_recs(df).count() > 0 and seen.value == 30
    df, seen = counted(spark, base.withColumnRenamed("address", "parcel_id"), "parcel_id")
    roll = spark.createDataFrame([("0 Main Street", "n", "x")], "PARID string, roll_no string, JV string")
    out = enrich.cama_join(df.select("rid", "parcel_id"), roll, ["roll_no"], keep=["roll_no"])
    assert out.columns == ["rid", "parcel_id", "roll_no", "status", "data_quality"]
    assert out.where("roll_no = 'n'").count() == 3 and seen.value == 30
    assert enrich.cama_join(df.select("rid", "parcel_id"), roll, ["roll_no"]).columns == ["rid", "parcel_id", "PARID", "roll_no", "JV", "status", "data_quality"]


def test_the_report_computes_component_stats_once(spark, sf, monkeypatch):
    calls, real = [], pipelines.agg.component_stats
    monkeypatch.setattr(pipelines.agg, "component_stats", lambda df: calls.append(real(df).where("column <> 'tagged'")) or calls[-1])
    text = plan(catalogue.QUERIES["run6_full_report_all_sections"](spark, sf))
    assert 0 < text.count("tagged") == plan(calls[0]).count("tagged")


def test_borders_beyond_the_driver_are_stored_and_read_instead_of_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.uniform(0, 1, (3000, 2))
    x[::50] = np.round(x[::50], 1)  # some rows lie as far from one centre as from another
    points = spark.createDataFrame(x.tolist(), "a double, b double").repartition(3)
    starts = np.stack([x[rng.choice(len(x), 4, replace=False)] for _ in range(3)])
    for name, value in (("PLAIN", 3), ("BORDER_ROWS", 40), ("JOB", 0.0)):
        monkeypatch.setattr(ml, name, value)
    rows, real = [], ml._stored_pass
    monkeypatch.setattr(ml, "_stored_pass", lambda borders, centres: rows.append(max(b.table.count() for b in borders.values())) or real(borders, centres))
    centres, _, reads = ml.lloyd(points, starts)
    slowest = 0
    for s in range(3):
        c, steps = starts[s].copy(), 0
        while True:
            own = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
            after = np.array([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(4)])
            steps, moved, c = steps + 1, np.sqrt(((after - c) ** 2).sum(axis=1)).max(), after
            if moved <= 1e-4 or steps == 300:
                break
        slowest = max(slowest, steps)
        assert np.allclose(centres[s], c, atol=1e-12)
    assert rows and reads < 0.7 * slowest  # before: as many as steps


def test_rows_as_far_from_two_centres_go_to_the_first():
    x = np.array([[0.0, 1.0], [0.0, -3.0], [2.0, 1.0], [1.0, 7.0], [1.0 + 1e-9, 7.0]])
    centres = np.array([[[0.0, 0.0], [2.0, 0.0], [2.0, 0.0]], [[5.0, 5.0], [5.0, 5.0], [5.0, 5.0]]])
    tile = next(ml._tiles(x, 3))
    own = ml._owned(tile, centres)[0]
    assert own.argmax(axis=1).tolist() == [[0, 0, 1, 0, 1], [0] * 5] and (own.sum(axis=1) == 1).all()
    assert ml._own_sums(x, centres)[0, 1].tolist() == [3.0 + 1e-9, 8.0, 2.0]


def test_the_filter_chain_reads_what_a_step_has_stored(spark, monkeypatch):
    rows = [(f"r{i}", float(i % 2) * 1000 + i % 7, float(i % 2) * 5 + i % 3) for i in range(300)]
    df = spark.createDataFrame(rows, "rid string, building_sqft double, lot_size_acres double")
    written, real = [], ml.stored
    monkeypatch.setattr(ml, "stored", lambda df, **how: written.append(df.columns) or real(df, **how))
    out, summary = ml.apply_ml(df, ["rid"], contamination=0.1, clusters=2, reference={"building_sqft": 1000.0}, low=0.0, n_init=2)
    assert len(written) == 4  # before: the features of the segments and of the similarity once more
    scores = [r["similarity_score"] for r in out.collect()]
    found = {r["metric"]: r["value"] for r in summary.collect()}
    assert scores == sorted(scores, reverse=True) and found["similar_properties"] == len(scores) > 0
    assert np.isclose(found["avg_similarity"], np.mean(scores))


def test_the_roll_is_moved_slim_and_joined_where_it_lies(spark, monkeypatch):
    props = spark.createDataFrame([("a", "12"), ("b", "1-2"), ("c", "3"), ("d", None), ("e", "0"), ("f", "4.5")], "rid string, parcel_id string")
    roll = spark.createDataFrame([("12", None, 2, "x"), ("12", None, 1, "y"), ("1-2", None, 3, "z"), (None, "00000000000000003", 4, "u"), ("9", "4/5", 5, "v"),
                                  ("45", None, 6, "w")], "PARID string, PCN string, no int, JV string")
    monkeypatch.setattr(enrich.F, "xxhash64", lambda c: F.hash(c).cast("long") % 1)  # every key has the same hash
    out = enrich.cama_join(props, roll, ["no"], min_rows=100)
    got = {r["rid"]: (r["no"], r["JV"], r["status"], r["data_quality"]) for r in out.collect()}
    none = (None, None, "NOT_FOUND_IN_CAMA", "FAILED")
    assert got == {"a": (1, "y", None, "COMPLETE"), "b": (3, "z", None, "COMPLETE"), "c": (4, "u", None, "COMPLETE"), "d": none, "e": none, "f": (6, "w", None, "COMPLETE")}
    text = plan(enrich.cama_join(props, roll, ["no"], keep=["no"], min_rows=100))
    moved = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "RoundRobin" not in line]
    assert "__salt" not in text and "__key" not in "".join(moved)  # before: a third exchange of the roll for the salts
