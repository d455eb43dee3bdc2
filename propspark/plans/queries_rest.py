"""Queries for models (ML), recommendations (REC), events (EVT), runs (RUN), streams (STR), user functions and IO."""

from pyspark.sql import Window, functions as F

from propspark.operators import analytics, events as ev, ml, quality as dq, recommend as rec, runs as rn, scoring as sco, udf
from propspark.plans import pipelines
from propspark.plans.props import PROPS_SQL as P, TODAY, props, scratch, table
from propspark.plans.queries_analytics import rounded
from propspark.plans.queries_clean import G, KEY, gappy
from propspark.plans.queries_scoring import candidates, ids, scored, weighted
from propspark.plans.registry import query
from propspark.plans.sqltext import CLASS, SCORED_SQL as S, WEIGHTED_SQL as W
from propspark.sources import io
from propspark.streaming import ingest


# --- models --------------------------------------------------------------------------------------------------------

ML_COLS = ["building_sqft", "lot_size_acres", "year_built", "sold_price"]


@query("ml1_features", G + """SELECT rid, round(coalesce(building_sqft,(SELECT median(building_sqft) FROM gappy)),4) AS f_building_sqft,
 round(coalesce(lot_size_acres,(SELECT median(lot_size_acres) FROM gappy)),4) AS f_lot_size_acres, cast(year_built as double) AS f_year_built FROM gappy""")
def _(spark, d):
    df = gappy(spark, d).select("rid", "building_sqft", "lot_size_acres", "year_built", F.lit(5.0).alias("rent"))
    out, names = ml.features(df)
    return rounded(ids(out, *[f"f_{c}" for c in names]), 4)


@query("ml2_drop_anomalies")
def _(spark, d):
    df = props(spark, d).select("rid", *ML_COLS)
    return ml.drop_anomalies(df, ["rid"]).select("rid", "anomaly_score")


@query("ml3_segments")
def _(spark, d):
    out, _ = ml.segment(props(spark, d).select("rid", *ML_COLS))
    return ml.segment_sizes(out)


REF = {"building_sqft": 30000.0, "lot_size_acres": 3.0, "year_built": 1995.0}
SIM = G + ", med AS (SELECT " + ", ".join(f"median({c}) AS {c}" for c in ML_COLS) + " FROM gappy), fil AS (SELECT rid, " + ", ".join(
    f"coalesce(g.{c}, m.{c})::double AS {c}" for c in ML_COLS) + " FROM gappy g, med m), st AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in ML_COLS) + " FROM fil), z AS (SELECT rid, " + ", ".join(
    f"({c}-m_{c})/s_{c} AS {c}" for c in ML_COLS) + " FROM fil, st), r AS (SELECT " + ", ".join(
    f"({REF[c] if c in REF else 'med.' + c}-m_{c})/s_{c} AS r_{c}" for c in ML_COLS) + " FROM st, med), s AS (SELECT rid, (" + "+".join(
    f"{c}*r_{c}" for c in ML_COLS) + ")/(sqrt(" + "+".join(f"{c}*{c}" for c in ML_COLS) + ")*sqrt(" + "+".join(
    f"r_{c}*r_{c}" for c in ML_COLS) + """)) AS v FROM z, r) SELECT rid, round(v,6) AS similarity_score FROM s WHERE v>=0.8"""


@query("ml4_similar", SIM)
def _(spark, d):
    return rounded(ids(ml.similar(gappy(spark, d), REF, 0.8, ML_COLS), "similarity_score"))


@query("ml4_similar_vectors", """WITH r AS (SELECT embedding AS e FROM embeddings WHERE vec_id=0), p AS (SELECT vec_id, label,
 list_cosine_similarity(embedding::double[], e::double[]) AS v FROM embeddings, r) SELECT vec_id, label, round(v,6) AS similarity_score FROM p WHERE v>=0.2""")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return rounded(ml.similar_vectors(e, "embedding", e.where("vec_id = 0").select("embedding"), 0.2).select("vec_id", "label", "similarity_score"))


@query("ml5_filter_chain")
def _(spark, d):
    df = props(spark, d).select("rid", *ML_COLS)
    _, summary = ml.apply_ml(df, ["rid"], contamination=0.1, clusters=3, reference=REF, low=0.5)
    return summary


# --- recommendations -----------------------------------------------------------------------------------------------

R1 = ["building_sqft", "sold_price", "lot_size_acres"]


def _rec1():
    parts = []
    for c in R1:
        src = f"(SELECT quantile_cont({c},0.25) AS a, quantile_cont({c},0.75) AS b, quantile_cont({c},0.8) AS e FROM props)"
        n = f"(SELECT count(*) FROM props WHERE {c}<a-1.5*(b-a) OR {c}>b+1.5*(b-a))"
        parts.append(f"""SELECT '{c}' AS "column", 'outlier_filter' AS type, round(a-1.5*(b-a),4) AS min, round(b+1.5*(b-a),4) AS max, NULL::varchar AS "values", {n} AS n, 0.8::double AS confidence FROM {src} WHERE {n}>0""")
        if "price" in c:
            parts.append(f"SELECT '{c}','high_value_filter',round(e,4),NULL,NULL,NULL,0.7 FROM {src}")
    parts.append("SELECT 'city','common_values_filter',NULL,NULL,(SELECT string_agg(city,', ' ORDER BY n DESC, city) FROM (SELECT city, count(*) AS n FROM props GROUP BY 1 ORDER BY 2 DESC,1 LIMIT 3)),NULL,0.6")
    return P + " UNION ALL ".join(parts)


@query("rec1_recommend", _rec1())
def _(spark, d):
    return rounded(rec.recommend(props(spark, d), R1, ["city"]), 4)


@query("rec2_recommend_ml", P + """, c AS (SELECT count(*) AS n FROM props) SELECT 'ml_anomaly_detection' AS type, 0.1::double AS option, 0.8::double AS confidence FROM c WHERE n>1000
UNION ALL SELECT 'ml_clustering', least(5,greatest(2,n//50))::double, 0.7 FROM c WHERE n>100""")
def _(spark, d):
    return rec.recommend_ml(props(spark, d))


@query("rec3_recommend_result", P + """, c AS (SELECT count(*) AS n, count(*) FILTER (building_sqft>=200000) AS k FROM props)
SELECT 'relax_filters' AS recommendation FROM c WHERE (n-k)*100.0/n>90 UNION ALL SELECT 'add_specific_criteria' FROM c WHERE (n-k)*100.0/n<10
UNION ALL SELECT 'broaden_ranges' FROM c WHERE k<10""")
def _(spark, d):
    from propspark.operators.filters import filter_map_summary

    return rec.recommend_result(filter_map_summary(props(spark, d), {"building_sqft": {"min": 200000}}))


@query("rec4_portfolio", S + """, m AS (SELECT 'focus_municipality' AS recommendation, city AS detail, round(avg(flex_score),6) AS value FROM cand GROUP BY city ORDER BY avg(flex_score) DESC, city LIMIT 3),
 u AS (SELECT 'target_use', property_use, round(avg(flex_score),6) FROM cand GROUP BY property_use ORDER BY avg(flex_score) DESC, property_use LIMIT 1)
SELECT * FROM m UNION ALL SELECT * FROM u UNION ALL SELECT 'sweet_spot_500k_2m','',round(avg(flex_score),6) FROM cand WHERE market_value BETWEEN 500000 AND 2000000
UNION ALL SELECT 'ideal_size_1_5_acres','',count(*) FROM cand WHERE lot_size_acres BETWEEN 1 AND 5
UNION ALL SELECT 'high_score_under_1m','',count(*) FROM cand WHERE flex_score>=7 AND market_value<1000000""")
def _(spark, d):
    return rounded(rec.portfolio_recs(candidates(spark, d)))


def run_table(spark, d):
    """Metrics of one run per supplier file, derived from its rows."""
    k = F.col("l_suppkey")
    msg = (F.when(k % 14 == 0, "Timeout while reading").when(k % 14 == 7, "File not found: x").otherwise(None))
    g = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count("*").alias("property_count"), F.count_if(F.col("l_quantity") > 40).alias("flex_candidate_count"))
    return g.select(
        F.concat(F.lit("file_"), k.cast("string")).alias("source_file"), (k % 7 != 0).alias("success"), "property_count", "flex_candidate_count",
        (F.col("property_count") / 64).alias("processing_time"), (F.col("property_count") / 1024).alias("file_size_mb"),
        F.coalesce(msg, F.when(k % 7 == 0, "Invalid column")).alias("error_message"), (k % 21 == 0).alias("recovered"))


RUNS = """runs AS (SELECT 'file_' || l_suppkey AS source_file, l_suppkey%7<>0 AS success, count(*) AS property_count, count(*) FILTER (l_quantity>40) AS flex_candidate_count,
 count(*)/64.0 AS processing_time, count(*)/1024.0 AS file_size_mb, CASE WHEN l_suppkey%14=0 THEN 'Timeout while reading' WHEN l_suppkey%14=7 THEN 'File not found: x' END AS error_message,
 l_suppkey%21=0 AS recovered FROM lineitem GROUP BY l_suppkey)
"""


@query("rec5_pipeline", S + ", " + RUNS + """, o AS (SELECT count(*) FILTER (flex_score BETWEEN 8 AND 10) AS p, count(*) FILTER (flex_score>=6 AND flex_score<8) AS g FROM cand)
SELECT 'prioritize_prime' AS recommendation, '' AS detail, p::double AS value FROM o WHERE p>0 UNION ALL SELECT 'visit_good','',g FROM o WHERE g>p*2
UNION ALL SELECT 'focus_state', (SELECT state FROM cand GROUP BY state ORDER BY avg(flex_score) DESC, state LIMIT 1), NULL
UNION ALL SELECT 'ideal_size_score','',round(avg(flex_score),6) FROM cand WHERE lot_size_acres BETWEEN 1 AND 5
UNION ALL SELECT 'file_failures','',round(count(*) FILTER (NOT success)*100.0/count(*),6) FROM runs HAVING count(*) FILTER (NOT success)*100.0/count(*)>10
UNION ALL SELECT 'slow_processing','',0.5""")
def _(spark, d):
    return rounded(rec.pipeline_recs(candidates(spark, d), run_table(spark, d), 0.5))


@query("rec6_quality", G + """, x AS (SELECT zoning, state, CASE WHEN row_pos%3=0 THEN lot_size_acres END AS lot_size_acres, address FROM gappy),
 b AS (SELECT quantile_cont(lot_size_acres,0.25) AS a1, quantile_cont(lot_size_acres,0.75) AS a3 FROM x),
 o AS (SELECT count(*) FILTER (lot_size_acres<a1-1.5*(a3-a1) OR lot_size_acres>a3+1.5*(a3-a1))*100.0/count(*) AS oa FROM x, b),
 w AS (SELECT count(*) FILTER (n>m) AS bad FROM (SELECT count(DISTINCT v) AS n, count(DISTINCT lower(v)) AS m FROM
  (SELECT 'z' AS c, zoning AS v FROM x UNION ALL SELECT 's', state FROM x UNION ALL SELECT 'a', address FROM x) GROUP BY c)),
 q AS (SELECT (count(zoning)+count(state)+count(lot_size_acres)+count(address))*1.0/(count(*)*4) AS completeness, (SELECT (4-0.3*bad)/4 FROM w) AS consistency,
  (SELECT (3 + CASE WHEN oa>5 THEN greatest(0.5,1-oa/100) ELSE 1 END)/4 FROM o) AS validity, (SELECT count(*) FROM (SELECT DISTINCT * FROM x))*1.0/count(*) AS uniqueness FROM x)
SELECT 'missing_column' AS kind, 'city' AS subject, NULL::double AS value UNION ALL SELECT 'missing_column','property_type',NULL UNION ALL SELECT 'missing_column','building_sqft',NULL
UNION ALL SELECT 'improve_quality','overall',round((completeness+consistency+validity+uniqueness)/4,6) FROM q WHERE (completeness+consistency+validity+uniqueness)/4<0.7
UNION ALL SELECT 'low_score','completeness',round(completeness,6) FROM q WHERE completeness<0.5 UNION ALL SELECT 'low_score','consistency',round(consistency,6) FROM q WHERE consistency<0.5
UNION ALL SELECT 'low_score','validity',round(validity,6) FROM q WHERE validity<0.5 UNION ALL SELECT 'low_score','uniqueness',round(uniqueness,6) FROM q WHERE uniqueness<0.5
UNION ALL SELECT 'high_missing','lot_size_acres',round((count(*)-count(lot_size_acres))*100.0/count(*),6) FROM x
UNION ALL SELECT 'many_duplicates','lot_size_acres',round(count(DISTINCT lot_size_acres)*100.0/count(*),6) FROM x UNION ALL SELECT 'many_duplicates','zoning',round(count(DISTINCT zoning)*100.0/count(*),6) FROM x
UNION ALL SELECT 'many_duplicates','state',round(count(DISTINCT state)*100.0/count(*),6) FROM x""")
def _(spark, d):
    x = gappy(spark, d).select("zoning", "state", F.when(F.col("row_pos") % 3 == 0, F.col("lot_size_acres")).alias("lot_size_acres"), "address")
    return rounded(rec.quality_recs(x))


# --- events --------------------------------------------------------------------------------------------------------

def audit(spark, d):
    kinds = {"click": "user_action", "view": "data_access", "signup": "user_login", "purchase": "data_modification", "error": "security_event"}
    kind = F.lit(None).cast("string")
    for k, v in kinds.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    return table(spark, d, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", kind.alias("event_type"), F.concat("event_type", F.lit(" Page")).alias("action"),
        F.when(F.col("value") > 40, "high").when(F.col("value") > 20, "medium").otherwise("low").alias("severity"),
        (F.col("event_type") != "error").alias("success"), F.col("props").alias("details"), F.concat(F.lit("r"), (F.col("event_id") % 3).cast("string")).alias("resource_type"))


A = """WITH audit AS (SELECT event_id, ts, user_id, CASE event_type WHEN 'click' THEN 'user_action' WHEN 'view' THEN 'data_access' WHEN 'signup' THEN 'user_login'
 WHEN 'purchase' THEN 'data_modification' ELSE 'security_event' END AS event_type, event_type || ' Page' AS action, CASE WHEN value>40 THEN 'high' WHEN value>20 THEN 'medium' ELSE 'low' END AS severity,
 event_type<>'error' AS success, props AS details, 'r' || (event_id%3) AS resource_type FROM events)
"""


@query("evt1_query_events", A + """SELECT event_id, user_id, action FROM audit WHERE ts>='2024-01-05' AND ts<='2024-01-25' AND event_type IN ('user_action','data_access') AND severity='low'
 AND resource_type='r1' AND lower(action) LIKE '%page%' AND success ORDER BY ts DESC, event_id LIMIT 100 OFFSET 20""")
def _(spark, d):
    return ev.query_events(audit(spark, d), "2024-01-05", "2024-01-25", None, ["user_action", "data_access"], "low", "r1", "PAGE", True, 20, 100).select("event_id", "user_id", "action")


@query("evt2_event_report", A + """SELECT count(*) AS total_events, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
 round(count(*) FILTER (success)*100.0/count(*),6) AS success_percentage, strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS "end",
 count(DISTINCT user_id) AS active_users, count(*) FILTER (event_type='security_event') AS security_events, count(*) FILTER (event_type='data_modification') AS data_modifications FROM audit""")
def _(spark, d):
    out = rounded(ev.event_report(audit(spark, d)))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("start", "end")})


@query("evt2_event_counts", A + """SELECT 'event_type' AS section, event_type AS key, count(*) AS n FROM audit GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM audit GROUP BY 2
UNION ALL (SELECT 'user_id', cast(user_id as varchar), count(*) FROM audit GROUP BY user_id ORDER BY 3 DESC, 2 LIMIT 10)""")
def _(spark, d):
    return ev.event_counts(audit(spark, d))


DIGEST = "sha256(to_json({'action':action,'details':details,'event_id':event_id,'event_type':event_type,'timestamp':strftime(ts,'%Y-%m-%dT%H:%M:%S.%f'),'user_id':user_id})::varchar)"


@query("evt3_checksum", A + f"SELECT event_id, {DIGEST} AS checksum FROM audit")
def _(spark, d):
    return ev.with_checksum(audit(spark, d)).select("event_id", "checksum")


def tampered(spark, d):
    signed = ev.with_checksum(audit(spark, d))
    return signed.withColumn("action", F.when(F.col("event_id") % 50 == 0, "changed").otherwise(F.col("action")))


@query("evt3_verify", A + """SELECT count(*) AS total_events, count(*) FILTER (event_id%50=0) AS corrupted_events,
 round((count(*)-count(*) FILTER (event_id%50=0))*100.0/count(*),6) AS integrity_percentage FROM audit""")
def _(spark, d):
    return rounded(ev.verify(tampered(spark, d)))


@query("evt3_corrupted_ids", A + "SELECT event_id FROM audit WHERE event_id%50=0")
def _(spark, d):
    return ev.corrupted(tampered(spark, d)).select("event_id")


# The log of a program in another language: nested details, and checksums over its own JSON text.
LOG = A + """, log AS (SELECT event_id AS id, event_type, ts AS "timestamp", user_id, action, json_extract(details, '$.k')::bigint AS k, value FROM audit JOIN (SELECT event_id AS e, value FROM events) v ON e=event_id),
 txt AS (SELECT *, '{"action": "' || action || '", "details": {"by \\u00e9": {"k": ' || k || ', "tags": ["' || event_type || '", "a\\"b\\n"]}, "seen": ' || (k%2=0) || ', "value": ' || value || '}, "event_type": "'
  || event_type || '", "id": ' || id || ', "timestamp": "' || strftime("timestamp", '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us("timestamp")%1000000<>0 THEN strftime("timestamp", '.%f') ELSE '' END
  || '", "user_id": ' || coalesce(user_id::varchar, 'null') || '}' AS t FROM log)
"""


def event_log(spark, d):
    value = table(spark, d, "events").select("event_id", "value")
    inner = F.struct(F.array("event_type", F.lit('a"b\n')).alias("tags"), F.get_json_object("details", "$.k").cast("long").alias("k"))
    seen = F.get_json_object("details", "$.k").cast("long") % 2 == 0
    return audit(spark, d).join(value, "event_id").select(
        F.col("event_id").alias("id"), "event_type", F.col("ts").alias("timestamp"), "user_id", "action",
        F.struct(F.col("value"), seen.alias("seen"), inner.alias("by é")).alias("details"))


@query("evt3_log_checksum", LOG + "SELECT id, sha256(t) AS checksum FROM txt")
def _(spark, d):
    log = event_log(spark, d)
    return log.select("id", ev.log_checksum(log).alias("checksum"))


@query("evt3_log_verify", LOG + """SELECT count(*) AS total_events, count(*) FILTER (id%50=0) AS corrupted_events,
 round((count(*)-count(*) FILTER (id%50=0))*100.0/count(*),6) AS integrity_percentage FROM txt""")
def _(spark, d):
    log = event_log(spark, d)
    text = "value double, seen boolean, `by é` struct<k: long, tags: array<string>>"
    kept = log.withColumn("checksum", ev.log_checksum(log)).withColumn("details", F.to_json("details"))
    one_byte = F.when(F.col("id") % 50 == 0, F.replace("details", F.lit('a\\"b'), F.lit('a\\"c'))).otherwise(F.col("details"))
    changed = kept.withColumn("details", one_byte)
    return rounded(ev.verify(changed, expected=ev.log_checksum(changed, text)))


@query("evt4_event_stats", A + """SELECT count(*) AS total_events, count(*) FILTER (ts>TIMESTAMP '2024-01-29 00:00:00') AS events_last_24h,
 strftime(min(ts),'%Y-%m-%d %H:%M:%S') AS oldest_event, strftime(max(ts),'%Y-%m-%d %H:%M:%S') AS newest_event FROM audit""")
def _(spark, d):
    out = ev.event_stats(audit(spark, d), "2024-01-30 00:00:00")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("oldest_event", "newest_event")})


@query("evt5_export_events", A + """SELECT event_id, '{"severity":"' || severity || '","ok":' || success || '}' AS context FROM audit""")
def _(spark, d):
    df = audit(spark, d).select("event_id", F.struct("severity", F.col("success").alias("ok")).alias("context"))
    out = io.export(ev.exportable(df), scratch(spark, "events"), ["json"])
    return spark.read.schema("event_id bigint, context string").json(out["json"])


WEEK = 7 * 24 * 60


@query("evt6_lockouts", A + """, f AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '604799.999999 seconds' PRECEDING AND CURRENT ROW) AS failures
 FROM audit WHERE NOT success) SELECT * FROM f WHERE failures>=5""")
def _(spark, d):
    return ev.lockouts(audit(spark, d), WEEK, 5).select("event_id", "user_id", "failures")


@query("win10_trailing_failures", A + """SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW) AS failures
 FROM audit WHERE NOT success""")
def _(spark, d):
    return ev.trailing_failures(audit(spark, d), 24 * 60).select("event_id", "user_id", "failures")


@query("win10_sliced_failures", A + """SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999 seconds' PRECEDING AND CURRENT ROW) AS failures
 FROM audit WHERE NOT success""")
def _(spark, d):
    return ev.sliced_failures(audit(spark, d), 24 * 60).select("event_id", "user_id", "failures")


@query("evt1_deep_pages", A + """, r AS (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id) AS place, count(*) OVER () AS n FROM audit)
SELECT event_id, place FROM r WHERE place BETWEEN 1 AND 20 OR place BETWEEN n//2+1 AND n//2+20 OR place>n-20""")
def _(spark, d):
    pages = analytics.Pages(audit(spark, d).select("event_id", "ts"), [F.desc("ts"), F.asc("event_id")])
    parts = [pages.page(at, 20).withColumn("place", F.row_number().over(Window.orderBy(F.desc("ts"), "event_id")).cast("long") + at)
             for at in (0, pages.total // 2, pages.total - 20)]
    return io.union_all(parts).select("event_id", "place")


# --- runs ----------------------------------------------------------------------------------------------------------

RW = "WITH " + RUNS


@query("run1_batch_stats", RW + """SELECT count(*) AS total_files, count(*) FILTER (success) AS successful_files, count(*) FILTER (NOT success) AS failed_files,
 cast(sum(property_count) FILTER (success) as bigint) AS total_properties, cast(sum(flex_candidate_count) FILTER (success) as bigint) AS total_candidates,
 round(avg(processing_time),6) AS average_processing_time, round(sum(processing_time),6) AS total_processing_time, round(count(*) FILTER (success)*100.0/count(*),6) AS success_rate,
 round(count(*)/sum(processing_time),6) AS files_per_second, round(sum(property_count) FILTER (success)/sum(processing_time),6) AS properties_per_second FROM runs""")
def _(spark, d):
    return rounded(rn.batch_stats(run_table(spark, d)))


@query("run2_throughput", RW + """SELECT round_even(count(*)/10.0,2) AS files_per_minute, round_even(sum(property_count)/10.0,2) AS properties_per_minute,
 round_even(sum(flex_candidate_count)/10.0,2) AS candidates_per_minute, round_even(avg(file_size_mb),2) AS average_file_size_mb FROM runs WHERE success""")
def _(spark, d):
    return rn.throughput(run_table(spark, d), 600)


@query("run3_error_counts", RW + """, e AS (SELECT CASE WHEN error_message LIKE 'Timeout%' THEN 'timeout' ELSE 'file_not_found' END AS error_type,
 CASE WHEN error_message LIKE 'Timeout%' THEN 'timeout' ELSE 'file_access' END AS error_category, 'medium' AS error_severity FROM runs WHERE NOT success)
SELECT 'error_type' AS section, error_type AS key, count(*) AS n FROM e GROUP BY 2 UNION ALL SELECT 'error_category', error_category, count(*) FROM e GROUP BY 2
UNION ALL SELECT 'error_severity', error_severity, count(*) FROM e GROUP BY 2""")
def _(spark, d):
    return rn.error_counts(run_table(spark, d))


@query("run3_error_summary", RW + """SELECT count(*) FILTER (NOT success) AS total_errors, count(*) FILTER (NOT success AND recovered) AS recovered_files,
 count(*) FILTER (NOT success AND NOT recovered) AS permanent_failures, round(count(*) FILTER (NOT success)*1.0/count(*),6) AS error_rate,
 round(count(*) FILTER (NOT success AND recovered)*1.0/count(*) FILTER (NOT success),6) AS recovery_rate FROM runs""")
def _(spark, d):
    return rounded(rn.error_summary(run_table(spark, d)))


@query("run4_compare_history", """WITH h AS (SELECT cast(o_orderdate as date) AS run_ts, count(*) AS total_properties, avg(CASE WHEN o_orderstatus='F' THEN 100.0 ELSE 0.0 END) AS industrial_percentage,
 avg(o_totalprice)/10000 AS avg_completeness FROM orders GROUP BY 1), n AS (SELECT * FROM h ORDER BY run_ts DESC LIMIT 5),
 c AS (SELECT count(*) AS p, avg(CASE WHEN o_orderstatus='F' THEN 100.0 ELSE 0.0 END) AS i, avg(o_totalprice)/10000 AS q FROM orders)
SELECT (SELECT count(*) FROM n) AS runs_compared, true AS comparison_available, round(p-(SELECT avg(total_properties) FROM n),6) AS properties_vs_avg,
 round(i-(SELECT avg(industrial_percentage) FROM n),6) AS industrial_vs_avg, round(q-(SELECT avg(avg_completeness) FROM n),6) AS quality_vs_avg FROM c""")
def _(spark, d):
    o = table(spark, d, "orders")
    metrics = [F.count("*").alias("total_properties"), F.avg(F.when(F.col("o_orderstatus") == "F", 100.0).otherwise(0.0)).alias("industrial_percentage"),
               (F.avg("o_totalprice") / 10000).alias("avg_completeness")]
    history = o.groupBy(F.col("o_orderdate").cast("date").alias("run_ts")).agg(*metrics)
    return rounded(rn.compare_history(o.agg(*metrics), history, 5))


IND7 = "regexp_matches(lower(property_type),'industrial|warehouse|distribution|flex|manufacturing|storage|logistics')"
FIELDS5 = ["building_sqft", "property_type", "zoning", "lot_size_acres"]


@query("run5_summary_report", G + ", c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS f, count({c})*100.0/count(*) AS v FROM gappy" for c in FIELDS5) + f""")
, r AS (SELECT 'dataset_overview' AS section, 'total_properties' AS key, count(*)::double AS value FROM gappy UNION ALL SELECT 'dataset_overview','total_columns',23
 UNION ALL SELECT 'property_type_analysis','unique_types',count(DISTINCT property_type) FROM gappy UNION ALL SELECT 'property_type_analysis','industrial_types',count(DISTINCT CASE WHEN {IND7} THEN property_type END) FROM gappy
 UNION ALL SELECT 'property_type_analysis','total_industrial',count(*) FILTER ({IND7}) FROM gappy UNION ALL SELECT 'property_type_analysis','industrial_percentage',count(*) FILTER ({IND7})*100.0/count(*) FROM gappy
 UNION ALL SELECT 'property_types',property_type,count(*) FROM gappy GROUP BY 2 UNION ALL SELECT 'field_completeness',f,v FROM c UNION ALL SELECT 'data_quality_metrics','average_completeness',avg(v) FROM c
 UNION ALL SELECT 'data_quality_metrics','min_completeness',min(v) FROM c UNION ALL SELECT 'data_quality_metrics','max_completeness',max(v) FROM c UNION ALL SELECT 'data_quality_metrics','fields_analyzed',count(*) FROM c
 UNION ALL SELECT 'data_quality_metrics','complete_fields',count(*) FILTER (v=100) FROM c UNION ALL SELECT 'data_quality_metrics','incomplete_fields',count(*) FILTER (v<100) FROM c)
SELECT section, key, round(value,5) AS value FROM r""")
def _(spark, d):
    return rounded(pipelines.summary_report(gappy(spark, d), FIELDS5), 5)


RB = {n: lo for n, lo in (("excellent_9_to_10", 9), ("very_good_8_to_9", 8), ("good_7_to_8", 7), ("fair_6_to_7", 6), ("marginal_5_to_6", 5), ("poor_4_to_5", 4))}


@query("run6_full_report", W + """, r AS (SELECT 'score_ranges' AS section, 'excellent_9_to_10' AS key, count(*) FILTER (flex_score>=9) AS value FROM weighted
 UNION ALL SELECT 'score_ranges','very_good_8_to_9',count(*) FILTER (flex_score>=8 AND flex_score<9) FROM weighted UNION ALL SELECT 'score_ranges','good_7_to_8',count(*) FILTER (flex_score>=7 AND flex_score<8) FROM weighted
 UNION ALL SELECT 'score_ranges','fair_6_to_7',count(*) FILTER (flex_score>=6 AND flex_score<7) FROM weighted UNION ALL SELECT 'score_ranges','marginal_5_to_6',count(*) FILTER (flex_score>=5 AND flex_score<6) FROM weighted
 UNION ALL SELECT 'score_ranges','poor_4_to_5',count(*) FILTER (flex_score>=4 AND flex_score<5) FROM weighted UNION ALL SELECT 'score_ranges','very_poor_below_4',count(*) FILTER (flex_score<4) FROM weighted
 """ + "".join(f"UNION ALL SELECT 'percentiles','flex_score_p{p}',quantile_cont(flex_score,{p / 100}) FROM weighted " for p in (10, 25, 50, 75, 90))
    + "".join(f"UNION ALL SELECT 'component_{n}','{c}',{f}({c}) FROM weighted " for c in sco.COMPONENTS for n, f in (("mean", "avg"), ("median", "median"), ("std", "stddev_samp")))
    + "".join(f"UNION ALL SELECT 'coverage_{n}','{c}:' || {c},{f} FROM weighted WHERE {c} IS NOT NULL GROUP BY {c} " for c in ("state", "city", "county", "zoning") for n, f in (("count", "count(*)"), ("mean", "avg(flex_score)")))
    + """UNION ALL SELECT 'top_candidates', lpad(cast(row_number() OVER (ORDER BY flex_score DESC, parcel_id, rid) as varchar),2,'0') || ':' || rid, flex_score
 FROM (SELECT * FROM weighted ORDER BY flex_score DESC, parcel_id, rid LIMIT 10))
SELECT section, key, round(value,5) AS value FROM r""")
def _(spark, d):
    keep = ["score_ranges", "percentiles", "component_mean", "component_median", "component_std", "coverage_count", "coverage_mean", "top_candidates"]
    return rounded(pipelines.full_report(weighted(spark, d), run_table(spark, d)).where(F.col("section").isin(keep)), 5)


@query("run6_full_report_all_sections")
def _(spark, d):
    return pipelines.full_report(weighted(spark, d), run_table(spark, d), 0.5)


@query("run7_performance_report", RW + """SELECT cast(sum(property_count) FILTER (success) as bigint) AS total_properties, cast(sum(flex_candidate_count) FILTER (success) as bigint) AS flex_candidates,
 round(sum(flex_candidate_count) FILTER (success)*100.0/sum(property_count) FILTER (success),6) AS conversion_rate, round(sum(property_count) FILTER (success)/sum(processing_time),6) AS processing_rate,
 concat_ws(',', CASE WHEN sum(property_count) FILTER (success)/sum(processing_time)<100 THEN 'increase_batch_size' END, CASE WHEN sum(property_count) FILTER (success)>10000 THEN 'enable_parallel_processing' END,
 CASE WHEN sum(flex_candidate_count) FILTER (success)*100.0/sum(property_count) FILTER (success)<1 THEN 'relax_filtering_criteria' WHEN sum(flex_candidate_count) FILTER (success)*100.0/sum(property_count) FILTER (success)>20
 THEN 'tighten_filtering_criteria' END) AS recommendations FROM runs""")
def _(spark, d):
    return rounded(rn.performance_report(run_table(spark, d))).withColumn("recommendations", F.concat_ws(",", "recommendations"))


# --- pipelines, streams, user functions, IO ------------------------------------------------------------------------

@query("pipeline_multi_file", W + f""", keyed AS (SELECT *, {KEY} AS k FROM weighted WHERE flex_score>=4)
SELECT rid, source_file, flex_score, {CLASS} AS flex_classification FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY flex_score DESC, parcel_id, rid) AS r FROM keyed) WHERE r=1""")
def _(spark, d):
    keep = ["rid", "source_file", "flex_score", "flex_classification"]
    return ids(pipelines.file_pipeline(props(spark, d), TODAY, keep=keep), *keep[1:])


@query("str1_incremental_ingest", """SELECT o_orderkey%2 AS run, o_orderkey, round(o_totalprice*10,2) AS market_value FROM orders""")
def _(spark, d):
    base = scratch(spark, "ingest")
    orders = table(spark, d, "orders")
    pick = lambda b: b.select(F.col("o_orderkey") % 2, "o_orderkey", F.round(F.col("o_totalprice") * 10, 2).alias("market_value")).toDF("run", "o_orderkey", "market_value")
    for run in (0, 1):  # new files come between the runs, and the second one reads only those
        orders.where(F.col("o_orderkey") % 2 == run).write.mode("append").parquet(f"{base}/in")
        ingest.ingest_stream(spark, f"{base}/in", orders.schema, f"{base}/out", f"{base}/ckpt", transform=pick).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch_id")


@query("str2_event_windows", A + """, w AS (SELECT unnest(range(0,3)) AS i), x AS (SELECT time_bucket(INTERVAL '1 day', ts) - i*INTERVAL '1 day' AS s, user_id, success FROM audit, w)
SELECT cast(s as varchar) AS window_start, user_id, count(*) AS events, count(*) FILTER (NOT success) AS failures FROM x GROUP BY 1,2 HAVING count(*) FILTER (NOT success)>=2""")
def _(spark, d):
    base = scratch(spark, "events")
    raw = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    live = raw.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("event_type") != "error").alias("success"))
    counts = ingest.event_windows(live, "3 days", "1 day", late="60 days")
    ingest.event_stream(counts, f"{base}/out", f"{base}/ckpt").awaitTermination()
    now = ingest.latest(spark, f"{base}/out", ["window_start", "window_end", "user_id"])
    return ingest.failing_windows(now, 2).select(F.col("window_start").cast("string").alias("window_start"), "user_id", "events", "failures")


@query("str2_lockouts", A + """, f AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '604799.999999 seconds' PRECEDING AND CURRENT ROW) AS failures
 FROM audit WHERE NOT success) SELECT * FROM f WHERE failures>=5""")
def _(spark, d):
    base = scratch(spark, "lockouts")
    raw = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    live = raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("event_type") != "error").alias("success"))
    ingest.lockout_stream(live, f"{base}/out", f"{base}/ckpt", WEEK, 5).awaitTermination()
    return ingest.live_lockouts(spark, f"{base}/out").select("event_id", "user_id", "failures")


@query("udf1_map_chunks", P + "SELECT rid, round(building_sqft/1000,6) AS thousands FROM props")
def _(spark, d):
    df = props(spark, d).select("rid", "building_sqft")
    return udf.map_chunks(df, lambda p: p.assign(thousands=(p["building_sqft"] / 1000).round(6))[["rid", "thousands"]], "rid string, thousands double")


@query("udf2_score_with", P + "SELECT rid, lot_size_acres*2+1 AS by_column, lot_size_acres*2+1 AS by_function FROM props")
def _(spark, d):
    out = udf.score_with(props(spark, d), F.col("lot_size_acres") * 2 + 1, name="by_column")
    return ids(udf.score_with(out, lambda a: a * 2 + 1, ["lot_size_acres"], "by_function"), "by_column", "by_function")


@query("src1_scan")
def _(spark, d):
    return io.scan(spark, d, "*.parquet", recursive=True).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "size_bytes")


@query("src2_read_properties", """SELECT 'customer.parquet' AS source_file, count(*) AS n, count(c_acctbal) AS with_customer, 0::bigint AS with_supplier FROM customer
UNION ALL SELECT 'supplier.parquet', count(*), 0, count(s_acctbal) FROM supplier""")
def _(spark, d):
    df = io.read_properties(spark, [("parquet", [f"{d}/customer.parquet"]), ("parquet", [f"{d}/supplier.parquet"])])
    return df.groupBy("source_file").agg(F.count("*").alias("n"), F.count("c_acctbal").alias("with_customer"), F.count("s_acctbal").alias("with_supplier"))


@query("src2_csv_layouts", """SELECT 'c_custkey,c_name,c_acctbal' AS layout, count(*) AS n, sum(c_custkey) AS keys FROM customer UNION ALL
SELECT 's_name,s_suppkey', count(*), sum(s_suppkey) FROM supplier UNION ALL SELECT 'c_name,c_custkey', count(*), sum(c_custkey) FROM customer""")
def _(spark, d):
    base = scratch(spark, "layouts")
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    for part in (c.select("c_custkey", "c_name", "c_acctbal"), s.select("s_name", "s_suppkey"), c.select("c_name", "c_custkey")):
        part.repartition(3).write.mode("append").csv(f"{base}/in", header=True)
    files = [r["path"] for r in io.scan(spark, f"{base}/in", "*.csv").collect()]  # the caller's list of files
    groups = io.csv_groups(spark, files)
    layouts = [io.read_properties(spark, [g]).drop("source_file", "source_path") for g in groups]
    key = lambda df: F.sum(F.col("c_custkey" if "c_custkey" in df.columns else "s_suppkey").cast("long"))
    return io.union_all([df.agg(F.lit(",".join(df.columns)).alias("layout"), F.count("*").alias("n"), key(df).alias("keys")) for df in layouts])


@query("src3_file_metadata", """SELECT 'lineitem.parquet' AS file_name, '.parquet' AS extension, count(*) AS estimated_properties FROM lineitem
UNION ALL SELECT 'orders.parquet', '.parquet', count(*) FROM orders""")
def _(spark, d):
    return io.file_metadata(spark, [f"{d}/lineitem.parquet", f"{d}/orders.parquet"]).select("file_name", "extension", "estimated_properties")


def small(spark, d):
    return candidates(spark, d).select("rid", "city", "flex_score")


@query("src4_cama_csv", S + "SELECT rid, city, cast(flex_score as varchar) AS flex_score FROM cand")
def _(spark, d):
    out = io.export(small(spark, d), scratch(spark, "csv"), ["csv"])
    return io.read_cama_csv(spark, out["csv"])


@query("snk1_export", S + "SELECT f.fmt AS format, count(*) AS n, round(sum(flex_score),4) AS total FROM cand, (VALUES ('csv'),('json'),('parquet')) f(fmt) GROUP BY 1")
def _(spark, d):
    out = io.export(small(spark, d), scratch(spark, "export"), ["csv", "json", "parquet"])
    back = [io.read_group(spark, f, [p]).select(F.lit(f).alias("format"), F.col("flex_score").cast("double").alias("flex_score")) for f, p in out.items()]
    return rounded(io.union_all(back).groupBy("format").agg(F.count("*").alias("n"), F.sum("flex_score").alias("total")), 4)


@query("snk2_export_versioned", S + "SELECT f.fmt AS format, 'r1' AS run_ts, count(*) AS record_count, true AS success FROM cand, (VALUES ('csv'),('parquet')) f(fmt) GROUP BY 1")
def _(spark, d):
    return io.export_versioned(small(spark, d), scratch(spark, "versioned"), "r1").drop("path", "export_time")


@query("snk3_metadata", S + "SELECT f.fmt AS format, count(*) AS record_count FROM cand, (VALUES ('csv'),('parquet')) f(fmt) GROUP BY 1")
def _(spark, d):
    base = scratch(spark, "meta")
    io.save_metadata(io.export_versioned(small(spark, d), base, "r1"), rn.batch_stats(run_table(spark, d)), f"{base}/meta")
    return spark.read.json(f"{base}/meta/export_results").select("format", "record_count")


@query("snk4_store", S + "SELECT batch_id, count(*) AS n FROM cand, (VALUES ('b1'),('b2')) b(batch_id) GROUP BY 1")
def _(spark, d):
    base = scratch(spark, "store")
    for b in ("b1", "b2"):
        io.store(small(spark, d), f"{base}/t", "append", b)
    return spark.read.parquet(f"{base}/t").groupBy("batch_id").agg(F.count("*").alias("n"))


@query("snk6_flatten_metrics", S + """SELECT 'scores_n' AS "Metric", cast(count(*) as varchar) AS "Value" FROM cand UNION ALL SELECT 'scores_range_low', cast(min(flex_score) as varchar) FROM cand
UNION ALL SELECT 'scores_range_high', cast(max(flex_score) as varchar) FROM cand UNION ALL SELECT 'states', cast(count(DISTINCT state) as varchar) FROM cand""")
def _(spark, d):
    rep = candidates(spark, d).agg(F.count("*").alias("n"), F.min("flex_score").alias("lo"), F.max("flex_score").alias("hi"), F.count_distinct("state").alias("states"))
    nested = rep.select(F.struct("n", F.struct(F.col("lo").alias("low"), F.col("hi").alias("high")).alias("range")).alias("scores"), "states")
    return io.flatten_metrics(nested)


@query("snk7_stamp", S + """SELECT rid, 'T' AS export_timestamp, 'propspark' AS data_source, source_file AS aggregation_source_file, 'T' AS aggregation_processed_date,
 'scalable_v1.0' AS pipeline_version FROM cand""")
def _(spark, d):
    out = io.stamp(candidates(spark, d), {"export_timestamp": "T", "aggregation_processed_date": "T"})
    return ids(out, "export_timestamp", "data_source", "aggregation_source_file", "aggregation_processed_date", "pipeline_version")
