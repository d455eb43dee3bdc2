"""One query per corpus operator, over whole tables with production parameters, and the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from propspark.llm.common import table
from propspark.llm import cotrain, decontaminate, lm, merkle, packing, pii, secrets, shard, simhash, spotsigs, toolcalls, urlfilter, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``sql`` is the equivalent for the check engine."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


_SQL_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
              "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")


@query("op1_decontaminate", sql=f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
 i AS (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark),
 win AS (SELECT DISTINCT item_id, len(w[k:k + 9]) AS n, array_to_string(w[k:k + 9], ' ') AS s
         FROM i, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(k) WHERE len(w) > 0),
 place AS (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS s
        FROM d, (SELECT DISTINCT n FROM win) AS sizes, unnest(range(1, len(w) - n + 2)) AS t(k)),
 hit AS (SELECT doc_id, k, n, item_id FROM place JOIN win USING (n, s)),
 cover AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(k, k + n)) AS t(p) GROUP BY doc_id),
 named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


# (verdict, host, path prefix)
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
             ("allow", "com", "/fr/"), ("block", "com", "/de/"))
# Hosts that are blocked where no rule fits, with their subdomains.
URL_BLOCKED = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
                    for top in ("com", "net", "org"))
_RULE_ROWS = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
_BLOCKED_ROWS = ", ".join(f"('{h}')" for h in URL_BLOCKED)


@query("op2_urlfilter", sql=f"""
WITH rules(verdict, h, p) AS (VALUES {_RULE_ROWS}), blocked(h) AS (VALUES {_BLOCKED_ROWS}),
 u AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
 s AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
 fit AS (SELECT page_id, host, path, h || p AS rule, verdict FROM s JOIN rules
         ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
 best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM fit GROUP BY page_id)
SELECT s.page_id, s.host, s.path, rule,
 coalesce(verdict, CASE WHEN EXISTS (SELECT 1 FROM blocked b WHERE s.host = b.h OR ends_with(s.host, '.' || b.h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN best USING (page_id)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES, URL_BLOCKED)


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query("op5_shard")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


@query("op8_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.report(table(spark, sf_dir, "documents"))
    base = ("assign", "access", "hex")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def counted(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(counted, base),
                        F.sha2(listed(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


@query("op9_spotsigs")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = spotsigs.edited_pairs(table(spark, sf_dir, "documents"))
    return pairs.select("doc_id", "n_chars", "edited_sha256", spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"),
                        spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
                        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
                        spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"), "next_id")


@query("op7_cotrain")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op11_pii")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    names = F.array(*map(F.lit, pii.KINDS))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")

    base = F.filter("spans", lambda s: s["score"].isNull())

    def counted(at, name):
        return F.size(F.filter(base, lambda s: s["kind"] == at)).cast("long").alias(f"n_{name}")

    return found.select("doc_id", *(counted(at, name) for at, name in enumerate(pii.KINDS)), F.sha2(listed(base), 256).alias("base_sha256"),
                        listed(F.col("spans")).alias("spans"))


@query("op12_whiten")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten.whiten(table(spark, sf_dir, "embeddings"))


@query("op13_merkle")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(merkle.manifest(table(spark, sf_dir, "documents")))


@query("op3_lm")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


# The conversations hold no tool calls, so the query reads every assistant turn as one, which says its whole text and refers to
# the result of the assistant's turn before it; the user's next turn is its result.
REPLY_SCHEMA = (toolcalls.Param("reply", "after", "string", required=False), toolcalls.Param("reply", "text", "string"))


@query("op6_toolcalls", sql="""
WITH RECURSIVE m AS (SELECT *, conv_id || '-' || turn AS id FROM conversations),
 calls AS (SELECT conv_id, turn, id AS call_id, text, CASE WHEN turn >= 2 THEN conv_id || '-' || (turn - 2) END AS need FROM m WHERE role = 'assistant'),
 results AS (SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS call_id, text FROM m WHERE role = 'user' AND turn > 0),
 c AS (SELECT a.*, b.call_id IS NOT NULL AS waits, r.turn AS answer
   FROM calls a LEFT JOIN calls b ON b.call_id = a.need LEFT JOIN results r ON r.call_id = a.call_id),
 placed AS (SELECT call_id, turn AS due, 0 AS depth, answer FROM c WHERE NOT waits
   UNION ALL SELECT c.call_id, greatest(c.turn, placed.due, coalesce(placed.answer, placed.due)), depth + 1, c.answer FROM c JOIN placed ON c.need = placed.call_id),
 out AS (
 SELECT conv_id, turn, 'call' AS kind, c.call_id, c.answer IS NOT NULL AS linked, due AS order_turn, 2 * depth AS level, text IS NOT NULL AS valid,
   concat_ws(';', CASE WHEN text IS NULL THEN 'text: missing' END, CASE WHEN need IS NOT NULL AND NOT waits THEN 'unknown reference' END, CASE WHEN c.answer IS NULL THEN 'no result' END) AS problems,
   '{"arguments":{' || CASE WHEN need IS NOT NULL THEN '"after":"$' || need || '",' ELSE '' END || '"text":' || to_json(text)::varchar
     || '},"id":"' || c.call_id || '","name":"reply","role":"assistant"}' AS json FROM c JOIN placed ON c.call_id = placed.call_id
 UNION ALL
 SELECT r.conv_id, r.turn, 'result', r.call_id, c.call_id IS NOT NULL, greatest(r.turn, coalesce(due, r.turn)),
   CASE WHEN c.call_id IS NULL THEN 0 ELSE 2 * depth + 1 END, c.call_id IS NOT NULL, CASE WHEN c.call_id IS NULL THEN 'no call' ELSE '' END,
   CAST(to_json({'content': r.text, 'id': r.call_id, 'role': 'tool'}) AS varchar)
 FROM results r LEFT JOIN c ON r.call_id = c.call_id LEFT JOIN placed ON r.call_id = placed.call_id
 UNION ALL
 SELECT conv_id, turn, 'message', NULL, false, turn, 0, true, '', CAST(to_json({'content': text, 'role': role}) AS varchar)
 FROM m WHERE role NOT IN ('assistant') AND NOT (role = 'user' AND turn > 0))
SELECT conv_id, turn, kind, call_id, linked, order_turn, CAST(level AS integer) AS level, valid, problems, json FROM out""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    name = lambda back: F.concat_ws("-", "conv_id", F.col("turn") - back)
    after = F.when(F.col("turn") >= 2, F.concat(F.lit("$"), name(2)))
    calls = said.where("role = 'assistant'").select(
        "conv_id", "turn", name(0).alias("call_id"), F.lit("reply").alias("name"), F.to_json(F.struct("text", after.alias("after"))).alias("arguments"))
    results = said.where("role = 'user' and turn > 0").select("conv_id", "turn", name(1).alias("call_id"), F.col("text").alias("content"))
    rest = said.where("not coalesce(role = 'assistant' or role = 'user' and turn > 0, false)").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return toolcalls.link(calls, results, REPLY_SCHEMA, rest).withColumn("problems", F.array_join("problems", ";"))
