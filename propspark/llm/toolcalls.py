"""Tool-call linking for chat data, with DataFrame operations only.

Calls and results are hash-joined by conversation and identifier, ordered so that a call comes before its result and
after the results it refers to, checked against parameter schemas, and serialised as canonical JSON (sorted keys, no
spaces, escapes in one form, numbers as a variant writes them). References are read from the parsed arguments.

Defined results: of calls that repeat an identifier in a conversation the first is linked to and the others are marked,
parallel ones of one turn too;
several results of one call are all linked; results without a call and calls without a result are marked; arguments
that are not a JSON object are kept as text and marked; a reference to an unknown identifier is marked and not waited
for; calls that wait for each other have no level and are marked; rows with a null conversation or identifier link to
nothing; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from propspark.llm.common import stored

# A string argument "$id" stands for the result of the call with that identifier; a name of a member does not.
REFERENCE = '"\\$([^"\\\\]+)"(?!:)'


@dataclass(frozen=True)
class Param:
    tool: str
    name: str
    kind: str  # integer, number, string, boolean, array or object
    required: bool = True
    least: float | None = None
    most: float | None = None


_KINDS = {"integer": "^BIGINT$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "string": "^STRING$", "boolean": "^BOOLEAN$",
          "array": "^ARRAY", "object": "^OBJECT"}


def problems_of(name: Column, arguments: Column, schemas: Sequence[Param]) -> Column:
    """Sorted texts of what is wrong with a call's arguments (a variant)."""
    found = [F.when(arguments.isNull() | ~F.schema_of_variant(arguments).startswith("OBJECT"), F.lit("arguments: not an object")),
             F.when(name.isNull() | ~name.isin(sorted({p.tool for p in schemas})), F.lit("unknown tool"))]
    for p in schemas:
        part = F.try_variant_get(arguments, f"$['{p.name}']", "variant")
        bad = F.when(part.isNull(), F.lit(f"{p.name}: missing") if p.required else None).when(
            ~F.schema_of_variant(part).rlike(_KINDS[p.kind]), F.lit(f"{p.name}: not {p.kind}"))
        number = F.try_variant_get(arguments, f"$['{p.name}']", "double")
        if p.least is not None:
            bad = bad.when(number < p.least, F.lit(f"{p.name}: too small"))
        if p.most is not None:
            bad = bad.when(number > p.most, F.lit(f"{p.name}: too large"))
        found.append(F.when(name == p.tool, bad))
    return F.array_sort(F.array_compact(F.array(*found)))


def references(arguments: Column) -> Column:
    """The identifiers that arguments (JSON text) refer to, after parsing: escapes are read, and text that is no JSON has none."""
    written = F.coalesce(F.to_json(F.try_parse_json(arguments)), F.lit(""))
    return F.array_distinct(F.regexp_extract_all(written, F.lit(REFERENCE), F.lit(1)))


def _followed(single: DataFrame) -> DataFrame:
    """Chains of calls that wait for one call each, followed to their ends. ``single``: no, to, hops, top. ``to`` becomes the first
    call of the chain that waits for none or for several; calls that only lead to a cycle are left out.

    Every round doubles the number of calls that are stepped over, so it takes the logarithm of the longest chain.
    """
    inner = single.select(F.col("no").alias("to"), F.lit(True).alias("open"))
    flagged = stored(single.join(inner, "to", "left").select(
        "no", "to", "hops", "top", F.coalesce("open", F.lit(False)).alias("open")))
    closed, ahead = flagged.where("not open"), flagged.where("open")
    left, steps = ahead.count(), 1
    most = left + 1  # calls in the longest chain
    while left and steps < 2 * most:
        beyond = closed.unionByName(ahead).select(F.col("no").alias("to"), F.col("to").alias("end"), F.col("hops").alias("more"),
                                                  F.col("top").alias("later"), F.col("open").alias("goes_on"))
        moved = stored(ahead.join(beyond, "to").select(
            "no", F.col("end").alias("to"), (F.col("hops") + F.col("more")).alias("hops"), F.greatest("top", "later").alias("top"),
            F.col("goes_on").alias("open")))
        closed, ahead = closed.unionByName(moved.where("not open")), moved.where("open")
        left, steps = ahead.count(), 2 * steps
    return closed.drop("open")


def _placed(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth, at) of every linkable call: ``depth`` counts the calls it waits for in a row, ``at`` is
    the latest turn of itself and of what it waits for. Calls in a cycle have nulls."""
    key = ["conv_id", "call_id"]
    answered = results.groupBy(*key).agg(F.min("turn").alias("answer"))
    asked = calls.select("no", "conv_id", "turn", F.explode(references(F.col("arguments"))).alias("need"))
    target = calls.select("conv_id", F.col("call_id").alias("need"), F.col("no").alias("to")).join(
        answered.withColumnRenamed("call_id", "need"), ["conv_id", "need"], "left")
    # From here on calls go by their numbers. ``top``: the latest turn on the way, without the end's own.
    needs = stored(asked.join(target, ["conv_id", "need"]).select("no", "to", F.greatest("turn", "answer").alias("top")))
    turns = calls.select("no", "turn")
    wanted = stored(needs.groupBy("no").agg(F.count(F.lit(1)).alias("wanted")))
    single = needs.join(wanted.where("wanted = 1"), "no").select("no", "to", F.lit(1).alias("hops"), "top")
    chains = stored(_followed(single))
    several = wanted.where("wanted > 1")
    done = last = stored(turns.join(wanted, "no", "left_anti").select("no", F.lit(0).alias("depth"), F.col("turn").alias("at")))
    left = several.count()
    if left:
        # What several needs wait for, past the chains.
        end = chains.select(F.col("no").alias("to"), F.col("to").alias("end"), "hops", F.col("top").alias("later"))
        leads = needs.join(several, "no").join(end, "to", "left")
        waits = wanted.where("wanted = 1").select(F.col("no").alias("to")).join(chains.select(F.col("no").alias("to")), "to", "left_anti")
        stuck = leads.join(waits, "to", "left_semi").select("no").distinct()  # waits for a cycle
        links = stored(leads.join(stuck, "no", "left_anti").select(
            "no", F.coalesce("end", "to").alias("need"), (F.coalesce("hops", F.lit(0)) + 1).alias("hops"), F.greatest("top", "later").alias("top")))
        # One round for each call with several needs in the longest chain. A round looks only at the needs that the one before has
        # met, and stores only the calls that wait for nothing any more.
        met = None
        while left:
            known = last.select(F.col("no").alias("need"), "depth", "at")
            news = links.join(known, "need").select("no", (F.col("depth") + F.col("hops")).alias("depth"), F.greatest("at", "top").alias("at"))
            met = stored(news if met is None else met.join(last.select("no"), "no", "left_anti").unionByName(news))
            ready = (met.groupBy("no").agg(F.max("depth").alias("depth"), F.max("at").alias("at"), F.count(F.lit(1)).alias("have"))
                     .join(several, "no").where("have = wanted"))
            last = stored(ready.select("no", "depth", "at"))
            fresh = last.count()
            if not fresh:
                break
            done, left = done.unionByName(last), left - fresh
    chained = chains.join(done.select(F.col("no").alias("to"), "depth", "at"), "to").select(
        "no", (F.col("depth") + F.col("hops")).alias("depth"), F.greatest("at", "top").alias("at"))
    return calls.select(*key, "no").join(done.unionByName(chained), "no").select(*key, "depth", "at")


def link(calls: DataFrame, results: DataFrame, schemas: Sequence[Param], messages: DataFrame | None = None) -> DataFrame:
    """One row per call (conv_id, turn, call_id, name, arguments as JSON text), result (conv_id, turn, call_id, content)
    and, where given, plain message (conv_id, turn, role, content).

    Returns conv_id, turn, kind, call_id, linked, order_turn, level, valid, problems and json. Sorting a conversation by
    order_turn, level and turn is a topological order that keeps the turns where they allow it.
    """
    key = ["conv_id", "call_id"]
    calls = stored(calls.select("conv_id", "turn", "call_id", "name", "arguments", F.monotonically_increasing_id().alias("no")))
    results = stored(results.select("conv_id", "turn", "call_id", "content"))
    usable = calls.where("conv_id is not null and call_id is not null")
    first = stored(usable.groupBy(*key).agg(F.min(F.struct("turn", "name", "arguments", "no")).alias("c")).select(*key, "c.*"))
    placed = stored(_placed(first, results))
    ids = first.select(*key, F.col("turn").alias("first_turn"), F.col("no").alias("first_no"))
    answered = results.select(*key).distinct().withColumn("answered", F.lit(True))
    known = placed.select(*key, "depth", "at")
    unknown = (first.select(*key, F.explode(references(F.col("arguments"))).alias("need"))
               .join(first.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti")
               .groupBy(*key).agg(F.lit(True).alias("dangling")))
    parsed = F.try_parse_json("arguments")
    c = (calls.withColumn("variant", parsed).join(ids, key, "left").join(known, key, "left").join(answered, key, "left").join(unknown, key, "left"))
    again = F.col("no") != F.col("first_no")
    extra = F.array_compact(F.array(
        F.when(F.col("first_turn").isNull(), "no identifier"), F.when(again, "identifier repeated"),
        F.when(F.col("dangling"), "unknown reference"), F.when(F.col("first_turn").isNotNull() & F.col("depth").isNull(), "waits for itself"),
        F.when(F.col("answered").isNull(), "no result")))
    wrong = problems_of(F.col("name"), F.col("variant"), schemas)
    is_object = F.coalesce(F.schema_of_variant("variant").startswith("OBJECT"), F.lit(False))
    call_rows = c.select(
        "conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.coalesce("answered", F.lit(False)).alias("linked"),
        F.coalesce("at", "turn").alias("order_turn"), (F.col("depth") * 2).alias("level"), (F.size(wrong) == 0).alias("valid"),
        F.concat(wrong, extra).alias("problems"),
        F.to_json(F.struct(F.when(is_object, F.col("variant")).alias("arguments"), F.col("call_id").alias("id"), "name",
                           F.when(~is_object, F.col("arguments")).alias("raw"), F.lit("assistant").alias("role"))).alias("json"))
    r = results.join(ids, key, "left").join(known, key, "left")
    result_rows = r.select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.col("first_turn").isNotNull().alias("linked"),
        F.greatest("turn", F.coalesce("at", "turn")).alias("order_turn"),
        F.when(F.col("first_turn").isNull(), 0).otherwise(F.col("depth") * 2 + 1).alias("level"),
        F.col("first_turn").isNotNull().alias("valid"),
        F.when(F.col("first_turn").isNull(), F.array(F.lit("no call"))).otherwise(F.array().cast("array<string>")).alias("problems"),
        F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("tool").alias("role"))).alias("json"))
    out = call_rows.unionByName(result_rows)
    if messages is not None:
        out = out.unionByName(messages.select(
            "conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(False).alias("linked"),
            F.col("turn").alias("order_turn"), F.lit(0).alias("level"), F.lit(True).alias("valid"), F.array().cast("array<string>").alias("problems"),
            F.to_json(F.struct("content", "role")).alias("json")))
    return out
