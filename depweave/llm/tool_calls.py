"""Chat formatting: links tool calls to results, orders and validates them, and writes canonical JSON. DataFrame functions only.

* ``calls``: conv_id, call_id, turn, name, arguments (JSON text), depends_on (array of call ids, may be null).
* ``results``: conv_id, call_id, turn, content.
* ``others``: conv_id, turn, role, content: messages that are neither; may be left out.
* ``schemas``: tool name to {argument: {"type", "required", "min_length", "max_length", "minimum", "maximum", "enum"}}.

Calls meet results by a hash join on (conv_id, call_id). Repeated calls of one identifier count once, the earliest
wins (least turn, then name, then arguments); of several results the earliest is linked and ``n_results`` counts all.
With ``repeats`` nothing is collapsed: a row comes out for each pair of a call and a result of one identifier, with ``n_results`` 1 or 0,
so that every text is in the output; m repeated calls with n results give m * n rows. Order then is that of the earliest call.
Otherwise one row comes out for each identifier, and for each row without one; status is ``linked``, ``missing`` (no result),
``orphan`` (result without call) or ``unidentified``; every other message is a valid row of status ``other``.

Topological order: (order_turn, order_hop) rises from each call to those that depend on it and starts at the call's own turn, so
conversations whose calls only look back are done at once. In the others each round closes the dependencies that are ready and jumps over
those that wait for a single other one, so a chain or tree takes rounds as the logarithm of its length; only calls that wait for several
others take a round for each on their longest chain. What no longer shrinks is in or behind a cycle, has a null order and the
error ``cycle``; cycles add no rounds. Null turns count as turn 0.

Arguments are parsed as JSON; errors are sorted and joined by ``;``. The canonical JSON has sorted keys, no spaces and
the arguments as parsed. Null and empty arguments or contents are kept (null arguments are invalid). Rows are never
gathered by conversation, so a conversation with a third of all turns is dealt like any other. Very long contents are written whole;
empty tables give an empty table; other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.llm.common import materialise

Schemas = Mapping[str, Mapping[str, Mapping[str, Any]]]
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}
SCHEMAS: Schemas = {
    "reply": {
        "prompt": {"type": "string", "required": True, "min_length": 1, "max_length": 1000},
        "turn": {"type": "integer", "required": True, "minimum": 0},
    }
}
ID = ["conv_id", "call_id"]
HOPS = 1 << 40  # more than any way without a cycle has; ways in cycles double each round
TABLES = 16


def errors_of(name: Column, parsed: Column, schemas: Schemas) -> Column:
    """Array of error strings for arguments parsed as a variant."""
    per_tool = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        found: list[Column] = []
        for field, rule in sorted(fields.items()):
            value = F.try_variant_get(parsed, f"$['{field}']", "variant")
            missing = value.isNull() | F.is_variant_null(value)
            if rule.get("required"):
                found.append(F.when(missing, F.lit(f"{field}: missing")))
            if kind := rule.get("type"):
                have = F.schema_of_variant(value)
                right = F.lit(False)
                for start in TYPES[kind]:
                    right = right | have.startswith(start)
                found.append(F.when(~missing & ~right, F.lit(f"{field}: not {kind}")))
            text = F.try_variant_get(value, "$", "string")
            number = F.try_variant_get(value, "$", "double")
            if "min_length" in rule:
                found.append(F.when(~missing & (F.length(text) < rule["min_length"]), F.lit(f"{field}: too short")))
            if "max_length" in rule:
                found.append(F.when(~missing & (F.length(text) > rule["max_length"]), F.lit(f"{field}: too long")))
            if "minimum" in rule:
                found.append(F.when(~missing & (number < rule["minimum"]), F.lit(f"{field}: too small")))
            if "maximum" in rule:
                found.append(F.when(~missing & (number > rule["maximum"]), F.lit(f"{field}: too large")))
            if "enum" in rule:
                found.append(F.when(~missing & ~text.isin(list(rule["enum"])), F.lit(f"{field}: not listed")))
        per_tool = F.when(name == tool, F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")).otherwise(per_tool)
    not_object = parsed.isNull() | ~F.schema_of_variant(parsed).startswith("OBJECT")
    return F.when(not_object, F.array(F.lit("arguments: no JSON object"))).otherwise(per_tool)


def _gathered(ways: DataFrame) -> DataFrame:
    """(conv_id, call_id, at, open), one row a call: the greatest place known and the longest way to each open dependency. ways: conv_id, call_id, at, dep (null: none), hops."""
    listed = F.array_sort(F.collect_list(F.when(F.col("dep").isNotNull(), F.struct("dep", "hops"))))
    last = lambda way, i: F.coalesce(F.get("open", i + 1)["dep"] != way["dep"], F.lit(True))
    return ways.groupBy(*ID).agg(F.max("at").alias("at"), listed.alias("open")).withColumn("open", F.filter("open", last))


def _round(now: DataFrame) -> DataFrame:
    """The open calls of ``now`` after a round: first dependencies that are ready are closed, then those with a single one open are jumped over."""
    later = F.greatest("at", F.when(F.col("reached").isNotNull(), F.struct(F.col("reached.turn").alias("turn"), (F.col("reached.hop") + F.col("hops")).alias("hop")))).alias("at")
    ways = now.where(F.size("open") > 0).select(*ID, "at", F.inline("open"))
    ready = now.where(F.size("open") == 0).select("conv_id", F.col("call_id").alias("dep"), F.col("at").alias("reached"))
    closed = _gathered(ways.join(ready, ["conv_id", "dep"], "left").select(*ID, later, F.when(F.col("reached").isNull(), F.col("dep")).alias("dep"), "hops"))
    ways = closed.select(*ID, "at", F.inline_outer("open")).withColumn("__to", F.coalesce("dep", "call_id"))
    met = ways.join(closed.select("conv_id", F.col("call_id").alias("__to"), F.col("at").alias("reached"), F.col("open").alias("__next")), ["conv_id", "__to"])
    over = F.size("__next") == 1
    step = F.get("__next", F.lit(0))
    hops = F.when(over, F.least(F.col("hops") + step["hops"], F.lit(HOPS))).otherwise(F.col("hops"))
    return _gathered(met.select(*ID, later, F.when(over, step["dep"]).otherwise(F.col("dep")).alias("dep"), hops.alias("hops")))


def topological(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, order_turn, order_hop, lost (a dependency names no call); calls: one row an identifier."""
    nodes = calls.select(*ID, F.coalesce("turn", F.lit(0)).cast("long").alias("order_turn"), F.lit(0).cast("long").alias("order_hop"))
    wanted = calls.select(*ID, F.explode("depends_on").alias("dep")).where("dep IS NOT NULL").distinct()
    known = calls.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("__known"))
    edges = wanted.join(known, ["conv_id", "dep"], "left")
    lost = edges.groupBy(*ID).agg(F.bool_or(F.col("__known").isNull()).alias("lost"))
    edges = edges.where("__known").select("conv_id", "call_id", "dep")
    turn = F.coalesce("turn", F.lit(0)).cast("long")
    before = calls.select("conv_id", F.col("call_id").alias("dep"), turn.alias("dep_turn"))
    forward = edges.join(calls.select(*ID, turn.alias("own_turn")), ID).join(before, ["conv_id", "dep"]).where("dep_turn >= own_turn").select("conv_id").distinct()
    forward = materialise(forward, "looks-forward")
    if not forward.isEmpty():
        own = nodes.join(forward, "conv_id", "left_semi").select(*ID, F.struct(F.col("order_turn").alias("turn"), F.col("order_hop").alias("hop")).alias("at"))
        now = materialise(_gathered(own.join(edges, ID, "left").withColumn("hops", F.lit(1).cast("long"))), "ready-calls")
        done, before = [nodes.join(forward, "conv_id", "left_anti")], None
        while True:
            done.append(now.where(F.size("open") == 0).select(*ID, F.col("at.turn").alias("order_turn"), F.col("at.hop").alias("order_hop")))
            if len(done) > TABLES:
                done = [materialise(functools.reduce(DataFrame.unionByName, done), "ordered-calls")]
            left = now.where(F.size("open") > 0).count()
            if left in (0, before):
                break
            before = left
            now = materialise(_round(now), "ready-calls")
        nothing = F.lit(None).cast("long").alias
        stuck = now.where(F.size("open") > 0).select(*ID, nothing("order_turn"), nothing("order_hop"))
        nodes = functools.reduce(DataFrame.unionByName, [*done, stuck])
    return nodes.join(lost, ID, "left").withColumn("lost", F.coalesce("lost", F.lit(False)))


def _json(value: Column) -> Column:
    """A string as JSON text, null as null."""
    boxed = F.to_json(F.struct(value.alias("v")))
    return F.when(value.isNull(), F.lit("null")).otherwise(F.substring(boxed, F.lit(6), F.length(boxed) - 6))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas = SCHEMAS, repeats: bool = False, others: DataFrame | None = None) -> DataFrame:
    """conv_id, call_id, turn, name, status, n_results, valid, errors, order_turn, order_hop, json."""
    has_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    first = F.min(F.struct("turn", "name", "arguments", "depends_on")).alias("__c")
    one = calls.where(has_id).groupBy(*ID).agg(first).select(*ID, "__c.*")
    if repeats:
        asked = calls.where(has_id).select(*ID, "turn", "name", "arguments", "depends_on")
        given = results.where(has_id).select(*ID, F.lit(1).cast("long").alias("n_results"), F.struct("turn", "content").alias("__r"))
    else:
        asked = one
        given = results.where(has_id).groupBy(*ID).agg(F.count(F.lit(1)).alias("n_results"), F.min(F.struct("turn", "content")).alias("__r"))
    both = asked.withColumn("__call", F.lit(True)).join(given, ID, "full")
    alone = calls.where(~has_id).withColumn("__call", F.lit(True)).select(*ID, "turn", "name", "arguments", "depends_on", "__call")
    both = both.unionByName(alone, allowMissingColumns=True).unionByName(
        results.where(~has_id).select(*ID, F.lit(1).cast("long").alias("n_results"), F.struct("turn", "content").alias("__r")), allowMissingColumns=True
    )
    both = both.join(topological(one).withColumnsRenamed({"order_turn": "__turn", "order_hop": "__hop"}), ID, "left")
    parsed = F.try_parse_json("arguments")
    is_call = F.coalesce("__call", F.lit(False))
    extra = F.array_compact(F.array(F.when(F.col("lost"), F.lit("dependency: unknown")), F.when(is_call & F.col("__turn").isNull() & has_id, F.lit("cycle"))))
    listed = F.when(is_call, F.concat(errors_of(F.coalesce("name", F.lit("")), parsed, schemas), extra)).otherwise(F.array(F.lit("no call")))
    status = F.when(~has_id, "unidentified").when(~is_call, "orphan").when(F.col("__r").isNull(), "missing").otherwise("linked")
    valid = F.size("__errors") == 0
    call_json = F.when(is_call, F.concat(F.lit('{"arguments":'), F.coalesce(F.to_json(parsed), _json(F.col("arguments"))), F.lit(',"id":'), _json(F.col("call_id")), F.lit(',"name":'), _json(F.col("name")), F.lit("}"))).otherwise("null")
    result_json = F.when(F.col("__r").isNull(), "null").otherwise(F.concat(F.lit('{"content":'), _json(F.col("__r.content")), F.lit(',"id":'), _json(F.col("call_id")), F.lit("}")))
    linked = both.withColumn("__errors", F.array_sort(listed)).select(
        "conv_id",
        "call_id",
        F.coalesce("turn", "__r.turn").alias("turn"),
        "name",
        status.alias("status"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        valid.alias("valid"),
        F.array_join("__errors", ";").alias("errors"),
        F.col("__turn").alias("order_turn"),
        F.col("__hop").alias("order_hop"),
        F.concat(F.lit('{"call":'), call_json, F.lit(',"result":'), result_json, F.lit(',"valid":'), valid.cast("string"), F.lit("}")).alias("json"),
    )
    if others is None:
        return linked
    message = F.concat(F.lit('{"content":'), _json(F.col("content")), F.lit(',"role":'), _json(F.col("role")), F.lit("}"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = others.select(
        "conv_id", none("string").alias("call_id"), "turn", none("string").alias("name"), F.lit("other").alias("status"), F.lit(0).cast("long").alias("n_results"), F.lit(True).alias("valid"),
        F.lit("").alias("errors"), none("long").alias("order_turn"), none("long").alias("order_hop"), F.concat(F.lit('{"message":'), message, F.lit(',"valid":true}')).alias("json"),
    )
    return linked.unionByName(rows)


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Plain chats as calls, results and other messages: a user turn calls ``reply``, an assistant turn is the result of the turn before it.

    Plain chats name no dependencies, so they are made from numbers: turn t depends on t - 2, but of four pairs of turns the second
    looks forward to t + 2 in conversations of even number, and the third back to t - 4 unless that number is divisible by three:
    then the two close a cycle.
    """
    name = lambda turn: F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string"))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn").alias("turn")))
    t = F.col("turn")
    pair, conv = F.expr("turn div 2 % 4"), F.col("conv_id")
    depends = F.when((pair == 1) & (conv % 2 == 0), F.array(name(t + 2))).when((pair == 2) & (conv % 3 != 0), F.array(name(t - 4)))
    calls = turns.where("role = 'user'").select(
        "conv_id",
        F.when(t.isNotNull(), name(t)).alias("call_id"),
        "turn",
        F.lit("reply").alias("name"),
        arguments.alias("arguments"),
        F.coalesce(depends, F.when(t >= 2, F.array(name(t - 2)))).alias("depends_on"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", F.when(t.isNotNull(), name(t - 1)).alias("call_id"), "turn", F.col("text").alias("content"))
    others = turns.where("role IS NULL OR role NOT IN ('user', 'assistant')").select("conv_id", "turn", "role", F.col("text").alias("content"))
    return calls, results, others


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every turn of the conversations, user and assistant turns as linked calls, repeated ones too."""
    calls, results, others = from_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))
    return link(calls, results, repeats=True, others=others)


SQL = """
WITH RECURSIVE calls AS (SELECT conv_id, turn, conv_id || '-' || turn AS call_id, text FROM conversations WHERE role = 'user'),
wanted AS (
  SELECT conv_id, turn, unnest(CASE WHEN turn // 2 % 4 = 1 AND conv_id % 2 = 0 THEN [turn + 2] WHEN turn // 2 % 4 = 2 AND conv_id % 3 <> 0 THEN [turn - 4]
    WHEN turn >= 2 THEN [turn - 2] ELSE [] END) AS dep FROM (SELECT DISTINCT conv_id, turn FROM calls)),
edges AS (SELECT * FROM wanted w WHERE EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = w.conv_id AND d.turn = w.dep)),
lost AS (SELECT DISTINCT conv_id, turn FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM calls d WHERE d.conv_id = w.conv_id AND d.turn = w.dep)),
reach(conv_id, turn, dep) AS (SELECT conv_id, turn, dep FROM edges UNION SELECT r.conv_id, r.turn, e.dep FROM reach r JOIN edges e ON e.conv_id = r.conv_id AND e.turn = r.dep),
loops AS (SELECT conv_id, turn FROM reach WHERE turn = dep),
stuck AS (SELECT conv_id, turn FROM loops UNION SELECT r.conv_id, r.turn FROM reach r JOIN loops l ON l.conv_id = r.conv_id AND l.turn = r.dep),
paths(conv_id, turn, here, hops) AS (
  SELECT conv_id, turn, turn, 0::BIGINT FROM (SELECT DISTINCT conv_id, turn FROM calls) c WHERE NOT EXISTS (SELECT 1 FROM stuck s WHERE s.conv_id = c.conv_id AND s.turn = c.turn)
  UNION SELECT p.conv_id, p.turn, e.dep, p.hops + 1 FROM paths p JOIN edges e ON e.conv_id = p.conv_id AND e.turn = p.here),
placed AS (SELECT conv_id, turn, max(struct_pack(a := here, h := hops)) AS place FROM paths GROUP BY conv_id, turn),
results AS (SELECT conv_id, turn, conv_id || '-' || (turn - 1) AS call_id, text FROM conversations WHERE role = 'assistant'),
marked AS (
  SELECT c.*, p.place, CASE WHEN p.place IS NULL THEN 'cycle' END AS e0, CASE WHEN l.turn IS NOT NULL THEN 'dependency: unknown' END AS e1,
         CASE WHEN text IS NULL THEN 'prompt: missing' WHEN length(text) < 1 THEN 'prompt: too short' WHEN length(text) > 1000 THEN 'prompt: too long' END AS e2
  FROM calls c LEFT JOIN placed p ON p.conv_id = c.conv_id AND p.turn = c.turn LEFT JOIN lost l ON l.conv_id = c.conv_id AND l.turn = c.turn),
both_sides AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.call_id, r.call_id) AS call_id, coalesce(c.turn, r.turn) AS turn,
         c.place.a AS order_turn, c.place.h AS order_hop, c.call_id AS cid, r.call_id AS rid, c.text AS ct, r.text AS rt, c.turn AS cturn,
         CASE WHEN c.call_id IS NULL THEN 'no call' ELSE concat_ws(';', e0, e1, e2) END AS errors
  FROM marked c FULL JOIN results r ON c.call_id = r.call_id AND c.conv_id = r.conv_id)
SELECT conv_id, call_id, turn, CASE WHEN cid IS NOT NULL THEN 'reply' END AS name,
  CASE WHEN cid IS NULL THEN 'orphan' WHEN rid IS NULL THEN 'missing' ELSE 'linked' END AS status,
  (rid IS NOT NULL)::BIGINT AS n_results, errors = '' AS valid, errors, order_turn, order_hop,
  '{"call":' || CASE WHEN cid IS NULL THEN 'null' ELSE '{"arguments":{' || coalesce('"prompt":' || to_json(ct)::VARCHAR || ',', '') || '"turn":' || cturn || '},"id":' || to_json(call_id)::VARCHAR || ',"name":"reply"}' END
  || ',"result":' || CASE WHEN rid IS NULL THEN 'null' ELSE '{"content":' || coalesce(to_json(rt)::VARCHAR, 'null') || ',"id":' || to_json(call_id)::VARCHAR || '}' END
  || ',"valid":' || CASE WHEN errors = '' THEN 'true' ELSE 'false' END || '}' AS json
FROM both_sides
UNION ALL
SELECT conv_id, NULL, turn, NULL, 'other', 0, true, '', NULL, NULL,
  '{"message":{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '},"valid":true}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""
