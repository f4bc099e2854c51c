"""Chat formatting with tool calls: link calls and results by identifier, order calls after what they need, check arguments
against schemas and write each turn as canonical JSON. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frequent, look_up, stored

#: Between the parts of a join key.
APART = "\x1f"
#: What schema_of_variant calls a JSON value of each kind begins with one of these.
KINDS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}


@dataclass(frozen=True)
class Parameter:
    kind: str
    required: bool = False
    #: Most code points of a string.
    longest: int | None = None
    choices: tuple[str, ...] = ()


def _when(condition: Column, error: str) -> Column:
    return F.when(condition, F.lit(error))


def schema_errors(name: Column, payload: Column, schemas: dict[str, dict[str, Parameter]]) -> Column:
    """array<string>: what is wrong with the arguments (JSON text) of the tool `name`, in the order of the schema."""
    parsed = F.try_parse_json(payload)
    kind = F.schema_of_variant(parsed)
    out = F.array(F.lit("unknown tool"))
    for tool, parameters in schemas.items():
        checks = []
        for p, what in parameters.items():
            value = F.try_variant_get(parsed, f"$['{p}']", "variant")
            text = F.try_variant_get(parsed, f"$['{p}']", "string")
            seen = F.schema_of_variant(value)
            right = F.lit(False)
            for start in KINDS[what.kind]:
                right = right | seen.startswith(start)
            if what.required:
                checks.append(_when(value.isNull(), f"missing: {p}"))
            checks.append(_when(value.isNotNull() & ~right, f"not of kind {what.kind}: {p}"))
            if what.longest is not None:
                checks.append(_when(right & (F.char_length(text) > what.longest), f"too long: {p}"))
            if what.choices:
                checks.append(_when(right & ~text.isin(*what.choices), f"not a choice: {p}"))
        known = F.array(*(F.lit(p) for p in parameters)).cast("array<string>")
        more = F.transform(F.array_sort(F.array_except(F.json_object_keys(payload), known)), lambda k: F.concat(F.lit("unexpected: "), k))
        own = F.concat(F.array_compact(F.array(*checks).cast("array<string>")), F.coalesce(more, F.array().cast("array<string>")))
        out = F.when(name == tool, F.when(F.coalesce(kind.startswith("OBJECT"), F.lit(False)), own).otherwise(F.array(F.lit("not a JSON object")))).otherwise(out)
    return out


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): 0 where nothing is needed, else one more than the highest level needed; null on and behind cycles.

    nodes: (node), distinct. edges: (node, needs), distinct, both in nodes. A node that needs one other is a link of a chain. Chains are
    shortened by doubling: each round a link takes over where the one it points to points, so a chain of n calls takes log2 n rounds.
    Only nodes that need several others take a round for each level of such nodes. Each round is stored.
    """
    needs = edges.groupBy("node").agg(F.count("*").alias("kind"), F.min("needs").alias("to"))
    nodes = stored(nodes.join(needs, "node", "left").select("node", F.coalesce("kind", F.lit(0)).alias("kind"), "to"))
    links = nodes.filter("kind = 1").select("node", "to")
    ends = nodes.select(F.col("node").alias("to"), "kind")
    first = stored(look_up(links, ends, "to", frequent(links, "to", links.count())).select("node", "to", F.lit(1).alias("dist"), "kind"))
    closed, chained = first.filter("kind <> 1"), first.filter("kind = 1")
    n = chained.count()
    while n:
        ahead = closed.unionByName(chained).select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("dist").alias("_dist"), F.col("kind").alias("_kind"))
        jumped = look_up(chained, ahead, "to", frequent(chained, "to", n))
        step = stored(jumped.select("node", F.col("_to").alias("to"), (F.col("dist") + F.col("_dist")).alias("dist"), F.col("_kind").alias("kind")))
        closed, chained = closed.unionByName(step.filter("kind <> 1")), step.filter("kind = 1")
        before, n = n, chained.count()
        if n == before:  # some end of a chain is reached in each round: what is left runs into cycles
            break
    known = nodes.filter("kind = 0").select("node", F.lit(0).alias("level"))
    several = nodes.filter("kind > 1").select("node")
    if not several.isEmpty():
        known = stored(known.unionByName(_branch_levels(several, edges, known, closed)))
    ranked = look_up(closed.select("node", "to", "dist"), known.select(F.col("node").alias("to"), "level"), "to", frequent(closed, "to", closed.count()))
    out = known.unionByName(ranked.select("node", (F.col("level") + F.col("dist")).alias("level")))
    never = chained.select("node", F.lit(None).cast("int").alias("level"))
    return out.unionByName(never).unionByName(several.join(known, "node", "left_anti").select("node", F.lit(None).cast("int").alias("level")))


def _branch_levels(several: DataFrame, edges: DataFrame, known: DataFrame, chains: DataFrame) -> DataFrame:
    """(node, level) of the nodes that need several others and are not on or behind a cycle; chains: (node, to, dist) of the links."""
    own = edges.join(several, "node", "left_semi")
    ways = chains.select(F.col("node").alias("needs"), "to", "dist")
    own = look_up(own, ways, "needs", frequent(own, "needs", own.count()))
    waiting = stored(own.select("node", F.coalesce("to", "needs").alias("to"), (F.coalesce("dist", F.lit(0)) + 1).alias("dist")))
    newly, done, best = known, [], None
    while True:
        hit = stored(look_up(waiting, newly.select(F.col("node").alias("to"), "level"), "to", frequent(waiting, "to", waiting.count())))
        got = hit.filter("level is not null").select("node", (F.col("level") + F.col("dist")).alias("level"))
        waiting = hit.filter("level is null").drop("level")
        best = stored((got if best is None else best.unionByName(got)).groupBy("node").agg(F.max("level").alias("level")))
        newly = stored(best.join(waiting, "node", "left_anti"))
        if newly.isEmpty():
            break
        done.append(newly)
        best = best.join(waiting, "node", "left_semi")
    out = done[0] if done else known.limit(0)
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def link_tool_calls(turns: DataFrame, schemas: dict[str, dict[str, Parameter]]) -> DataFrame:
    """One row per turn: conv_id, turn, kind, id, partner_turn, level, errors, json.

    turns: conv_id, turn (long), kind (call, result; any other is a message), id (of the call; for a result the call it
    answers), name (a call's tool, a message's role), payload (a call's arguments as JSON text, else the content) and
    after (array<string>: ids of the calls that a call needs). Further columns are not read.

    Calls and results meet by (conv_id, id): partner_turn is the first turn of the other kind. (level, turn) puts calls
    after what they need, and results with their calls: a call's level is that of `levels`, null for a cycle, a result's that of its
    call, and 0 for all other rows. Needs that no call answers to do not count. A null conv_id or id links nothing. Repeated rows give
    repeated rows, with the error "repeated id" for calls and "repeated result" for results; an empty table gives none.

    json has its keys in order, without white space or null members; arguments that are no JSON stay a string.
    """
    base = turns.select("conv_id", "turn", "kind", "id", "name", "payload", "after")
    base = base.withColumn("_key", F.when(F.col("conv_id").isNotNull() & F.col("id").isNotNull(), F.concat_ws(APART, F.col("conv_id").cast("string"), "id")))
    is_call, is_result = F.coalesce(F.col("kind") == "call", F.lit(False)), F.coalesce(F.col("kind") == "result", F.lit(False))
    base = base.withColumn("_key", F.when(is_call | is_result, F.col("_key")))
    ids = stored(
        base.filter(F.col("_key").isNotNull())
        .groupBy("_key")
        .agg(
            F.min(F.when(is_call, F.col("turn"))).alias("_called"),
            F.min(F.when(is_result, F.col("turn"))).alias("_answered"),
            F.count_if(is_call).alias("_calls"),
            F.count_if(is_result).alias("_results"),
        )
    )

    # What calls need, and when it was called.
    needs = base.filter(is_call & F.col("_key").isNotNull()).select("conv_id", "turn", F.col("_key").alias("node"), F.explode(F.array_distinct("after")).alias("_id"))
    needs = needs.select("conv_id", "turn", "node", F.concat_ws(APART, F.col("conv_id").cast("string"), "_id").alias("_key"))
    wanted = stored(needs)
    n_needs = wanted.count()
    edges = stored(look_up(wanted, ids.select("_key", "_called"), "_key", frequent(wanted, "_key", n_needs)).withColumn("lost", F.col("_called").isNull()))
    lost = edges.filter("lost").select(F.col("node").alias("_key"), F.lit(True).alias("_lost")).distinct()
    calls = ids.filter("_calls > 0").select(F.col("_key").alias("node"))
    found = levels(calls, edges.filter("not lost").select("node", F.col("_key").alias("needs")).distinct())
    # All three have one row for each key.
    ranked = ids.join(found.select(F.col("node").alias("_key"), "level"), "_key", "left").join(lost, "_key", "left")
    info = stored(ranked.withColumn("_level", F.when(F.col("_calls") > 0, F.col("level")).otherwise(0)).drop("level"))
    rows = look_up(base, info, "_key", frequent(base.filter(F.col("_key").isNotNull()), "_key", base.count()))
    rows = rows.withColumn("_level", F.when(F.col("_key").isNotNull(), F.col("_level")).otherwise(0))

    none = F.array().cast("array<string>")
    call_errors = F.concat(
        F.array_compact(
            F.array(
                _when(F.col("_key").isNull(), "no id"),
                _when(F.col("_calls") > 1, "repeated id"),
                _when(F.col("_key").isNotNull() & F.col("_answered").isNull(), "no result"),
                _when(F.col("_answered") <= F.col("turn"), "result before call"),
                _when(F.col("_lost"), "unknown need"),
                _when(F.col("_level").isNull(), "cycle"),
            )
        ),
        schema_errors(F.col("name"), F.col("payload"), schemas),
    )
    result_errors = F.array_compact(F.array(_when(F.col("_called").isNull(), "no call"), _when(F.col("_results") > 1, "repeated result")))
    as_call = F.to_json(F.struct(F.coalesce(F.try_parse_json("payload"), F.col("payload").cast("variant")).alias("arguments"), "id", "name", F.lit("call").alias("type")))
    as_result = F.to_json(F.struct(F.col("payload").alias("content"), "id", F.lit("result").alias("type")))
    as_message = F.to_json(F.struct(F.col("payload").alias("content"), F.col("name").alias("role"), F.lit("message").alias("type")))
    return rows.select(
        "conv_id",
        "turn",
        F.when(is_call | is_result, F.col("kind")).otherwise("message").alias("kind"),
        F.when(is_call | is_result, F.col("id")).alias("id"),
        F.when(is_call, F.col("_answered")).when(is_result, F.col("_called")).alias("partner_turn"),
        F.col("_level").alias("level"),
        F.when(is_call, call_errors).when(is_result, result_errors).otherwise(none).alias("errors"),
        F.when(is_call, as_call).when(is_result, as_result).otherwise(as_message).alias("json"),
    )
