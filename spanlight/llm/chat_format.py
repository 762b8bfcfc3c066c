"""Chat formatting: tool calls are linked to results, ordered, validated and written as canonical JSON.

Calls and results come out of the messages as two tables and meet in a hash join on (conversation, call
identifier). Only DataFrame functions are used.

Messages: (conv_id, turn, role, text). Recognised are
* an ``assistant`` text that is a JSON object ``{"call_id", "name", "arguments", "after"}``: a tool call; ``after``
  lists identifiers of calls whose results it needs;
* a ``tool`` text ``{"call_id", "content"}``: a result;
* a ``user`` text: a call of the built-in tool ``reply`` with argument ``prompt``, identifier ``<turn>``; it follows up on the
  message before it, so it needs the ``reply`` call of which that is the result (two turns earlier), if there is one;
* any other ``assistant`` text: the result of the ``reply`` call of the turn before it;
* everything else (system, unknown or null role): context.

Identifiers of messages and of ``reply`` calls are two name spaces: a call ``"3"`` is not the call of turn 3.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanlight.llm.common import stash, whole


@dataclass(frozen=True)
class Param:
    """What a tool accepts as a parameter: the type as ``schema_of_variant`` prints it, and for strings their length in characters."""

    kind: str
    required: bool = True
    least: int = 0
    most: int | None = None

    def accepts(self, value: Column) -> Column:
        """Whether a variant, which may be missing, fits."""
        ok = F.schema_of_variant(value) == self.kind
        if self.least or self.most is not None:
            length = F.length(F.try_variant_get(value, "$", "string"))
            ok = ok & (length >= self.least)
            ok = ok if self.most is None else ok & (length <= self.most)
        return F.coalesce(ok, F.lit(False)) if self.required else value.isNull() | F.coalesce(ok, F.lit(False))


Tool = dict[str, Param]
#: A prompt has something to say and fits a chat window.
TOOLS: dict[str, Tool] = {"reply": {"prompt": Param("STRING", least=1, most=300)}}

CALL = "call_id string, name string, arguments string, after array<string>"
RESULT = "call_id string, content string"


def split_messages(messages: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and context of ``messages``; null text counts as empty, null ids stay null.

    ``key`` is the identifier with its name space, and ``after`` lists keys.
    """
    text = whole(F.col("text"))
    role = F.coalesce(F.col("role"), F.lit(""))
    looks = text.rlike(r"^\s*\{") & role.isin("assistant", "tool")
    call = F.when(looks & (role == "assistant"), F.from_json(text, CALL))
    result = F.when(looks & (role == "tool"), F.from_json(text, RESULT))
    base = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        call.alias("call"),
        result.alias("result"),
    )
    is_call = F.col("call.call_id").isNotNull() & F.col("call.name").isNotNull()
    is_result = F.col("result.call_id").isNotNull()
    turn_text = lambda back: F.coalesce((F.col("turn") - back).cast("string"), F.lit(""))
    of_call = lambda i: F.concat(F.lit("call:"), i)
    of_turn = lambda i: F.concat(F.lit("turn:"), i)
    calls = base.where(is_call).select(
        "conv_id",
        "turn",
        of_call(F.col("call.call_id")).alias("key"),
        "call.call_id",
        "call.name",
        F.coalesce("call.arguments", F.lit("{}")).alias("arguments"),
        F.transform("call.after", of_call).alias("after"),
    )
    asked = base.where(F.col("role") == "user").select(
        "conv_id",
        "turn",
        of_turn(turn_text(0)).alias("key"),
        turn_text(0).alias("call_id"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("text").alias("prompt"))).alias("arguments"),
        F.when(F.col("turn").isNotNull(), F.array(of_turn(turn_text(2)))).alias("after"),
    )
    results = base.where(is_result).select("conv_id", "turn", of_call(F.col("result.call_id")).alias("key"), "result.call_id", F.coalesce("result.content", F.lit("")).alias("content"))
    said = base.where((F.col("role") == "assistant") & ~F.coalesce(is_call, F.lit(False))).select(
        "conv_id", "turn", of_turn(turn_text(1)).alias("key"), turn_text(1).alias("call_id"), F.col("text").alias("content")
    )
    rest = base.where(~F.col("role").isin("user", "assistant") & ~is_result).select("conv_id", "turn", "role", "text")
    return calls.unionByName(asked), results.unionByName(said), rest


def topo_levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that need nothing, else one more than the deepest call needed.

    Kahn's algorithm with jumps: a call that waits for one call only is that call's level plus a length, so needs of it
    become needs of that call, and chains halve in each round. In any round the first calls that wait get their levels, so
    it ends when nothing moves, however deep the calls are. Calls on a cycle, or behind one, get a null level: a length
    that exceeds the number of calls is a cycle, and so is what does not move. Needs that name no call are void.
    """
    ids = calls.select("conv_id", "call_id").distinct()
    edges = calls.select("conv_id", "call_id", F.explode("after").alias("need")).distinct()
    known = ids.withColumnRenamed("call_id", "need")
    edges = edges.join(known.select(F.col("conv_id").alias("c"), F.col("need").alias("n")), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("need") == F.col("n")), "left_semi")
    edges = stash(edges, "call-edges")
    if edges.isEmpty():
        return ids.withColumn("level", F.lit(0))
    ids = stash(ids, "call-ids")
    n_calls = ids.count()
    waiting = edges.select(F.col("conv_id").alias("c"), F.col("call_id").alias("n")).distinct()
    free = ids.join(waiting, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("call_id") == F.col("n")), "left_anti")
    # kind 0: the target is the call ``need``; 1: nothing is needed any more; 2: a cycle.
    links = edges.select("conv_id", "call_id", F.lit(0).alias("kind"), "need", F.lit(1).cast("long").alias("length"))
    links = links.unionByName(free.select("conv_id", "call_id", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("need"), F.lit(0).cast("long").alias("length")))
    links = stash(links, "call-links")
    while True:
        target = F.max(F.struct("kind", "need", "length")).alias("t")
        single = links.groupBy("conv_id", "call_id").agg(target, F.count("*").alias("n")).where("n = 1 or t.kind = 2")
        single = single.select(F.col("conv_id").alias("c"), F.col("call_id").alias("i"), "t")
        meets = (F.col("kind") == 0) & F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("need") == F.col("i"))
        moved = F.col("t").isNotNull()
        length = F.when(moved, F.col("length") + F.col("t.length")).otherwise(F.col("length"))
        kind = F.when(length > n_calls, 2).when(moved, F.col("t.kind")).otherwise(F.col("kind"))
        need = F.when(kind == 0, F.when(moved, F.col("t.need")).otherwise(F.col("need")))
        after = links.join(single, meets, "left").select(
            "conv_id", "call_id", kind.alias("kind"), need.alias("need"), F.when(kind == 2, 0).otherwise(length).alias("length"), moved.alias("moved")
        )
        after = after.groupBy("conv_id", "call_id", "kind", "need").agg(F.max("length").alias("length"), F.max("moved").alias("moved"))
        after = stash(after, "call-links")
        if after.where("moved").isEmpty():
            break
        links = after.drop("moved")
    one = links.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.max("kind").alias("kind"), F.max("length").alias("length"))
    return one.select("conv_id", "call_id", F.when((F.col("n") == 1) & (F.col("kind") == 1), F.col("length")).cast("int").alias("level"))


def arguments_valid(name: Column, arguments: Column, tools: dict[str, Tool]) -> Column:
    """Whether the arguments are an object that fits the tool's parameters; false for unknown tools.

    The schemas are settings, so they become one expression for each tool.
    """
    parsed = F.try_parse_json(arguments)
    valid = F.lit(False)
    for tool, params in tools.items():
        fits = F.array_size(F.array_except(F.json_object_keys(arguments), F.array(*[F.lit(p) for p in params]))) == 0
        for name_of, param in params.items():
            fits = fits & param.accepts(F.try_variant_get(parsed, f"$.{name_of}", "variant"))
        valid = F.when(name == tool, F.coalesce(fits, F.lit(False))).otherwise(valid)
    return valid


def format_chats(messages: DataFrame, tools: dict[str, Tool] | None = None) -> DataFrame:
    """One row per distinct call, per result without a call, and per context message.

    Columns: conv_id, turn, call_id, status (``linked``, ``unanswered``, ``orphan`` or ``context``), n_calls and n_results
    (rows that carried the identifier), level (topological; calls sort by (conv_id, level, turn)), args_valid,
    message (canonical JSON: sorted keys, no white space, no null fields).

    Identifiers that agents give and turns are kept apart, so one identifier may have a row of each kind.
    Rows that repeat an identifier are one call (or result): the one that sorts first stays, all are counted. An empty table
    gives no rows; other columns are not read; null text is empty, and null conversations and turns are values like others.
    They combine before the shuffle, so neither a long conversation nor a repeated identifier makes pairs
    or meets in one task as rows. Arguments that are no JSON stay as a string and are not valid.
    """
    tools = tools or TOOLS
    calls, results, rest = split_messages(messages)
    one = F.min(F.struct("turn", "call_id", "name", "arguments", "after")).alias("c")
    calls = calls.groupBy("conv_id", "key").agg(one, F.count("*").alias("n_calls"))
    calls = calls.select("conv_id", "key", "c.*", "n_calls")
    levels = topo_levels(calls.select("conv_id", F.col("key").alias("call_id"), "after"))
    calls = calls.join(
        levels.select(F.col("conv_id").alias("lc"), F.col("call_id").alias("li"), "level"),
        F.col("conv_id").eqNullSafe(F.col("lc")) & (F.col("key") == F.col("li")),
        "left",
    ).drop("lc", "li")
    first = F.min(F.struct("turn", "call_id", "content")).alias("r")
    results = results.groupBy("conv_id", "key").agg(first, F.count("*").alias("n_results"))
    results = results.select(F.col("conv_id").alias("rc"), F.col("key").alias("rk"), F.col("r.call_id").alias("ri"), F.col("r.turn").alias("rt"), "r.content", "n_results")
    linked = calls.join(results, F.col("conv_id").eqNullSafe(F.col("rc")) & (F.col("key") == F.col("rk")), "full")

    is_call = F.col("n_calls").isNotNull()
    is_result = F.col("n_results").isNotNull()
    args = F.coalesce(F.try_parse_json("arguments"), F.parse_json(F.to_json(F.struct(F.col("arguments").alias("text")))))
    linked = linked.select(
        F.when(is_call, F.col("conv_id")).otherwise(F.col("rc")).alias("conv_id"),
        F.coalesce(F.when(is_call, F.col("turn")), F.col("rt")).alias("turn"),
        F.coalesce("call_id", "ri").alias("call_id"),
        F.when(is_call & is_result, "linked").when(is_call, "unanswered").otherwise("orphan").alias("status"),
        F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        F.col("level").cast("int").alias("level"),
        F.when(is_call, arguments_valid(F.col("name"), F.col("arguments"), tools)).alias("args_valid"),
        F.to_json(
            F.struct(
                F.when(is_call, args).alias("arguments"),
                F.coalesce("call_id", "ri").alias("call_id"),
                F.when(is_call, F.col("name")).alias("name"),
                F.col("content").alias("result"),
            )
        ).alias("message"),
    )
    context = rest.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n")).select(
        "conv_id",
        "turn",
        F.lit("").alias("call_id"),
        F.lit("context").alias("status"),
        F.col("n").alias("n_calls"),
        F.lit(0).cast("long").alias("n_results"),
        F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("boolean").alias("args_valid"),
        F.to_json(F.struct(F.col("text").alias("content"), F.col("role").alias("role"))).alias("message"),
    )
    return linked.unionByName(context)
