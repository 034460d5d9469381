"""Tool-call linking for chat data, with DataFrame functions only.

Calls and results meet in an equi-join on conversation and call identifier.
Calls are ordered topologically by the call each one builds on: pointers jump
in doubling steps, so the rounds grow with the logarithm of the longest chain.
Arguments are checked against the tools' schemas inside the row, and every
exchange is written as canonical JSON (keys sorted, no spaces, numbers without
trailing zeros) through the variant type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flagloom.llm.common import settle

#: Which variant types each schema type takes.
_TYPES = {
    "string": r"STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": r"BIGINT|DECIMAL\(\d+,\d+\)|DOUBLE|FLOAT",
    "boolean": r"BOOLEAN", "array": r"ARRAY<.*>", "object": r"OBJECT<.*>", "null": r"VOID",
}


def canonical_json(text: Column) -> Column:
    """Canonical form of a JSON text; null if it is null, malformed, or repeats a key."""
    return F.to_json(F.try_parse_json(text))


def topological_levels(calls: DataFrame) -> DataFrame:
    """``(conv_id, call_id, level, cyclic)`` for ``(conv_id, call_id, parent_id)``
    rows with distinct keys: 0 for a call without a (known) parent, else one
    more than its parent's. On or behind a cycle ``level`` is null."""
    nodes = calls.select("conv_id", "call_id", "parent_id")
    known = nodes.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"))
    jump = settle(nodes.join(known, (F.col("conv_id") == F.col("_c")) & (F.col("parent_id") == F.col("_p")), "left")
                  .select("conv_id", "call_id", F.col("_p").alias("up"),
                          F.col("_p").isNotNull().cast("long").alias("level")), "calls-up")
    total, open_ = jump.agg(F.count("*"), F.count("up")).first()
    for _ in range(int(total).bit_length() + 1):
        if not open_:
            break
        above = jump.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"), F.col("up").alias("_up"),
                            F.col("level").alias("_more"))
        climbing = jump.where("up IS NOT NULL").join(above, (F.col("conv_id") == F.col("_c")) & (F.col("up") == F.col("_p")))
        jump = settle(jump.where("up IS NULL").unionByName(
            climbing.select("conv_id", "call_id", F.col("_up").alias("up"), (F.col("level") + F.col("_more")).alias("level"))),
            "calls-up")
        open_ = jump.agg(F.count("up")).first()[0]
    return jump.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"),
                       F.col("up").isNotNull().alias("cyclic"))


def _argument_errors(args: Column, params: Column) -> Column:
    """Sorted messages about an argument object against ``array<struct<param, type, required>>``."""
    typed = F.transform(F.map_entries(args.cast("map<string,variant>")),
                        lambda e: F.struct(e["key"].alias("k"), F.schema_of_variant(e["value"]).alias("t")))
    def matches(p: Column, t: Column) -> Column:
        ok = F.lit(False)
        for name, pattern in _TYPES.items():
            ok = ok | ((p["type"] == name) & t["t"].rlike(f"^({pattern})$"))
        return ok

    missing = F.transform(F.filter(params, lambda p: p["required"] & ~F.exists(typed, lambda t: t["k"] == p["param"])),
                          lambda p: F.concat(F.lit("missing:"), p["param"]))
    extra = F.transform(F.filter(typed, lambda t: ~F.exists(params, lambda p: p["param"] == t["k"])),
                        lambda t: F.concat(F.lit("unknown:"), t["k"]))
    wrong = F.transform(F.filter(typed, lambda t: F.exists(params, lambda p: (p["param"] == t["k"]) & ~matches(p, t))),
                        lambda t: F.concat(F.lit("type:"), t["k"]))
    return F.array_sort(F.concat(missing, extra, wrong))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Exchanges of ``calls`` (``conv_id, call_id, seq, tool, arguments, parent_id``)
    and ``results`` (``conv_id, call_id, seq, content``) under ``schemas``
    (``tool, param, type, required``; a tool without parameters has one row with a null param).

    One row per call, and one per identifier of results that no call has:
    ``conv_id``, ``call_id``, ``seq``, ``tool``, ``level``, ``n_results``, ``status``,
    ``errors``, ``record``. Sorting a conversation by ``level, seq, call_id`` puts
    every call after the one it builds on. ``status`` is the first that
    holds of ``orphan_result``; ``duplicate_id`` (a later call under a used
    identifier: it gets no result); ``cycle``; ``unknown_parent``; ``bad_json``
    (arguments null, malformed, or not an object); ``unknown_tool``; ``invalid``
    (``errors`` lists ``missing:``, ``type:`` and ``unknown:`` parameters);
    ``no_result``; ``ok``. Of several results the first by ``seq``, then
    content, is linked and ``n_results`` counts all. Rows of equal calls are one.
    ``record`` is canonical JSON with null for what is absent. Null identifiers
    link to nothing: such calls stay as ``no_id`` and such results are
    orphans. Other columns are ignored; no rows give none.
    """
    calls = calls.select("conv_id", "call_id", "seq", "tool", "arguments", "parent_id").distinct()
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    content = ["seq", "tool", "arguments", "parent_id"]
    groups = (calls.where(named).groupBy("conv_id", "call_id")
              .agg(F.min(F.struct(*content)).alias("first")))
    first = settle(groups.select("conv_id", "call_id", "first.*"), "calls-first")
    later = (calls.where(named).join(first.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"),
                                                  F.struct(*content).alias("_first")),
                                     (F.col("conv_id") == F.col("_c")) & (F.col("call_id") == F.col("_i")))
             .where(~F.struct(*content).eqNullSafe(F.col("_first"))).select(*calls.columns))
    answers = (results.groupBy("conv_id", "call_id")
               .agg(F.min(F.struct("seq", "content")).alias("answer"), F.count("*").alias("n_results")))
    levels = topological_levels(first)
    tools = schemas.groupBy("tool").agg(F.collect_list(F.when(F.col("param").isNotNull(),
                                                              F.struct("param", "type", "required"))).alias("params"))

    def on(a: str, b: str) -> Column:
        return (F.col("conv_id") == F.col(a)) & (F.col("call_id") == F.col(b))

    linked = (first
              .join(levels.select(F.col("conv_id").alias("_lc"), F.col("call_id").alias("_li"), "level", "cyclic"),
                    on("_lc", "_li"))
              .join(answers.where(named).select(F.col("conv_id").alias("_rc"), F.col("call_id").alias("_ri"),
                                                "answer", "n_results"), on("_rc", "_ri"), "left")
              .withColumn("_state", F.lit(None).cast("string")))
    none = {"level": "long", "cyclic": "boolean", "n_results": "long"}
    bare = [later.withColumn("_state", F.lit("duplicate_id")), calls.where(~named).withColumn("_state", F.lit("no_id"))]
    answer_type = answers.schema["answer"].dataType
    linked = linked.select(*calls.columns, "level", "cyclic", "answer", "n_results", "_state")
    for rows in bare:
        rows = rows.select(*calls.columns, *(F.lit(None).cast(t).alias(c) for c, t in none.items()), "_state")
        linked = linked.unionByName(rows.withColumn("answer", F.lit(None).cast(answer_type)))
    judged = (linked.join(tools.withColumnRenamed("tool", "_tool"), F.col("tool") == F.col("_tool"), "left")
              .withColumn("_args", F.try_parse_json("arguments"))
              .withColumn("_object", F.coalesce(F.schema_of_variant("_args").startswith("OBJECT<"), F.lit(False))))
    errors = F.when(F.col("_object") & F.col("params").isNotNull(), _argument_errors(F.col("_args"), F.col("params")))
    judged = judged.withColumn("errors", F.coalesce(errors, F.array().cast("array<string>")))
    status = (F.when(F.col("_state").isNotNull(), F.col("_state")).when(F.col("cyclic"), F.lit("cycle"))
              .when(F.col("parent_id").isNotNull() & (F.col("level") == 0), F.lit("unknown_parent"))
              .when(~F.col("_object"), F.lit("bad_json")).when(F.col("params").isNull(), F.lit("unknown_tool"))
              .when(F.size("errors") > 0, F.lit("invalid")).when(F.col("answer").isNull(), F.lit("no_result"))
              .otherwise(F.lit("ok")))
    exchange = F.to_json(F.struct(
        F.col("_args").alias("arguments"), F.col("call_id").alias("call_id"), F.col("conv_id").alias("conv_id"),
        F.col("parent_id").alias("parent_id"), F.col("answer.content").alias("result"), F.col("tool").alias("tool")),
        {"ignoreNullFields": "false"})
    exchanges = judged.select("conv_id", "call_id", "seq", "tool", "level",
                              F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
                              status.alias("status"), "errors", exchange.alias("record"))
    known = first.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"))
    lost = answers.join(known, on("_c", "_i"), "left_anti")
    text = F.to_json(F.struct(F.lit(None).cast("string").alias("arguments"), "call_id", "conv_id",
                              F.lit(None).cast("string").alias("parent_id"), F.col("answer.content").alias("result"),
                              F.lit(None).cast("string").alias("tool")), {"ignoreNullFields": "false"})
    orphans = lost.select("conv_id", "call_id", F.col("answer.seq").alias("seq"), F.lit(None).cast("string").alias("tool"),
                          F.lit(None).cast("long").alias("level"), "n_results", F.lit("orphan_result").alias("status"),
                          F.array().cast("array<string>").alias("errors"), text.alias("record"))
    return exchanges.unionByName(orphans)
