"""Tool calls of conversations: linked to their results, ordered, validated and written as canonical JSON.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veilframe.session import fresh_path, stage

_KEY = ("conv_id", "call_id")


def _words(before: str, names: Column) -> Column:
    return F.transform(names, lambda n: F.concat(F.lit(before), n))


def _when(condition: Column, text: str | Column) -> Column:
    return F.when(condition, F.array(F.lit(text) if isinstance(text, str) else text)).otherwise(F.array().cast("array<string>"))


def _suits(kind: Column, found: Column) -> Column:
    """Whether a value whose schema is `found` is of a declared type. Types that are not of the list allow any value."""
    number = found.isin("BIGINT", "DOUBLE", "FLOAT") | found.startswith("DECIMAL(")
    return (
        F.when(kind == "string", found == "STRING").when(kind == "integer", (found == "BIGINT") | found.rlike(r"^DECIMAL\(\d+,0\)$"))
        .when(kind == "number", number).when(kind == "boolean", found == "BOOLEAN").when(kind == "array", found.startswith("ARRAY<"))
        .when(kind == "object", found.startswith("OBJECT<")).when(kind == "null", found == "VOID").otherwise(True)
    )


def with_argument_errors(calls: DataFrame) -> DataFrame:
    """`calls` with `errors`: what is wrong with the JSON text `arguments` under `params` (array of param, type,
    required; null: no such tool).

    In this order: no object at all, missing parameters, unknown ones, values of another type; each by name.
    """
    has = lambda p: F.array_contains(F.col("given_names"), p["param"])
    missing = F.transform(F.filter("params", lambda p: p["required"] & ~has(p)), lambda p: p["param"])
    extra = F.filter("given_names", lambda n: ~F.array_contains(F.col("params.param"), n))
    wrong = F.filter("params", lambda p: has(p) & ~_suits(p["type"], F.try_element_at(F.col("given_kinds"), p["param"])))
    mine = ("parsed", "given", "given_names", "given_kinds")
    return (
        calls.withColumn("parsed", F.coalesce(F.schema_of_variant(F.try_parse_json("arguments")).startswith("OBJECT<"), F.lit(False)))
        .withColumn("given", F.from_json(F.when(F.col("parsed"), F.col("arguments")), "map<string, variant>"))
        .withColumn("given_names", F.array_sort(F.map_keys("given")))
        .withColumn("given_kinds", F.transform_values("given", lambda _, v: F.schema_of_variant(v)))
        .withColumn(
            "errors",
            F.when(F.col("params").isNull(), F.array(F.lit("unknown tool"))).when(~F.col("parsed"), F.array(F.lit("arguments are no object")))
            .otherwise(F.concat(_words("missing ", missing), _words("unknown ", extra), F.transform(wrong, lambda p: F.concat(F.lit("no "), p["type"], F.lit(": "), p["param"])))),
        ).drop(*mine)
    )


def _written(df: DataFrame, count: Column) -> tuple[DataFrame, int]:
    """`df` staged in the shared folder, and a count taken while it was written."""
    seen, path = Observation(), fresh_path(df.sparkSession, "needs")
    df.observe(seen, count.alias("n")).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["n"]


def topological_levels(edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of every call that has an edge (conv_id, call_id, dep) to a call it needs.

    level is the length of the longest chain of needs below it: 1 if it only needs calls that need nothing; null in a
    cycle and above one. Chains of calls with one need each are followed by pointer jumping, so a chain of n calls takes
    log2(n) rounds; when a round ends no more of them, what is left runs into a cycle. Calls with several needs then take a
    round per such call along the deepest path. Every round is staged in the shared folder.
    """
    needs, _ = _written(edges.select(*_KEY, "dep").distinct(), F.count("*"))
    number = needs.groupBy(*_KEY).agg(F.count("*").alias("number"), F.min("dep").alias("at"))
    chain, left = number.where("number = 1").select(*_KEY, "at", F.lit(1).cast("long").alias("steps"), F.lit(True).alias("moved")), None
    while True:
        onward = chain.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("onward"), F.col("steps").alias("more"))
        chain, now = _written(
            chain.join(onward, ["conv_id", "at"], "left").select(
                *_KEY, F.coalesce("onward", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("onward").isNotNull().alias("moved"),
            ), F.count_if("moved"),
        )
        if not now or now == left:
            break
        left = now
    # Each need of a call with several of them, as the call its chain ends in and the steps there; `known` once that has a level.
    several, open_ = _written(
        needs.join(number.where("number > 1").select(*_KEY), [*_KEY], "left_semi")
        .join(chain.select("conv_id", F.col("call_id").alias("dep"), "at", "steps", "moved"), ["conv_id", "dep"], "left")
        .select(*_KEY, F.coalesce("at", "dep").alias("at"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"), F.coalesce("moved", F.lit(False)).alias("stuck"))
        .join(number.where("number > 1").select("conv_id", F.col("call_id").alias("at"), F.lit(True).alias("waits")), ["conv_id", "at"], "left")
        .select(*_KEY, "at", "steps", F.when(~F.col("stuck") & F.col("waits").isNull(), F.col("steps")).alias("known")), F.count("*"),
    )
    while open_:
        ready = several.groupBy(*_KEY).agg(F.when(F.count("*") == F.count("known"), F.max("known")).alias("level")).where("level is not null")
        ready = ready.select("conv_id", F.col("call_id").alias("at"), "level")
        several, now = _written(
            several.join(ready, ["conv_id", "at"], "left").select(*_KEY, "at", "steps", F.coalesce("known", F.col("level") + F.col("steps")).alias("known")), F.count_if(F.col("known").isNull()),
        )
        if not now or now == open_:
            break
        open_ = now
    tops = several.groupBy(*_KEY).agg(F.when(F.count("*") == F.count("known"), F.max("known")).alias("level"))
    below = tops.select("conv_id", F.col("call_id").alias("at"), F.col("level").alias("base"), F.lit(True).alias("several"))
    single = chain.join(below, ["conv_id", "at"], "left").select(
        *_KEY, F.when(~F.col("moved"), F.when(F.col("several"), F.col("base") + F.col("steps")).otherwise(F.col("steps"))).alias("level"),
    )
    return single.unionAll(tops).withColumn("level", F.col("level").cast("int"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call, and one per result without a call: conv_id, call_id, position, name, level, n_errors, json.

    `calls`: conv_id, call_id, position, name, arguments (JSON text), depends_on (array of call_ids of the same
    conversation). `results`: conv_id, call_id, position, content. `schemas`: name, param, type, required. Other columns
    are ignored.

    Calls and results are joined by conversation and identifier. Of calls with one identifier the first by position (then
    by content) is linked, the others are errors; of several results the first by position counts, which is an error too,
    as are a missing result, a missing identifier, a need of a call that is not there, and a cycle of needs. A call or
    result without conversation or identifier is linked with nothing. `level` orders the calls of a conversation so that
    each comes after all it needs; equal levels are in order of position.

    `json` is canonical: keys in order, no white space, numbers in one form; arguments and results that are JSON objects
    or arrays are nested in that form, any other text is a string. Rows that are equal in all columns are one call each,
    the second and later of them with a repeated identifier.
    """
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    params = (
        schemas.where("name is not null and param is not null").groupBy("name", "param").agg(F.min("type").alias("type"), F.max(F.coalesce("required", F.lit(False))).alias("required"))
        .groupBy("name").agg(F.array_sort(F.collect_list(F.struct("param", "type", "required"))).alias("params"))  # a tool's own parameters
    )
    own = calls.select(
        "conv_id", "call_id", F.col("position").cast("long").alias("position"), "name", "arguments",
        F.array_distinct(F.coalesce("depends_on", F.array().cast("array<string>"))).alias("needs"),
    )
    own = stage(
        with_argument_errors(own.join(params, "name", "left")).drop("params")
        .select("*", F.xxhash64("name", "arguments", "needs").alias("hash"), F.monotonically_increasing_id().alias("row")),
        "calls",
    )
    answers = results.select(*_KEY, F.col("position").cast("long").alias("position"), "content")
    heads = stage(
        own.where(named).groupBy(*_KEY).agg(F.min(F.struct("position", "hash", "row")).alias("head")).select(*_KEY, F.col("head.row").alias("row")), "heads",
    )
    dep = heads.select("conv_id", F.col("call_id").alias("dep"), F.lit(True).alias("there"))
    needs = stage(own.where(named).select(*_KEY, "row", F.explode("needs").alias("dep")).join(dep, ["conv_id", "dep"], "left"), "needs")
    unknown = needs.where("there is null").groupBy("row").agg(F.array_sort(F.collect_list("dep")).alias("unknown_needs"))  # of one call's own list
    levels = topological_levels(needs.where("there").join(heads, [*_KEY, "row"], "left_semi")).withColumn("levelled", F.lit(True))

    answer = answers.where(named).groupBy(*_KEY).agg(F.min(F.struct("position", "content")).alias("first"), F.count("*").alias("n_results"))
    linked = stage(
        heads.join(answer, [*_KEY], "left").join(levels, [*_KEY], "left")
        .select("row", F.lit(True).alias("first_of_id"), F.col("first.content").alias("content"), "n_results", "level", "levelled"), "linked",
    )
    whole = own.join(linked, "row", "left").join(unknown, "row", "left")
    none = F.array().cast("array<string>")
    errors = F.concat(
        "errors", _when(~named, "no identifier"), _when(named & F.col("first_of_id").isNull(), "repeated identifier"),
        _when(F.col("first_of_id") & F.col("n_results").isNull(), "no result"),
        _when(F.col("n_results") > 1, F.concat(F.col("n_results").cast("string"), F.lit(" results"))),
        _words("needs unknown ", F.coalesce("unknown_needs", none)), _when(F.col("levelled") & F.col("level").isNull(), "in or above a cycle"),
    )
    level = F.when(F.col("first_of_id"), F.when(F.col("levelled"), F.col("level")).otherwise(0))
    called = whole.select(*_KEY, "position", "name", level.alias("level"), errors.alias("errors"), "arguments", "content")
    lost = answers.join(heads, [*_KEY], "left_anti").select(
        *_KEY, "position", F.lit(None).cast("string").alias("name"), F.lit(None).cast("int").alias("level"),
        F.array(F.lit("no call")).alias("errors"), F.lit(None).cast("string").alias("arguments"), "content",
    )
    message = F.struct(
        F.col("arguments_").alias("arguments"), F.col("call_id").cast("string").alias("call_id"), "errors", "level", "name", F.col("content_").alias("result"),
    )
    return called.unionAll(lost).withColumn("arguments_", _value(F.col("arguments"))).withColumn("content_", _value(F.col("content"))).select(
        *_KEY, "position", "name", "level", F.size("errors").alias("n_errors"), F.to_json(F.to_variant_object(message)).alias("json"),
    )


def _value(text: Column) -> Column:
    """A JSON object or array as it is, any other text as a string."""
    parsed = F.try_parse_json(text)
    nested = F.schema_of_variant(parsed).rlike("^(OBJECT|ARRAY)<")
    return F.when(nested, parsed).otherwise(text.cast("variant"))
