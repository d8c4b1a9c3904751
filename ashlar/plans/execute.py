"""Execution of compiled graphs over tables of inputs: executors are column builders, a plan is a short list of nodes.

Every row of ``contexts`` is one execution; a node's executor reads columns and earlier results, and its result is added to a map of node ids
to JSON.  All of a plan's nodes run in one projection, so executions are as many as rows and never leave their partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

#: name -> function of (input columns by field name) that gives a column
Executor = Callable[[dict[str, Column]], Column]


def validate_presence(inputs: dict[str, Column]) -> Column:
    """Errors of all input fields that are blank."""
    errors = F.flatten(F.array(*[rules.presence(value, field)["errors"] for field, value in inputs.items()]))
    return F.struct((F.size(errors) == 0).alias("valid"), errors.alias("errors"))


def validate_length(inputs: dict[str, Column]) -> Column:
    """Errors of input fields that are not between ``_min`` and ``_max`` (constants among the inputs) characters long."""
    bounds = {k: inputs.get(k) for k in ("_min", "_max")}
    errors = []
    for field, value in inputs.items():
        if field not in bounds:
            n = F.char_length(F.coalesce(value.cast("string"), F.lit("")))
            errors += [F.when(bounds["_min"].isNotNull() & (bounds["_min"] != 0) & (n < bounds["_min"]), F.concat(F.lit(f"{field} is too short (min "), bounds["_min"].cast("string"), F.lit(")")))] if bounds["_min"] is not None else []
            errors += [F.when(bounds["_max"].isNotNull() & (bounds["_max"] != 0) & (n > bounds["_max"]), F.concat(F.lit(f"{field} is too long (max "), bounds["_max"].cast("string"), F.lit(")")))] if bounds["_max"] is not None else []
    found = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    return F.struct((F.size(found) == 0).alias("valid"), found.alias("errors"))


def transform_identity(inputs: dict[str, Column]) -> Column:
    return F.struct(*[value.alias(field) for field, value in inputs.items()])


BUILT_IN: dict[str, Executor] = {"validate_presence": validate_presence, "validate_length": validate_length, "transform_identity": transform_identity}


def result_of(node_id: str, fn_name: str, inputs: dict[str, Column], executors: dict[str, Executor]) -> Column:
    """A node's result as JSON; without an executor of its name it says so, which is no error."""
    if fn_name in executors:
        return F.to_json(executors[fn_name](inputs))
    return F.to_json(F.struct(F.lit("no_executor").alias("status"), F.lit(node_id).alias("node")))


def execute(contexts: DataFrame, plan: list[dict], executors: dict[str, Executor] | None = None) -> DataFrame:
    """``contexts`` with ``results`` (node id to JSON), ``trace`` (ids in order) and ``result`` (the last one's).

    ``plan`` lists nodes in order: id, fn_name, inputs (field names).  A field is a column of ``contexts``, or an earlier node's result
    by its id; a field that is neither is null.  ``executors`` are added to the built-in ones and may replace them.
    """
    known, values, done = BUILT_IN | (executors or {}), {}, contexts
    for node in plan:
        fields = {f: F.col(f) if f in contexts.columns else values.get(f, F.lit(None).cast("string")) for f in node["inputs"]}
        values[node["id"]] = result_of(node["id"], node["fn_name"], fields, known)
    pairs = [x for k, v in values.items() for x in (F.lit(k), v)]
    done = done.withColumn("results", F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"))
    done = done.withColumn("trace", F.array(*[F.lit(n["id"]) for n in plan]).cast("array<string>"))
    return done.withColumn("result", F.element_at("results", F.element_at("trace", -1)) if plan else F.lit(None).cast("string"))


def execution_log(executed: DataFrame, execution_id: str) -> DataFrame:
    """(execution_id, step, node_id, success, result): one row per node and execution."""
    steps = executed.select(F.col(execution_id).alias("execution_id"), F.posexplode("trace").alias("step", "node_id"), "results")
    return steps.select("execution_id", "step", "node_id", F.lit(True).alias("success"), F.element_at("results", F.col("node_id")).alias("result"))


def layers(df: DataFrame, processors: dict[str, Callable[[DataFrame], DataFrame]], active: set[str] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """``df`` through the processors of the active layers in order, and every layer's activation (1, or 0 if it was not active or its processor could not be applied).

    A processor that cannot be applied leaves the table as it was, with the reason in ``layer_<name>_error``."""
    activation = {}
    for name, processor in processors.items():
        activation[name] = 0.0
        if active is not None and name not in active:
            continue
        try:
            df = processor(df)
            activation[name] = 1.0
        except Exception as problem:  # a layer's failure is data, whatever it is
            df = df.withColumn(f"layer_{name}_error", F.lit(str(problem).split("\n")[0]))
    return df, activation
