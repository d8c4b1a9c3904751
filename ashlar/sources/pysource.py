"""Code graphs of Python source files: one small parser call per file, the graph itself by joins.

Each file is parsed on its own inside a task (files are spread by Spark); calls are resolved to definitions by name with a
join, in the file first, so no task needs more than one file.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ROWS = "path string, seq int, parent int, node_type string, name string, line_count int, param_count int, nesting_depth int, calls array<string>, error string"
_KINDS = {ast.ClassDef: "CLASS", ast.If: "IF", ast.For: "FOREACH", ast.AsyncFor: "FOREACH", ast.While: "WHILE"}


def _name(call: ast.Call) -> str | None:
    return call.func.id if isinstance(call.func, ast.Name) else call.func.attr if isinstance(call.func, ast.Attribute) else None


def _file_rows(path: str, text: str | None) -> list[dict]:
    """Definitions and control flow of one file in source order; a file that cannot be read gives one row with its error."""
    blank = {"path": path, "seq": 0, "parent": None, "node_type": "MODULE", "name": path, "line_count": 0, "param_count": 0, "nesting_depth": 0, "calls": [], "error": None}
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as problem:
        return [blank | {"error": type(problem).__name__}]
    rows = [blank | {"line_count": (text or "").count("\n") + 1}]
    waiting = [(child, 0, "MODULE", 0, 0) for child in reversed(list(ast.iter_child_nodes(tree)))]  # node, parent, its kind, callable, depth
    while waiting:
        node, parent, above, inside, depth = waiting.pop()
        kind = _KINDS.get(type(node))
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            kind = "METHOD" if above == "CLASS" else "FUNCTION"
        if isinstance(node, ast.Call) and (called := _name(node)):
            rows[inside]["calls"].append(called)
        if kind:
            flow = kind in ("IF", "FOREACH", "WHILE")
            arguments = node.args if kind in ("METHOD", "FUNCTION") else None
            count = len(arguments.posonlyargs) + len(arguments.args) + len(arguments.kwonlyargs) if arguments else 0
            rows.append(blank | {"seq": len(rows), "parent": parent, "node_type": kind, "name": getattr(node, "name", kind.lower()), "line_count": node.end_lineno - node.lineno + 1, "param_count": count, "calls": []})
            parent, above, depth = len(rows) - 1, kind, depth + 1 if flow else 0
            if flow:
                rows[inside]["nesting_depth"] = max(rows[inside]["nesting_depth"], depth)
            elif arguments:
                inside = parent
        waiting += [(child, parent, above, inside, depth) for child in reversed(list(ast.iter_child_nodes(node)))]
    return rows


def parsed(files: DataFrame) -> DataFrame:
    """Rows of all ``files`` (path, text) with a graph-wide ``id``; an empty or null text is an empty module."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for path, text in zip(batch.column("path"), batch.column("text"), strict=True):
                yield pa.RecordBatch.from_pylist(_file_rows(path.as_py(), text.as_py()), schema)

    schema = pa.schema([("path", pa.string()), *[(n, pa.int32()) for n in ("seq", "parent")], ("node_type", pa.string()), ("name", pa.string()), *[(n, pa.int32()) for n in ("line_count", "param_count", "nesting_depth")], ("calls", pa.list_(pa.string())), ("error", pa.string())])
    return files.select("path", "text").mapInArrow(run, _ROWS).withColumn("id", F.xxhash64("path", "seq"))


def code_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of parsed(): CONTAINS from parent to child, CALLS to definitions of that name in the file, or else to the
    one definition of that name anywhere; names defined in several other files stay unresolved."""
    nodes = rows.select("id", "node_type", "name", F.lit("").alias("body"), "line_count", "param_count", "nesting_depth", "path")
    contains = rows.where("parent is not null").select(F.xxhash64("path", F.col("parent")).alias("src"), F.col("id").alias("dst"), F.lit("CONTAINS").alias("edge_type"))
    calls = rows.select(F.col("id").alias("src"), "path", F.explode(F.array_distinct("calls")).alias("name"))
    defined = rows.where("node_type in ('METHOD', 'FUNCTION', 'CLASS')")
    own = defined.groupBy("path", "name").agg(F.min("id").alias("near"))
    alone = defined.groupBy("name").agg(F.min("id").alias("far"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    found = calls.join(own, ["path", "name"], "left").join(alone, "name", "left").select("src", F.coalesce("near", "far").alias("dst"), F.lit("CALLS").alias("edge_type"))
    return nodes, contains.unionByName(found.where("dst is not null"))
