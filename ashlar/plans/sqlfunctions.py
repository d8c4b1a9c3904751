"""Functions that SQL text can call: the vector algebra as SQL functions, code graphs as a table function.

``register(spark)`` makes them known to a session for as long as it lasts, so that a SQL node (sources.catalog.sql_node) can use them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..functions import bitvec as V
from ..sources import pysource

#: name -> (parameters, type, body); bodies are SQL, so they are inlined into the plan.
FUNCTIONS = {
    "fp_xor": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "ARRAY<BIGINT>", "zip_with(a, b, (x, y) -> x ^ y)"),
    "hamming": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "INT", "aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x)"),
    "fp_popcount": ("a ARRAY<BIGINT>", "INT", "aggregate(transform(a, x -> bit_count(x)), 0, (n, x) -> n + x)"),
    "fp_majority3": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>, c ARRAY<BIGINT>", "ARRAY<BIGINT>", "transform(arrays_zip(a, b, c), z -> (z.a & z.b) | (z.a & z.c) | (z.b & z.c))"),
    "fp_similarity": ("a ARRAY<BIGINT>, b ARRAY<BIGINT>", "DOUBLE", f"1 - aggregate(zip_with(a, b, (x, y) -> bit_count(x ^ y)), 0, (n, x) -> n + x) / {float(V.BITS)}D"),
    "fp_seed": (
        "t STRING",
        "ARRAY<BIGINT>",
        f"transform(sequence(0, {V.WORDS - 1}), i -> CAST(conv(array_join(transform(sequence(8, 1, -1), k -> substring(sha2(t || ':' || CAST(i AS STRING), 256), 2 * k - 1, 2)), ''), 16, -10) AS BIGINT) & IF(i = {V.WORDS - 1}, {V.LAST_MASK}L, -1L))",
    ),
}


@udtf(returnType="path string, seq int, parent int, node_type string, name string, line_count int, param_count int, nesting_depth int, calls array<string>, error string", useArrow=True)
class CodeGraph:
    """Definitions and control flow of Python source: code_graph(TABLE(files) PARTITION BY path), a table of (path, text)."""

    def eval(self, row: Row) -> Iterator[tuple]:
        for found in pysource._file_rows(row["path"], row["text"]):
            yield tuple(found.values())


def register(spark: SparkSession) -> None:
    """Make FUNCTIONS and code_graph known to the session."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("code_graph", CodeGraph)
