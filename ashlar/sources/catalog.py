"""Catalog tables: upserts, appends, versions, file scans, text sinks.

A table is a folder of versions, each a Parquet folder; a reader takes the last one that is complete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by ``order``; of several the greatest by the other columns, which must have an order (no maps).  Added up partially before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    last = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("last"))
    return last.select(*[F.col(c) if c in keys else F.col("last")[c].alias(c) for c in rows.columns])


def upserted(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """``current`` with the rows of ``changes`` in place of those of equal keys."""
    return current.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def upserted_edges(current: DataFrame, changes: DataFrame, nodes: DataFrame) -> DataFrame:
    """As upserted by src, dst and type; an edge with an unknown end is dropped."""
    ends = nodes.select("id")
    known = changes.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return upserted(current, known, ["src", "dst", "type"])


def save_version(df: DataFrame, table: str, version: int) -> None:
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", True).parquet(f"{table}/version={version}")


def versions(spark: SparkSession, table: str) -> list[int]:
    """The complete versions of a table: those whose write was committed (_SUCCESS)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{table}/version=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def load_version(spark: SparkSession, table: str, version: int | None = None) -> DataFrame:
    """A version, by default the last that is complete."""
    known = versions(spark, table)
    if not known or (version is not None and version not in known):
        raise ValueError(f"{table} has no complete version" + ("" if version is None else f" {version}"))
    return spark.read.parquet(f"{table}/version={known[-1] if version is None else version}")


def append(df: DataFrame, table: str) -> None:
    """Create or append; not for a table of versions."""
    df.write.mode("append").parquet(table)


def emitted(rows: DataFrame, wanted: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good, errors): rows whose ``wanted`` columns are all set, and the others with ``error``, which names the columns that are not."""
    lacking = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in wanted]))
    marked = rows.withColumn("error", F.array_join(lacking, ", "))
    return marked.where("error = ''").drop("error"), marked.where("error <> ''")


def node_by_id(nodes: DataFrame, value) -> DataFrame:
    return nodes.where(F.col("id") == value)


def outgoing(edges: DataFrame, value) -> DataFrame:
    return edges.where(F.col("src") == value)


def dependencies(edges: DataFrame, value) -> DataFrame:
    """(id): what ``value`` depends on; edges lead from what depends."""
    return edges.where((F.col("src") == value) & (F.col("edge_type") == "DEPENDS")).select(F.col("dst").alias("id"))


def dependents(edges: DataFrame, value) -> DataFrame:
    return edges.where((F.col("dst") == value) & (F.col("edge_type") == "DEPENDS")).select(F.col("src").alias("id"))


def of_type(rows: DataFrame, *kinds: str) -> DataFrame:
    """Nodes or edges of some types."""
    return rows.where(F.col("node_type" if "node_type" in rows.columns else "edge_type").isin(*kinds))


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    """The node of least id with a name, or none."""
    return nodes.where(F.col("name") == name).orderBy("id").limit(1)


def children_of(nodes: DataFrame, edges: DataFrame, name: str, edge_type: str = "CONTAINS") -> DataFrame:
    """(id, name) of what nodes of a name lead to by edges of a type."""
    parents = nodes.where(F.col("name") == name).select(F.col("id").alias("src"))
    links = edges.where(F.col("edge_type") == edge_type).select("src", "dst").join(parents, "src", "left_semi")
    return links.select(F.col("dst").alias("id")).join(nodes.select("id", "name"), "id")


def ends_of(nodes: DataFrame, edges: DataFrame, edge_type: str) -> DataFrame:
    """(src_name, dst_name) of the edges of a type."""
    side = lambda k: nodes.select(F.col("id").alias(k), F.col("name").alias(f"{k}_name"))
    return edges.where(F.col("edge_type") == edge_type).select("src", "dst").join(side("src"), "src").join(side("dst"), "dst").select("src_name", "dst_name")


def counts_in_range(nodes: DataFrame, column: str, least, below) -> DataFrame:
    """(column, n) of the values from ``least`` to under ``below``."""
    return nodes.where((F.col(column) >= least) & (F.col(column) < below)).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def united(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """Rows of both by key; of a key in both, a's."""
    return a.dropDuplicates([key]).unionByName(b.join(a.select(key), key, "left_anti").dropDuplicates([key]))


def intersected(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.join(b.select(key), key, "left_semi")


def subtracted(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    return a.join(b.select(key), key, "left_anti")


def distance_within(rows: DataFrame, column: str, vector: list[float], below: float) -> DataFrame:
    """Rows with ``distance``, the Euclidean distance of an array column to a vector, where it is under ``below``."""
    squares = F.zip_with(column, F.array(*[F.lit(float(x)) for x in vector]), lambda x, y: (x - y) * (x - y))
    far = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
    return rows.withColumn("distance", far).where(F.col("distance") < below)


def ranked_within(rows: DataFrame, conditions: list[Column], weights: dict[str, float], k: int = 10, idx: str = "id") -> DataFrame:
    """The k rows that meet all conditions with the largest weighted sum of columns, as ``score``; ties by ``idx``."""
    score = F.lit(0.0)
    for c, w in weights.items():
        score = score + F.col(c) * w
    kept = rows
    for condition in conditions:
        kept = kept.where(condition)
    return kept.withColumn("score", score).orderBy(F.desc("score"), idx).limit(k)


def sql_node(spark: SparkSession, text: str, fields: list[str], context: dict) -> DataFrame:
    """A SQL node: its text with ``?`` for the context's values of its input fields, in their order."""
    return spark.sql(text, args=[context.get(f) for f in fields])


def tree_lines(paths: DataFrame) -> DataFrame:
    """(path, line) of containment paths (depth, path), indented by depth; sort by path to print."""
    last = F.element_at(F.split("path", " → "), -1)
    return paths.select("path", F.concat(F.repeat(F.lit("  "), F.col("depth")), last).alias("line"))


def from_json(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """``rows`` with the fields of a JSON column as columns; text that does not parse gives nulls."""
    return rows.withColumn("parsed", F.from_json(column, schema)).select(*rows.columns, "parsed.*")


def views(nodes: DataFrame, edges: DataFrame) -> None:
    """Register a code graph for SQL as code_nodes and code_edges."""
    nodes.createOrReplaceTempView("code_nodes")
    edges.createOrReplaceTempView("code_edges")


def source_files(spark: SparkSession, folder: str, suffix: str, without: tuple[str, ...] = ("spec", "test")) -> DataFrame:
    """(path, text) of files below ``folder``, whole, those left out whose path holds a word of ``without``."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(folder, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    for word in without:
        rows = rows.where(~F.col("path").contains(word))
    return rows


def prefixed(nodes: DataFrame, pattern: str) -> DataFrame:
    """Nodes whose id is LIKE the pattern; _ and % are wildcards."""
    return nodes.where(F.col("id").like(pattern))


def edges_within(edges: DataFrame, nodes: DataFrame, pattern: str) -> DataFrame:
    """Edges with an end LIKE the pattern and both ends among the nodes."""
    ends = nodes.select("id")
    own = edges.where(F.col("src").like(pattern) | F.col("dst").like(pattern))
    return own.join(ends.withColumnRenamed("id", "src"), "src", "left_semi").join(ends.withColumnRenamed("id", "dst"), "dst", "left_semi")


def dependency_counts(atoms: DataFrame, edges: DataFrame) -> DataFrame:
    n = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return atoms.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): Graphviz text: the opening (0), a line per node (1) and edge (2), the end (3); sort by both for the file."""
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c).cast("string"), '"', '\\\\"'), F.lit('"'))
    first = nodes.select(F.lit(1).alias("part"), F.concat(quoted("id"), F.lit(";")).alias("line"))
    lines = first.union(edges.select(F.lit(2), F.concat(quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(";"))))
    return lines.union(nodes.sparkSession.createDataFrame([(0, "digraph {"), (3, "}")], "part int, line string"))


def json_of(df: DataFrame, id_column: str) -> DataFrame:
    return df.select(F.col(id_column), F.to_json(F.struct(*df.columns)).alias("json"))


def lanes(rows: DataFrame, idx: Column, n: int = 8) -> DataFrame:
    """Rows dealt to ``n`` lanes by idx, with their lane."""
    return rows.withColumn("lane", F.pmod(idx, F.lit(n)).cast("int")).repartition(n, "lane")
