"""Session helpers of the subpackage: inputs, tables in the shared folder, sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The white space of the contracts: words are runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders of the tables written inside the innermost scratch() block, if there is one.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where that is unset in a local session, as in tests, a folder is made and set; a cluster without it is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ashlar-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, lineage cut, and safe
    against the loss of any executor.  The files live as long as the shared folder, or, unless ``keep``, as the scratch() block around."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _made.get() is not None and not keep:
        _made.get().append(path)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that written() makes inside the block are deleted at its end: write what is wanted of them with ``keep`` before."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for path in made:
            _delete(spark, path)


def dropped(df: DataFrame) -> None:
    """Delete a table that written() made, once nothing reads it any more."""
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, parent)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(taken: list[str], wanted: str) -> str:
    """``wanted``, or the first of wanted_1, wanted_2 ... that no column has (case aside)."""
    names, i, name = {x.lower() for x in taken}, 0, wanted
    while name.lower() in names:
        i += 1
        name = f"{wanted}_{i}"
    return name


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """A free name for each of ``wanted``, for helper columns beside a caller's own."""
    found: list[str] = []
    for name in wanted:
        found.append(free_name([*taken, *found], name))
    return found


def keyed(column: str):
    """The column of that very name, also where the name holds dots or backquotes."""
    return F.col("`" + column.replace("`", "``") + "`")


def lower_ascii(text):
    """Lower-case A-Z only, as the contracts say; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(df: DataFrame, group: list[str], order: list, name: str) -> DataFrame:
    """The rows with ``name``, their place from 0 in their group by ``order``, for groups of any size.

    Rows are sorted globally (a group takes as many tasks as it needs, rows that tie in everything are dealt at random) and written once;
    of each task and group only the first place and the number of rows meet, so there are no more of these than tasks and groups together.
    Groups must be few (they and the tasks are broadcast): shards, not documents.
    """
    at, salt, task, first, before, n = free_names([*df.columns, name], "at", "salt", "task", "first", "before", "n")
    laid = df.withColumn(salt, F.rand(7)).orderBy(*[keyed(g) for g in group], *order, salt).drop(salt).withColumn(at, F.monotonically_increasing_id())
    laid = written(laid, "numbered")
    runs = laid.groupBy(*[keyed(g) for g in group], F.shiftright(at, 33).alias(task)).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(*[keyed(g) for g in group]).orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0)) - F.col(first)).drop(first, n).alias("r")
    same = F.shiftright(F.col(f"l.{at}"), 33) == F.col(f"r.{task}")
    for g in group:
        g = g.replace("`", "``")
        same = same & F.col(f"l.`{g}`").eqNullSafe(F.col(f"r.`{g}`"))
    kept = [F.col("l.`" + c.replace("`", "``") + "`") for c in df.columns]
    return laid.alias("l").join(F.broadcast(runs), same).select(*kept, (F.col(f"l.{at}") + F.col(f"r.{before}")).alias(name))
