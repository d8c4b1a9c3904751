"""Tables that are looked up and changed in part: clustered files with bounds, buckets that are rewritten only where something changes.

A table is a folder of data folders, one a version, and a list for each version of the folders that make it up; the list is written last, so a
reader sees a version whole or not at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import load_version, save_version, versions

BUCKETS = 64


def write_clustered(rows: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """Rows in the order of ``key`` in files that do not overlap, each with a Bloom filter of its keys, and a list of the files' bounds (a row a file).

    Rows of one key lie in one file; a null key is in the first.
    """
    dealt = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.option(f"parquet.bloom.filter.enabled#{key}", "true").mode("overwrite").parquet(f"{path}/data")
    spark = rows.sparkSession
    written = spark.read.schema(rows.schema).parquet(f"{path}/data").select(F.input_file_name().alias("file"), F.col(key).alias("k"))
    written.groupBy("file").agg(F.min("k").alias("least"), F.max("k").alias("most"), F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/bounds")


def looked_up(spark: SparkSession, path: str, key: str, values: list) -> tuple[DataFrame, list[str]]:
    """(rows whose key is one of ``values``, the files that were opened for them): only files whose bounds hold a value, and of these only pages that may."""
    bounds = spark.read.parquet(f"{path}/bounds")
    holds = reduce(lambda a, b: a | b, [(F.lit(v) >= F.col("least")) & (F.lit(v) <= F.col("most")) for v in values])
    files = sorted(r["file"] for r in bounds.where(holds).select("file").collect())
    schema = spark.read.parquet(f"{path}/data").schema
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return rows.where(F.col(key).isin(values)), files


class BucketedTable:
    """A table of unique keys in buckets by a hash of the key; an upsert writes those buckets anew that it touches, and leaves all other files as they are."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.version = versions(spark, f"{self.path}/list")[-1]
        made = load_version(spark, f"{self.path}/list", self.version)
        self.folders = {r["bucket"]: r["folder"] for r in made.where("bucket >= 0").collect()}  # a row a bucket
        about = made.where("bucket < 0").first()
        self.keys, self.buckets = about["folder"].split(","), about["buckets"]
        self.schema = spark.read.parquet(f"{self.path}/empty").schema

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: list[str], buckets: int = BUCKETS) -> BucketedTable:
        path = path.rstrip("/")
        rows.limit(0).coalesce(1).write.mode("errorifexists").parquet(f"{path}/empty")
        _write(rows.dropDuplicates(keys), f"{path}/data/v=0", keys, buckets)
        _list(rows.sparkSession, path, 0, {b: "v=0" for b in _buckets_of(rows, keys, buckets)}, keys, buckets)
        return cls(rows.sparkSession, path)

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of the last version, or of some of its buckets."""
        wanted = [f"{self.path}/data/{v}/bucket={b}" for b, v in sorted(self.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], self.schema)

    def files(self) -> set[str]:
        """The names of the files that make up the table."""
        return {f.split("/data/")[1] for f in self.read().inputFiles()}

    def upsert(self, changes: DataFrame) -> list[int]:
        """Put ``changes`` (unique keys, the table's columns) in place of the rows of equal keys; the buckets that were written anew.

        Rows of those buckets are read, without the changed keys, and written with the changes; the new list takes effect when it is complete.  If two writers meet,
        the second fails when it finds the first one's folder.
        """
        changes = changes.select(*self.schema.names)
        touched = _buckets_of(changes, self.keys, self.buckets)
        same = reduce(lambda a, b: a & b, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in self.keys])
        left = self.read(touched).alias("old").join(changes.select(*self.keys).alias("new"), same, "left_anti")
        name = f"v={self.version + 1}"
        _write(left.unionByName(changes), f"{self.path}/data/{name}", self.keys, self.buckets)
        _list(self.spark, self.path, self.version + 1, self.folders | {b: name for b in touched}, self.keys, self.buckets)
        self.__init__(self.spark, self.path)
        return touched


def _bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _buckets_of(rows: DataFrame, keys: list[str], buckets: int) -> list[int]:
    return sorted(r["b"] for r in rows.select(_bucket(keys, buckets).alias("b")).distinct().collect())


def _write(rows: DataFrame, path: str, keys: list[str], buckets: int) -> None:
    rows.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket").sortWithinPartitions(*keys).write.partitionBy("bucket").mode("errorifexists").parquet(path)


def _list(spark: SparkSession, path: str, version: int, folders: dict[int, str], keys: list[str], buckets: int) -> None:
    rows = [(b, v, buckets) for b, v in folders.items()] + [(-1, ",".join(keys), buckets)]
    save_version(spark.createDataFrame(rows, "bucket int, folder string, buckets int").coalesce(1), f"{path}/list", version)
