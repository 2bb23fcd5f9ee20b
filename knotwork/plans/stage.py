"""Tables between the rounds of a loop: lineage is cut by what all executors can read again."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder of this machine only where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="knotwork-checkpoint-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = current.get()
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself where it is no more than a stored table, filtered and projected; else staged."""
    node = df._jdf.queryExecution().optimizedPlan()
    while node.getClass().getSimpleName() in ("Project", "Filter"):
        node = node.children().head()
    return df if node.getClass().getSimpleName() == "LogicalRelation" else staged(df, name)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


#: Files of a table that the driver looks at one by one; more are looked at by a job.
LISTED = 1000


def state_of(spark: SparkSession, path: str) -> str:
    """A digest of the names, lengths and times of the files of a table."""
    where, files = _file_system(spark, path)
    statuses = files.listStatus(where)
    if len(statuses) <= LISTED:
        found: object = sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in statuses)
    else:
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        found = tuple(rows.agg(F.count("*"), F.bit_xor(F.xxhash64("path", "length", "modificationTime"))).collect()[0])
    return hashlib.sha256(repr((path, found)).encode()).hexdigest()[:24]


def kept(spark: SparkSession, name: str, inputs: list[str], build: Callable[[], dict[str, DataFrame]], tables: list[str]) -> dict[str, DataFrame]:
    """Tables that are built once for as long as the files of their inputs don't change, and then read again.

    A table counts once its write has been committed; what a failed build left is built anew."""
    root = f"{shared_dir(spark)}/kept/{name}-" + "-".join(state_of(spark, i) for i in inputs)
    paths = {t: f"{root}/{t}" for t in tables}

    def there(path: str) -> bool:
        where, files = _file_system(spark, f"{path}/_SUCCESS")
        return files.exists(where)

    if not all(map(there, paths.values())):
        for t, df in build().items():
            df.write.mode("overwrite").parquet(paths[t])
    return {t: spark.read.parquet(p) for t, p in paths.items()}


def cached(spark: SparkSession, op: str, inputs: list[str], params: object, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of an operation on tables, kept for as long as neither they nor its parameters change."""
    name = f"{op}-{hashlib.sha256(repr(params).encode()).hexdigest()[:16]}"
    return kept(spark, name, inputs, lambda: {"result": build()}, ["result"])["result"]
