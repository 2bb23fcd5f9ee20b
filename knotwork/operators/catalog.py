"""Stored tables of contexts: Parquet below one folder, partitioned by context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, root: str, table: str) -> None:
    """Replaces the contexts that ``df`` holds and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("context").parquet(f"{root}/{table}")


def load(spark: SparkSession, root: str, table: str, *contexts: str) -> DataFrame:
    """The table, or these contexts of it: other partitions aren't read."""
    df = spark.read.option("recursiveFileLookup", "false").parquet(f"{root}/{table}").withColumn("context", F.col("context").cast("string"))
    return df.filter(F.col("context").isin(*contexts)) if contexts else df


def renamed(df: DataFrame, old: str, new: str) -> DataFrame:
    """``df`` with a context under another name; it mustn't be taken."""
    if not df.filter(F.col("context") == new).isEmpty():
        raise ValueError(f"{new} exists")
    return df.withColumn("context", F.when(F.col("context") == old, new).otherwise(F.col("context")))


def without(df: DataFrame, context: str) -> DataFrame:
    return df.filter(F.col("context") != context)


def verified(edge: DataFrame, shares: DataFrame, aliases: DataFrame) -> DataFrame:
    """(check, n): how many rows of stored tables break what always holds of them."""
    triple = ["context", "subject", "label", "object"]
    twice = edge.groupBy(*triple).agg(F.count("*").alias("n")).filter("n > 1")
    counted = shares.groupBy(*triple).agg(F.sum("count").alias("attested")).join(edge.groupBy(*triple).agg(F.max("count").alias("count")), triple, "left")
    names = edge.select("context", F.lit("concept").alias("kind"), F.col("subject").alias("alias")).union(edge.select("context", F.lit("concept"), "object")).union(edge.select("context", F.lit("label"), "label")).distinct()
    chained = aliases.select("context", "kind", "alias", "canonical").join(aliases.select("context", "kind", F.col("alias").alias("canonical")).distinct(), ["context", "kind", "canonical"], "left_semi")
    checks = {
        "edge_twice": twice,
        "negative_count": edge.filter("count < 0"),
        "weight_of_dead_edge": edge.filter("count = 0 AND sum <> 0"),
        "sum_not_finite": edge.filter(F.isnan("sum") | (F.abs("sum") == float("inf")) | F.col("sum").isNull()),
        "attested_above_count": counted.filter("attested > count"),
        "attribution_without_edge": counted.filter("count IS NULL"),
        "alias_is_a_name": aliases.join(names, ["context", "kind", "alias"], "left_semi"),
        "alias_of_an_alias": chained,
    }
    out = None
    for check, rows in checks.items():
        n = rows.agg(F.lit(check).alias("check"), F.count("*").alias("n"))
        out = n if out is None else out.union(n)
    return out


def promoted(log: DataFrame, sources: list[str], context: str) -> DataFrame:
    """What the named sources say, as assertions of another context."""
    return log.filter(F.col("source").isin(sources)).withColumn("context", F.lit(context))
