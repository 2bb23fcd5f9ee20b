"""Sets of test questions as JSON lines: a header, then a case a line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.sources.jsonl import lines

VERSION, MOST_RELEVANCE = 1, 3
CASE = (
    "case_id string, query string, cues array<string>, expected_sources array<struct<source:string,relevance:int>>, expected_concepts array<string>, expected_labels array<string>, "
    "expected_associations array<struct<subject:string,label:string,object:string>>, expected_citations array<struct<source:string,paragraph:int,quote:string>>, "
    "options struct<limit:int,floor:double,tags:array<string>,since:bigint,until:bigint>, tags array<string>, since bigint, until bigint"
)
FIELDS = ("case_id", "query", "cues", "expected_sources", "expected_concepts", "expected_labels", "expected_associations", "expected_citations", "options", "tags", "since", "until")


def load(spark: SparkSession, path: str, header: str = "kb_eval") -> DataFrame:
    """(file, line, the fields of a case, refused): every line but the header's; ``refused`` says what is wrong with it."""
    rows = lines(spark, path)
    first = rows.groupBy("file").agg(F.min("line").alias("first"))
    read = rows.join(first, "file").select("file", "line", "first", F.from_json("value", CASE, {"mode": "PERMISSIVE"}).alias("r"), F.json_object_keys("value").alias("keys"), F.get_json_object("value", f"$.{header}").alias("version"))
    names = F.array(*map(F.lit, FIELDS))
    times = read.filter("line > first").groupBy("file", F.col("r.case_id").alias("id")).agg(F.min("line").alias("at"))
    read = read.join(times.withColumnRenamed("file", "f"), (F.col("file") == F.col("f")) & F.col("r.case_id").eqNullSafe(F.col("id")), "left")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    wrong = (
        F.when(F.col("keys").isNull(), "not JSON")
        .when(F.col("line") == F.col("first"), F.when(~F.coalesce(F.col("version") == str(VERSION), F.lit(False)), "not a header of this version"))
        .when(F.size(F.array_except("keys", names)) > 0, "unknown field")
        .when(blank(F.col("r.case_id")), "case_id is empty")
        .when(blank(F.col("r.query")), "query is empty")
        .when(F.col("line") > F.col("at"), "case_id repeats")
        .when(F.exists(F.coalesce("r.expected_sources", F.array().cast("array<struct<source:string,relevance:int>>")), lambda s: blank(s["source"]) | (s["relevance"] > MOST_RELEVANCE) | (s["relevance"] < 0)), "expected source without name or of a relevance above 3")
    )
    out = read.withColumn("refused", wrong).filter("line > first OR refused IS NOT NULL")
    return out.select("file", "line", *(F.col(f"r.{f}").alias(f) for f in FIELDS), "refused")


def checked(cases: DataFrame) -> DataFrame:
    """The cases, if none is refused."""
    bad = cases.filter("refused IS NOT NULL").orderBy("file", "line").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].file}: line {bad[0].line + 1}: {bad[0].refused}")
    return cases.drop("refused")
