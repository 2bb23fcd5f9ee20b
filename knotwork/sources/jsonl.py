"""Import and export of batches as JSON lines.

A file is a run of batches; each opens with a header line that names its context and
source, and the lines up to the next header belong to it.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.functions.scalar import average
from knotwork.operators.fold import attributions

#: All fields that any line may have.
LINE = (
    "kb_batch int, context string, source string, create struct<description:string,pinned:boolean>, passage string, stored_at bigint, date bigint, "
    "tags array<string>, subject string, label string, object string, weight double, paragraph int, alias string, canonical string, kind string, "
    "question string, section string, locator struct<kind:string,value:string>, kb_group string, kb_schema int, mode string"
)
FIELDS = [f.strip().split()[0] for f in re.split(r",\s*(?![^<]*>)", LINE)]
#: After every name of a source.
LAST = "\U0010ffff"
KINDS = {"header": "kb_batch", "group": "kb_group", "schema": "kb_schema", "passage": "passage", "association": "subject", "alias": "alias", "question": "question", "section": "section", "locator": "locator"}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of every line that isn't blank, numbered within its file.

    Files are read in splits, a line a row: a line's place is that of its split and its order there.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"), F.regexp_replace("value", r"\r\z", "").alias("value"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("block", "place")) - 1
    return rows.select("file", number.alias("line"), "value").filter(F.trim("value") != "")


def parsed(rows: DataFrame, prefix: str = "kb") -> DataFrame:
    """Lines with their fields, kind, batch number and the header's context and source;
    a line that is no JSON object or has an unknown field has the kind ``refused``.

    ``prefix`` is what the keys of headers of batches, groups and schemas begin with: files
    of another producer have another one."""
    value = F.col("value")
    if prefix != "kb":
        value = F.regexp_replace(value, rf'^(\s*\{{\s*)"{re.escape(prefix)}_(batch|group|schema)"', r'$1"kb_$2"')
    read = rows.select("file", "line", F.from_json(value, LINE, {"mode": "PERMISSIVE"}).alias("r"), F.json_object_keys(value).alias("keys"))
    kind = F.when(F.col("keys").isNull() | (F.size(F.array_except("keys", F.array(*map(F.lit, FIELDS)))) > 0), "refused")
    for name, field in KINDS.items():
        kind = kind.when(F.col(f"r.{field}").isNotNull(), name)
    read = read.withColumn("what", kind.otherwise("refused"))
    order = Window.partitionBy("file").orderBy("line")
    head = F.when(F.col("what") == "header", F.struct("r.context", "r.source", "r.create"))
    return read.withColumns({"batch": F.count(F.when(F.col("what") == "header", 1)).over(order), "head": F.last(head, ignorenulls=True).over(order)})


def associations(read: DataFrame) -> DataFrame:
    """Assertions of all batches, in order of file and line."""
    rows = read.filter("what = 'association'")
    files = rows.select("file").distinct()  # a row a file
    rows = rows.join(files.withColumn("place", F.row_number().over(Window.orderBy("file"))), "file")
    seq = F.col("place").cast("long") * (1 << 32) + F.col("line")
    return rows.select(F.col("head.context").alias("context"), seq.alias("seq"), "r.subject", "r.label", "r.object", F.coalesce("r.weight", F.lit(1.0)).alias("weight"), F.col("head.source").alias("source"), "r.paragraph")


def passages(read: DataFrame) -> DataFrame:
    return read.filter("what = 'passage'").select(F.col("head.context").alias("context"), F.col("head.source").alias("source"), F.col("r.passage").alias("text"), "r.stored_at", "r.date", "r.tags")


def aliases(read: DataFrame) -> DataFrame:
    return read.filter("what = 'alias'").select(F.col("head.context").alias("context"), F.coalesce("r.kind", F.lit("concept")).alias("kind"), "r.alias", "r.canonical")


def marks(read: DataFrame) -> DataFrame:
    """(context, source, paragraph, questions, section, locator): marks of paragraphs; of several sections or locators the last counts."""
    rows = read.filter("what IN ('question', 'section', 'locator')")
    last = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("line")))
    return rows.groupBy(F.col("head.context").alias("context"), F.col("head.source").alias("source"), F.col("r.paragraph").alias("paragraph")).agg(
        F.transform(F.sort_array(F.collect_list(F.when(F.col("r.question").isNotNull(), F.struct("line", "r.question")))), lambda x: x["question"]).alias("questions"), last("r.section").alias("section"), last("r.locator").alias("locator")
    )


def created(read: DataFrame) -> DataFrame:
    """(context, description, pinned): what headers ask to create, each context once, by its first header."""
    rows = read.filter("what = 'header' AND head.create IS NOT NULL")
    first = rows.groupBy(F.col("head.context").alias("context")).agg(F.min_by("head.create", F.struct("file", "line")).alias("create"))
    return first.select("context", "create.description", F.coalesce("create.pinned", F.lit(False)).alias("pinned"))


def replaced(old: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows (context, source, ..) after an import: those of the imported sources (context, source) give way to the new ones."""
    return old.join(sources.select("context", "source").distinct(), ["context", "source"], "left_anti").select(new.columns).union(new)


def with_aliases(old: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases after an import: a spelling means what it was last said to mean."""
    keys = ["context", "kind", "alias"]
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*keys, "canonical").union(new.select(*keys, "canonical").distinct())


def preview(read: DataFrame) -> DataFrame:
    """(context, source, what, n): what an import would bring."""
    return read.groupBy(F.col("head.context").alias("context"), F.col("head.source").alias("source"), "what").agg(F.count("*").alias("n"))


def export_lines(assertions: DataFrame, context: str, sources: list[str] | None = None, create: tuple[str, bool] | None = None, aliases: DataFrame | None = None, paragraphs: DataFrame | None = None) -> DataFrame:
    """(source, place, value): for each source a header, its passage if texts are given, and
    its associations, weights from that source alone; before all of them a header that creates
    the context (description, pinned), and after all the aliases under a header of no source's
    name.  Written sorted by source and place it can be imported again."""
    shares = attributions(assertions.filter(F.col("context") == context))
    if sources is not None:
        shares = shares.filter(F.col("source").isin(sources))
    body = shares.select("source", F.col("first_seq").alias("place"), F.to_json(F.struct("subject", "label", "object", average(F.col("sum"), F.col("count")).alias("weight"), "paragraph")).alias("value"))
    heads = shares.select("source").distinct().select("source", F.lit(-1).cast("long").alias("place"), F.to_json(F.struct(F.lit(1).alias("kb_batch"), F.lit(context).alias("context"), "source")).alias("value"))
    out = heads.union(body)
    spark = assertions.sparkSession
    if paragraphs is not None:
        kept = paragraphs.filter(F.col("context") == context).join(shares.select("source").distinct(), "source", "left_semi")
        whole = kept.groupBy("source").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("paragraph", "text"))), lambda p: p["text"]), "\n\n").alias("passage"))
        out = out.union(whole.select("source", F.lit(-1).cast("long"), F.to_json(F.struct("passage"))))
    if create is not None:
        row = spark.createDataFrame([(context, *create)], "context string, description string, pinned boolean")
        out = out.union(row.select(F.lit(""), F.lit(-2).cast("long"), F.to_json(F.struct(F.lit(1).alias("kb_batch"), "context", F.lit("").alias("source"), F.struct("description", "pinned").alias("create")))))
    if aliases is not None:
        own = aliases.filter(F.col("context") == context)
        head = spark.createDataFrame([(LAST, -1, f'{{"kb_batch":1,"context":{json.dumps(context)},"source":"aliases"}}')], "source string, place long, value string")
        out = out.union(head).union(own.select(F.lit(LAST), F.lit(0).cast("long"), F.to_json(F.struct("alias", "canonical", "kind"))))
    return out


def write(rows: DataFrame, path: str) -> None:
    rows.repartitionByRange("source").sortWithinPartitions("source", "place", "value").select("value").write.text(path)
