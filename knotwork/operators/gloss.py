"""Glosses: a name with its heaviest facts as one short text, for every name at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Facts in the gloss of a concept, examples in that of a label, and candidates that get one.
FACTS, EXAMPLES, CANDIDATES = 4, 3, 8


def _text(name: str, facts: str, own: bool) -> F.Column:
    """Sentences in order of weight.  A subject is named where it is neither the gloss's own
    nor that of the sentence before."""
    start = F.struct(F.concat(F.col(name), F.lit("。")).alias("text"), F.lit(None).cast("string").alias("last"))

    def add(state, f):
        known = F.coalesce(f["subject"] == state["last"], F.lit(False))
        if own:
            known |= f["subject"] == F.col(name)
        subject = F.when(known, "").otherwise(F.concat(f["subject"], F.lit("の")))
        sentence = F.concat(subject, f["label"], F.lit("は"), f["object"], F.when(f["sum"] < 0, "ではない").otherwise(""), F.lit("。"))
        return F.struct(F.concat(state["text"], sentence).alias("text"), f["subject"].alias("last"))

    return F.aggregate(facts, start, add, lambda state: state["text"])


def _heaviest(rows: DataFrame, name: str, k: int) -> DataFrame:
    """(context, name, facts): of the rows around each name the ``k`` of largest sum, earlier ones first among equals."""
    order = Window.partitionBy("context", name).orderBy(F.abs("sum").desc(), "first_seq", "subject", "label", "object")
    best = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return best.groupBy("context", name).agg(F.sort_array(F.collect_list(F.struct("place", "subject", "label", "object", "sum"))).alias("facts"))


def concept_glosses(edge: DataFrame, k: int = FACTS) -> DataFrame:
    """(context, concept, gloss) of every concept of a live edge; a loop counts once."""
    live = edge.filter("count > 0").select("context", "subject", "label", "object", "sum", "first_seq")
    around = live.withColumn("concept", F.col("subject")).union(live.filter("subject <> object").withColumn("concept", F.col("object")))
    return _heaviest(around, "concept", k).select("context", "concept", _text("concept", "facts", True).alias("gloss"))


def label_glosses(edge: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """(context, label, gloss) of every live label."""
    live = edge.filter("count > 0").select("context", "subject", "label", "object", "sum", "first_seq").withColumn("name", F.col("label"))
    return _heaviest(live, "name", k).select("context", F.col("name").alias("label"), _text("name", "facts", False).alias("gloss"))


def glossed(candidates: DataFrame, glosses: DataFrame, by: list[str] = (), most: int = CANDIDATES) -> DataFrame:
    """Candidates (by.., name, score) of a resolution with ``gloss`` for the first ``most`` of each."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "name"))
    named = glosses.select(F.col("concept").alias("name"), "gloss")
    out = candidates.withColumn("_place", place).join(named, "name", "left")
    return out.select(*candidates.columns, F.when(F.col("_place") <= most, F.col("gloss")).alias("gloss"))
