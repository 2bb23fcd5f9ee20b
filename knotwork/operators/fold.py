"""From the log of assertions to edges and attributions, and what changes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.scalar import average, saturated

TRIPLE = ["context", "subject", "label", "object"]
#: A source that stands for none.
UNSOURCED = "export:unsourced"


def canonical(assertions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every name replaced by what it is an alias of."""
    out = assertions
    for column, kind in (("subject", "concept"), ("object", "concept"), ("label", "label")):
        names = aliases.filter(F.col("kind") == kind).select("context", F.col("alias").alias(column), F.col("canonical").alias("_canonical"))
        out = out.join(names, ["context", column], "left").withColumn(column, F.coalesce("_canonical", column)).drop("_canonical")
    return out


def attributions(assertions: DataFrame) -> DataFrame:
    """(triple, source, sum, count, paragraph, first_seq): each source's share; the paragraph is that of its first assertion."""
    return (
        assertions.filter("source IS NOT NULL")
        .groupBy(*TRIPLE, "source")
        .agg(saturated(F.sum("weight")).alias("sum"), F.count("*").alias("count"), F.min_by("paragraph", "seq").alias("paragraph"), F.min("seq").alias("first_seq"))
    )


def edges(assertions: DataFrame) -> DataFrame:
    """(triple, sum, count, first_seq): one row a triple, in order of ``first_seq``.

    One shuffle on the triple, summed before it.
    """
    return assertions.groupBy(*TRIPLE).agg(saturated(F.sum("weight")).alias("sum"), F.count("*").alias("count"), F.min("seq").alias("first_seq"))


def weighted(edge: DataFrame) -> DataFrame:
    return edge.select(*TRIPLE, average(F.col("sum"), F.col("count")).alias("weight"), "count")


def retract_source(assertions: DataFrame, source: str, context: str | None = None) -> DataFrame:
    """Edges without what ``source`` said; an edge that nobody else attests stays, dead."""
    said = (F.col("source") == source) if context is None else (F.col("source") == source) & (F.col("context") == context)
    kept = ~F.coalesce(said, F.lit(False))
    return assertions.groupBy(*TRIPLE).agg(
        saturated(F.coalesce(F.sum(F.when(kept, F.col("weight"))), F.lit(0.0))).alias("sum"), F.count(F.when(kept, 1)).alias("count"), F.min("seq").alias("first_seq")
    )


def apply_ops(ops: DataFrame) -> DataFrame:
    """Edges of an ordered log (seq, op, triple, weight, source).

    ``associate`` adds; ``retract_association`` ends all that was said of its
    triple before; ``retract_source`` ends what its source said before, of any
    triple of its context.  Dead edges stay.
    """
    said = ops.filter("op = 'associate'")
    ended = ops.filter("op = 'retract_association'").groupBy(*TRIPLE).agg(F.max("seq").alias("edge_end"))
    left = ops.filter("op = 'retract_source'").groupBy("context", "source").agg(F.max("seq").alias("source_end"))
    known = said.join(ended, TRIPLE, "left").join(left, ["context", "source"], "left")
    live = (F.col("seq") > F.coalesce("edge_end", F.lit(-1))) & (F.col("seq") > F.coalesce("source_end", F.lit(-1)))
    return known.groupBy(*TRIPLE).agg(saturated(F.coalesce(F.sum(F.when(live, F.col("weight"))), F.lit(0.0))).alias("sum"), F.count(F.when(live, 1)).alias("count"), F.min("seq").alias("first_seq"))


def source_edges(assertions: DataFrame, source: str) -> DataFrame:
    """How many edges a retraction of ``source`` would touch."""
    return assertions.filter(F.col("source") == source).select(*TRIPLE).distinct().agg(F.count("*").alias("edges"))


def unsourced_edges(assertions: DataFrame, floor: float = 0.0) -> DataFrame:
    """(triple, residual, unattributed): edges of which not all is attested, by what isn't."""
    floor = abs(floor) if floor == floor else 0.0
    named = F.col("source").isNotNull() & (F.col("source") != UNSOURCED)
    out = assertions.groupBy(*TRIPLE).agg(F.coalesce(F.sum(F.when(named, 0.0).otherwise(F.col("weight"))), F.lit(0.0)).alias("residual"), F.count(F.when(~F.coalesce(named, F.lit(False)), 1)).alias("unattributed"))
    return out.filter((F.col("unattributed") > 0) & (F.abs("residual") >= floor))


def unsourced_summary(assertions: DataFrame) -> DataFrame:
    return unsourced_edges(assertions).groupBy("context").agg(F.count("*").alias("edges"), F.sum("residual").alias("residual"), F.sum("unattributed").alias("unattributed"))


def degrees(edge: DataFrame) -> DataFrame:
    """(context, concept, degree, first_seen) over live edges; a loop counts twice."""
    live = edge.filter("count > 0")
    ends = live.select("context", F.col("subject").alias("concept"), (F.col("first_seq") * 2).alias("seen")).union(live.select("context", F.col("object"), F.col("first_seq") * 2 + 1))
    return ends.groupBy("context", "concept").agg(F.count("*").alias("degree"), F.min("seen").alias("first_seen"))


def top_concepts(edge: DataFrame, k: int) -> DataFrame:
    """The ``k`` concepts of most live edges, ties to the one seen first."""
    return degrees(edge).orderBy(F.desc("degree"), "first_seen", "concept").limit(k).select("concept", "degree")


def statistics(assertions: DataFrame, edge: DataFrame) -> DataFrame:
    """Per context: associations, dead ones and their share, concepts, labels, sources."""
    counts = edge.groupBy("context").agg(F.count("*").alias("associations"), F.count(F.when(F.col("count") == 0, 1)).alias("dead_edges"), F.countDistinct("label").alias("labels"))
    names = edge.select("context", F.col("subject").alias("name")).union(edge.select("context", "object")).groupBy("context").agg(F.countDistinct("name").alias("concepts"))
    sources = assertions.groupBy("context").agg(F.countDistinct("source").alias("sources"))
    return counts.join(names, "context").join(sources, "context").select("context", "associations", "dead_edges", F.when(F.col("associations") == 0, 0.0).otherwise(F.col("dead_edges") / F.col("associations")).alias("dead_ratio"), "concepts", "labels", "sources")


def compacted(edge: DataFrame) -> DataFrame:
    return edge.filter("count > 0")


def dead_aliases(aliases: DataFrame, edge: DataFrame) -> DataFrame:
    """Aliases of names that no live edge has."""
    live = edge.filter("count > 0")
    concepts = live.select("context", F.lit("concept").alias("kind"), F.col("subject").alias("canonical")).union(live.select("context", F.lit("concept"), "object"))
    names = concepts.union(live.select("context", F.lit("label"), "label")).distinct()
    return aliases.join(names, ["context", "kind", "canonical"], "left_anti").select("context", "kind", "alias", "canonical")


def check_aliases(proposed: DataFrame, aliases: DataFrame, edge: DataFrame) -> DataFrame:
    """``proposed`` with a verdict: ``conflict`` with a name or other alias, ``unknown_canonical``, else ``ok``."""
    concepts = edge.select("context", F.lit("concept").alias("kind"), F.col("subject").alias("name")).union(edge.select("context", F.lit("concept"), "object"))
    names = concepts.union(edge.select("context", F.lit("label"), "label")).distinct()
    taken = names.select("context", "kind", F.col("name").alias("alias"), F.col("name").alias("means")).union(aliases.select("context", "kind", "alias", F.col("canonical")))
    known = names.select("context", "kind", F.col("name").alias("canonical"), F.lit(True).alias("known"))
    out = proposed.join(taken, ["context", "kind", "alias"], "left").join(known, ["context", "kind", "canonical"], "left")
    verdict = F.when(F.col("means").isNotNull() & (F.col("means") != F.col("canonical")), "conflict").when(F.col("known").isNull(), "unknown_canonical").otherwise("ok")
    return out.select("context", "kind", "alias", "canonical", verdict.alias("verdict"))


def replaced_source(old: DataFrame, batch: DataFrame) -> DataFrame:
    """The log after an import: a batch replaces all that its sources said before."""
    return old.join(batch.select("context", "source").distinct(), ["context", "source"], "left_anti").select(batch.columns).union(batch)


def exported(assertions: DataFrame, sources: list[str] | None = None) -> DataFrame:
    """(source, triple, weight, count): the kept sources' shares, weights from them alone."""
    shares = attributions(assertions)
    if sources is not None:
        shares = shares.filter(F.col("source").isin(sources))
    return shares.select("source", *TRIPLE, average(F.col("sum"), F.col("count")).alias("weight"), "count")


def with_attributions(edge: DataFrame, shares: DataFrame) -> DataFrame:
    """Edges with their attributions as a list, in order of first assertion."""
    items = shares.groupBy(*TRIPLE).agg(F.sort_array(F.collect_list(F.struct("first_seq", "source", F.col("sum"), F.col("count"), "paragraph"))).alias("items"))
    listed = F.transform("items", lambda i: F.struct(i["source"].alias("source"), average(i["sum"], i["count"]).alias("weight"), i["count"].alias("count"), i["paragraph"].alias("paragraph")))
    return edge.join(items, TRIPLE, "left").select(*edge.columns, F.coalesce(listed, F.array().cast("array<struct<source:string,weight:double,count:bigint,paragraph:int>>")).alias("attributions"))


def ordinals(edge: DataFrame) -> DataFrame:
    """Edges with a dense number in order of first assertion, by context."""
    return edge.withColumn("edge_id", F.row_number().over(Window.partitionBy("context").orderBy("first_seq", "subject", "label", "object")) - 1)
