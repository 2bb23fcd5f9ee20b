"""Audits: what contradicts, what is stale, what may be the same, what breaks the schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.scalar import effective_time
from knotwork.operators.fold import TRIPLE
from knotwork.operators.match import closure, expanded_types
from knotwork.plans.tables import TYPE_LABEL

LIMIT, EVIDENCE = 100, 20


def contradictions(edge: DataFrame) -> DataFrame:
    """(context, subject, label, objects, tendency): subjects with several live objects
    of a label; the tendency is the share of the label's subjects that have one."""
    live = edge.filter("count > 0")
    groups = live.groupBy("context", "subject", "label").agg(F.count("*").alias("objects"))
    tendency = groups.groupBy("context", "label").agg((F.count(F.when(F.col("objects") == 1, 1)) / F.count("*")).alias("tendency"))
    return groups.filter("objects > 1").join(tendency, ["context", "label"]).select("context", "subject", "label", "objects", "tendency")


def contradiction_page(edge: DataFrame, limit: int = LIMIT) -> DataFrame:
    return contradictions(edge).orderBy(F.desc("tendency"), "label", "subject").limit(limit)


def sign_conflicts(shares: DataFrame) -> DataFrame:
    """(triple, affirming, denying): edges that some source affirms and another denies; sums of zero do neither."""
    sides = shares.groupBy(*TRIPLE).agg(F.count(F.when(F.col("sum") > 0, 1)).alias("affirming"), F.count(F.when(F.col("sum") < 0, 1)).alias("denying"))
    return sides.filter("affirming > 0 AND denying > 0")


def staleness(shares: DataFrame, sources: DataFrame, floor: int = 0) -> DataFrame:
    """(triple, latest, gap): dated edges older than the newest of their subject, by at least ``floor`` seconds."""
    dated = sources.select("context", "source", effective_time(F.col("stored_at"), F.col("date")).alias("at"))
    latest = shares.join(dated, ["context", "source"], "left").groupBy(*TRIPLE).agg(F.max("at").alias("latest")).filter("latest IS NOT NULL")
    newest = latest.groupBy("context", "subject").agg(F.max("latest").alias("newest"))
    gap = F.col("newest") - F.col("latest")
    return latest.join(newest, ["context", "subject"]).filter((gap > 0) & (gap >= floor)).select(*TRIPLE, "latest", gap.alias("gap"))


def undatable(shares: DataFrame, sources: DataFrame, edge: DataFrame) -> DataFrame:
    """Live edges without any dated source."""
    dated = sources.filter(effective_time(F.col("stored_at"), F.col("date")).isNotNull()).select("context", "source")
    seen = shares.join(dated, ["context", "source"], "left_semi").select(*TRIPLE).distinct()
    return edge.filter("count > 0").join(seen, TRIPLE, "left_anti")


def facts(edge: DataFrame) -> DataFrame:
    """(concept, fact): what is said around a concept, as direction, label and other end."""
    live = edge.filter("count > 0")
    return live.select(F.col("subject").alias("concept"), F.struct(F.lit("out").alias("direction"), "label", F.col("object").alias("other")).alias("fact")).union(
        live.select("object", F.struct(F.lit("in").alias("direction"), "label", F.col("subject").alias("other")))
    )


def merge_evidence(edge: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, shared, only_a, only_b, overlap) of pairs (a, b) of concepts: how much is said of both."""
    said = facts(edge).distinct()
    sizes = said.groupBy("concept").agg(F.count("*").alias("n"))
    both = pairs.join(said.withColumnRenamed("concept", "a"), "a").join(said.select(F.col("concept").alias("b"), "fact"), ["b", "fact"]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    out = pairs.join(both, ["a", "b"], "left").join(sizes.select(F.col("concept").alias("a"), F.col("n").alias("na")), "a", "left").join(sizes.select(F.col("concept").alias("b"), F.col("n").alias("nb")), "b", "left")
    out = out.fillna(0, ["shared", "na", "nb"])
    union = F.col("na") + F.col("nb") - F.col("shared")
    overlap = F.when(union == 0, 0.0).otherwise(F.col("shared") / union)
    return out.select("a", "b", "shared", (F.col("na") - F.col("shared")).alias("only_a"), (F.col("nb") - F.col("shared")).alias("only_b"), overlap.alias("overlap"))


def contradiction_section(edge: DataFrame, shares: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(place, kind, subject, label, object, objects, tendency, affirming, denying): subjects of
    several objects, of the steadiest labels first, then edges that sources disagree about,
    up to ``limit`` in all."""
    text, long = (lambda: F.lit(None).cast("string")), (lambda: F.lit(None).cast("long"))
    groups = contradictions(edge).select(F.lit(0).alias("kind"), "subject", "label", text().alias("object"), "objects", "tendency", long().alias("affirming"), long().alias("denying"))
    signs = sign_conflicts(shares).select(F.lit(1), "subject", "label", "object", long(), F.lit(None).cast("double"), "affirming", "denying")
    order = ("kind", F.desc("tendency"), "label", "subject", "object")
    best = groups.union(signs).orderBy(*order).limit(limit)
    names = F.array(F.lit("objects"), F.lit("contested"))
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("kind", F.get(names, F.col("kind")))  # at most ``limit`` rows


def merge_section(edge: DataFrame, pairs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Candidates (a, b, score) to be one concept with what is said of both, most shared
    facts first, then most alike names."""
    best = pairs.groupBy("a", "b").agg(F.max("score").alias("score"))
    said = merge_evidence(edge, best.select("a", "b"))
    return said.join(best, ["a", "b"]).orderBy(F.desc("overlap"), F.desc("score"), "a", "b").limit(limit).select("a", "b", "score", "shared", "only_a", "only_b", "overlap")


def shared_facts(edge: DataFrame, pairs: DataFrame, most: int = EVIDENCE) -> DataFrame:
    """(a, b, side, place, fact) for pairs (a, b): the first ``most`` facts that both have, and that one has alone."""
    said = facts(edge).distinct()
    sides = pairs.select("a", "b", F.explode(F.array(F.struct(F.lit("a").alias("of"), F.col("a").alias("concept")), F.struct(F.lit("b").alias("of"), F.col("b").alias("concept")))).alias("x"))
    held = sides.select("a", "b", "x.of", F.col("x.concept").alias("concept")).join(said, "concept")
    per = held.groupBy("a", "b", "fact").agg(F.sort_array(F.collect_set("of")).alias("by"))
    named = per.select("a", "b", F.when(F.size("by") == 2, "both").otherwise(F.get("by", F.lit(0))).alias("side"), "fact")
    place = F.row_number().over(Window.partitionBy("a", "b", "side").orderBy("fact"))
    return named.withColumn("place", place).filter(F.col("place") <= most)


def consolidation(edge: DataFrame, shares: DataFrame, sources: DataFrame, pairs: DataFrame, checks: set[str] = frozenset({"merge", "contradiction", "staleness"}), limit: int = LIMIT, floor: int = 0) -> dict[str, DataFrame]:
    """The sections that are asked for, each in its order and up to ``limit``."""
    if not checks or not set(checks) <= {"merge", "contradiction", "staleness"}:
        raise ValueError("checks are merge, contradiction and staleness, one at least")
    out = {}
    if "merge" in checks:
        out["merge"] = merge_section(edge, pairs, limit)
    if "contradiction" in checks:
        out["contradiction"] = contradiction_section(edge, shares, limit)
    if "staleness" in checks:
        out["staleness"] = staleness(shares, sources, floor).orderBy(F.desc("gap"), "subject", "label", "object").limit(limit)
    return out


def drift(assertions: DataFrame, edge: DataFrame, aliases: DataFrame, twins: DataFrame | None, unsourced: DataFrame) -> DataFrame:
    """(section, a, b, amount): weight that nobody attests, aliases of nothing, names that may be one."""
    out = unsourced.select(F.lit("unsourced").alias("section"), F.concat_ws(" ", "subject", "label", "object").alias("a"), F.lit(None).cast("string").alias("b"), F.col("residual").alias("amount"))
    out = out.union(aliases.select(F.lit("dead_alias"), "alias", "canonical", F.lit(None).cast("double")))
    return out if twins is None else out.union(twins.select(F.lit("twins"), "a", "b", "score"))


#: Names that a schema may have at most, how deep a type may lie, and bytes of a name.
TYPES, RELATIONS, SIDE_TYPES, DEPTH, NAME_BYTES = 500, 500, 64, 8, 1024


def installed(is_a: dict[str, list[str]], relations: dict[str, dict[str, list[str]]]) -> dict[str, set[str]]:
    """The closure of a schema that may be installed; others are refused with the reason."""
    if len(is_a) > TYPES or len(relations) > RELATIONS:
        raise ValueError(f"a schema has at most {TYPES} types and {RELATIONS} relations")
    if TYPE_LABEL in relations:
        raise ValueError(f"{TYPE_LABEL} is reserved")
    sides = {(name, side): r.get(side, []) for name, r in relations.items() for side in ("domain", "range")}
    for (name, side), held in sides.items():
        if len(held) > SIDE_TYPES:
            raise ValueError(f"the {side} of {name} has more than {SIDE_TYPES} types")
    for name in [*is_a, *relations, *(t for ts in is_a.values() for t in ts), *(t for ts in sides.values() for t in ts)]:
        if len(name.encode()) > NAME_BYTES:
            raise ValueError(f"the name {name[:40]}... is too long")
    above = closure(is_a)

    def depth(t: str) -> int:
        return 1 + max(map(depth, is_a.get(t, ())), default=0)

    if deep := [t for t in above if depth(t) > DEPTH]:
        raise ValueError(f"{deep[0]} lies deeper than {DEPTH}")
    return above


def unknown_labels(edge: DataFrame, relations: dict[str, dict[str, list[str]]]) -> DataFrame:
    """(context, label): live labels that the schema doesn't declare."""
    return edge.filter((F.col("count") > 0) & (F.col("label") != TYPE_LABEL) & ~F.col("label").isin(sorted(relations))).select("context", "label").distinct()


def reserved_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases that stand for the reserved label or take its name."""
    return aliases.filter((F.col("kind") == "label") & ((F.col("alias") == TYPE_LABEL) | (F.col("canonical") == TYPE_LABEL)))


def schema_violations(edge: DataFrame, is_a: dict[str, list[str]], relations: dict[str, dict[str, list[str]]], closed_labels: bool = False) -> DataFrame:
    """(context, subject, label, object, kind): live edges that break the schema.

    ``domain`` and ``range`` when a typed end has none of the types that the label
    permits, ``label`` when labels are closed and this one isn't declared.  Untyped
    ends break nothing, and type edges are exempt.
    """
    closure(is_a)  # refuses cycles
    checked = edge.filter((F.col("count") > 0) & (F.col("label") != TYPE_LABEL)).select(*TRIPLE)
    typed = expanded_types(edge, is_a)
    held = typed.groupBy("context", "concept").agg(F.collect_set("type").alias("types"))
    found = []
    for kind, column in (("domain", "subject"), ("range", "object")):
        permitted = {label: r[kind] for label, r in relations.items() if r.get(kind)}
        if permitted:
            of = F.create_map(*(x for label, ts in sorted(permitted.items()) for x in (F.lit(label), F.array(*map(F.lit, sorted(ts))))))
            ends = checked.filter(F.col("label").isin(sorted(permitted))).join(held.withColumnRenamed("concept", column), ["context", column])
            found.append(ends.filter(~F.arrays_overlap("types", F.element_at(of, F.col("label")))).select(*TRIPLE, F.lit(kind).alias("kind")))
    if closed_labels:
        found.append(checked.filter(~F.col("label").isin(sorted(relations))).select(*TRIPLE, F.lit("label").alias("kind")))
    out = found[0] if found else checked.limit(0).select(*TRIPLE, F.lit("").alias("kind"))
    for more in found[1:]:
        out = out.union(more)
    return out


def untyped_concepts(edge: DataFrame) -> DataFrame:
    live = edge.filter((F.col("count") > 0) & (F.col("label") != TYPE_LABEL))
    names = live.select("context", F.col("subject").alias("concept")).union(live.select("context", "object")).distinct()
    typed = edge.filter((F.col("count") > 0) & (F.col("label") == TYPE_LABEL)).select("context", F.col("subject").alias("concept"))
    return names.join(typed, ["context", "concept"], "left_anti")


def undeclared_types(edge: DataFrame, is_a: dict[str, list[str]]) -> DataFrame:
    declared = sorted(closure(is_a))
    return edge.filter((F.col("count") > 0) & (F.col("label") == TYPE_LABEL) & ~F.col("object").isin(declared)).select("context", F.col("object").alias("type")).distinct()


def newest_first(rows: DataFrame, by: str, key: list[str], limit: int) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("context").orderBy(F.desc(by), *key))).filter(F.col("place") <= limit)
