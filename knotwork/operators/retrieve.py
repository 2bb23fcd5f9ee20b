"""Retrieval in one go: from wordings to names, what is said around them, and what it says so."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.operators import entry, fold, match, search, traverse
from knotwork.plans.stage import settled, staged
from knotwork.plans.tables import Tables

MOST_CUES = 1000
KEYS = ["subject", "label", "object"]


@dataclass(frozen=True)
class Retrieved:
    resolved: DataFrame  # (cue, name, score, kind)
    anchors: list[str]
    outline: DataFrame | None  # (concept, role, label, edges)
    associations: DataFrame | None  # (place, origin, triple, weight, count)
    citations: DataFrame | None  # (source, paragraph, text)
    passages: DataFrame | None  # (query, source, paragraph, score, rank)
    fallback: str


def anchors(resolved: DataFrame, cues: list[str], auto_pick: bool = True) -> list[str]:
    """The best name of each cue, in the order of the cues, each once; the cues themselves where nothing is picked."""
    if not auto_pick:
        return list(dict.fromkeys(cues))
    place = F.row_number().over(Window.partitionBy("cue").orderBy(F.desc("score"), "name"))
    best = dict(resolved.withColumn("place", place).filter("place = 1").select("cue", "name").collect())  # a row a cue
    return list(dict.fromkeys(best[c] for c in cues if c in best))


def gathered(edge: DataFrame, names: list[str], labels: list[str] = (), decay: float = traverse.DECAY, limit: int = traverse.STRONGEST) -> DataFrame:
    """(place, origin, triple, weight, count): what the anchors say under the labels, if any are
    given, then what activation reaches; a triple once, where it comes first."""
    live = settled(match.visible(edge), "live")
    parts = []
    if labels:
        page = match.page(match.query_any(live, names, list(labels)))
        order = F.row_number().over(Window.orderBy(F.abs("weight").desc(), *KEYS))  # a page of rows
        parts.append(page.select(F.lit(0).alias("lane"), order.alias("n"), *KEYS, "weight", "count"))
    active = traverse.activate(live, names, decay, limit)
    order = F.row_number().over(Window.orderBy(F.desc("strength"), *KEYS))  # ``limit`` rows
    parts.append(active.select(F.lit(1).alias("lane"), order.alias("n"), *KEYS, "weight", "count"))
    rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    first = rows.groupBy(*KEYS).agg(F.min(F.struct("lane", "n", "weight", "count")).alias("by"))
    place = F.row_number().over(Window.orderBy("by.lane", "by.n"))
    return first.select(place.alias("place"), F.get(F.array(F.lit("query"), F.lit("activate")), F.col("by.lane")).alias("origin"), *KEYS, "by.weight", "by.count")


def cited(associations: DataFrame, tables: Tables) -> DataFrame:
    """(source, paragraph, text): the paragraphs that the associations' sources point at, each once, as far as they are stored."""
    wanted = tables.assertions.join(associations.select(*KEYS), KEYS, "left_semi")
    places = fold.attributions(wanted).filter("paragraph IS NOT NULL").select("source", "paragraph").distinct()
    return tables.paragraphs.select("source", "paragraph", "text").join(places, ["source", "paragraph"], "left_semi")


def retrieve(
    tables: Tables, cues: list[str], labels: list[str] = (), auto_pick: bool = True, describe_first: bool = True, fetch_citations: bool = True,
    fallback: tuple[search.Index, DataFrame] | None = None, only_if_empty: bool = True, edge: DataFrame | None = None, limit: int = search.LIMIT, decay: float = traverse.DECAY, activate_limit: int = traverse.STRONGEST,
) -> Retrieved:
    """Resolve, describe, query, activate, cite; a search of passages (an index, and terms
    (query, term)) where asked for, by default only where the graph gave nothing.  ``edge`` is
    the fold of the tables' assertions where it is stored."""
    cues = list(dict.fromkeys(cues))
    if len(cues) > MOST_CUES:
        raise ValueError(f"{len(cues)} cues, {MOST_CUES} at most")
    edge = settled(fold.edges(tables.assertions) if edge is None else edge, "edges")
    spark = edge.sparkSession
    spelled = entry.spellings(edge, tables.aliases)
    resolved = staged(entry.resolve_all(spelled, spark.createDataFrame([(c,) for c in cues], "cue string")), "resolved")
    names = anchors(resolved, cues, auto_pick)
    outline = associations = citations = None
    if describe_first and names:
        outline = match.described(edge, names)
    if names:
        associations = staged(gathered(edge, names, labels, decay, activate_limit), "associations")
        if fetch_citations and tables.paragraphs is not None:
            citations = cited(associations, tables)
    empty = associations is None or associations.isEmpty()
    reason = "not_requested" if fallback is None else "always" if not only_if_empty else "graph_empty" if empty else "suppressed"
    passages = search.ranked(search.scores(*fallback), limit) if reason in ("always", "graph_empty") else None
    return Retrieved(resolved, names, outline, associations, citations, passages, reason)
