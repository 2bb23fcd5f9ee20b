"""Facts around names: filters, pages and windows over edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.scalar import average, effective_time, saturated
from knotwork.operators.fold import TRIPLE, attributions, edges
from knotwork.plans.tables import TYPE_LABEL, Tables

#: Rows of a page by default and at most.
MATCHES, MOST_MATCHES = 100, 1000


def known(aliases: DataFrame | None, names: list[str], kind: str) -> list[str]:
    """The names that spellings stand for; the spellings are parameters, so what comes back is as few."""
    if aliases is None or not names:
        return names
    found = dict(aliases.filter((F.col("kind") == kind) & F.col("alias").isin(names)).select("alias", "canonical").collect())
    return [found.get(n, n) for n in names]


def recall(edge: DataFrame, cue: str, aliases: DataFrame | None = None) -> DataFrame:
    """Every edge, dead ones too, that has the cue as subject, object or label."""
    (concept,), (label,) = known(aliases, [cue], "concept"), known(aliases, [cue], "label")
    return edge.filter((F.col("subject") == concept) | (F.col("object") == concept) | (F.col("label") == label))


def query_any(edge: DataFrame, subjects: list[str] = (), labels: list[str] = (), objects: list[str] = (), aliases: DataFrame | None = None) -> DataFrame:
    """Edges that have one of the names in each position that names any."""
    keep = F.lit(True)
    for column, names, kind in (("subject", subjects, "concept"), ("label", labels, "label"), ("object", objects, "concept")):
        if names:
            keep &= F.col(column).isin(known(aliases, list(names), kind))
    return edge.filter(keep)


def page(edge: DataFrame, limit: int = MATCHES, after: tuple[float, str, str, str] | None = None, contexts: bool = False) -> DataFrame:
    """The heaviest ``limit`` rows (subject, label, object, weight, count, total), by
    magnitude and then name; ``total`` is counted before the cursor ``after`` (weight
    and triple of the last row seen) and the limit."""
    rows = edge.select(*TRIPLE, average(F.col("sum"), F.col("count")).alias("weight"), "count")
    total = rows.agg(F.count("*").alias("total"))
    keys = [*["context"] * contexts, "subject", "label", "object"]
    if after is not None:
        weight, *seat = after
        last = F.struct(*(F.lit(x) for x in seat))
        seated = F.struct("subject", "label", "object")
        rows = rows.filter((seated != last) & ((F.abs("weight") < abs(weight)) | ((F.abs("weight") == abs(weight)) & (seated > last))))
    best = rows.orderBy(F.abs("weight").desc(), *keys).limit(min(limit, MOST_MATCHES))
    return best.crossJoin(F.broadcast(total)).select(*["context"] * contexts, "subject", "label", "object", "weight", "count", "total")  # one row


def source_filter(sources: DataFrame, tags: list[str] = (), since: int | None = None, until: int | None = None) -> DataFrame:
    """Sources with any of the tags and an effective time in [since, until)."""
    if since is not None and until is not None and since >= until:
        raise ValueError("since must lie before until")
    keep = F.lit(True)
    if tags:
        keep &= F.coalesce(F.arrays_overlap("tags", F.array(*map(F.lit, sorted(set(tags))))), F.lit(False))
    at = effective_time(F.col("stored_at"), F.col("date"))
    if since is not None:
        keep &= at >= since
    if until is not None:
        keep &= at < until
    return sources.filter(keep)


def refuse_window(contexts: list[str], since: int | None, until: int | None) -> None:
    """Several contexts can't be asked within a window: their sources' times don't compare."""
    if len(set(contexts)) > 1 and (since is not None or until is not None):
        raise ValueError("a window asks one context")


def crossed(tables: Tables, contexts: list[str], since: int | None = None, until: int | None = None) -> DataFrame:
    """Edges of the contexts asked for, of one within a window if there is any."""
    refuse_window(contexts, since, until)
    inside = tables.within(*contexts)
    return windowed(inside, since, until) if since is not None or until is not None else edges(inside.assertions)


def windowed(tables: Tables, since: int | None = None, until: int | None = None) -> DataFrame:
    """Edges as the sources in the window attest them; unsourced weight and undated
    sources aren't seen, and neither are edges that none attests."""
    seen = source_filter(tables.sources.filter(effective_time(F.col("stored_at"), F.col("date")).isNotNull()), since=since, until=until).select("context", "source")
    shares = tables.assertions.join(seen, ["context", "source"], "left_semi")
    return shares.groupBy(*TRIPLE).agg(saturated(F.sum("weight")).alias("sum"), F.count("*").alias("count"), F.min("seq").alias("first_seq"))


def visible(edge: DataFrame, hidden: list[str] = (TYPE_LABEL,)) -> DataFrame:
    """Live edges whose label isn't reserved: what walks go over."""
    return edge.filter((F.col("count") > 0) & ~F.col("label").isin(list(hidden)))


def describe(edge: DataFrame, concept: str) -> DataFrame:
    """(role, label, edges): tallies of live labels around a concept, most first."""
    live = edge.filter("count > 0")
    sides = [live.filter(F.col(side) == concept).groupBy("label").agg(F.count("*").alias("edges"), F.min("first_seq").alias("seen")).withColumn("role", F.lit(side)) for side in ("subject", "object")]
    return sides[0].unionByName(sides[1]).orderBy(F.desc("role"), F.desc("edges"), "seen", "label").select("role", "label", "edges")


def described(edge: DataFrame, concepts: list[str]) -> DataFrame:
    """(concept, role, label, edges): ``describe`` of several concepts."""
    live = edge.filter("count > 0")
    sides = [live.filter(F.col(side).isin(list(concepts))).groupBy(F.col(side).alias("concept"), F.lit(side).alias("role"), "label").agg(F.count("*").alias("edges")) for side in ("subject", "object")]
    return sides[0].unionByName(sides[1])


def concept_types(edge: DataFrame) -> DataFrame:
    """(context, concept, types): asserted types, not expanded."""
    return edge.filter((F.col("count") > 0) & (F.col("label") == TYPE_LABEL)).groupBy("context", F.col("subject").alias("concept")).agg(F.sort_array(F.collect_set("object")).alias("types"))


def closure(is_a: dict[str, list[str]]) -> dict[str, set[str]]:
    """Each declared type with all that it is; a schema has at most 500 of them."""
    def above(t: str, seen: frozenset[str]) -> set[str]:
        if t in seen:
            raise ValueError(f"{t} is its own ancestor")
        return {t}.union(*(above(p, seen | {t}) for p in is_a.get(t, ())))

    return {t: above(t, frozenset()) for t in {*is_a, *(p for ps in is_a.values() for p in ps)}}


def expanded_types(edge: DataFrame, is_a: dict[str, list[str]]) -> DataFrame:
    """(context, concept, type): asserted types and what they are."""
    typed = edge.filter((F.col("count") > 0) & (F.col("label") == TYPE_LABEL)).select("context", F.col("subject").alias("concept"), F.col("object").alias("type"))
    above = closure(is_a)
    if not above:
        return typed.distinct()
    mapping = F.create_map(*(x for t, all_ in sorted(above.items()) for x in (F.lit(t), F.array(*map(F.lit, sorted(all_))))))
    return typed.select("context", "concept", F.explode(F.coalesce(F.element_at(mapping, F.col("type")), F.array("type"))).alias("type")).distinct()


def type_filter(rows: DataFrame, typed: DataFrame, subjects: list[str] = (), objects: list[str] = ()) -> DataFrame:
    """Rows whose subject and object have one of the types; ``typed`` is expanded."""
    for column, wanted in (("subject", subjects), ("object", objects)):
        if wanted:
            having = typed.filter(F.col("type").isin(list(wanted))).select("context", F.col("concept").alias(column)).distinct()
            rows = rows.join(having, ["context", column], "left_semi")
    return rows


def vocabulary(edge: DataFrame, prefix: str = "", after: str | None = None, limit: int = 100, kind: str = "concept", excluded: list[str] = ()) -> DataFrame:
    """(name, total): names in order but for the excluded ones, from the cursor on; the total is of all with the prefix."""
    names = edge.select(F.col("label").alias("name")) if kind == "label" else edge.select(F.col("subject").alias("name")).union(edge.select("object"))
    names = names.filter(~F.col("name").isin(list(excluded))) if excluded else names
    return listing(names.distinct(), "name", prefix, after, limit)


def label_sample(edge: DataFrame, limit: int) -> DataFrame:
    """(label): the labels that were seen first."""
    return edge.groupBy("label").agg(F.min("first_seq").alias("seen")).orderBy("seen", "label").limit(limit).select("label")


def listing(rows: DataFrame, key: str, prefix: str = "", after: str | None = None, limit: int = 100) -> DataFrame:
    """A page of ``rows`` by ``key`` with the total before the cursor."""
    kept = rows.filter(F.col(key).startswith(prefix)) if prefix else rows
    total = kept.agg(F.count("*").alias("total"))
    page_ = (kept if after is None else kept.filter(F.col(key) > after)).orderBy(key).limit(max(1, limit))
    return page_.crossJoin(F.broadcast(total))  # one row


def adjacent(edge: DataFrame, a: str, b: str) -> DataFrame:
    ends = (F.col("subject") == a) & (F.col("object") == b) | (F.col("subject") == b) & (F.col("object") == a)
    return edge.filter((F.col("count") > 0) & ends).agg((F.count("*") > 0).alias("adjacent"))


def labels_share_subject(edge: DataFrame) -> DataFrame:
    """(context, a, b): pairs of labels that some live subject has both of."""
    held = edge.filter("count > 0").select("context", "subject", "label").distinct()
    both = held.alias("x").join(held.alias("y"), F.expr("x.context = y.context AND x.subject = y.subject AND x.label < y.label"))
    return both.select("x.context", F.col("x.label").alias("a"), F.col("y.label").alias("b")).distinct()


def lookup(sources: DataFrame, wanted: list[str]) -> DataFrame:
    """(source, found) for each of the wanted sources."""
    asked = sources.sparkSession.createDataFrame([(w,) for w in wanted], "source string")
    return asked.join(sources.select("source").distinct().withColumn("found", F.lit(True)), "source", "left").select("source", F.coalesce("found", F.lit(False)).alias("found"))


def decorated(shares: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """Attributions with the section that governs their paragraph and its locator."""
    marks = paragraphs.select("context", "source", "paragraph", "section", "locator")
    return shares.join(marks, ["context", "source", "paragraph"], "left")


def shares_of(tables: Tables) -> DataFrame:
    return attributions(tables.assertions)


def magnitude(edge: DataFrame) -> Column:
    return F.abs(edge["sum"])
