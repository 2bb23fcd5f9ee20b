"""Walks over live edges, as rounds of joins with a frontier.

Each round is a table of its own in the shared folder, so that a plan never grows
with the number of rounds.  A frontier holds what is new; what was seen leaves by
anti-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.plans.stage import settled, staged

DEEPEST = 10
DECAY, STRONGEST, FLOOR = 0.5, 20, 1e-6
TRAILS, EXPANSIONS = 10, 100_000
KEYS = ["subject", "label", "object"]


def adjacency(edge: DataFrame) -> DataFrame:
    """(src, dst, direction, edge): every edge from both ends, a loop once."""
    fields = F.struct("first_seq", *KEYS, "sum", "count")
    out = edge.select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.lit(0).alias("direction"), fields.alias("edge"))
    back = edge.filter("subject <> object").select(F.col("object").alias("src"), F.col("subject").alias("dst"), F.lit(1).alias("direction"), fields.alias("edge"))
    return out.union(back)


def _names(edge: DataFrame, names: list[str]) -> DataFrame:
    return edge.sparkSession.createDataFrame([(n, i) for i, n in enumerate(dict.fromkeys(names))], "concept string, place long")


def _present(edge: DataFrame, names: list[str]) -> DataFrame:
    """(concept, place) of the names that an edge has: the edges are read for these alone."""
    ends = [edge.filter(F.col(side).isin(list(names))).select(F.col(side).alias("concept")) for side in ("subject", "object")]
    return _names(edge, names).join(ends[0].union(ends[1]).distinct(), "concept", "left_semi")


def _either(edge: DataFrame, nodes: DataFrame, column: str) -> DataFrame:
    """Edges of which an end is a node (concept, ``column``), with its column as ``of_subject`` and ``of_object``."""
    out = edge
    for side in ("subject", "object"):
        out = out.join(nodes.select(F.col("concept").alias(side), F.col(column).alias(f"of_{side}")), side, "left")
    return out.filter("of_subject IS NOT NULL OR of_object IS NOT NULL")


def distances(edge: DataFrame, origins: list[str], depth: int) -> DataFrame:
    """(concept, distance, path): concepts within ``depth`` hops of the origins, with
    the chain by which each was found first."""
    near = adjacency(edge)
    start = _present(edge, origins)
    seen = frontier = staged(start.select("concept", F.lit(0).alias("distance"), F.array("concept").alias("path"), F.array(F.struct(F.col("place").alias("p"), F.lit(0).alias("d"), F.lit(0).cast("long").alias("s"))).alias("order")), "frontier")
    for distance in range(1, min(depth, DEEPEST) + 1):
        found = frontier.join(near, F.col("concept") == F.col("src")).select(
            F.col("dst"), F.struct(F.concat("order", F.array(F.struct(F.lit(0).cast("long").alias("p"), F.col("direction").alias("d"), F.col("edge.first_seq").alias("s")))).alias("order"), F.concat("path", F.array("dst")).alias("path")).alias("way")
        )
        best = found.groupBy(F.col("dst").alias("concept")).agg(F.min("way").alias("way")).join(seen.select("concept"), "concept", "left_anti")
        frontier = staged(best.select("concept", F.lit(distance).alias("distance"), F.col("way.path").alias("path"), F.col("way.order").alias("order")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def explore(edge: DataFrame, origins: list[str], depth: int) -> DataFrame:
    """(distance, path, subject, label, object, weight, count): every edge within reach
    at the hop that touches it first, with the chain to the concept that does."""
    depth, edge = min(depth, DEEPEST), settled(edge, "edges")
    nodes = distances(edge, origins, depth - 1).select("concept", F.struct("distance", "order", "path").alias("by"))
    first = _either(edge, nodes, "by").withColumn("by", F.least("of_subject", "of_object"))
    return first.select((F.col("by.distance") + 1).alias("distance"), F.col("by.path").alias("path"), *KEYS, (F.col("sum") / F.col("count")).alias("weight"), "count")


def explore_page(rows: DataFrame, limit: int = 100, after: tuple[int, str, str, str] | None = None) -> DataFrame:
    """The nearest ``limit`` rows of ``explore`` by distance and name, from the cursor ``after``
    (distance and triple of the last row seen) on; ``total`` is that of all."""
    total = rows.agg(F.count("*").alias("total"))
    if after is not None:
        rows = rows.filter(F.struct("distance", *KEYS) > F.struct(*(F.lit(x) for x in after)))
    return rows.orderBy("distance", *KEYS).limit(max(0, min(limit, 1000))).crossJoin(F.broadcast(total))  # one row


def activation(edge: DataFrame, origins: list[str], decay: float = DECAY) -> DataFrame:
    """(concept, strength): spreading activation, the best product over all ways.

    A concept passes its strength times ``decay`` to a neighbour in proportion to the
    edge's magnitude among all of its own; less than ``FLOOR`` isn't passed.  Each round
    reads the edges of the concepts that the last one made stronger, and no others.
    """
    live = edge.filter("sum <> 0")
    near = adjacency(live).select("src", "dst", F.abs("edge.sum").alias("pull"))
    best = frontier = staged(_present(live, origins).select("concept", F.lit(1.0).alias("strength")), "active")
    while True:
        out = staged(near.join(frontier, F.col("concept") == F.col("src")).select("src", "dst", "pull", "strength"), "out")
        total = out.groupBy("src").agg(F.sum("pull").alias("total"))
        ways = out.groupBy("src", "dst").agg(F.max("pull").alias("pull"), F.max("strength").alias("strength")).join(total, "src")
        flow = ways.select(F.col("dst").alias("concept"), (F.col("strength") * (F.col("pull") * decay / F.col("total"))).alias("flow"))
        flow = flow.filter(F.col("flow") >= FLOOR).groupBy("concept").agg(F.max("flow").alias("flow"))
        frontier = staged(flow.join(best, "concept", "left").filter("strength IS NULL OR flow > strength").select("concept", F.col("flow").alias("strength")), "active")
        if frontier.isEmpty():
            return best
        best = staged(best.union(frontier).groupBy("concept").agg(F.max("strength").alias("strength")), "best")


def activate(edge: DataFrame, origins: list[str], decay: float = DECAY, limit: int = STRONGEST) -> DataFrame:
    """(strength, subject, label, object, weight, count, total): the edges that activation
    reaches, strongest first; ties to the one asserted first."""
    edge = settled(edge, "edges")
    active = activation(edge, origins, decay)
    reached = _either(edge.filter("sum <> 0"), active, "strength").withColumn("strength", F.greatest("of_subject", "of_object") * decay * F.abs("sum"))
    total = reached.agg(F.count("*").alias("total"))
    best = reached.orderBy(F.desc("strength"), "first_seq", *KEYS).limit(limit)
    return best.crossJoin(F.broadcast(total)).select("strength", *KEYS, (F.col("sum") / F.col("count")).alias("weight"), "count", "total")  # one row


def paths(edge: DataFrame, origins: list[str], targets: list[str], depth: int, limit: int = TRAILS) -> tuple[DataFrame, bool]:
    """(length, strength, concepts, edges, total) and whether the budget ran out: simple
    trails between origins and targets, short ones and then strong ones first.

    A trail goes on only to concepts that can still reach a target within ``depth``.
    """
    depth, edge = min(depth, DEEPEST), settled(edge, "edges")
    remaining = distances(edge, targets, depth).select(F.col("concept").alias("dst"), F.col("distance").alias("left"))
    near = adjacency(edge).join(remaining, "dst")
    goal = _names(edge, targets).select(F.col("concept").alias("at"))
    start = _present(edge, origins)
    trail = staged(start.select(F.col("concept").alias("at"), F.array("concept").alias("concepts"), F.array().cast("array<bigint>").alias("edges"), F.lit(float("inf")).alias("strength")), "trails")
    found, spent, capped = None, 0, False
    for length in range(1, depth + 1):
        step = trail.join(near, F.col("at") == F.col("src")).filter((F.col("left") <= depth - length) & ~F.array_contains("concepts", F.col("dst")))
        step = step.select(F.col("dst").alias("at"), F.concat("concepts", F.array("dst")).alias("concepts"), F.concat("edges", F.array("edge.first_seq")).alias("edges"), F.least("strength", F.abs("edge.sum")).alias("strength"))
        trail = staged(step, "trails")
        n = trail.count()
        spent += n
        capped = capped or spent > EXPANSIONS
        hits = trail.join(goal, "at", "left_semi").select(F.lit(length).alias("length"), "strength", "concepts", "edges")
        found = hits if found is None else found.union(hits)
        if not n or capped:
            break
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("length", F.desc("strength"), "concepts", "edges").limit(limit).crossJoin(F.broadcast(total)), capped  # one row


def component(edge: DataFrame, origins: list[str]) -> DataFrame:
    """(concept): all that the origins reach, however far."""
    near = adjacency(edge).select("src", "dst").distinct()
    seen = frontier = staged(_names(edge, origins).select("concept"), "reached")
    while True:
        found = frontier.join(near, F.col("concept") == F.col("src")).select(F.col("dst").alias("concept")).distinct()
        frontier = staged(found.join(seen, "concept", "left_anti"), "reached")
        if frontier.isEmpty():
            return seen
        seen = staged(seen.union(frontier), "seen")


def unreachable_from(edge: DataFrame, origins: list[str]) -> DataFrame:
    """Edges whose subject the origins don't reach; every edge where no origin is known."""
    edge = settled(edge, "edges")
    return edge.join(component(edge, origins).select(F.col("concept").alias("subject")), "subject", "left_anti").select(*edge.columns)
