"""Groups of contexts: named bundles that may hold other groups, three deep at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST, MOST_MEMBERS = 3, 1000


def closure(groups: DataFrame, name: str) -> DataFrame:
    """(context): all contexts of a group and of the groups in it.  ``groups`` has
    (name, contexts, groups); the depth is bounded, so this is as many joins."""
    if groups.filter(F.col("name") == name).isEmpty():
        raise LookupError(f"no group {name}")
    level = groups.filter(F.col("name") == name)
    found = level.select(F.explode("contexts").alias("context"))
    for _ in range(DEEPEST - 1):
        level = level.select(F.explode("groups").alias("name")).distinct().join(groups, "name")
        found = found.union(level.select(F.explode("contexts").alias("context")))
    return found.distinct()


def targets(contexts: list[str], groups: DataFrame, names: list[str]) -> list[str]:
    """Contexts in the order asked for, then those of the groups by name, each once; a group of more than 1000 is refused."""
    out = list(dict.fromkeys(contexts))
    for name in names:
        found = [r[0] for r in closure(groups, name).orderBy("context").limit(MOST_MEMBERS + 1).collect()]
        if len(found) > MOST_MEMBERS:
            raise ValueError(f"{name} holds more than {MOST_MEMBERS} contexts")
        out += [c for c in found if c not in out]
    return out


def validate(groups: dict[str, dict[str, list[str]]]) -> list[tuple[str, str]]:
    """The edges (group, child) to drop, in order of name, so that no group is in itself or too deep."""
    kept: dict[str, list[str]] = {}
    dropped = []

    def depth(name: str, above: tuple[str, ...] = ()) -> float:
        if name in above:
            return float("inf")
        return 1 + max((depth(c, (*above, name)) for c in kept.get(name, ())), default=0)

    for name in sorted(groups):
        for child in sorted(groups[name].get("groups", ())):
            kept.setdefault(name, []).append(child)
            if child not in groups or max(depth(g) for g in kept) > DEEPEST:
                kept[name].remove(child)
                dropped.append((name, child))
    return dropped


def changed_members(members: list[str], add: list[str], remove: list[str], existing: set[str]) -> list[str]:
    """Members after a change, removals first; what is added must exist."""
    if unknown := [a for a in add if a not in existing]:
        raise LookupError(f"no context {unknown[0]}")
    out = [m for m in members if m not in set(remove)]
    out += [a for a in dict.fromkeys(add) if a not in out]
    if len(out) > MOST_MEMBERS:
        raise ValueError(f"a group has at most {MOST_MEMBERS} members")
    return out


def swept(groups: DataFrame, context: str) -> DataFrame:
    """Groups without a context that was deleted."""
    return groups.withColumn("contexts", F.array_remove("contexts", context))
