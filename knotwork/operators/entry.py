"""From a wording to stored names: exact, contained, fuzzy, and by meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.scalar import bigrams, containment, cosine, dice, normalized
from knotwork.operators import vectors
from knotwork.plans.stage import staged

DICE_FLOOR, TWIN_FLOOR, CONFIDENT = 0.3, 0.6, 0.5
SEMANTIC_FLOOR, SEMANTIC_LIMIT = 0.35, 5


def spellings(edge: DataFrame, aliases: DataFrame | None = None, kind: str = "concept") -> DataFrame:
    """(name, spelling, norm): all wordings of every name of one kind."""
    names = edge.select(F.col("label").alias("name")) if kind == "label" else edge.select(F.col("subject").alias("name")).union(edge.select("object"))
    rows = names.distinct().select("name", F.col("name").alias("spelling"))
    if aliases is not None:
        rows = rows.union(aliases.filter(F.col("kind") == kind).select("canonical", "alias"))
    return rows.withColumn("norm", normalized(F.col("spelling"))).filter("norm <> ''")


def informative(spelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(name, spelling, gram) without stop-grams, and the stop-grams: those of more
    than max(64, a twentieth) of the spellings."""
    grams = spelled.select("name", "spelling", F.explode(bigrams(F.col("norm"))).alias("gram"))
    total = spelled.agg(F.greatest(F.lit(64), F.floor(F.count("*") / 20)).alias("most"))
    stops = grams.groupBy("gram").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).filter("n > most").select("gram")  # one row
    return grams.join(stops, "gram", "left_anti"), stops


def resolve(spelled: DataFrame, cue: str, floor: float = DICE_FLOOR) -> DataFrame:
    """(name, score, kind) of the names that a cue may mean, best first.

    A spelling equal to the cue scores 1; one that contains the cue or is contained in
    it scores the ratio of their lengths; without any equal one, others score the Dice
    of their informative pairs of characters.
    """
    needle = spelled.sparkSession.createDataFrame([(cue,)], "cue string").select(normalized(F.col("cue")).alias("needle"))
    near = spelled.crossJoin(F.broadcast(needle))  # one row
    tier = F.when(F.col("norm") == F.col("needle"), 1.0).when(F.contains("norm", "needle") | F.contains("needle", "norm"), containment(F.col("norm"), F.col("needle")))
    scored = near.withColumn("score", F.when(F.col("needle") != "", tier)).filter("score IS NOT NULL")
    direct = scored.select("name", "spelling", "score", F.when(F.col("norm") != F.col("needle"), "containment").when(normalized(F.col("name")) == F.col("needle"), "exact").otherwise("alias").alias("kind"))
    grams, stops = informative(spelled)
    asked = needle.select(F.explode(bigrams(F.col("needle"))).alias("gram")).join(stops, "gram", "left_anti")
    n_asked = asked.agg(F.count("*").alias("n_asked"))
    sizes = grams.groupBy("name", "spelling").agg(F.count("*").alias("size"))
    shared = grams.join(F.broadcast(asked), "gram").groupBy("name", "spelling").agg(F.count("*").alias("both"))
    exact = direct.agg(F.coalesce(F.max(F.col("score") == 1.0), F.lit(False)).alias("landed"))
    fuzzy = shared.join(direct.select("name", "spelling"), ["name", "spelling"], "left_anti").join(sizes, ["name", "spelling"]).crossJoin(F.broadcast(n_asked)).crossJoin(F.broadcast(exact))  # one row each
    fuzzy = fuzzy.withColumn("score", 2.0 * F.col("both") / (F.col("n_asked") + F.col("size"))).filter(~F.col("landed") & (F.col("score") >= floor))
    rows = direct.union(fuzzy.select("name", "spelling", "score", F.lit("fuzzy")))
    order = {"exact": 3, "alias": 2, "containment": 1, "fuzzy": 0}
    rank = F.create_map(*(x for k, v in order.items() for x in (F.lit(k), F.lit(v))))
    best = rows.groupBy("name").agg(F.max(F.struct("score", rank[F.col("kind")].alias("rank"), "kind")).alias("best"))
    return best.select("name", F.col("best.score").alias("score"), F.col("best.kind").alias("kind")).orderBy(F.desc("score"), "name")


_ORDER = {"exact": 3, "alias": 2, "containment": 1, "fuzzy": 0}


def resolve_all(spelled: DataFrame, cues: DataFrame, floor: float = DICE_FLOOR) -> DataFrame:
    """(cue, name, score, kind): ``resolve`` of every one of ``cues`` (cue) at once.

    A spelling that holds a cue is found by the cue's rarest pair of characters, one that
    a cue holds by the spelling's first; so each pair of them is looked at by what they
    share, not with all others.
    """
    spelled = staged(spelled.select("name", "spelling", "norm").distinct(), "spellings")
    needles = staged(cues.select("cue").distinct().withColumn("needle", normalized(F.col("cue"))).filter("needle <> ''"), "needles")
    grams = spelled.select("name", "spelling", "norm", F.explode(bigrams(F.col("norm"))).alias("gram"))
    asked = needles.select("cue", "needle", F.explode(bigrams(F.col("needle"))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    letters = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.col(c), F.lit("(?s)(.)"), 1)))
    row = ("cue", "needle", "name", "spelling", "norm")

    rarest = asked.join(counts, "gram", "left").groupBy("cue", "needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r")).select("cue", "needle", F.col("r.gram").alias("gram"))
    holds = rarest.join(grams, "gram").filter(F.contains("norm", "needle")).select(*row)
    held = asked.join(spelled.filter(F.char_length("norm") > 1).withColumn("gram", F.substring("norm", 1, 2)), "gram").filter(F.contains("needle", "norm")).select(*row)
    one = needles.filter(F.char_length("needle") == 1).join(spelled.withColumn("letter", letters("norm")), F.col("needle") == F.col("letter")).select(*row)
    other = needles.withColumn("letter", letters("needle")).join(spelled.filter(F.char_length("norm") == 1), F.col("letter") == F.col("norm")).select(*row)
    near = staged(holds.union(held).union(one).union(other).distinct(), "direct")
    score = F.when(F.col("norm") == F.col("needle"), 1.0).otherwise(containment(F.col("norm"), F.col("needle")))
    kind = F.when(F.col("norm") != F.col("needle"), "containment").when(normalized(F.col("name")) == F.col("needle"), "exact").otherwise("alias")
    direct = near.select("cue", "name", "spelling", score.alias("score"), kind.alias("kind"))

    known, stops = informative(spelled)
    open_cues = needles.join(near.filter("norm = needle").select("cue").distinct(), "cue", "left_anti")
    wanted = asked.join(open_cues.select("cue"), "cue", "left_semi").join(stops, "gram", "left_anti").select("cue", "gram")
    n_wanted = wanted.groupBy("cue").agg(F.count("*").alias("n_asked"))
    sizes = known.groupBy("name", "spelling").agg(F.count("*").alias("size"))
    shared = wanted.join(known, "gram").groupBy("cue", "name", "spelling").agg(F.count("*").alias("both"))
    fuzzy = shared.join(near.select("cue", "name", "spelling"), ["cue", "name", "spelling"], "left_anti").join(sizes, ["name", "spelling"]).join(n_wanted, "cue")
    fuzzy = fuzzy.withColumn("score", 2.0 * F.col("both") / (F.col("n_asked") + F.col("size"))).filter(F.col("score") >= floor)
    rows = direct.union(fuzzy.select("cue", "name", "spelling", "score", F.lit("fuzzy")))
    rank = F.create_map(*(x for k, v in _ORDER.items() for x in (F.lit(k), F.lit(v))))
    best = rows.groupBy("cue", "name").agg(F.max(F.struct("score", rank[F.col("kind")].alias("rank"), "kind")).alias("best"))
    return best.select("cue", "name", F.col("best.score").alias("score"), F.col("best.kind").alias("kind"))


def unrelated(pairs: DataFrame, edge: DataFrame, kind: str = "concept") -> DataFrame:
    """Twins (a, b, ..) without those that resemble each other because they are related: concepts
    that a live edge joins, labels that some subject has both of."""
    live = edge.filter("count > 0")
    if kind == "concept":
        ends = live.select(F.col("subject").alias("a"), F.col("object").alias("b"))
        ends = ends.union(ends.select("b", "a")).distinct()
    else:
        held = live.select("subject", "label").distinct()
        ends = held.select("subject", F.col("label").alias("a")).join(held.select("subject", F.col("label").alias("b")), "subject").select("a", "b").distinct()
    return pairs.join(ends, ["a", "b"], "left_anti")


def audited_names(lexical: DataFrame, semantic: DataFrame | None, types: DataFrame | None = None) -> DataFrame:
    """(a, b, score, tier): twins of both tiers, a pair once and by its spelling if it can be;
    without names (name) of types where a schema has them."""
    rows = lexical.select("a", "b", "score", F.lit("lexical").alias("tier"))
    if semantic is not None:
        rows = rows.union(semantic.join(lexical.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "score", F.lit("semantic")))
    for side in ("a", "b") if types is not None else ():
        rows = rows.join(types.select(F.col("name").alias(side)), side, "left_anti")
    return rows.select("a", "b", "score", "tier")


def twins(spelled: DataFrame, floor: float = TWIN_FLOOR) -> DataFrame:
    """(a, b, score): names whose spellings share informative pairs of characters, by Dice.

    Two spellings of that likeness share one of their rarest pairs of characters: of as many
    as can be without coming below the floor.  So only those are joined, and only between
    spellings of sizes that permit it; both sets are then compared as a whole.
    """
    grams = staged(informative(spelled)[0], "grams")
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    sets = staged(grams.join(often, "gram").groupBy("name", "spelling").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams")).withColumn("size", F.size("grams")), "sets")
    least = floor / (2 - floor)  # of a set's pairs that a partner must share
    first = F.slice("grams", 1, F.greatest(F.col("size") - F.ceil(F.col("size") * least - 1e-9).cast("int") + 1, F.lit(1)))
    probes = sets.select("name", "spelling", "size", F.explode(first).alias("g")).select("name", "spelling", "size", F.col("g.gram").alias("gram"))
    x, y = probes.alias("x"), probes.alias("y")
    sizes = F.expr(f"2 * least(x.size, y.size) >= {floor!r} * (x.size + y.size)")
    near = x.join(y, F.expr("x.gram = y.gram AND x.name < y.name") & sizes).select(F.col("x.name").alias("a"), F.col("x.spelling").alias("sa"), F.col("y.name").alias("b"), F.col("y.spelling").alias("sb")).distinct()
    for side in "ab":
        near = near.join(sets.select(F.col("name").alias(side), F.col("spelling").alias(f"s{side}"), F.transform("grams", lambda g: g["gram"]).alias(f"g{side}")), [side, f"s{side}"])
    scored = near.groupBy("a", "b").agg(F.max(dice(F.col("ga"), F.col("gb"))).alias("score"))
    return scored.filter(F.col("score") >= floor)


def semantic_resolve(vectors: DataFrame, query: DataFrame, floor: float = SEMANTIC_FLOOR, limit: int = SEMANTIC_LIMIT) -> DataFrame:
    """(name, score): names (name, vector) closest to the one query vector, if close enough."""
    near = vectors.crossJoin(F.broadcast(query.select(F.col("vector").alias("asked")).limit(1)))  # one row
    scored = near.select("name", cosine(F.col("vector"), F.col("asked")).alias("score"))
    return scored.filter(F.col("score") >= floor).orderBy(F.desc("score"), "name").limit(limit)


def merged_tiers(lexical: DataFrame, semantic: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """Lexical rows (name, score), then semantic ones of other names where the best
    lexical score is below ``confident``."""
    best = lexical.agg(F.coalesce(F.max("score"), F.lit(0.0)).alias("best"))
    extra = semantic.join(lexical.select("name"), "name", "left_anti").crossJoin(F.broadcast(best)).filter(F.col("best") < confident)  # one row
    return lexical.select("name", "score", F.lit("lexical").alias("tier")).union(extra.select("name", "score", F.lit("semantic")))


def semantic_twins(named: DataFrame, floor: float, limit: int = 100) -> DataFrame:
    """(a, b, score): the closest pairs of all names (name, vector), by their cosine in six decimals."""
    return vectors.closest_pairs(named, floor, limit)


def calibrated_floor(probes: DataFrame) -> DataFrame:
    """(upper, lower, floor) of probes (probe, name, expected, score): the middle between
    the least score of an expected name and the best of any other; null where they overlap."""
    per = probes.groupBy("probe").agg(F.max(F.when(F.col("expected"), F.col("score"))).alias("hit"), F.max(F.when(~F.col("expected"), F.col("score"))).alias("miss"))
    bands = per.agg(F.min("hit").alias("upper"), F.max("miss").alias("lower"))
    middle = (F.col("upper") + F.col("lower")) / 2
    rounded = F.round(middle, 2)
    inside = (rounded > F.col("lower")) & (rounded < F.col("upper"))
    return bands.select("upper", "lower", F.when(F.col("upper") > F.col("lower"), F.when(inside, rounded).otherwise(middle)).alias("floor"))


def explained(spelled: DataFrame, cue: str, name: str, limit: int, floor: float = DICE_FLOOR, semantic: DataFrame | None = None, skipped: str | None = None) -> DataFrame:
    """(name, verdict, score, rank): why a name is or isn't among the first ``limit``; rank is
    the limit that would reach it.  Where its spelling has nothing of the cue, its cosine of
    ``semantic`` (name, score) tells how far below the floor it is, or ``skipped`` why that
    tier didn't run."""
    scored = resolve(spelled, cue, 0.0).withColumn("served", (F.col("score") >= floor) | (F.col("kind") != "fuzzy"))
    ranked = scored.withColumn("rank", F.rank().over(Window.partitionBy("served").orderBy(F.desc("score"), "name")))
    asked = spelled.sparkSession.createDataFrame([(name,)], "name string").join(spelled.select("name").distinct().withColumn("known", F.lit(True)), "name", "left").join(ranked, "name", "left")
    near = asked.withColumn("cosine", F.lit(None).cast("double")) if semantic is None else asked.join(semantic.select("name", F.col("score").alias("cosine")), "name", "left")
    without = F.when(F.col("cosine").isNotNull(), F.when(F.col("cosine") >= SEMANTIC_FLOOR, "served_by_meaning").otherwise("below_floor")).otherwise("no_overlap" if skipped is None else f"tier_skipped: {skipped}")
    verdict = F.when(F.col("known").isNull(), "not_in_vocabulary").when(F.col("score").isNull(), without).when(~F.col("served"), "below_floor").when(F.col("rank") > limit, "outranked").otherwise("served")
    return near.select("name", verdict.alias("verdict"), F.coalesce("score", "cosine").alias("score"), F.when(F.col("served"), F.col("rank")).alias("rank"))
