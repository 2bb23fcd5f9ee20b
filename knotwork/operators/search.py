"""Paragraphs and their search: BM25, vectors, and both fused."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.functions.scalar import bm25, fnv1a, idf, questions_agree, reciprocal_rank, terms, terms_of

LIMIT = 5
PLACE = ["source", "paragraph"]


def paragraphs(passages: DataFrame, keep: list[str] = ("context", "source")) -> DataFrame:
    """(keep.., paragraph, text): the runs of lines that aren't blank."""
    lines = F.concat(F.lit("\n"), "text", F.lit("\n"))
    parts = F.transform(F.split(lines, r"(?U)\n(?:[^\S\n]*\n)+"), lambda p: F.regexp_replace(p, r"^\n+|\r?\n*\z", ""))
    kept = F.filter(parts, lambda p: p.rlike(r"(?U)\S"))
    return passages.select(*keep, F.posexplode(kept).alias("paragraph", "text"))


def governed(marks: DataFrame) -> DataFrame:
    """(source, paragraph, section): a section's mark holds until the next one of its source."""
    order = Window.partitionBy("source").orderBy("paragraph").rowsBetween(Window.unboundedPreceding, 0)
    return marks.select(*PLACE, F.last("section", ignorenulls=True).over(order).alias("section"))


def tokenized(rows: DataFrame, questions: str | None = None) -> DataFrame:
    """(source, paragraph, terms); terms of questions that a paragraph answers count as its own."""
    found = terms(F.col("text"))
    if questions is not None:
        found = F.concat(found, terms(F.array_join(F.coalesce(questions, F.array().cast("array<string>")), "\n")))
    return rows.select(*PLACE, found.alias("terms"))


@dataclass(frozen=True)
class Index:
    """Postings (term, source, paragraph, tf, length), carriers (term, carriers) and one row
    of corpus (documents, mean): all that a search by terms reads."""

    postings: DataFrame
    carriers: DataFrame
    corpus: DataFrame


TABLES = ["postings", "lengths", "carriers", "corpus"]


def postings(tokens: DataFrame) -> DataFrame:
    """(term, source, paragraph, tf, length); a paragraph's terms are counted before their shuffle."""
    return tokens.select(*PLACE, F.size("terms").alias("length"), F.explode("terms").alias("term")).groupBy("term", *PLACE, "length").agg(F.count("*").alias("tf")).select("term", *PLACE, "tf", "length")


def lengths(tokens: DataFrame) -> DataFrame:
    return tokens.select(*PLACE, F.size("terms").alias("length"))


def corpus(length: DataFrame) -> DataFrame:
    """(documents, mean): one row; a mean below 1 counts as 1."""
    return length.agg(F.count("*").alias("documents"), F.greatest(F.coalesce(F.avg("length"), F.lit(1.0)), F.lit(1.0)).alias("mean"))


def carriers(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("carriers"))


def indexed(tokens: DataFrame) -> Index:
    posted = postings(tokens)
    return Index(posted, carriers(posted), corpus(lengths(tokens)))


def stored(posted: DataFrame, length: DataFrame) -> dict[str, DataFrame]:
    """The tables of an index as they are best stored: postings in ranges of terms, a term of
    many carriers in several, so that a search reads the ranges of its terms."""
    return {"postings": posted.repartitionByRange("term", "source").sortWithinPartitions("term"), "lengths": length, "carriers": carriers(posted), "corpus": corpus(length)}


def refreshed(posted: DataFrame, length: DataFrame, before: DataFrame, now: DataFrame, tokenize) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths brought up to date: ``before`` (source, digest) is what they were
    made of, ``now`` (source, digest, text) what there is.  Only sources that are new or
    changed are tokenized (``tokenize`` of (source, text)); the others' rows stay, those
    of sources that are gone leave."""
    same = now.select("source", "digest").join(before.select("source", "digest"), ["source", "digest"], "left_semi").select("source").distinct()
    tokens = tokenize(now.join(same, "source", "left_anti"))
    return posted.join(same, "source", "left_semi").select("term", *PLACE, "tf", "length").union(postings(tokens)), length.join(same, "source", "left_semi").select(*PLACE, "length").union(lengths(tokens))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query, term): distinct terms of queries (query, text)."""
    return queries.select("query", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def explained(index: Index, asked: DataFrame) -> DataFrame:
    """(query, term, source, paragraph, tf, carriers, idf, contribution) where a term occurs.

    Only the asked terms' postings are read; carriers and the mean are those of all
    paragraphs, whatever is filtered later.
    """
    wanted = asked.join(index.carriers, "term").crossJoin(F.broadcast(index.corpus))  # one row
    wanted = wanted.withColumn("idf", idf(F.col("documents"), F.col("carriers")))
    hits = wanted.join(index.postings, "term")
    return hits.select("query", "term", *PLACE, "tf", "carriers", "idf", bm25(F.col("idf"), F.col("tf"), F.col("length"), F.col("mean")).alias("contribution"))


def explained_places(index: Index, asked: DataFrame, places: DataFrame) -> DataFrame:
    """As ``explained`` for places (query, source, paragraph), with a row of tf 0 for each asked term that a place lacks."""
    weights = asked.join(index.carriers, "term", "left").crossJoin(F.broadcast(index.corpus))  # one row
    weights = weights.select("query", "term", F.coalesce("carriers", F.lit(0)).alias("carriers"), "documents", "mean")
    rows = places.select("query", *PLACE).distinct().join(weights, "query").join(index.postings, ["term", *PLACE], "left")
    weight = idf(F.col("documents"), F.col("carriers"))
    return rows.select("query", "term", *PLACE, F.coalesce("tf", F.lit(0)).alias("tf"), "carriers", weight.alias("idf"), F.coalesce(bm25(weight, F.col("tf"), F.col("length"), F.col("mean")), F.lit(0.0)).alias("contribution"))


def scores(index: Index, asked: DataFrame, eligible: DataFrame | None = None) -> DataFrame:
    """(query, source, paragraph, score), of eligible sources only if given."""
    rows = explained(index, asked)
    if eligible is not None:
        rows = rows.join(eligible.select("source").distinct(), "source", "left_semi")
    return rows.groupBy("query", *PLACE).agg(F.round(F.sum("contribution"), 6).alias("score"))


def ranked(scored: DataFrame, limit: int, by: list[str] = ("query",)) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), *PLACE))
    return scored.withColumn("rank", place).filter(F.col("rank") <= limit)


def plan(limit: int, query: str, provider: bool, stored: tuple[str, int] | None, current: tuple[str, int] | None, failure: str | None = None) -> list[tuple[str, bool, str | None]]:
    """(lane, ran, reason): which lanes a search runs, and why one doesn't.  ``stored`` and
    ``current`` are name and width of the model of the vectors there are and of the query's."""
    if limit == 0:
        return [("bm25", False, "zero_limit"), ("vector", False, "zero_limit")]
    if not terms_of(query):
        return [("bm25", False, "no_query_terms"), ("vector", False, "no_query_terms")]
    if failure is not None:
        reason = f"query_embedding_failed: {failure}"
    elif not provider or current is None:
        reason = "off"
    elif stored is None:
        reason = "no_vectors"
    elif stored[0] != current[0]:
        reason = "model_changed"
    else:
        reason = None if stored[1] == current[1] else "width_changed"
    return [("bm25", True, None), ("vector", reason is None, reason)]


def lanes_run(spark: SparkSession, planned: list[tuple[str, bool, str | None]]) -> DataFrame:
    return spark.createDataFrame(planned, "lane string, ran boolean, reason string")


def live_only(hits: DataFrame, live: DataFrame) -> DataFrame:
    """Hits (.., source, paragraph, hash) of an index whose paragraph hasn't changed since it was made."""
    return hits.join(live.select(*PLACE, "hash"), [*PLACE, "hash"], "left_semi")


def from_cache(near: DataFrame, asked: DataFrame, cached: DataFrame, floor: float) -> DataFrame:
    """(query, entry, score): the cached question (entry, text) that stands for an asked one
    (query, text): close enough by ``near`` (query, source, score), and alike in what it
    denies, counts and names."""
    close = near.filter(F.col("score") >= floor).select("query", F.col("source").alias("entry"), "score")
    both = close.join(asked.select("query", F.col("text").alias("asked")), "query").join(cached.select("entry", F.col("text").alias("stored")), "entry")
    return both.filter(questions_agree(F.col("asked"), F.col("stored"))).groupBy("query").agg(F.max_by(F.struct("entry", "score"), F.struct("score", "entry")).alias("best")).select("query", "best.entry", "best.score")


def cited(paragraphs_: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source, paragraph, text, section, locator, verdict) of wanted places: the paragraph with the
    section that governs it and its own locator, or why there is none."""
    known = paragraphs_.select("source").distinct().withColumn("stored", F.lit(True))
    sections = governed(paragraphs_.select(*PLACE, "section")).withColumnRenamed("section", "governing")
    rows = wanted.select(*PLACE).distinct().join(known, "source", "left").join(paragraphs_.select(*PLACE, "text", "locator"), PLACE, "left").join(sections, PLACE, "left")
    verdict = F.when(F.col("stored").isNull(), "unknown_source").when(F.col("text").isNull(), "index_out_of_range").otherwise("ok")
    return rows.select(*PLACE, "text", F.col("governing").alias("section"), "locator", verdict.alias("verdict"))


def pool(limit: int) -> int:
    return max(4 * limit, 50)


def fused(lexical: DataFrame, semantic: DataFrame | None, limit: int = LIMIT, floor: float = 0.0, live: DataFrame | None = None) -> DataFrame:
    """(query, source, paragraph, score, rank): both lanes by reciprocal rank; the lexical
    score itself where no vector lane ran.  The floor cuts a lane's pool after it is filled.
    With ``live`` (source, paragraph, hash) only vectors made of a paragraph as it is now count."""
    if semantic is not None and live is not None:
        semantic = live_only(semantic, live)
    if semantic is None:
        return ranked(lexical, limit)
    words = ranked(lexical, pool(limit)).select("query", *PLACE, F.col("rank").alias("word_rank"))
    sense = ranked(semantic, pool(limit)).filter(F.col("score") >= floor).select("query", *PLACE, F.col("rank").alias("sense_rank"))
    both = words.join(sense, ["query", *PLACE], "full_outer")
    score = F.round(reciprocal_rank(F.col("word_rank")) + reciprocal_rank(F.col("sense_rank")), 9)
    return ranked(both.select("query", *PLACE, score.alias("score")), limit)


def interleaved(scored: DataFrame, contexts: list[str], limit: int) -> DataFrame:
    """Rows (context, query, ..) of several contexts by rank within each, then by the order of
    the contexts asked for: scores of different contexts don't compare."""
    order = F.create_map(*(x for i, c in enumerate(contexts) for x in (F.lit(c), F.lit(i))))
    rows = ranked(scored.filter(F.col("context").isin(contexts)), limit, ["query", "context"]).withColumn("target", order[F.col("context")])
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank", "target"))
    return rows.withColumn("place", place).filter(F.col("place") <= limit).select("query", "place", "context", *PLACE, "score")


def stale_vectors(vectors: DataFrame, live: DataFrame) -> DataFrame:
    """Vectors (source, paragraph, hash) whose paragraph has changed or gone: those to embed anew."""
    return vectors.join(live.select(*PLACE, "hash"), [*PLACE, "hash"], "left_anti")


#: Paragraphs that are embedded together, and in one refresh at most.
EMBED_CHUNK, EMBED_MOST = 128, 20_000


def refreshed_vectors(stored_: DataFrame, live: DataFrame, embed: Callable[[list[str]], list[list[float]]], most: int = EMBED_MOST) -> DataFrame:
    """(source, paragraph, hash, vector) of all live paragraphs (source, paragraph, hash, text):
    those whose hash is the stored one keep their vector, the others are embedded anew."""
    kept = stored_.select(*PLACE, "hash", "vector").join(live.select(*PLACE, "hash"), [*PLACE, "hash"], "left_semi")
    due = live.join(stored_.select(*PLACE, "hash"), [*PLACE, "hash"], "left_anti").select(*PLACE, "hash", "text")
    if due.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} paragraphs to embed in one refresh")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for begin in range(0, len(frame), EMBED_CHUNK):
                part = frame.iloc[begin : begin + EMBED_CHUNK]
                yield part[[*PLACE, "hash"]].assign(vector=[list(map(float, v)) for v in embed(part["text"].tolist())])

    hash_kind, kind = due.schema["hash"].dataType.simpleString(), due.schema["paragraph"].dataType.simpleString()
    return kept.withColumn("vector", F.col("vector").cast("array<double>")).union(due.mapInPandas(run, f"source string, paragraph {kind}, hash {hash_kind}, vector array<double>"))


def hashed_embedding(texts: list[str], width: int = 64) -> list[list[float]]:
    """Counts of hashed terms: a stand-in for a model, the same everywhere."""
    out = []
    for text in texts:
        vector = [0.0] * width
        for term in terms_of(text):
            h = fnv1a(term.encode())
            vector[h % width] += 1.0 if h >> 63 else -1.0
        out.append(vector)
    return out


def verdicts(scored: DataFrame, known: DataFrame, asked: DataFrame, limit: int, eligible: DataFrame | None = None) -> DataFrame:
    """(query, source, paragraph, verdict, rank) of asked places: why each is or isn't served."""
    places = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), *PLACE))
    out = asked.join(known.select("source", F.lit(True).alias("stored")).distinct(), "source", "left").join(known.select(*PLACE, F.lit(True).alias("there")), PLACE, "left")
    out = out.join(scored.withColumn("rank", places).select("query", *PLACE, "rank"), ["query", *PLACE], "left")
    allowed = F.lit(True)
    if eligible is not None:
        out, allowed = out.join(eligible.select("source", F.lit(True).alias("allowed")).distinct(), "source", "left"), F.col("allowed").isNotNull()
    verdict = F.when(F.col("stored").isNull(), "not_stored").when(F.col("there").isNull(), "paragraph_out_of_range").when(~allowed, "filtered_out").when(F.col("rank").isNull(), "no_term_overlap").when(F.col("rank") > limit, "outranked").otherwise("served")
    return out.select("query", *PLACE, verdict.alias("verdict"), "rank")
