"""Checks of extracted facts against the text they come from, without a model."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.functions.scalar import candidate_terms, normalized, sentences
from knotwork.operators.search import paragraphs

#: Characters of a covering run at least, and of a name that must appear as it is at most; share of a name to be covered.
LEAST_RUN, VERBATIM, COVERED = 2, 3, (3, 4)
#: Terms that make a sentence owe a fact, and parts of a fact that must occur in it; bytes of a quote.
TERMS, PARTS, QUOTE_BYTES = 2, 2, 120


def squeezed(text: str) -> str:
    """Lower case, without white space."""
    return "".join(c.lower() for c in text if not c.isspace())


def occurs(within: str, name: str) -> bool:
    """Whether a name is in a squeezed text: as it is or, if long enough, in runs that cover
    three quarters of it, taken greedily from the left and as long as they can be."""
    wanted = squeezed(name)
    if wanted in within:
        return True
    if len(wanted) <= VERBATIM:
        return False
    at = covered = 0
    while at < len(wanted):
        end = at
        while end < len(wanted) and wanted[at : end + 1] in within:
            end += 1
        run = end - at
        covered += run if run >= LEAST_RUN else 0
        at += max(run, 1) if run >= LEAST_RUN else 1
    return covered * COVERED[1] >= len(wanted) * COVERED[0]


@F.pandas_udf(T.BooleanType())
def occurrence(text: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or n is None else occurs(squeezed(t), n) for t, n in zip(text, name, strict=True)], dtype=object)


def quote_matches(quote: Column, text: Column) -> Column:
    """Whether a paragraph holds a quote, both trimmed and normalised."""
    strip = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    return F.contains(normalized(strip(text)), normalized(strip(quote)))


def coverage_gaps(texts: DataFrame, triples: DataFrame) -> DataFrame:
    """(source, paragraph, place, quote): sentences of (source, text) with two candidate terms
    and more of which no triple (source, subject, label, object) of their source has two
    parts that occur in them.

    A source's triples come to its sentences as one list; they are what one document says.
    """
    rows = paragraphs(texts, ["source"]).select("source", "paragraph", F.posexplode(sentences(F.col("text"))).alias("place", "sentence"))
    owing = rows.filter(F.size(candidate_terms(F.col("sentence"))) >= TERMS)
    said = triples.groupBy("source").agg(F.collect_set(F.struct("subject", "label", "object")).alias("said"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for sentence, facts in zip(frame["sentence"], frame["said"], strict=True):
                within = squeezed(sentence)
                found = any(sum(occurs(within, f[p]) for p in ("subject", "label", "object") if f[p] is not None) >= PARTS for f in ([] if facts is None else facts))
                keep.append(not found)
            out = frame.loc[keep, ["source", "paragraph", "place", "sentence"]]
            yield out.assign(sentence=[s.encode()[:QUOTE_BYTES].decode("utf-8", "ignore") for s in out["sentence"]]).rename(columns={"sentence": "quote"})

    return owing.join(said, "source", "left").mapInPandas(run, "source string, paragraph int, place int, quote string")


def pruned_aliases(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """Proposed aliases (alias, canonical) of an extraction that may stay: of a known name (name),
    not blank, not the name itself, and not one alias for two names."""
    clean = aliases.filter((F.trim("alias") != "") & (F.col("alias") != F.col("canonical"))).select("alias", "canonical").distinct()
    single = clean.groupBy("alias").agg(F.count("*").alias("n")).filter("n = 1").select("alias")
    return clean.join(single, "alias", "left_semi").join(names.select(F.col("name").alias("canonical")).distinct(), "canonical", "left_semi").select("alias", "canonical")


def merged_extractions(rows: DataFrame) -> DataFrame:
    """(source, subject, label, object, weight, n) of several passes over the same source:
    blank parts are refused, equal triples become one with the mean of their weights."""
    part = lambda c: F.trim(F.col(c))
    clean = rows.select("source", part("subject").alias("subject"), part("label").alias("label"), part("object").alias("object"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    clean = clean.filter("subject <> '' AND label <> '' AND object <> ''")
    return clean.groupBy("source", "subject", "label", "object").agg(F.avg("weight").alias("weight"), F.count("*").alias("n"))
