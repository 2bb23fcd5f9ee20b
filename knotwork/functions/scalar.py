"""Scalar functions as Catalyst expressions, and the few that Catalyst can't express."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Widest finite double: sums saturate there.
WIDEST = 1.7976931348623157e308
K1, B = 1.2, 0.75
RRF = 60


def saturated(total: Column) -> Column:
    return F.greatest(F.least(total, F.lit(WIDEST)), F.lit(-WIDEST))


def average(total: Column, count: Column) -> Column:
    """Weight of an association: 0 of a dead one."""
    return F.when(count == 0, 0.0).otherwise(total / count)


def bigrams(text: Column) -> Column:
    """The distinct pairs of neighbouring characters; one pass over the text."""
    chars = F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)
    pairs = lambda c: F.zip_with(F.slice(c, 1, F.size(c) - 1), F.slice(c, 2, F.size(c) - 1), lambda x, y: F.concat(x, y))
    return F.when(F.char_length(text) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs(chars)))


def evidence_bigrams(text: Column) -> Column:
    """As ``bigrams``, but a text of one character pairs it with itself."""
    return F.when(F.char_length(text) == 1, F.array(F.concat(text, text))).otherwise(bigrams(text))


def pair_codes(pairs: Column) -> Column:
    """Pairs of characters as numbers, which compare faster: two code points of 21 bits."""
    return F.transform(pairs, lambda p: F.ascii(F.left(p, F.lit(1))).cast("long") * 2097152 + F.ascii(F.right(p, F.lit(1))))


def dice(a: Column, b: Column) -> Column:
    """Of two sets; of two empty ones 1."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def multiset_dice(a: Column, b: Column) -> Column:
    """Dice of the pairs of neighbouring characters of two lower-cased texts, each pair as
    often as it is there; texts too short for a pair are equal or not."""
    pairs = lambda t: F.when(F.char_length(t) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(t) - 1), lambda i: F.substr(t, i, F.lit(2))))
    x, y = F.lower(a), F.lower(b)
    px, py = pairs(x), pairs(y)
    times = lambda p, of: F.size(F.filter(of, lambda q: q == p))
    shared = F.aggregate(F.array_intersect(px, py), F.lit(0), lambda n, p: n + F.least(times(p, px), times(p, py)))
    return F.when((F.size(px) == 0) | (F.size(py) == 0), F.when(x == y, 1.0).otherwise(0.0)).otherwise(2.0 * shared / (F.size(px) + F.size(py)))


def containment(a: Column, b: Column) -> Column:
    """Shorter by longer length in characters."""
    return F.least(F.char_length(a), F.char_length(b)) / F.greatest(F.char_length(a), F.char_length(b))


def idf(documents: Column, carriers: Column) -> Column:
    return F.log(1 + (documents - carriers + 0.5) / (carriers + 0.5))


def bm25(weight: Column, tf: Column, length: Column, mean: Column) -> Column:
    return weight * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where the widths differ or a side has no length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def reciprocal_rank(rank: Column) -> Column:
    return F.when(rank.isNull(), 0.0).otherwise(1.0 / (RRF + rank))


def effective_time(stored_at: Column, date: Column) -> Column:
    return F.coalesce(date, stored_at)


def tokens_estimate(text: Column) -> Column:
    """An ASCII character counts a quarter, any other one; rounded up."""
    ascii_ = F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.ceil((ascii_ + 4 * (F.char_length(text) - ascii_)) / 4)


def json_bytes(value: Column) -> Column:
    """Bytes of a struct as compact JSON; fields that are null are left out."""
    return F.octet_length(F.to_json(value))


def json_array_bytes(item_bytes: Column, items: Column) -> Column:
    """Bytes of an array of so many items with so many bytes of their own."""
    return item_bytes + 2 + F.greatest(items - 1, F.lit(0))


def clamped(value: Column, fallback: float) -> Column:
    """Into [0, 1]; NaN and null become the fallback."""
    return F.when(value.isNull() | F.isnan(value), fallback).otherwise(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)))


def sentences(text: Column) -> Column:
    """Cut at full stops of either script, exclamation and question marks and line ends."""
    return F.filter(F.transform(F.split(text, "[。!?！？\n]"), lambda s: F.trim(s)), lambda s: s != "")


def candidate_terms(text: Column, most: int = 100) -> Column:
    """The first distinct runs of letters that may name something."""
    runs = F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9\-._/+#一-龯々ァ-ヶー]+)"), 1)
    trimmed = F.transform(runs, lambda r: F.regexp_replace(r, r"^[\-._/+#]+|[\-._/+#]+$", ""))
    kept = F.filter(trimmed, lambda r: (F.char_length(r) >= 2) & ~r.rlike("^[0-9]+$") & (F.octet_length(r) <= 64))
    return F.slice(F.array_distinct(kept), 1, most)


def _normalized(text: str) -> str:
    lower = lambda s: "".join(c.lower() for c in s)  # noqa: E731  by character: no rule looks at its neighbours
    folded = lower(unicodedata.normalize("NFKC", lower(text)))
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in folded)


#: Texts of these characters alone are their own compatibility form, and no rule of case looks beyond one of them.
PLAIN = r"^[\x00-\x7FÀ-ÖØ-öø-ÿ]*\z"


def plain(text: Column) -> Column:
    return text.rlike(PLAIN)


@F.pandas_udf(T.StringType())
def normalized_any(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else _normalized(t))


def normalized(text: Column) -> Column:
    """Lower case, compatibility form, katakana as hiragana.  Plain text is done in the JVM;
    Python gets a null in its place and sees only the others."""
    return F.when(plain(text), F.lower(text)).otherwise(normalized_any(F.when(~plain(text), text)))


#: Offset and prime of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes, state: int = FNV_OFFSET) -> int:
    for byte in data:
        state = (state ^ byte) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return state


def folded(fields: list[str]) -> int:
    """A hash of several fields, each with its end, so that no two lists of fields run together."""
    state = FNV_OFFSET
    for field in fields:
        state = fnv1a(b"\0", fnv1a(field.encode(), state))
    return state


@F.pandas_udf(T.StringType())
def fnv1a_hex(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else f"{fnv1a(t.encode()):016x}")


_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_RUN = re.compile(r"[A-Za-z0-9]+")


def terms_of(text: str) -> list[str]:
    """Words of ASCII letters and digits, pairs of neighbouring other letters (one alone
    stands for itself), then the parts of words in camel case."""
    out: list[str] = []
    word, run = [], []

    def flush() -> None:
        if word:
            out.append("".join(word))
            word.clear()
        if len(run) == 1:
            out.append(run[0])
        out.extend(a + b for a, b in zip(run, run[1:], strict=False))
        run.clear()

    for c in _normalized(text):
        if c.isascii() and c.isalnum():
            if run:
                flush()
            word.append(c)
        elif c.isalnum():
            if word:
                flush()
            run.append(c)
        else:
            flush()
    flush()
    for m in _RUN.finditer(unicodedata.normalize("NFKC", text)):
        parts = _CAMEL.split(m[0])
        if len(parts) > 1:
            out += [p.lower() for p in parts]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def terms_any(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield text.map(lambda t: None if t is None else terms_of(t))


def plain_terms(text: Column) -> Column:
    """The terms of plain text, as many of each as ``terms_of`` gives, in another order."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("([a-z0-9]+)"), 1)
    runs = F.regexp_extract_all(low, F.lit("([ß-öø-ÿ]+)"), 1)
    pairs = F.transform(runs, lambda r: F.when(F.char_length(r) == 1, F.array(r)).otherwise(F.transform(F.sequence(F.lit(1), F.char_length(r) - 1), lambda i: F.substr(r, i, F.lit(2)))))
    camel = F.filter(F.regexp_extract_all(text, F.lit("([A-Za-z0-9]+)"), 1), lambda r: r.rlike("[a-z0-9][A-Z]|[A-Z][A-Z][a-z]"))
    parts = F.transform(camel, lambda r: F.split(r, "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"))
    return F.concat(words, F.flatten(pairs), F.transform(F.flatten(parts), F.lower))


def terms(text: Column) -> Column:
    """The terms of a text as a bag: plain texts in the JVM, others in Python; none of a null."""
    return F.coalesce(F.when(plain(text), plain_terms(text)).otherwise(terms_any(F.when(~plain(text), text))), F.array().cast("array<string>"))


#: Words and parts of words that turn a question around.
NEGATION_WORDS = ("no", "not", "never", "none", "neither", "nor", "without", "cannot", "non")
NEGATION_PARTS = ("n't", "ない", "ません", "なかった", "せず", "不", "無")


def guard_marks(text: str) -> tuple:
    """What two questions must have in common to be answered alike: negations, numbers, names."""
    folded = unicodedata.normalize("NFKC", text).replace("’", "'")
    split = lambda s: [t for t in "".join(c if c.isalnum() else " " for c in s).split() if t]
    low = folded.lower()
    words = split(low)
    negations = [words.count(w) for w in NEGATION_WORDS] + [low.count(p) for p in NEGATION_PARTS]
    numbers = sorted("".join(c if c.isnumeric() else " " for c in folded).split())
    names = [t.lower() for i, t in enumerate(split(folded)) if any(map(str.isupper, t)) and (i or len(t) > 1 and all(map(str.isupper, t)))]
    return negations, numbers, sorted(names)


@F.pandas_udf(T.BooleanType())
def questions_agree(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([guard_marks(x) == guard_marks(y) for x, y in zip(a, b, strict=True)])
