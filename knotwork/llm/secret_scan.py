"""Secret scans: three patterns, and the guess cost of values in credential contexts.

The patterns give the kinds ``assign``, ``access`` and ``hex``: leftmost matches
that don't overlap within a kind, those too short dropped.  The method adds the
kind ``guess``: of every value that stands in a credential context (a name such
as password, pwd, auth or client_secret, then ``:``, ``=`` or ``=>``) the least
decimal logarithm of the guesses that an attacker needs is found by dynamic
programming over segmentations into words, dates, repeats, keyboard walks and
brute-force characters; values of at least ``STRONG`` are added.  Words are a ranked
list: those that attackers try first, then the words of a tokenizer's rank file in its
order, if one is given (a word costs the logarithm of its rank, so ordinary words and
placeholders such as ``changeme2020`` add nothing).  Walks go over neighbouring keys of
a keyboard in any direction.  A quoted value goes
up to its closing quote on the line, whatever it holds; any other one ends at the first
character that isn't visible ASCII.  The name may follow a lower-case letter or digit if
it begins with a capital, as in ``dbPassword``.

Spans count code points, end exclusive, in whole texts.  Defined results: a null
text counts as empty and has no spans; equal texts get equal results; a table
without rows gives none; columns other than those named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from math import comb, log10

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.llm.common import sliced

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # as AKIA[A-Z0-9]+ of 20 characters and more: a shorter run holds no longer one
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as [0-9a-f]+ of 24 and more
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Groups 1 and 2 are values up to their closing quote on the line, 3 others; a name may follow a mark, or begin inside a word in camel case.
CONTEXT = re.compile(
    r"""(?:(?<![A-Za-z0-9])|(?-i:(?<=[a-z0-9])(?=[A-Z])))(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|credentials?|auth|bearer)["']?[\x20\t]*+(?:=>|:=|[:=])[\x20\t]*+"""
    r"""(?:"((?:[^"\\\r\n]|\\[^\r\n])*+)"|'((?:[^'\\\r\n]|\\[^\r\n])*+)'|["']?([!-~]+))""",
    re.ASCII | re.IGNORECASE,
)
CONTEXT_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer")
#: Logarithm of guesses from which a value counts as a secret.
STRONG = 10.0
#: Words that attackers try first, most usual first.
WORDS = (
    "password", "admin", "welcome", "letmein", "login", "user", "test", "guest", "secret", "master",
    "root", "default", "changeme", "hello", "dragon", "monkey", "shadow", "sunshine", "princess", "football",
    "baseball", "love", "super", "pass", "token", "key", "example", "sample", "demo", "temp",
    "access", "system", "server", "database", "service", "public", "private", "account", "client",
    "summer", "winter", "spring", "autumn", "your", "here", "value", "none", "null", "true",
    "false", "todo", "insert", "placeholder", "dummy", "fake", "string", "the", "and", "with",
)
#: Rows of keys, each half a key to the right of the one above, and the orders of letters and digits.
KEY_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
ORDERS = ("abcdefghijklmnopqrstuvwxyz", "0123456789")
#: Characters that stand for letters in disguised words.
DISGUISES = str.maketrans("013457@$!", "oieastasi")
#: Names of months.
MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_YEAR, _MONTH, _DAY, _MARK = r"(?:19|20)\d\d", r"(?:0[1-9]|1[0-2])", r"(?:0[1-9]|[12]\d|3[01])", r"[-/._,\x20]*+"
DATES = tuple(
    re.compile(p)
    for p in (
        rf"{_YEAR}([-/._]?){_MONTH}\1{_DAY}",
        rf"{_DAY}([-/._]?){_MONTH}\1{_YEAR}",
        rf"{_MONTH}([-/._]?){_DAY}\1{_YEAR}",
        rf"(?:0?[1-9]|[12]\d|3[01]){_MARK}(?:{MONTHS}){_MARK}{_YEAR}",
        rf"(?:{MONTHS}){_MARK}(?:(?:0?[1-9]|[12]\d|3[01]){_MARK})?{_YEAR}",
        rf"{_YEAR}{_MARK}(?:{MONTHS})(?:{_MARK}(?:0?[1-9]|[12]\d|3[01]))?",
    )
)
YEAR = re.compile(_YEAR)
DATE_COST, YEAR_COST, SEGMENT_COST = log10(365 * 120), log10(120), log10(2)
LONGEST_PERIOD = 8
#: Values of which a worker remembers the cost.
REMEMBERED = 50_000


def _steps() -> dict[tuple[str, str], tuple[int, int]]:
    """The direction from each key to each of its neighbours, and from each letter or digit to the next."""
    at = {key: (row, column) for row, keys in enumerate(KEY_ROWS) for column, key in enumerate(keys)}
    found = {}
    for a, (row, column) in at.items():
        for b, (other_row, other_column) in at.items():
            step = other_row - row, other_column - column
            if step in ((0, 1), (0, -1), (1, 0), (-1, 0), (1, -1), (-1, 1)):
                found[a, b] = step
    for order in ORDERS:
        for a, b in zip(order, order[1:], strict=False):
            found.setdefault((a, b), (0, 2))
            found.setdefault((b, a), (0, -2))
    return found


_STEPS, _KEYS, _WAYS = _steps(), sum(map(len, KEY_ROWS)), 6


def ranked_words(rank_file: bytes = b"") -> dict[str, int]:
    """Words of three letters and more with their place: ``WORDS``, then the whole words (after a blank) of the rank file."""
    rows = (line.split() for line in rank_file.splitlines() if line.strip())
    words = list(WORDS)
    for _, token in sorted((int(rank), base64.b64decode(token)) for token, rank in rows):
        if len(token) > 3 and token[:1] == b" " and token[1:].isalpha():
            words.append(token[1:].decode().lower())
    return {w: i for i, w in reversed(list(enumerate(words)))}


def _character_cost(value: str) -> float:
    """Of a brute-force character: the size of the classes that the value draws on."""
    classes = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26), (lambda c: not c.isalnum(), 33))
    return log10(max(10, sum(n for has, n in classes if any(map(has, value)))))


def _walks(low: str) -> Iterator[tuple[int, int, float]]:
    """Keyboard walks: the guesses are where one begins, how long it is, and where and how it turns."""
    begin = 0
    while begin < len(low):
        end, turns, last = begin + 1, 0, None
        while end < len(low) and (step := _STEPS.get((low[end - 1], low[end]))) is not None:
            turns += step != last
            last, end = step, end + 1
        if end - begin >= 3:
            yield begin, end, log10(_KEYS * (end - begin)) + log10(comb(end - begin - 1, turns - 1)) + turns * log10(_WAYS)
        begin = max(end - 1, begin + 1)


def _repeats(value: str, each: float) -> Iterator[tuple[int, int, float]]:
    for period in range(1, LONGEST_PERIOD + 1):
        begin = 0
        while begin + period < len(value):
            end = begin + period
            while end < len(value) and value[end] == value[end - period]:
                end += 1
            if end - begin >= max(3, 2 * period):
                yield begin, end, each * period + log10((end - begin) / period)
                # the parts of a run that leave out its first or last character, for neighbours that need it
                yield begin + 1, end, each * period + log10((end - begin) / period)
            begin = max(begin + 1, end - period)


class Guesser:
    """What values cost to guess by a ranked list of words."""

    def __init__(self, words: dict[str, int] | None = None):
        words = ranked_words() if words is None else words
        self.ranks = {w: log10(i + 2) for w, i in words.items()}
        self.longest = max(map(len, words), default=0)
        self.known: dict[str, float] = {}

    def _words(self, value: str, low: str) -> Iterator[tuple[int, int, float]]:
        plain, n = low.translate(DISGUISES), len(value)
        for begin in range(n):
            for end in range(begin + 3, min(n, begin + self.longest) + 1):
                for form, extra in ((low, 0.0), (plain, 1.0)):
                    if (rank := self.ranks.get(form[begin:end])) is not None:
                        raised = sum(map(str.isupper, value[begin:end]))
                        yield begin, end, rank + extra + (log10(2) if raised in (0, end - begin) or raised == 1 and value[begin].isupper() else log10(2) * (raised + 1)) * (raised > 0)
                        break

    def segments(self, value: str) -> Iterator[tuple[int, int, float]]:
        """(begin, end, cost) of every segment other than a brute-force character."""
        low = "".join(c.lower()[0] for c in value)
        yield from self._words(value, low)
        for patterns, cost in ((DATES, DATE_COST), ((YEAR,), YEAR_COST)):
            for pattern in patterns:
                for begin in range(len(low)):
                    if m := pattern.match(low, begin):
                        yield begin, m.end(), cost
        yield from _repeats(value, _character_cost(value))
        yield from _walks(low)

    def cost(self, value: str) -> float:
        """Decimal logarithm of the guesses that the cheapest segmentation needs; time in proportion to the length."""
        ending: dict[int, list[tuple[int, float]]] = {}
        for begin, end, cost in self.segments(value):
            ending.setdefault(end, []).append((begin, cost))
        each = _character_cost(value)
        best = [0.0]
        for end in range(1, len(value) + 1):
            least = best[end - 1] + each
            for begin, cost in ending.get(end, ()):
                least = min(least, best[begin] + cost + SEGMENT_COST)
            best.append(least)
        return best[-1]

    def strong(self, value: str) -> bool:
        if len(value) < 6:
            return False
        if (cost := self.known.get(value)) is None:
            cost = self.cost(value)
            if len(value) < 100:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[value] = cost
        return cost >= STRONG


_PLAIN = Guesser()


def spans(text: str, guesser: Guesser = _PLAIN) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every span, in order."""
    found = []
    low = text.lower() if text.isascii() else text.translate(_ASCII_LOWER)
    if any(name in low for name in ASSIGN_NAMES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(stem in low for stem in CONTEXT_STEMS):
        at = 0
        while m := CONTEXT.search(text, at):
            group = m.lastindex
            value = m[group] if group < 3 else m[3].rstrip("\"'`,;.)>]}")
            strong = guesser.strong(value)
            if strong:
                found.append((m.start(group), 3, m.start(group) + len(value)))
            # what looks like a weak quoted value may hold a name and its value
            at = m.end() if strong or group == 3 else m.start(group)
    return sorted(found)


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def written_out(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


_GUESSERS: dict[str | None, Guesser] = {}


def _shared(spark: SparkSession, rank_file: str | None):
    """A function that gives a worker its guesser, built once; what is broadcast is a list of words."""
    if rank_file is None:
        words = None
    else:
        with open(rank_file, "rb") as f:
            words = ranked_words(f.read())
    shared = spark.sparkContext.broadcast(words)

    def guesser() -> Guesser:
        if rank_file not in _GUESSERS:
            _GUESSERS[rank_file] = Guesser(shared.value)
        return _GUESSERS[rank_file]

    return guesser


def scanned(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", rank_file: str | None = None) -> DataFrame:
    """(id, spans array<struct<start, kind, end>>) of every row."""
    guesser = _shared(df.sparkSession, rank_file)
    kind = df.schema[id_column].dataType.simpleString()
    item = pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = guesser()
        for batch in sliced(batches):
            rows = [[{"start": a, "kind": KINDS[k], "end": b} for a, k, b in spans(text.as_py() or "", own)] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], ["id", "spans"])

    out = df.select(F.col(id_column).alias("id"), F.col(text_column)).mapInArrow(run, f"id {kind}, spans array<struct<start int, kind string, end int>>")
    return out.withColumnRenamed("id", id_column)


def counted(df: DataFrame, rank_file: str | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    found = scanned(df, rank_file=rank_file)
    text = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "guess")
    of = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def masked(text: str | None, guesser: Guesser = _PLAIN, mark: str = "[secret]") -> str | None:
    """``text`` with every span, and spans that overlap as one, replaced."""
    if not text or not (found := spans(text, guesser)):
        return text
    out, at = [], 0
    begin = end = -1
    for start, _, stop in found:
        if start > end:
            if end >= 0:
                out += [text[at:begin], mark]
                at = end
            begin, end = start, stop
        else:
            end = max(end, stop)
    return "".join([*out, text[at:begin], mark, text[end:]])


def redacted(df: DataFrame, text_column: str = "text", length_column: str | None = "n_chars", rank_file: str | None = None) -> DataFrame:
    """All rows and columns of ``df``, secrets in the text masked and its length brought up to date."""
    guesser = _shared(df.sparkSession, rank_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = guesser()
        for batch in sliced(batches):
            at = batch.schema.get_field_index(text_column)
            yield batch.set_column(at, batch.schema.field(at), pa.array([masked(t.as_py(), own) for t in batch.column(at)], batch.schema.field(at).type))

    out = df.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in df.schema.fields]))
    if length_column in df.columns:
        out = out.withColumn(length_column, F.when(F.col(text_column).isNotNull(), F.char_length(text_column).cast(df.schema[length_column].dataType)).otherwise(F.col(length_column)))
    return out


def base_digest(text: str) -> str:
    return hashlib.sha256(written_out([s for s in spans(text) if s[1] < 3]).encode()).hexdigest()
