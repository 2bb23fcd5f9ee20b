"""Language identification by a string kernel.

Texts are sets of the character n-grams of length 1 to 3 that they hold, of any code
points: an n-gram is its code points in 63 bits, so none collide and none are left
out.  The blended-spectrum presence kernel of two texts counts the n-grams that both
hold, weighted by length and normalised to 1 for equal sets.  Nystroem features of a
text are its kernels with ``LANDMARKS`` landmark texts times the inverse root of the
landmarks' own kernel matrix, and one-versus-rest kernel ridge regression on those
gives each language a value.  Texts are scored in batches: a presence matrix times
the landmarks' matrix, in whole numbers, then times the weights.

The classifier is fitted on a sample of labelled rows: about ``SAMPLE`` rows in
all, equally many of each language, those of least hashed id and text.  Only text and
label are read of them; a prediction reads the text alone.

Defined results: a text that is null or has no letter (no code point of category L)
is ``und`` with score 0; so is every text where no row is labelled; equal texts get
equal results, whatever texts they are scored with; ties go to the language first in
order of name; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from knotwork.llm.common import sliced

#: Bits of a code point in an n-gram's code, and the mark that stands before and after a text.
POINT, EDGE = 21, (1 << 21) - 1
#: What an n-gram counts: one of a single code point, and a longer one.
SINGLE, LONGER = 1, 2
LANDMARKS, SAMPLE, RIDGE = 160, 2400, 1e-2
#: Texts and n-grams of one presence matrix; code points whose n-grams are made together.
ROWS, COLUMNS, POINTS = 192, 8192, 1 << 18
#: A text of whose n-grams the landmarks hold less than this share is in no language that was learned.
LEAST_KNOWN = 0.1
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def ngrams(text: str) -> np.ndarray:
    """Codes of the distinct n-grams of the lower-cased text, ascending: single code points first."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.full(len(points) + 2, EDGE, np.uint64)
    c[1:-1] = points
    c[1:-1] += np.uint64(1)  # so that no place of a longer n-gram is 0
    parts = []
    for begin in range(0, len(points), POINTS):
        one = c[begin : begin + POINTS + 2]
        two = one[:-1] | one[1:] << np.uint64(POINT)
        last = two[-1:] if begin + POINTS >= len(points) else two[:0]
        parts.append(np.unique(np.concatenate([one[1:-1], two[:-1], last, two[:-1] | one[2:] << np.uint64(2 * POINT)])))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))


def own_kernel(codes: np.ndarray) -> int:
    """The kernel of a set with itself before normalisation."""
    single = int(np.searchsorted(codes, np.uint64(1 << POINT)))
    return SINGLE * single + LONGER * (len(codes) - single)


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # n-grams of the landmarks, ascending
    held: np.ndarray  # bits: which landmarks hold each of them
    own: np.ndarray  # the landmarks' kernels with themselves
    values: np.ndarray  # (landmarks, languages)
    _rows: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_rows": None}

    def kernels(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, landmarks) normalised kernels, and the share of each text's n-grams that
        some landmark holds.  The products add up whole numbers below 2^24, so they are
        exact and don't depend on what is scored together."""
        if self._rows is None:
            self._rows = np.unpackbits(self.held, axis=1, count=len(self.own))
        sets = [ngrams(t) for t in texts]
        flat = np.concatenate([np.zeros(0, np.uint64), *sets])
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(self.codes, flat), len(self.codes) - 1)
        known = self.codes[at] == flat
        row, at = row[known], at[known]
        held = np.bincount(row, np.where(self.codes[at] < np.uint64(1 << POINT), SINGLE, LONGER), len(sets))
        used, at = np.unique(at, return_inverse=True)
        shared = np.zeros((len(sets), len(self.own)))
        for begin in range(0, len(used), COLUMNS):
            columns = used[begin : begin + COLUMNS]
            inside = (at >= begin) & (at < begin + COLUMNS)
            presence = np.zeros((len(sets), len(columns)), np.float32)
            presence[row[inside], at[inside] - begin] = 1
            weight = np.where(self.codes[columns] < np.uint64(1 << POINT), np.float32(SINGLE), np.float32(LONGER))
            shared += presence @ (self._rows[columns] * weight[:, None])
        own = np.maximum(np.array([own_kernel(s) for s in sets], np.float64), 1)
        return shared / np.sqrt(own[:, None] * self.own), held / own

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language with the largest value, its share of exp(4 * value), and
        the share of the text's n-grams that are known.  Values are added up in one fixed order."""
        values, known = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for begin in range(0, len(texts), ROWS):
            near, known[begin : begin + ROWS] = self.kernels(texts[begin : begin + ROWS])
            for j in range(len(self.own)):
                values[begin : begin + ROWS] += near[:, j, None] * self.values[j]
        best = values.argmax(1)
        powers = np.exp(4 * (values - values[np.arange(len(texts)), best][:, None]))
        return best, np.round(1 / powers.sum(1), 9), known


def fit(texts: list[str], labels: list[str], seed: int = 1) -> Model | None:
    """The model of labelled texts, or None where there is none."""
    pairs = sorted((x, y) for x, y in zip(labels, texts, strict=True) if has_letter(y))
    if not pairs:
        return None
    labels, texts = [x for x, _ in pairs], [y for _, y in pairs]
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == c))[: max(1, LANDMARKS // len(languages))] for c in range(len(languages))])
    sets = [ngrams(texts[i]) for i in chosen]
    codes = np.unique(np.concatenate(sets))
    held = np.zeros((len(codes), len(sets)), bool)
    for j, s in enumerate(sets):
        held[np.searchsorted(codes, s), j] = True
    model = Model(languages, codes, np.packbits(held, axis=1), np.array([own_kernel(s) for s in sets], np.float64), np.zeros((0, 0)))

    near = np.concatenate([model.kernels(texts[i : i + ROWS])[0] for i in range(0, len(texts), ROWS)])
    among, vectors = np.linalg.eigh(near[chosen])
    kept = among > 1e-6 * among[-1]
    root = vectors[:, kept] / np.sqrt(among[kept])
    z = near @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    share = np.bincount(y, minlength=len(languages))
    balance = (len(y) / (len(languages) * share))[y][:, None]
    solved = np.linalg.solve(z.T @ (balance * z) + RIDGE * len(texts) / LANDMARKS * np.eye(z.shape[1]), z.T @ (balance * target))
    model.values = root @ solved
    return model


def held_out(id_column: Column) -> Column:
    """Whether a row is kept from learning: CRC-32 of its id in decimal leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned(df: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang") -> Model | None:
    """Fits the classifier; what comes to the driver is the sample and a count per language.

    Rows that repeat id and text share a hash; the number of a language's rows that come
    is bounded all the same."""
    rows = df.select(F.col(id_column).alias("id"), F.col(label_column).cast("string").alias("label"), F.col(text_column).alias("text"))
    rows = rows.filter(~held_out(F.col("id")) & F.col("label").isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    if not counts:
        return None
    each = max(8, sample // len(counts))
    place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
    least = F.lit(False)
    for label, n in counts.items():
        least = least | ((F.col("label") == label) & (place < min(1 << 30, (each << 30) // n + 1)))
    order = F.row_number().over(Window.partitionBy("label").orderBy(place))
    found = rows.filter(least).withColumn("order", order).filter(F.col("order") <= 2 * each).select("label", "text").toArrow()
    return fit(found.column(1).to_pylist(), found.column(0).to_pylist())


def identified(df: DataFrame, model: Model | None, keep: list[str], text_column: str = "text", unlearned: str = UNDETERMINED) -> DataFrame:
    """Columns ``keep`` of every row with (lang_pred, score, known); without a model,
    ``unlearned`` marks texts with letters."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    read = [*keep, *[text_column] * (text_column not in keep)]
    names, at_text = [f"c{i}" for i in range(len(read))], read.index(text_column)
    kept = names[: len(keep)]
    schema = ", ".join([*(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(kept, keep, strict=True)), "lang_pred string, score double, known double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in sliced(batches):
            texts = batch.column(at_text).to_pylist()
            lettered = [i for i, t in enumerate(texts) if has_letter(t)]
            labels, scores, share = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts)), np.zeros(len(texts))
            if model is None:
                labels[lettered], share[lettered] = unlearned, 1
            elif lettered:
                best, scores[lettered], share[lettered] = model.predict([texts[i] for i in lettered])
                labels[lettered] = np.array(model.languages, object)[best]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(labels, pa.string()), pa.array(scores), pa.array(share)], [*kept, "lang_pred", "score", "known"])

    out = df.select(*(F.col(f"`{c}`").alias(n) for n, c in zip(names, read, strict=True))).mapInArrow(run, schema)
    return out.select(*(F.col(n).alias(c) for n, c in zip(kept, keep, strict=True)), "lang_pred", "score", "known")


def accepted(df: DataFrame, least: float = LEAST_KNOWN, label_column: str = "lang") -> DataFrame:
    """The rows of ``df`` whose text has a letter and, by the share of its n-grams that are
    known, is in a language that was learned; a label that is missing becomes the predicted one.  Where there is nothing
    to learn from, every text with a letter stays as it is."""
    out = identified(df, learned(df, label_column=label_column), df.columns, unlearned="")
    own = len(df.columns)
    marked = out.toDF(*(f"c{i}" for i in range(own)), "lang_pred", "score", "known").filter((F.col("lang_pred") != UNDETERMINED) & (F.col("known") >= least))
    found = F.nullif(F.col("lang_pred"), F.lit("")).cast(df.schema[label_column].dataType)
    return marked.select(*((F.coalesce(F.col(f"c{i}"), found) if c == label_column else F.col(f"c{i}")).alias(c) for i, c in enumerate(df.columns)))


def predicted(df: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    return identified(df, learned(df), ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
