"""MinHash near-duplicates with b-bit signatures.

Documents are sets of five-word shingles.  One pass over the texts gives each
document its set size, a 128-bit fingerprint of the set, the keys of its bands
and the low four bits of 192 minima, packed.  Documents of equal sets form a
class, a node of the graph, for which one text stands.  Candidate pairs come in two steps:

1. in every band bucket, one representative, its leader, against each other one;
   buckets have one of ``LEADERS`` ways to choose it, so that a group of near
   copies is seen from several of its members;
2. once the links of step 1 have merged classes into components, all pairs of a
   bucket whose components still differ.  A bucket beyond a block is cut into
   blocks, and pairs of blocks are dealt out as rows of their own, so that no
   task holds a large bucket.  Blocks are first compared by the short signatures,
   which gives no pairs but the members that have any plausible partner; those
   get signatures of eight times the length, and pairs plausible by these are
   given once, in the first band that both share.

A pair is plausible if the set sizes permit the similarity and the
collision-corrected estimate from counting equal low bits is within six
standard deviations of it; it is then confirmed on the full sets.  Pairs within
a component are not made, since they can't change it.

A pair of sets at exactly 75 percent shares no band with a probability of 1.2e-8
(0.6836 to the 48th power) and falls below the estimate's bound with one of 3e-9.

Defined results: a null or blank text has an empty set, links with nothing and is
kept; equal sets link whatever their size; rows that repeat a doc_id, with the same
text or another, count as one document with the links of all its texts, and are all
returned with one component; a null doc_id links with nothing, has no component and
is kept; a table without rows gives none.  Columns other than the two named are not
read.  ``without_duplicates`` goes by texts, so that none is lost by an id that two
texts share: of all rows whose texts link one stays, that of the least id, of which
rows that repeat id and text count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import released, rows_per_batch, written
from knotwork.llm.components import components
from knotwork.llm.shingles import blocks, mix, shingle_sets

BANDS, ROWS, BITS = 48, 4, 4
HASHES = BANDS * ROWS
LONG_HASHES = 8 * HASHES
LEADERS = 4
WORDS_64 = HASHES * BITS // 64
PERCENT = 75
#: Members of a bucket that are compared with one another as one block.
BLOCK = 512
#: Keys that a scan of the texts may be joined to by broadcast; more go by shuffle.
BROADCAST_IDS = 2_000_000
#: Bytes of text whose shingles are made together.
BLOCK_BYTES = 1 << 18
#: Texts, and pairs of texts, that a worker gets at once.
TEXTS, TEXT_PAIRS = 500, 64
_RNG = np.random.Generator(np.random.PCG64(4_096))
_XOR = _RNG.integers(0, 1 << 64, LONG_HASHES, np.uint64)
_ODD = _RNG.integers(0, 1 << 64, LONG_HASHES, np.uint64) | np.uint64(1)
_SEAL = _RNG.integers(0, 1 << 64, 3, np.uint64)


def least_matches(hashes: int = HASHES, percent: int = PERCENT) -> int:
    """Equal low-bit minima of so many below which a pair can't plausibly be similar enough."""
    chance = 1 / (1 << BITS)
    p = chance + (1 - chance) * percent / 100
    return int(hashes * p - 6 * (hashes * p * (1 - p)) ** 0.5)


def minima(sets: list[np.ndarray], hashes: int = HASHES) -> np.ndarray:
    """(len(sets), hashes) least hash values; the sets are not empty."""
    out = np.empty((len(sets), hashes), np.uint64)
    for begin, end in blocks([len(s) for s in sets], 1 << 15):
        flat = np.concatenate(sets[begin:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[begin : end - 1]])]).astype(np.int64)
        scratch = np.empty_like(flat)
        for k in range(hashes):
            np.bitwise_xor(flat, _XOR[k], out=scratch)
            np.multiply(scratch, _ODD[k], out=scratch)
            out[begin:end, k] = np.minimum.reduceat(scratch, starts)
    return out


def packed(values: np.ndarray) -> np.ndarray:
    """Low bits of the minima, sixteen in each number of a row."""
    low = (values ^ (values >> np.uint64(32))) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    return np.bitwise_or.reduce(low.reshape(len(low), -1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS)), axis=2)


def band_keys(values: np.ndarray) -> np.ndarray:
    keys = np.empty((len(values), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(values), band + 1, np.uint64)
        for k in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key + values[:, k])
        keys[:, band] = key
    return keys


SIGNATURE = [f"s{i}" for i in range(WORDS_64)]


def row_key(id_column: str, text_column: str) -> Column:
    """What names a row by its id and text."""
    return F.xxhash64(F.col(id_column).cast("long"), F.col(text_column).cast("string"))


def signatures(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, row_key, n, lo, hi, s0.., bands): set size, fingerprint, packed low bits and band keys."""
    schema = "doc_id long, row_key long, n long, lo long, hi long, " + ", ".join(f"{s} long" for s in SIGNATURE) + ", bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts = [t or b"" for t in batch.column(2).to_pylist()]
            for begin, end in blocks([len(t) for t in texts], BLOCK_BYTES):
                sets = shingle_sets(texts[begin:end])
                n = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(n)
                seals = np.zeros((2, len(sets)), np.uint64)
                low, keys = np.zeros((len(sets), WORDS_64), np.uint64), np.zeros((0, BANDS), np.uint64)
                if len(some):
                    held = [sets[i] for i in some]
                    for j in range(2):
                        seals[j, some] = [mix(s ^ _SEAL[j]).sum(dtype=np.uint64) for s in held]
                    values = minima(held)
                    low[some], keys = packed(values), band_keys(values)
                offsets = np.concatenate([[0], np.cumsum((n > 0) * BANDS)])
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(begin, end - begin) for i in range(2)),
                        pa.array(n),
                        *(pa.array(x.view(np.int64)) for x in seals),
                        *(pa.array(np.ascontiguousarray(low[:, j]).view(np.int64)) for j in range(WORDS_64)),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel().view(np.int64))),
                    ],
                    ["doc_id", "row_key", "n", "lo", "hi", *SIGNATURE, "bands"],
                )

    return df.select(F.col(id_column).cast("long").alias("doc_id"), row_key(id_column, text_column).alias("row_key"), F.col(text_column).cast("binary").alias("text")).mapInArrow(run, schema)


def matches(a: str, b: str) -> Column:
    """How many of the low-bit minima of sides ``a`` and ``b`` are equal."""
    ones = 0x1111111111111111  # a nibble's lowest bit, into which its other three are folded
    differ = []
    for s in SIGNATURE:
        x = f"({a}.{s} ^ {b}.{s})"
        folded = f"({x} | (shiftrightunsigned({x}, 1)) | (shiftrightunsigned({x}, 2)) | (shiftrightunsigned({x}, 3)))"
        differ.append(f"bit_count({folded} & {ones}L)")
    return F.expr(f"{HASHES} - ({' + '.join(differ)})")


def _plausible(a: str, b: str) -> Column:
    sizes = F.expr(f"100 * least({a}.n, {b}.n) >= {PERCENT} * greatest({a}.n, {b}.n)")
    return sizes & (matches(a, b) >= least_matches())


def narrowed(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """``df`` joined by ``how`` to a table of keys: by broadcast where they are few by
    count, else by shuffle."""
    return df.join(F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys, on, how)


def texts_of(nodes: DataFrame, reps: DataFrame, df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(node, text binary), one row for each of the nodes."""
    keys = written(reps.join(nodes, "node", "left_semi").select("row_key", "node"), "keys")
    texts = df.select(row_key(id_column, text_column).alias("row_key"), F.col(text_column).cast("binary").alias("text"))
    return narrowed(texts, keys, "row_key", "inner").select("node", "text")


def confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """The pairs (a, b) of nodes whose full sets are similar enough."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    texts = written(texts_of(nodes, reps, docs, id_column, text_column), "texts")
    if texts.count() > texts.select("node").distinct().count():
        texts = written(texts.dropDuplicates(["node"]), "texts")  # rows that repeat id and text
    sides = [texts.select(F.col("node").alias(x), F.col("text").alias(f"text_{x}")) for x in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sizes = [len(x or b"") + len(y or b"") for x, y in zip(left, right, strict=True)]
            for begin, end in blocks(sizes, BLOCK_BYTES):
                sets = shingle_sets([t or b"" for pair in zip(left[begin:end], right[begin:end], strict=True) for t in pair])
                keep = []
                for i in range(end - begin):
                    x, y = sets[2 * i], sets[2 * i + 1]
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(shared > 0 and 100 * shared >= PERCENT * (len(x) + len(y) - shared))
                keep = np.array(keep, bool)
                yield pa.RecordBatch.from_arrays([pa.array(a[begin:end][keep]), pa.array(b[begin:end][keep])], ["a", "b"])

    joined = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b")
    with rows_per_batch(docs.sparkSession, TEXT_PAIRS):
        return written(joined.mapInArrow(run, "a long, b long"), "links")


def _linked(df: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The signatures of all rows; classes (lo, hi, n, rep, node) of equal sets, rep the
    least id; rows (doc_id, row_key, node) of a class; and confirmed links (a, b) of
    nodes, enough of them for all components."""
    with rows_per_batch(df.sparkSession, TEXTS):
        docs = written(signatures(df, id_column, text_column), "signatures")
    usable = docs.filter("doc_id IS NOT NULL AND n > 0")
    classes = usable.groupBy("lo", "hi", "n").agg(F.min("doc_id").alias("rep"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    assigned = written(usable.select("doc_id", "row_key", "lo", "hi", "n").join(classes, ["lo", "hi", "n"]).select("doc_id", "row_key", "node"), "assigned")
    reps = usable.alias("d").join(classes.alias("c"), F.expr("d.doc_id = c.rep AND d.lo = c.lo AND d.hi = c.hi AND d.n = c.n"))
    reps = written(reps.select("c.node", "d.row_key", "d.n", *SIGNATURE, "bands").dropDuplicates(["node"]), "reps")
    mask = F.xxhash64(F.pmod(F.col("key"), F.lit(LEADERS)))
    members = reps.select(F.explode("bands").alias("key"), "node")
    buckets = members.groupBy("key").agg(F.min(F.col("node").bitwiseXOR(mask)).alias("first"), F.max(F.col("node").bitwiseXOR(mask)).alias("last")).filter("first < last")
    # sums that hot keys are joined with are tables of their own: a join of two plain shuffles is split where it is skewed
    buckets = written(buckets.select("key", F.col("first").bitwiseXOR(mask).alias("leader")), "buckets")
    members = written(members.join(buckets, "key"), "members")

    signed = reps.select("node", "n", *SIGNATURE)
    stars = members.filter("leader <> node").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    stars = stars.join(signed.alias("x"), F.col("a") == F.col("x.node")).join(signed.alias("y"), F.col("b") == F.col("y.node"))
    # nothing after the joins needs their partitioning, so that a leader of many members is split
    stars = written(stars.filter(_plausible("x", "y")).select("a", "b"), "near")
    links = confirmed(stars, reps, df, id_column, text_column)

    rest = _unresolved(members, components(links), reps)
    if not rest.isEmpty():
        links = links.union(confirmed(_within_buckets(rest, reps, df, id_column, text_column), reps, df, id_column, text_column))
    return docs, classes, assigned, links


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` with ``root``, one node for each component."""
    labels = components(links)
    return nodes.join(labels, "node", "left").withColumn("root", F.coalesce("label", "node")).drop("label")


def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``df``."""
    docs, classes, assigned, links = _linked(df, id_column, text_column)
    several = assigned.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("doc_id", "a")
    same = written(assigned.join(several, "doc_id").filter("node > a").select("a", F.col("node").alias("b")).distinct(), "same")
    rooted = written(_rooted(classes, links if same.isEmpty() else links.union(same)), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    named = written(rooted.join(least, "root").select("lo", "hi", "n", "node", "component_id"), "named")

    full = docs.filter("doc_id IS NOT NULL AND n > 0").select("doc_id", "n", "lo", "hi").join(named, ["lo", "hi", "n"]).select("doc_id", "n", "component_id")
    blank = docs.filter("doc_id IS NULL OR n = 0").select("doc_id", "n")
    known = assigned.join(blank.select("doc_id").distinct(), "doc_id", "left_semi").join(named, "node").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    blank = blank.join(known, "doc_id", "left").select("doc_id", "n", F.coalesce("component_id", "doc_id").alias("component_id"))
    return full.union(blank).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _unresolved(members: DataFrame, labels: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, node, label, block, n_blocks, n, signature, bands): the members of the
    buckets that hold more than one component."""
    labelled = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    open_buckets = labelled.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.count("*").alias("size")).filter("least < most")
    open_buckets = written(open_buckets.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("n_blocks")), "open")
    signed = reps.select("node", "n", F.array(*SIGNATURE).alias("signature"), "bands")
    rest = labelled.join(open_buckets, "key").join(signed, "node")
    return written(rest.withColumn("block", F.expr("cast(pmod(xxhash64(node), n_blocks) as int)")), "rest")


def _dealt(rest: DataFrame) -> DataFrame:
    """The members once for each pair of blocks that theirs is in, pairs of blocks together."""
    rows = rest.withColumn("other", F.explode(F.expr("sequence(0, n_blocks - 1)")))
    rows = rows.withColumns({"left": F.least("block", "other"), "right": F.greatest("block", "other")})
    rows = rows.select("key", "left", "right", "block", "node", "label", "n", "signature", "bands")
    return rows.repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "node")


class _Group:
    """The members of one pair of blocks of a bucket, and which of their pairs are plausible."""

    def __init__(self, columns: dict[str, np.ndarray], at: slice):
        self.key, self.ids, self.bands = columns["key"][at.start], columns["node"][at], columns["bands"][at]
        label, block, n, low = (columns[c][at] for c in ("label", "block", "n", "signature"))
        crossing = columns["left"][at.start] != columns["right"][at.start]
        x, y = [], []
        ones = np.uint64(0x1111111111111111)
        needed, hashes = least_matches(low.shape[1] * 64 // BITS), low.shape[1] * 64 // BITS
        for i in range(len(self.ids) - 1):
            j = np.arange(i + 1, len(self.ids))
            j = j[(label[j] != label[i]) & (100 * np.minimum(n[j], n[i]) >= PERCENT * np.maximum(n[j], n[i]))]
            if crossing:
                j = j[block[j] != block[i]]
            if not len(j):
                continue
            differ = low[j] ^ low[i]
            differ |= differ >> np.uint64(2)
            differ |= differ >> np.uint64(1)
            j = j[hashes - np.bitwise_count(differ & ones).sum(1) >= needed]
            x.append(np.full(len(j), i))
            y.append(j)
        none = np.zeros(0, np.int64)
        self.x, self.y = np.concatenate([none, *x]), np.concatenate([none, *y])

    def with_partner(self) -> tuple[np.ndarray, np.ndarray]:
        ids = self.ids[np.unique(np.concatenate([self.x, self.y]))]
        return np.full(len(ids), self.key), ids

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The plausible pairs of which no earlier band has both."""
        both = self.bands[self.x] == self.bands[self.y]
        first = self.bands[self.x, both.argmax(1)] == self.key if len(self.x) else np.zeros(0, bool)
        a, b = self.ids[self.x[first]], self.ids[self.y[first]]
        return np.minimum(a, b), np.maximum(a, b)


def _over_groups(rest: DataFrame, result: str, names: list[str]) -> DataFrame:
    """Calls ``result`` of each group; a group is a bounded pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in _then_none(batches):
            if batch is not None:
                held.append(batch)
                if sum(b.num_rows for b in held) < 2 * BLOCK + 1:
                    continue
            if not held:
                continue
            columns = _columns(pa.Table.from_batches(held).combine_chunks())
            where = np.stack([columns[c] for c in ("key", "left", "right")])
            cuts = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(0)) + 1
            edges = [0, *cuts.tolist(), where.shape[1]]
            last = edges[-2] if batch is not None else edges[-1]  # the last group may go on in the next batch
            for begin, end in zip(edges, edges[1:], strict=False):
                if end <= last:
                    found = getattr(_Group(columns, slice(begin, end)), result)()
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)
            held = [b for b in pa.Table.from_batches(held).slice(last).to_batches() if b.num_rows]

    return _dealt(rest).mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _columns(t: pa.Table) -> dict[str, np.ndarray]:
    out = {}
    for name in t.column_names:
        c = t.column(name)
        if pa.types.is_list(c.type):
            flat = pa.concat_arrays([x.flatten() for x in c.chunks]).to_numpy()
            out[name] = (flat.view(np.uint64) if name == "signature" else flat).reshape(t.num_rows, -1)
        else:
            out[name] = c.to_numpy()
    return out


def _within_buckets(rest: DataFrame, reps: DataFrame, docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(a, b): plausible pairs of different components within the same bucket."""
    promising = written(_over_groups(rest, "with_partner", ["key", "node"]).distinct(), "promising")
    texts = texts_of(promising.select("node").distinct(), reps, docs, id_column, text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for begin, end in blocks([len(t) for t in texts], BLOCK_BYTES):
                sets = shingle_sets(texts[begin:end])
                low = packed(minima(sets, LONG_HASHES)).view(np.int64)
                offsets = np.arange(end - begin + 1, dtype=np.int32) * low.shape[1]
                columns = [batch.column(0).slice(begin, end - begin), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(low.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "signature"])

    with rows_per_batch(docs.sparkSession, TEXTS):
        signed = written(texts.mapInArrow(run, "node long, n long, signature array<long>"), "long")
    rest = rest.drop("n", "signature").join(promising, ["key", "node"], "left_semi").join(signed.dropDuplicates(["node"]), "node")
    return written(_over_groups(rest, "pairs", ["a", "b"]).distinct(), "pairs")


def without_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of those whose texts link, one."""
    _, classes, assigned, links = _linked(df, id_column, text_column)
    rooted = written(_rooted(classes.select("node", "rep"), links), "rooted")
    first = written(rooted.groupBy("root").agg(F.min("rep").alias("first")), "least")
    rows = written(assigned.join(rooted.join(first, "root").select("node", "root", "first"), "node"), "rows")
    best = written(rows.filter("doc_id = first").groupBy("root").agg(F.min("row_key").alias("best")), "best")
    judged = written(rows.join(best, "root").groupBy("row_key").agg(F.max(F.col("row_key") == F.col("best")).alias("stays"), F.count("*").alias("times")), "judged")
    key = "_row_key"
    while key in df.columns:
        key += "_"
    out = narrowed(df.withColumn(key, row_key(id_column, text_column)), judged.filter("NOT stays").select(F.col("row_key").alias(key)), key, "left_anti")
    many = judged.filter("stays AND times > 1").select(F.col("row_key").alias(key))
    if not many.isEmpty():
        out = narrowed(out, many, key, "left_anti").union(narrowed(out, many, key, "left_semi").dropDuplicates([key]))
    return out.drop(key)
