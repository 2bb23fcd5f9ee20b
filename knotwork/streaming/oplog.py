"""The op log as a stream: state folded batch by batch, and the feed of changes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knotwork.operators.fold import TRIPLE

#: Events that a feed keeps for each context.
RING = 1024
STATE = [*TRIPLE, "source", "sum", "count"]


def delta(ops: DataFrame) -> DataFrame:
    """Each source's share of each edge from a batch of ``associate`` ops."""
    return ops.filter("op = 'associate'").groupBy(*TRIPLE, "source").agg(F.sum("weight").alias("sum"), F.count("*").alias("count"))


def merged(state: DataFrame | None, ops: DataFrame) -> DataFrame:
    """The shares after ``ops``: what a batch ends goes first, then what it says after that is added."""
    ended = ops.filter("op = 'retract_association'").groupBy(*TRIPLE).agg(F.max("seq").alias("edge_end"))
    left = ops.filter("op = 'retract_source'").groupBy("context", "source").agg(F.max("seq").alias("source_end"))
    live = ops.filter("op = 'associate'").join(ended, TRIPLE, "left").join(left, ["context", "source"], "left")
    live = live.filter((F.col("seq") > F.coalesce("edge_end", F.lit(-1))) & (F.col("seq") > F.coalesce("source_end", F.lit(-1))))
    new = live.groupBy(*TRIPLE, "source").agg(F.sum("weight").alias("sum"), F.count("*").alias("count"))
    if state is None:
        return new
    kept = state.join(ended.select(*TRIPLE), TRIPLE, "left_anti").join(left.select("context", "source"), ["context", "source"], "left_anti")
    return kept.select(*STATE).union(new.select(*STATE)).groupBy(*TRIPLE, "source").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))


#: What ends shares of earlier batches: an edge, or all that a source said in a context.
ENDED = "context string, subject string, label string, object string, source string, batch long"
DELTA = "context string, subject string, label string, object string, source string, sum double, count long, batch long"
MARK = "watermark long"


class Fold:
    """Keeps the shares of a stream of ops under ``path``.

    A batch writes what it adds, what it ends and how far it came, and no more: a share
    stays as long as no later batch ends it.  Every ``every`` batches the whole state is
    written as one table, so that reading it never takes more than so many others.  What
    a batch writes has its number, and comes from the numbers before it, so a batch that
    runs again after a failure writes the same once more.  Ops at or below the watermark
    of the batch before are skipped.
    """

    def __init__(self, spark: SparkSession, path: str, every: int = 16):
        self.spark, self.path, self.every = spark, path, every

    def _read(self, name: str, schema: str, numbers: Iterable[int]) -> DataFrame:
        paths = [f"{self.path}/{name}-{n}" for n in numbers]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def version(self, number: int) -> DataFrame | None:
        """The shares after the batch of a number."""
        if number < 0:
            return None
        base = (number + 1) // self.every * self.every - 1
        if base == number:
            return self._read("state", DELTA, [base]).select(*STATE)
        return self._folded(base, number)

    def _folded(self, base: int, number: int) -> DataFrame:
        later = range(base + 1, number + 1)
        shares = self._read("delta", DELTA, later)
        if base >= 0:
            shares = shares.union(self._read("state", DELTA, [base]))
        ended = self._read("ended", ENDED, later)
        of_edges = ended.filter("subject IS NOT NULL").groupBy(*TRIPLE).agg(F.max("batch").alias("edge_end"))
        of_sources = ended.filter("subject IS NULL").groupBy("context", "source").agg(F.max("batch").alias("source_end"))
        live = shares.join(of_edges, TRIPLE, "left").join(of_sources, ["context", "source"], "left")
        live = live.filter((F.col("batch") >= F.coalesce("edge_end", F.lit(-1))) & (F.col("batch") >= F.coalesce("source_end", F.lit(-1))))
        return live.groupBy(*TRIPLE, "source").agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))

    def __call__(self, ops: DataFrame, number: int) -> None:
        before = self._read("mark", MARK, [number - 1] if number else [])
        mark = before.agg(F.max("watermark").alias("mark"))
        new = ops.crossJoin(F.broadcast(mark)).filter("mark IS NULL OR seq > mark").drop("mark")  # one row
        batch = F.lit(number).cast("long").alias("batch")
        none = F.lit(None).cast("string")
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{self.path}/{name}-{number}")
        put(merged(None, new).select(*STATE, batch), "delta")
        edges_ended = new.filter("op = 'retract_association'").select(*TRIPLE, none.alias("source"), batch)
        sources_ended = new.filter("op = 'retract_source'").select("context", *(none.alias(c) for c in TRIPLE[1:]), "source", batch)
        put(edges_ended.union(sources_ended).distinct(), "ended")
        if (number + 1) % self.every == 0:
            put(self._folded(number - self.every, number).select(*STATE, batch), "state")
        put(new.agg(F.max("seq").alias("top")).crossJoin(F.broadcast(mark)).select(F.greatest("top", "mark").cast("long").alias("watermark")), "mark")  # a batch is complete once it has this

    def start(self, ops: DataFrame, checkpoint: str) -> StreamingQuery:
        return ops.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edges(state: DataFrame) -> DataFrame:
    return state.groupBy(*TRIPLE).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"))


def coalesced(ops: DataFrame) -> DataFrame:
    """(context, seq, kind, n): one event for what a call adds, aliases likewise; each retraction its own."""
    grouped = {"associate": "associations_added", "alias": "aliases_added", "unalias": "aliases_removed"}
    kind = F.create_map(*(x for k, v in grouped.items() for x in (F.lit(k), F.lit(v))))
    many = ops.filter(F.col("op").isin(*grouped)).groupBy("context", "call", kind[F.col("op")].alias("kind")).agg(F.min("seq").alias("seq"), F.count("*").alias("n"))
    single = ops.filter(~F.col("op").isin(*grouped)).select("context", "seq", F.col("op").alias("kind"), F.lit(1).cast("long").alias("n"))
    return many.select("context", "seq", "kind", "n").union(single)


def feed(events: DataFrame, since: int | None, limit: int, ring: int = RING) -> DataFrame:
    """(context, seq, kind, stale): what came after a position, oldest first; ``stale`` where
    the ring has dropped some of it.  Without a position nothing but where the feed stands."""
    head = events.groupBy("context").agg(F.max("seq").alias("head"))
    if since is None:
        return head.select("context", F.col("head").alias("seq"), F.lit("position").alias("kind"), F.lit(False).alias("stale"))
    held = events.withColumn("back", F.row_number().over(Window.partitionBy("context").orderBy(F.desc("seq")))).filter(F.col("back") <= ring)
    oldest = held.groupBy("context").agg(F.min("seq").alias("oldest"), F.count("*").alias("kept"))
    rows = held.join(oldest, "context").filter(F.col("seq") > since)
    stale = (F.col("kept") == ring) & (F.col("oldest") > since + 1)
    place = F.row_number().over(Window.partitionBy("context").orderBy("seq"))
    return rows.select("context", "seq", "kind", stale.alias("stale"), place.alias("place")).filter(F.col("place") <= limit).drop("place")


def cursor(epoch: int, seq: int) -> str:
    """A position in a feed, opaque to who holds it."""
    return f"cf1-{epoch:016x}-{seq}"


def position(text: str) -> tuple[int, int] | None:
    """Epoch and place of a cursor, or None where it isn't one."""
    mark, _, rest = text.partition("-")
    epoch, _, seq = rest.partition("-")
    try:
        return (int(epoch, 16), int(seq)) if mark == "cf1" else None
    except ValueError:
        return None


def feed_page(events: DataFrame, context: str, epoch: int, since: str | None, limit: int, ring: int = RING) -> tuple[DataFrame | None, str | None, bool]:
    """The events of one context after a cursor, the next cursor, and whether there are more.
    Without a cursor nothing but where the feed stands; (None, None, False) where the cursor
    is of another epoch, lies ahead, or events after it are no longer kept."""
    own = events.filter(F.col("context") == context)
    head = own.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"), F.count("*").alias("n")).collect()[0]
    if since is None:
        return own.limit(0), cursor(epoch, head["head"]), False
    at = position(since)
    if at is None or at[0] != epoch or at[1] > head["head"]:
        return None, None, False
    kept = own.orderBy(F.desc("seq")).limit(ring)
    if head["n"] > ring and kept.agg(F.min("seq")).collect()[0][0] > at[1] + 1:
        return None, None, False
    rows = kept.filter(F.col("seq") > at[1]).orderBy("seq").limit(limit)
    last = rows.agg(F.max("seq")).collect()[0][0]
    served = at[1] if last is None else last
    return rows, cursor(epoch, served), served < head["head"]


def complete(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers of the tables of a name below a path that were written whole, in order."""
    made = spark._jvm.org.apache.hadoop.fs.Path
    files = made(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(made(path)):
        return []
    found = [f.getPath() for f in files.listStatus(made(path)) if f.getPath().getName().startswith(f"{name}-")]
    return sorted(int(p.getName().removeprefix(f"{name}-")) for p in found if files.exists(made(p, "_SUCCESS")))


def tail(source: Fold, target: str) -> int | None:
    """Lands the newest complete version of a fold as one table in ``target``, unless it is
    there, and drops those it takes the place of; readers of ``target`` take its newest
    complete table, so they see a whole version at any time.  The number of the version, or
    None where there is none."""
    spark = source.spark
    newest = complete(spark, source.path, "mark")
    if not newest:
        return None
    there = complete(spark, target, "state")
    if newest[-1] not in there:
        source.version(newest[-1]).write.mode("overwrite").parquet(f"{target}/state-{newest[-1]}")
    made = spark._jvm.org.apache.hadoop.fs.Path
    for old in there:
        if old < newest[-1]:
            where = made(f"{target}/state-{old}")
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    return newest[-1]
