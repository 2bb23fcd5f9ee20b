"""Registered queries of the text lane, entry, evidence, measures and streams, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from knotwork.functions import scalar
from knotwork.operators import catalog, entry, evaluate, evidence, extraction, fold, match, search, vectors
from knotwork.plans import graph_queries, tables
from knotwork.plans.stage import kept, new_path, staged
from knotwork.sources import documents, jsonl
from knotwork.streaming import oplog

FOUND: dict[str, tuple] = {}
#: Terms of a text: words, pairs of other letters, and parts of words in camel case.
TERMS = r"""list_concat(list_concat(
  regexp_extract_all(lower({0}), '[a-z0-9]+'),
  flatten(list_transform(regexp_extract_all(lower({0}), '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}\p{{M}}]+'),
    lambda r: CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: r[i:i+1]) END))),
  flatten(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'),
    lambda r: list_transform(string_split(regexp_replace(regexp_replace(r, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' '), lambda p: lower(p))), lambda ps: len(ps) > 1)))"""
BM25 = (
    r"""
tokens AS (SELECT source AS context, 'doc:' || doc_id AS source, 0 AS paragraph, lang, """ + TERMS.format("text") + r""" AS terms FROM documents WHERE regexp_matches(text, '\S')),
lengths AS (SELECT context, source, paragraph, lang, len(terms) AS length FROM tokens),
posted AS (SELECT source, paragraph, term, count(*) AS tf FROM (SELECT source, paragraph, unnest(terms) AS term FROM tokens) GROUP BY ALL),
carriers AS (SELECT term, count(*) AS carriers FROM posted GROUP BY term),
corpus AS (SELECT count(*) AS documents, greatest(avg(length), 1.0) AS mean FROM lengths),
asked AS (SELECT DISTINCT query, term FROM (SELECT CAST(item_id AS VARCHAR) AS query, unnest(""" + TERMS.format("text") + r""") AS term FROM benchmark)),
explained AS (
  SELECT query, term, source, paragraph, tf, carriers, ln(1 + (documents - carriers + 0.5) / (carriers + 0.5)) AS idf,
         ln(1 + (documents - carriers + 0.5) / (carriers + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean)) AS contribution
  FROM asked JOIN carriers USING (term) JOIN posted USING (term) JOIN lengths USING (source, paragraph), corpus),
scored AS (SELECT query, source, paragraph, round(sum(contribution), 6) AS score FROM explained GROUP BY ALL)
"""
)
#: Distinct names of which all pairs are compared; the supplied tables have 64.
NAMES = 2000
RANK = "CAST(row_number() OVER (PARTITION BY {0} ORDER BY score DESC, source, paragraph) AS INTEGER)"


def query(sql: str | None):
    def register(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return register


def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.paragraphs(tables.passages(spark, sf_dir), ["context", "source", "tags"])


def _index(spark: SparkSession, sf_dir: str) -> search.Index:
    """The index of the documents, built once for as long as their file doesn't change."""

    def build() -> dict[str, DataFrame]:
        tokens = staged(search.tokenized(_paragraphs(spark, sf_dir)), "tokens")
        return search.stored(staged(search.postings(tokens), "postings"), search.lengths(tokens))

    found = kept(spark, "index", [f"{sf_dir}/documents.parquet"], build, search.TABLES)
    return search.Index(found["postings"], found["carriers"], found["corpus"])


def _asked(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    """The terms of the benchmark's items, or of some of them, as queries."""
    rows = tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query"), "text")
    return search.query_terms(rows.filter(F.col("query").isin(*only)) if only else rows)


def _scores(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    return search.scores(_index(spark, sf_dir), _asked(spark, sf_dir, *only))


@query(r"""WITH c AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id),
p AS (SELECT conv_id, unnest(list_filter(list_transform(regexp_split_to_array(chr(10) || text || chr(10), '\n(?:[ \t\r\f\v]*\n)+'), lambda x: regexp_replace(x, '^\n+|\r?\n*\z', '', 'g')), lambda x: regexp_matches(x, '\S'))) AS text, generate_subscripts(list_filter(regexp_split_to_array(chr(10) || text || chr(10), '\n(?:[ \t\r\f\v]*\n)+'), lambda x: regexp_matches(x, '\S')), 1) AS i FROM c)
SELECT 'conv:' || conv_id AS source, CAST(i - 1 AS INTEGER) AS paragraph, text FROM p""")
def paragraph_split(spark, sf_dir):
    turns = tables.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    passages = turns.select(tables.named("conv", "conv_id").alias("source"), F.array_join(F.transform("turns", lambda t: t["text"]), "\n\n").alias("text"))
    return search.paragraphs(passages, ["source"])


@query("WITH " + BM25 + "SELECT source, paragraph, term, tf FROM posted")
def postings_build(spark, sf_dir):
    return _index(spark, sf_dir).postings.select("source", "paragraph", "term", "tf")


@query("WITH " + BM25 + f"SELECT * FROM (SELECT query, source, paragraph, score, {RANK.format('query')} AS rank FROM scored) WHERE rank <= 5")
def bm25_search(spark, sf_dir):
    return search.ranked(_scores(spark, sf_dir), 5)


@query("WITH " + BM25 + "SELECT query, term, source, paragraph, tf, carriers, round(idf, 6) AS idf, round(contribution, 6) AS contribution FROM explained WHERE query = '3'")
def bm25_explain(spark, sf_dir):
    out = search.explained(_index(spark, sf_dir), _asked(spark, sf_dir, "3"))
    return out.withColumns({"idf": F.round("idf", 6), "contribution": F.round("contribution", 6)})


@query("WITH " + BM25 + f"SELECT * FROM (SELECT query, source, paragraph, score, {RANK.format('query')} AS rank FROM scored JOIN lengths USING (source, paragraph) WHERE lang IN ('fr', 'de')) WHERE rank <= 5")
def bm25_filtered(spark, sf_dir):
    eligible = match.source_filter(tables.passages(spark, sf_dir), ["fr", "de"])
    return search.ranked(search.scores(_index(spark, sf_dir), _asked(spark, sf_dir), eligible), 5)


COSINE = "round(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))), 6)"
VECTORS = f"""
v AS (SELECT vec_id, 'doc:' || vec_id AS source, 0 AS paragraph, label, embedding::DOUBLE[] AS v FROM embeddings),
sense AS (SELECT CAST(a.vec_id AS VARCHAR) AS query, b.source, b.paragraph, {COSINE} AS score FROM v a, v b WHERE a.vec_id IN (SELECT item_id FROM benchmark))
"""


def _asked_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item asks with the vector of its number."""
    asked = tables.read(spark, sf_dir, "embeddings").join(tables.read(spark, sf_dir, "benchmark"), F.col("vec_id") == F.col("item_id"))
    return asked.select(F.col("item_id").cast("string").alias("query"), F.col("embedding").alias("vector"))


def _sense(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return vectors.nearest(tables.vectors(spark, sf_dir), _asked_vectors(spark, sf_dir), k)


@query("WITH " + VECTORS + f"SELECT * FROM (SELECT query, source, CAST(paragraph AS INTEGER) AS paragraph, score, {RANK.format('query')} AS rank FROM sense) WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    return search.ranked(_sense(spark, sf_dir, 10), 10)


@query("WITH " + BM25 + ", " + VECTORS + f""",
a AS (SELECT * FROM (SELECT query, source, paragraph, {RANK.format('query')} AS r FROM scored) WHERE r <= 50),
b AS (SELECT * FROM (SELECT query, source, paragraph, score, {RANK.format('query')} AS r FROM sense) WHERE r <= 50 AND score >= 0.2),
f AS (SELECT query, source, paragraph, round(coalesce(1.0 / (60 + a.r), 0.0) + coalesce(1.0 / (60 + b.r), 0.0), 9) AS score FROM a FULL OUTER JOIN b USING (query, source, paragraph))
SELECT * FROM (SELECT query, source, CAST(paragraph AS INTEGER) AS paragraph, score, {RANK.format('query')} AS rank FROM f) WHERE rank <= 5""")
def hybrid_rrf(spark, sf_dir):
    return search.fused(_scores(spark, sf_dir), _sense(spark, sf_dir, search.pool(5)), 5, 0.2)


@query("WITH " + BM25 + f""",
r AS (SELECT query, context, source, paragraph, score, {RANK.format('query, context')} AS rank, list_position(['src3', 'src0', 'src7'], context) AS target FROM scored JOIN lengths USING (source, paragraph) WHERE context IN ('src3', 'src0', 'src7'))
SELECT * FROM (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY rank, target) AS INTEGER) AS place, context, source, paragraph, score FROM r WHERE rank <= 6) WHERE place <= 6""")
def cross_passage_interleave(spark, sf_dir):
    where = tables.passages(spark, sf_dir).select("source", "context")
    return search.interleaved(_scores(spark, sf_dir).join(where, "source"), ["src3", "src0", "src7"], 6)


@query("WITH " + BM25 + f""",
r AS (SELECT query, source, paragraph, {RANK.format('query')} AS rank FROM scored),
q AS (SELECT '3' AS query, source, paragraph FROM lengths UNION ALL SELECT '4', source, 9 FROM lengths UNION ALL SELECT '3', 'doc:none', 0)
SELECT q.query, q.source, CAST(q.paragraph AS INTEGER) AS paragraph,
  CASE WHEN q.source NOT IN (SELECT source FROM lengths) THEN 'not_stored' WHEN q.paragraph > 0 THEN 'paragraph_out_of_range' WHEN rank IS NULL THEN 'no_term_overlap' WHEN rank > 100 THEN 'outranked' ELSE 'served' END AS verdict, rank
FROM q LEFT JOIN r USING (query, source, paragraph)""")
def search_verdicts(spark, sf_dir):
    """Of every paragraph for one query, of paragraphs that aren't there for another, and of a source that isn't stored."""
    known = _paragraphs(spark, sf_dir)
    places = known.select("source", "paragraph").distinct()
    asked = places.select(F.lit("3").alias("query"), "source", "paragraph").union(places.select(F.lit("4"), "source", F.lit(9)))
    asked = asked.union(spark.createDataFrame([("3", "doc:none", 0)], "query string, source string, paragraph int"))
    return search.verdicts(_scores(spark, sf_dir, "3", "4"), known, asked, 100)


@query("WITH " + BM25 + f""",
top AS (SELECT query, source, paragraph FROM (SELECT *, {RANK.format('query')} AS r FROM scored WHERE query IN ('3', '4')) WHERE r <= 5),
every AS (SELECT t.query, a.term, t.source, t.paragraph, coalesce(p.tf, 0) AS tf, coalesce(carriers, 0) AS carriers, length, documents, mean FROM top t JOIN asked a USING (query) LEFT JOIN carriers USING (term) LEFT JOIN posted p USING (term, source, paragraph) JOIN lengths l ON l.source = t.source AND l.paragraph = t.paragraph, corpus),
weighted AS (SELECT *, ln(1 + (documents - carriers + 0.5) / (carriers + 0.5)) AS w FROM every)
SELECT query, term, source, CAST(paragraph AS INTEGER) AS paragraph, tf, carriers, round(w, 6) AS idf, round(w * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / mean)), 6) AS contribution FROM weighted""")
def bm25_explain_places(spark, sf_dir):
    """Every asked term in the best five of two queries, also where it doesn't occur."""
    index, asked = _index(spark, sf_dir), _asked(spark, sf_dir, "3", "4")
    best = staged(search.ranked(search.scores(index, asked), 5).select("query", "source", "paragraph"), "best")
    out = search.explained_places(index, asked, best)
    return out.withColumns({"idf": F.round("idf", 6), "contribution": F.round("contribution", 6)})


@query("WITH " + BM25 + "SELECT source, paragraph, term, tf FROM posted")
def index_refresh(spark, sf_dir):
    """An index made when a tenth of the documents weren't there and others had another text, brought up to date."""
    now = tables.passages(spark, sf_dir).select("source", "text", F.xxhash64("text").alias("digest"))
    number = F.substring_index("source", ":", -1).cast("long")
    then = now.filter(number % 10 != 0).withColumn("text", F.when(number % 7 == 3, F.concat("text", F.lit(" as it was"))).otherwise(F.col("text"))).select("source", "text", F.xxhash64("text").alias("digest"))
    gone = spark.createDataFrame([("doc:gone", "a text that went", 0)], then.schema)
    tokenize = lambda rows: search.tokenized(search.paragraphs(rows, ["source"]))
    old = staged(tokenize(then.union(gone)), "tokens")
    posted, _ = search.refreshed(staged(search.postings(old), "postings"), search.lengths(old), then.union(gone), now, tokenize)
    return posted.select("source", "paragraph", "term", "tf")


@query(None)
def vector_ivf(spark, sf_dir):
    """``vector_topk`` by probing lists, whatever the number of vectors."""
    index = vectors.inverted(tables.vectors(spark, sf_dir))
    return search.ranked(vectors.nearest_by_lists(index, _asked_vectors(spark, sf_dir), 10), 10)


@query("SELECT 'bm25' AS lane, true AS ran, NULL::VARCHAR AS reason UNION ALL SELECT 'vector', false, 'width_changed'")
def search_plan(spark, sf_dir):
    """The lanes of a search whose vectors have another width than the stored ones."""
    width = tables.read(spark, sf_dir, "embeddings").select(F.size("embedding")).first()[0]
    return search.lanes_run(spark, search.plan(5, "some words", True, ("model", width), ("model", width + 1)))


SPELLED = "spelled AS (SELECT DISTINCT p_name AS name, p_name AS norm FROM part UNION SELECT n_name, lower(n_name) FROM nation UNION SELECT 'small ring', 'tiny loop')"


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.read(spark, sf_dir, "part").select(F.col("p_name").alias("subject"), F.lit("is").alias("label"), F.col("p_name").alias("object")).union(tables.read(spark, sf_dir, "nation").select("n_name", F.lit("is"), F.col("n_name")))
    aliases = spark.createDataFrame([("concept", "tiny loop", "small ring")], "kind string, alias string, canonical string")
    return entry.spellings(names, aliases)


GRAMS = "grams AS (SELECT name, norm, unnest(list_distinct(list_transform(range(1, length(norm)), lambda i: norm[i:i+1]))) AS gram FROM spelled), stops AS (SELECT gram FROM grams GROUP BY gram HAVING count(*) > (SELECT greatest(64, count(*) // 20) FROM spelled)), informative AS (SELECT * FROM grams WHERE gram NOT IN (SELECT gram FROM stops)), sizes AS (SELECT name, norm, count(*) AS size FROM informative GROUP BY ALL)"


@query(f"WITH {SPELLED}, {GRAMS} SELECT a, b, round(max(2.0 * k / (na + nb)), 9) AS score FROM (SELECT x.name AS a, y.name AS b, x.norm, y.norm, count(*) AS k, any_value(sx.size) AS na, any_value(sy.size) AS nb FROM informative x JOIN informative y ON x.gram = y.gram AND x.name < y.name JOIN sizes sx ON sx.name = x.name AND sx.norm = x.norm JOIN sizes sy ON sy.name = y.name AND sy.norm = y.norm GROUP BY x.name, y.name, x.norm, y.norm) GROUP BY a, b HAVING max(2.0 * k / (na + nb)) >= 0.6")
def lexical_twins(spark, sf_dir):
    return entry.twins(staged(_spelled(spark, sf_dir), "spellings")).withColumn("score", F.round("score", 9))


CUES = ("blue ring", "Small Ring", "tiny loop", "smal rnig", "ring")


@query(f"""WITH {SPELLED}, {GRAMS}, cues AS (SELECT cue, lower(cue) AS needle FROM (VALUES {', '.join(f"('{c}')" for c in CUES)}) v(cue) UNION SELECT name, lower(name) FROM spelled),
direct AS (SELECT cue, name, norm, CASE WHEN norm = needle THEN 1.0::DOUBLE ELSE least(length(norm), length(needle)) / greatest(length(norm), length(needle)) END AS score,
  CASE WHEN norm <> needle THEN 'containment' WHEN lower(name) = needle THEN 'exact' ELSE 'alias' END AS kind FROM spelled, cues WHERE contains(norm, needle) OR contains(needle, norm)),
asked AS (SELECT cue, gram FROM (SELECT cue, unnest(list_distinct(list_transform(range(1, length(needle)), lambda i: needle[i:i+1]))) AS gram FROM cues) WHERE gram NOT IN (SELECT gram FROM stops)),
fuzzy AS (SELECT cue, i.name, i.norm, 2.0 * count(*) / (any_value(n) + any_value(size)) AS score FROM asked JOIN informative i USING (gram) JOIN (SELECT cue, count(*) AS n FROM asked GROUP BY cue) c USING (cue) JOIN sizes USING (name, norm)
  WHERE cue NOT IN (SELECT cue FROM direct WHERE score = 1.0) AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.cue = asked.cue AND d.name = i.name AND d.norm = i.norm) GROUP BY cue, i.name, i.norm),
every AS (SELECT cue, name, score, kind FROM direct UNION ALL SELECT cue, name, score, 'fuzzy' FROM fuzzy WHERE score >= 0.3)
SELECT cue, name, round(score, 9) AS score, kind FROM every QUALIFY row_number() OVER (PARTITION BY cue, name ORDER BY score DESC, list_position(['exact', 'alias', 'containment', 'fuzzy'], kind)) = 1""")
def resolve_tiers(spark, sf_dir):
    """Some wordings, and every name there is."""
    spelled = staged(_spelled(spark, sf_dir), "spellings")
    cues = spelled.select(F.col("name").alias("cue")).union(spark.createDataFrame([(c,) for c in CUES], "cue string"))
    return entry.resolve_all(spelled, cues).withColumn("score", F.round("score", 9))


@query(f"WITH {SPELLED} SELECT DISTINCT 'zzz' AS name, 'not_in_vocabulary' AS verdict, NULL::DOUBLE AS score, NULL::INTEGER AS rank FROM spelled UNION ALL SELECT 'small ring', 'served', 1.0, 1")
def explain_resolve(spark, sf_dir):
    spelled = staged(_spelled(spark, sf_dir), "spellings")
    return entry.explained(spelled, "small ring", "zzz", 5).union(entry.explained(spelled, "small ring", "small ring", 5))


@query(f"WITH v AS (SELECT 'vec:' || vec_id AS name, vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT * FROM (SELECT b.name, {COSINE} AS score FROM v a, v b WHERE a.vec_id = 0) WHERE score >= 0.35 ORDER BY score DESC, name LIMIT 5")
def semantic_resolve(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "embeddings").select(tables.named("vec", "vec_id").alias("name"), "vec_id", F.col("embedding").alias("vector"))
    return entry.semantic_resolve(rows, rows.filter("vec_id = 0")).withColumn("score", F.round("score", 6))


LANES = f"""lanes AS (SELECT query, 'bm25' AS lane, source AS item, {RANK.format('query')} AS rank FROM scored UNION ALL SELECT query, 'vector', source, {RANK.format('query')} FROM sense),
best AS (SELECT query, item, lane, min(rank) AS rank FROM lanes WHERE rank <= 50 GROUP BY ALL)"""


@query("WITH " + BM25 + ", " + VECTORS + ", " + LANES + """,
t AS (SELECT item, unnest(list_distinct(list_transform(range(1, length(text)), lambda i: text[i:i+1]))) AS gram FROM (SELECT 'doc:' || doc_id AS item, text FROM documents)),
n AS (SELECT item, count(*) AS n FROM t GROUP BY item),
g AS (SELECT DISTINCT query, item FROM best),
k AS (SELECT query, a, b, count(*) AS k FROM (SELECT x.query, x.item AS a, y.item AS b FROM g x JOIN g y ON x.query = y.query AND x.item < y.item) JOIN t p ON p.item = a JOIN t q ON q.item = b AND q.gram = p.gram GROUP BY ALL)
SELECT query, a, b, round(2.0 * k / (na.n + nb.n), 9) AS score FROM k JOIN n na ON na.item = a JOIN n nb ON nb.item = b WHERE 2.0 * k / (na.n + nb.n) >= 0.9""")
def near_dup_pairs(spark, sf_dir):
    """Within the pool of each query."""
    texts = tables.passages(spark, sf_dir).select(F.col("source").alias("item"), "text")
    pool = staged(_lanes(spark, sf_dir).select("query", "item").distinct().join(texts, "item"), "pool")
    return evidence.near_pairs(pool).select("query", "a", "b", F.round("score", 9).alias("score"))


@query("WITH " + BM25 + ", " + VECTORS + ", " + LANES + """
SELECT query, 'passage' AS kind, item, round(sum(1.0 / (60 + rank)), 9) AS score, list_sort(list(lane)) AS lanes FROM best GROUP BY query, item""")
def evidence_fuse(spark, sf_dir):
    return evidence.fuse(_lanes(spark, sf_dir))


def _lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    most = search.pool(search.LIMIT)
    lane = lambda df, name: search.ranked(df, most).select("query", F.lit(name).alias("lane"), F.lit("passage").alias("kind"), F.col("source").alias("item"), "rank")
    return lane(_scores(spark, sf_dir), "bm25").union(lane(_sense(spark, sf_dir, most), "vector"))


SAID = """said AS (SELECT CAST(item_id AS VARCHAR) AS query, 'doc:' || doc_id AS subject, label, object FROM (
  SELECT doc_id, 'written_in' AS label, 'lang:' || lang AS object FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'comes_from', source FROM documents WHERE source IS NOT NULL) JOIN benchmark ON doc_id IN (item_id, item_id + 1)),
ranks AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY subject, label, object) AS INTEGER) AS rank FROM said)"""


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query, subject, label, object, rank): what the graph says of the document of each item's number and of the next."""
    items = tables.read(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array(F.col("item_id"), F.col("item_id") + 1)).alias("doc"))
    rows = tables.writings(spark, sf_dir).join(items.withColumn("subject", tables.named("doc", "doc")), "subject")
    place = F.row_number().over(Window.partitionBy("query").orderBy("subject", "label", "object"))
    return rows.select(F.col("item_id").cast("string").alias("query"), "subject", "label", "object").withColumn("rank", place)


@query("WITH " + BM25 + ", " + VECTORS + ", " + LANES + ", " + SAID + """,
every AS (SELECT query, 'passage' AS kind, item, lane, rank FROM best UNION ALL SELECT query, 'association', concat_ws(' | ', subject, label, object), 'graph_query', rank FROM ranks)
SELECT query, kind, item, round(sum(1.0 / (60 + rank)), 9) AS score, list_sort(list(lane)) AS lanes FROM every GROUP BY query, kind, item""")
def evidence_assemble(spark, sf_dir):
    """Passages of both lanes and facts of the graph, fused."""
    return evidence.fuse(_lanes(spark, sf_dir).union(evidence.graph_lane(_said(spark, sf_dir), "graph_query")))


@query(None)
def evidence_select(spark, sf_dir):
    """Facts of a subject and label as one group, passages on their own."""
    said = staged(_said(spark, sf_dir), "said")
    texts = tables.passages(spark, sf_dir).select(F.col("source").alias("item"), F.col("context").alias("source"), "text", F.lit(None).cast("string").alias("group"))
    fused = staged(evidence.fuse(_lanes(spark, sf_dir).union(evidence.graph_lane(said, "graph_query"))), "fused")
    pool = fused.filter("kind = 'passage'").join(texts, "item").select("query", "kind", "item", "source", "text", "score", "group")
    facts = fused.join(evidence.association_items(said), ["query", "kind", "item"]).select("query", "kind", "item", "source", "text", "score", "group")
    return evidence.selected(pool.union(facts))


@query("WITH " + BM25 + f""",
hits AS (SELECT query, source AS item, {RANK.format('query')} AS rank FROM scored),
want AS (SELECT CAST(item_id AS VARCHAR) AS query, 'doc:' || doc_id AS item, quality + 1 AS relevance FROM benchmark JOIN labels ON doc_id % (SELECT count(*) FROM benchmark) = item_id),
met AS (SELECT w.query, w.item, relevance, rank FROM want w LEFT JOIN (SELECT * FROM hits WHERE rank <= 50) h USING (query, item)),
ideal AS (SELECT query, sum(relevance / log2(p + 1)) AS ideal FROM (SELECT query, relevance, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, item) AS p FROM want) GROUP BY query)
SELECT query, round(count(rank) / count(*), 9) AS recall, round(coalesce(1.0 / min(rank), 0.0), 9) AS reciprocal, round(least(coalesce(sum(relevance / log2(rank + 1)) / any_value(ideal), 0.0), 1.0), 9) AS ndcg FROM met JOIN ideal USING (query) GROUP BY query""")
def eval_metrics(spark, sf_dir):
    hits = search.ranked(_scores(spark, sf_dir), 50).select("query", F.col("source").alias("item"), "rank")
    items = tables.read(spark, sf_dir, "benchmark").select("item_id")
    n = items.agg(F.count("*").alias("n"))
    graded = tables.read(spark, sf_dir, "labels").crossJoin(F.broadcast(n))  # one row
    want = graded.join(items, F.col("doc_id") % F.col("n") == F.col("item_id")).select(F.col("item_id").cast("string").alias("query"), tables.named("doc", "doc_id").alias("item"), (F.col("quality") + 1).alias("relevance"))
    out = evaluate.retrieval(hits, want, 50)
    return out.select("query", *(F.round(c, 9).alias(c) for c in ("recall", "reciprocal", "ndcg")))


@query("WITH " + BM25 + f""",
hits AS (SELECT query, source AS item, {RANK.format('query')} AS rank FROM scored),
want AS (SELECT CAST(item_id AS VARCHAR) AS query, 'doc:' || doc_id AS item, quality + 1 AS relevance FROM benchmark JOIN labels ON doc_id % (SELECT count(*) FROM benchmark) = item_id),
met AS (SELECT w.query, w.item, rank FROM want w LEFT JOIN (SELECT * FROM hits WHERE rank <= 50) h USING (query, item)),
cases AS (SELECT query, count(rank) / count(*) AS recall, coalesce(1.0::DOUBLE / min(rank), 0.0) AS reciprocal FROM met GROUP BY query),
long AS (SELECT 'recall' AS metric, recall AS v FROM cases UNION ALL SELECT 'reciprocal', reciprocal FROM cases),
r AS (SELECT metric, v, row_number() OVER (PARTITION BY metric ORDER BY v) AS i, count(*) OVER (PARTITION BY metric) AS n FROM long)
SELECT metric, max(n) AS n, round(min(v), 9) AS min, round(min(v) FILTER (WHERE i >= ceil(50 * n / 100)), 9) AS p50, round(min(v) FILTER (WHERE i >= ceil(90 * n / 100)), 9) AS p90, round(max(v), 9) AS max, round(avg(v), 6) AS mean FROM r GROUP BY metric""")
def eval_summary(spark, sf_dir):
    out = evaluate.summary(staged(eval_metrics(spark, sf_dir), "cases"), ["recall", "reciprocal"])
    return out.select("metric", "n", *(F.round(c, 9).alias(c) for c in ("min", "p50", "p90", "max")), F.round("mean", 6).alias("mean"))


@query("""WITH s AS (SELECT event_type AS what, event_id AS rows, value * 2 + event_id * 3.0 AS amount FROM events),
l AS (SELECT what, regr_slope(amount, rows) AS slope, regr_intercept(amount, rows) AS base FROM s GROUP BY what)
SELECT what, 1000000::BIGINT AS rows, round(base + slope * 1000000, 3) AS amount FROM l""")
def capacity_fit(spark, sf_dir):
    """What a million rows need, by samples that grow with their number."""
    samples = tables.read(spark, sf_dir, "events").select(F.col("event_type").alias("what"), F.col("event_id").alias("rows"), (F.col("value") * 2 + F.col("event_id") * 3.0).alias("amount"))
    wanted = samples.select("what").distinct().withColumn("rows", F.lit(1_000_000).cast("long"))
    return evaluate.capacity(samples, wanted).withColumn("amount", F.round("amount", 3))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE isfinite(value))
SELECT event_type, max(n) AS n, min(value) AS min, min(value) FILTER (WHERE i >= ceil(50 * n / 100)) AS p50, min(value) FILTER (WHERE i >= ceil(90 * n / 100)) AS p90, min(value) FILTER (WHERE i >= ceil(99 * n / 100)) AS p99, max(value) AS max, round(avg(value), 6) AS mean, round(sum(value), 4) AS total FROM r GROUP BY event_type""")
def distribution_nearest_rank(spark, sf_dir):
    out = evaluate.distribution(tables.read(spark, sf_dir, "events"), "value", ["event_type"])
    return out.withColumns({"mean": F.round("mean", 6), "total": F.round("total", 4)})


@query("SELECT event_type, count(*) FILTER (WHERE value > 20) / count(*) AS value, count(*) AS n FROM events GROUP BY event_type")
def ratio_metric(spark, sf_dir):
    return evaluate.ratio(tables.read(spark, sf_dir, "events").withColumn("hit", F.col("value") > 20), "hit", ["event_type"])


@query("""WITH b AS (SELECT CAST(doc_id AS VARCHAR) AS case_id, n_chars / 100.0 AS v FROM documents), r AS (SELECT CAST(doc_id AS VARCHAR) AS case_id, n_chars / 110.0 AS v FROM documents JOIN labels USING (doc_id))
SELECT case_id, round(b.v, 6) AS base, round(r.v, 6) AS run, round(r.v - b.v, 6) AS delta, CASE WHEN r.v IS NULL THEN 'skipped' WHEN r.v < CASE case_id WHEN '4' THEN 1e9 ELSE 5.0 END THEN 'failed' ELSE 'passed' END AS verdict FROM b FULL OUTER JOIN r USING (case_id)""")
def eval_compare(spark, sf_dir):
    rows = tables.read(spark, sf_dir, "documents")
    run = lambda df, by: df.select(F.col("doc_id").cast("string").alias("case_id"), (F.col("n_chars") / by).alias("recall"))
    out = evaluate.compared(run(rows, 100.0), run(rows.join(tables.read(spark, sf_dir, "labels"), "doc_id"), 110.0), "recall", {"4": 1e9}, 5.0)
    return out.select("case_id", *(F.round(c, 6).alias(c) for c in ("base", "run", "delta")), "verdict")


@query("SELECT doc_id, CAST(ceil((length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) + 4 * (length(text) - length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')))) / 4) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", scalar.tokens_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[。!?！？\\n]'), lambda s: trim(s)), lambda s: s <> '') AS sentences FROM documents")
def sentence_split(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", scalar.sentences(F.col("text")).alias("sentences"))


@query("SELECT doc_id, list_sort(list_filter(list_distinct(list_transform(regexp_extract_all(text, '[A-Za-z0-9\\-._/+#一-龯々ァ-ヶー]+'), lambda r: regexp_replace(r, '^[\\-._/+#]+|[\\-._/+#]+$', '', 'g'))), lambda r: length(r) >= 2 AND NOT regexp_full_match(r, '[0-9]+') AND strlen(r) <= 64)) AS terms FROM documents")
def candidate_terms(spark, sf_dir):
    return tables.read(spark, sf_dir, "documents").select("doc_id", F.sort_array(scalar.candidate_terms(F.col("text"), 1_000_000)).alias("terms"))


PAIRS = "list_transform(range(1, length({0})), lambda i: {0}[i:i+1])"


@query(f"""WITH n AS (SELECT DISTINCT p_name, {PAIRS.format('p_name')} AS g FROM part)
SELECT a.p_name AS a, b.p_name AS b, round(2.0 * len(list_intersect(a.g, b.g)) / (len(list_distinct(a.g)) + len(list_distinct(b.g))), 9) AS dice, round(least(length(a.p_name), length(b.p_name)) / greatest(length(a.p_name), length(b.p_name)), 9) AS containment,
  round(2.0 * coalesce(list_sum(list_transform(list_intersect(a.g, b.g), lambda p: least(len(list_filter(a.g, lambda q: q = p)), len(list_filter(b.g, lambda q: q = p))))), 0) / (len(a.g) + len(b.g)), 9) AS multiset FROM n a, n b""")
def name_similarity(spark, sf_dir):
    """All pairs of at most ``NAMES`` distinct names; more are refused."""
    names = tables.read(spark, sf_dir, "part")
    a = staged(names.select(F.col("p_name").alias("a")).distinct(), "names")
    if a.limit(NAMES + 1).count() > NAMES:
        raise ValueError(f"more than {NAMES} names: all pairs are compared")
    both = a.crossJoin(a.select(F.col("a").alias("b")))
    return both.select("a", "b", F.round(scalar.dice(scalar.bigrams(F.col("a")), scalar.bigrams(F.col("b"))), 9).alias("dice"), F.round(scalar.containment(F.col("a"), F.col("b")), 9).alias("containment"), F.round(scalar.multiset_dice(F.col("a"), F.col("b")), 9).alias("multiset"))


@query("""SELECT p_name AS name, lower(lpad(hex(CAST(list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, length(p_name) + 1), lambda i: CAST(ascii(p_name[i]) AS UHUGEINT))),
  lambda h, b: (CAST(xor(CAST(h AS UBIGINT), CAST(b AS UBIGINT)) AS UHUGEINT) * 1099511628211) % 18446744073709551616) AS UBIGINT)), 16, '0')) AS hash FROM (SELECT DISTINCT p_name FROM part)""")
def fnv_hash(spark, sf_dir):
    return tables.read(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().select("name", scalar.fnv1a_hex(F.col("name")).alias("hash"))


@query("""WITH i AS (SELECT p_partkey % 10 AS shelf, strlen('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}') AS bytes FROM part) SELECT shelf, CAST(sum(bytes) + 2 + greatest(count(*) - 1, 0) AS BIGINT) AS bytes FROM i GROUP BY shelf""")
def json_size(spark, sf_dir):
    """Bytes of arrays of parts as JSON."""
    rows = tables.read(spark, sf_dir, "part").select((F.col("p_partkey") % 10).alias("shelf"), scalar.json_bytes(F.struct("p_partkey", "p_name")).cast("long").alias("bytes"))
    return rows.groupBy("shelf").agg(F.sum("bytes").alias("sum"), F.count("*").alias("n")).select("shelf", scalar.json_array_bytes(F.col("sum"), F.col("n")).alias("bytes"))


@query(r"""WITH b AS (SELECT item_id, text, (SELECT count(*) FROM benchmark) AS n FROM benchmark), p AS (SELECT d.doc_id, '  ' || substr(CASE WHEN doc_id % 2 = 0 THEN b.text ELSE d.text END, 4, 25) AS quote, d.text FROM documents d JOIN b ON d.doc_id % b.n = b.item_id)
SELECT doc_id, contains(lower(regexp_replace(text, '\A\s+|\s+\z', '', 'g')), lower(regexp_replace(quote, '\A\s+|\s+\z', '', 'g'))) AS found FROM p""")
def quote_match(spark, sf_dir):
    """Whether a document holds a quote, its own or one of a benchmark's item."""
    items = tables.read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    docs = tables.read(spark, sf_dir, "documents").crossJoin(F.broadcast(items.agg(F.count("*").alias("n"))))  # one row
    rows = docs.join(items, F.col("doc_id") % F.col("n") == F.col("item_id"))
    quote = F.concat(F.lit("  "), F.substring(F.when(F.col("doc_id") % 2 == 0, F.col("item")).otherwise(F.col("text")), 4, 25))
    return rows.select("doc_id", extraction.quote_matches(quote, F.col("text")).alias("found"))


@query(None)
def coverage_gaps(spark, sf_dir):
    """Sentences that hold candidate terms but neither language nor origin of their document."""
    triples = tables.writings(spark, sf_dir).select("source", "subject", "label", "object").withColumn("source", F.col("subject"))
    return extraction.coverage_gaps(tables.passages(spark, sf_dir), triples)


@query(None)
def semantic_cache(spark, sf_dir):
    """Items of the benchmark as questions that others of them may answer."""
    asked = _asked_vectors(spark, sf_dir).join(tables.read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query"), "text"), "query")
    cached = asked.filter(F.col("query").cast("long") % 2 == 0)
    near = vectors.nearest(cached.select(F.col("query").alias("source"), F.lit(0).alias("paragraph"), "vector"), asked.select("query", "vector"), 3)
    return search.from_cache(near, asked, cached.select(F.col("query").alias("entry"), "text"), 0.1)


@query("""WITH m AS (SELECT 'conv:' || conv_id AS source, CAST(turn AS INTEGER) AS paragraph, text, CASE WHEN turn % 3 = 0 THEN role || turn END AS section, 'turn ' || turn AS locator FROM conversations),
g AS (SELECT *, last_value(section IGNORE NULLS) OVER (PARTITION BY source ORDER BY paragraph) AS governing FROM m)
SELECT source, paragraph, text, governing AS section, locator, 'ok' AS verdict FROM g UNION ALL SELECT source, paragraph + 1000, NULL, NULL, NULL, 'index_out_of_range' FROM m UNION ALL SELECT 'none', 0, NULL, NULL, NULL, 'unknown_source'""")
def citations(spark, sf_dir):
    """Every turn of the conversations, as many that aren't there, and one of no source."""
    turns = tables.read(spark, sf_dir, "conversations").select(
        tables.named("conv", "conv_id").alias("source"), F.col("turn").cast("int").alias("paragraph"), "text", F.when(F.col("turn") % 3 == 0, F.concat("role", F.col("turn").cast("string"))).alias("section"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("locator")
    )
    wanted = turns.select("source", "paragraph").union(turns.select("source", F.col("paragraph") + 1000)).union(spark.createDataFrame([("none", 0)], "source string, paragraph int"))
    return search.cited(turns, wanted)


@query("SELECT 'events' AS context, event_id AS seq, CASE event_type WHEN 'error' THEN 'retract_association' WHEN 'signup' THEN 'retract_source' ELSE 'associate' END AS kind, (SELECT count(*) >= 1024 AND max(event_id) - 1023 > 11 FROM events) AS stale FROM events WHERE event_id > 10 AND event_id > (SELECT max(event_id) FROM events) - 1024 ORDER BY event_id LIMIT 100")
def change_feed_page(spark, sf_dir):
    events = graph_queries.event_ops(spark, sf_dir).select("context", "seq", F.col("op").alias("kind"))
    return oplog.feed(events, 10, 100)


@query("WITH " + graph_queries.OPS + "SELECT 'events' AS context, min(seq) AS seq, 'associations_added' AS kind, count(*) AS n FROM ops WHERE op = 'associate' GROUP BY seq // 4 UNION ALL SELECT 'events', seq, op, 1 FROM ops WHERE op <> 'associate'")
def coalesced_events(spark, sf_dir):
    return oplog.coalesced(graph_queries.event_ops(spark, sf_dir))


@query("WITH " + graph_queries.OPS + "SELECT subject, label, object, sum, count FROM folded WHERE count > 0")
def stream_fold(spark, sf_dir):
    """The op log as a stream of four files, folded batch by batch."""
    ops = graph_queries.event_ops(spark, sf_dir)
    path, total = new_path(spark, "stream"), ops.agg(F.max("seq")).collect()[0][0] or 0
    step = total // 4 + 1
    for part in range(4):
        ops.filter(F.floor(F.col("seq") / step) == part).coalesce(1).write.mode("append").parquet(f"{path}/ops")
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/ops")
    state = oplog.Fold(spark, f"{path}/state")
    run = state.start(stream, f"{path}/checkpoint")
    run.awaitTermination()
    last = run.lastProgress["batchId"] if run.lastProgress else 3
    return oplog.edges(state.version(last)).select("subject", "label", "object", "sum", "count")


@query("SELECT source AS case_id, count(l.doc_id) / count(*) AS covered, count(*) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY source")
def eval_coverage(spark, sf_dir):
    """The share of each origin's documents that are labelled."""
    rows = tables.read(spark, sf_dir, "documents").select(F.col("source").alias("case_id"), "doc_id")
    return evaluate.coverage(rows, rows.join(tables.read(spark, sf_dir, "labels"), "doc_id", "left_semi"), ["doc_id"])


@query("SELECT 'conv:' || conv_id AS source, CAST(turn AS INTEGER) AS paragraph, last_value(CASE WHEN turn % 3 = 0 THEN role || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations")
def section_fill(spark, sf_dir):
    marks = tables.read(spark, sf_dir, "conversations").select(tables.named("conv", "conv_id").alias("source"), F.col("turn").cast("int").alias("paragraph"), F.when(F.col("turn") % 3 == 0, F.concat("role", F.col("turn").cast("string"))).alias("section"))
    return search.governed(marks)


@query("""WITH p AS (SELECT label AS probe, max(vec_id / 1000.0) FILTER (WHERE vec_id % 2 = 0) + 0.9 AS hit, max(vec_id / 1000.0) FILTER (WHERE vec_id % 2 = 1) AS miss FROM embeddings GROUP BY label),
b AS (SELECT min(hit) AS upper, max(miss) AS lower, (min(hit) + max(miss)) / 2 AS middle FROM p)
SELECT round(upper, 6) AS upper, round(lower, 6) AS lower, round(CASE WHEN upper > lower THEN CASE WHEN round(middle, 2) > lower AND round(middle, 2) < upper THEN round(middle, 2) ELSE middle END END, 6) AS floor FROM b""")
def semantic_floor(spark, sf_dir):
    """Numbers of vectors as scores, those of expected names raised above the others."""
    expected = F.col("vec_id") % 2 == 0
    probes = tables.read(spark, sf_dir, "embeddings").select(F.col("label").alias("probe"), expected.alias("expected"), (F.col("vec_id") / 1000.0 + F.when(expected, 0.9).otherwise(0.0)).alias("score"))
    return entry.calibrated_floor(probes).select(*(F.round(c, 6).alias(c) for c in ("upper", "lower", "floor")))


@query(r"""WITH t AS (SELECT item_id, text, lower(text) AS low, list_filter(string_split_regex(text, '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
m AS (SELECT item_id, list_transform(['no', 'not', 'never', 'none', 'neither', 'nor', 'without', 'cannot', 'non'], lambda n: len(list_filter(w, lambda x: lower(x) = n))) AS words,
  list_transform(['n''t', 'ない', 'ません', 'なかった', 'せず', '不', '無'], lambda p: (length(low) - length(replace(low, p, ''))) / length(p)) AS parts, list_sort(regexp_extract_all(text, '\p{N}+')) AS numbers,
  list_sort(list_transform(list_filter(w, lambda x, i: regexp_matches(x, '\p{Lu}') AND (i > 1 OR (length(x) > 1 AND regexp_full_match(x, '\p{Lu}+')))), lambda x: lower(x))) AS names FROM t)
SELECT a.item_id AS a, a.words = b.words AND a.parts = b.parts AND a.numbers = b.numbers AND a.names = b.names AS agree FROM m a JOIN m b ON b.item_id = a.item_id + 1""")
def semantic_guard(spark, sf_dir):
    """Each benchmark item with the next: alike in what they deny, count and name?"""
    asked = tables.read(spark, sf_dir, "benchmark")
    pairs = asked.select(F.col("item_id").alias("a"), F.col("text").alias("ta")).join(asked.select((F.col("item_id") - 1).alias("a"), F.col("text").alias("tb")), "a")
    return pairs.select("a", scalar.questions_agree(F.col("ta"), F.col("tb")).alias("agree"))


UNESCAPED = "replace(replace(replace(replace(replace(replace(replace({0}, '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"


@query(r"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<script[^>]*>.*?</script>', '', 'g'), '(?s)<style[^>]*>.*?</style>', '', 'g'), '(?s)<nav[^>]*>.*?</nav>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS h FROM pages),
m AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '<h[1-6][^>]*>', chr(1) || chr(2), 'g'), '<title[^>]*>', chr(1) || chr(3), 'g'),
  '</?(?:p|li|td|th|blockquote|pre|div|article|section|br|tr|ul|ol|table|body|figcaption|dd|dt|title|h[1-6])(?:[ /][^>]*)?>', chr(1), 'g'), '<[^>]*>', '', 'g') AS h FROM c),
b AS (SELECT page_id, generate_subscripts(string_split(h, chr(1)), 1) AS i, unnest(string_split(h, chr(1))) AS x FROM m),
k AS (SELECT page_id, i, CASE WHEN x LIKE chr(2) || '%' THEN 'head' WHEN x LIKE chr(3) || '%' THEN 'title' ELSE 'text' END AS kind, trim(regexp_replace(""" + UNESCAPED.format("x") + r""", '[\s\x02\x03\xA0]+', ' ', 'g')) AS text FROM b),
f AS (SELECT *, last_value(CASE WHEN kind = 'head' THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY i) AS section FROM k WHERE text <> ''),
t AS (SELECT page_id, arg_min(text, i) AS title FROM f WHERE kind = 'title' GROUP BY page_id)
SELECT page_id, coalesce(title, '') AS title, NULL::VARCHAR AS canonical, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS paragraph, section, text FROM f LEFT JOIN t USING (page_id) WHERE kind = 'text'""")
def html_paragraphs(spark, sf_dir):
    return documents.html_paragraphs(tables.read(spark, sf_dir, "pages"))


SYMBOLS = """names AS (SELECT DISTINCT CASE WHEN p_partkey % 4 = 3 THEN 'src/tests/' ELSE 'src/' END || 'file' || (p_partkey % 9) || '.py' AS path, CASE WHEN p_partkey % 5 = 0 THEN 'test_' ELSE '' END || replace(p_name, ' ', '_') AS tail FROM part),
every AS (SELECT path || '::' || tail AS name, tail, path LIKE '%/tests/%' OR tail LIKE 'test\\_%' ESCAPE '\\' AS test FROM names UNION SELECT path, path, path LIKE '%/tests/%' FROM names)"""
FOUND_CUES = ("blue_ring", "ring", "blue", "src/file3.py", "file3.py", "file3.py::blue_ring", "bleu_rnig", "test_blue")


@query("WITH " + SYMBOLS + f""", cues AS (SELECT unnest([{', '.join(f"'{c}'" for c in FOUND_CUES)}]) AS cue),
direct AS (SELECT cue, name, test, CASE WHEN NOT contains(name, '::') THEN CASE WHEN name = cue OR string_split(name, '/')[-1] = cue THEN 4 END WHEN tail = cue THEN 0 WHEN contains(cue, '::') AND (ends_with(name, '::' || cue) OR ends_with(name, '/' || cue) OR name = cue) THEN 1 WHEN starts_with(tail, cue) THEN 2 WHEN contains(tail, cue) THEN 3 END AS t, 1.0::DOUBLE AS score FROM every, cues),
pairs AS (SELECT cue, name, test, {PAIRS.format('cue')} AS x, {PAIRS.format('tail')} AS y FROM every, cues WHERE contains(name, '::') AND cue NOT IN (SELECT cue FROM direct WHERE t IS NOT NULL)),
alike AS (SELECT cue, name, test, 5 AS t, 2.0 * coalesce(list_sum(list_transform(list_intersect(x, y), lambda p: least(len(list_filter(x, lambda q: q = p)), len(list_filter(y, lambda q: q = p))))), 0) / (len(x) + len(y)) AS score FROM pairs)
SELECT cue, name, ['exact', 'qualified', 'prefix', 'contains', 'path', 'fuzzy'][t + 1] AS tier, round(score, 9) AS score FROM (SELECT * FROM direct WHERE t IS NOT NULL UNION ALL SELECT * FROM alike WHERE score >= 0.65)
QUALIFY row_number() OVER (PARTITION BY cue ORDER BY t, CASE WHEN t = 5 THEN -score END, test, name) <= 20""")
def code_find_tiers(spark, sf_dir):
    """Parts as symbols of files; cues for each tier."""
    part = tables.read(spark, sf_dir, "part")
    path = F.concat(F.when(F.col("p_partkey") % 4 == 3, "src/tests/").otherwise("src/"), F.lit("file"), (F.col("p_partkey") % 9).cast("string"), F.lit(".py"))
    tail = F.concat(F.when(F.col("p_partkey") % 5 == 0, "test_").otherwise(""), F.replace("p_name", F.lit(" "), F.lit("_")))
    names = staged(part.select(F.concat(path, F.lit("::"), tail).alias("name")).union(part.select(path)).distinct(), "names")
    out = None
    for cue in FOUND_CUES:
        found = documents.code_find(names, cue).select(F.lit(cue).alias("cue"), "name", "tier", F.round("score", 9).alias("score"))
        out = found if out is None else out.union(found)
    return out


@query("SELECT 'order:' || l_orderkey AS source, 'supplier:' || l_suppkey AS subject, 'supplies' AS label, 'part:' || l_partkey AS object, sum(CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) / count(*) AS weight FROM lineitem GROUP BY ALL")
def export_import(spark, sf_dir):
    """Exported as JSON lines and read again."""
    path = new_path(spark, "export")
    jsonl.write(jsonl.export_lines(tables.supplies(spark, sf_dir), "tpch"), path)
    return jsonl.associations(jsonl.parsed(jsonl.lines(spark, path))).select("source", "subject", "label", "object", "weight")


@query("WITH " + BM25 + """, text AS (SELECT source AS item, row_number() OVER (ORDER BY score DESC, source) - 1 AS rank FROM scored WHERE query = '3' QUALIFY rank < 20),
graph AS (SELECT 'doc:' || doc_id AS item, row_number() OVER (ORDER BY 'doc:' || doc_id) - 1 AS rank FROM documents WHERE source = 'src3' QUALIFY rank < 20)
SELECT item, round(sum(1.0 / (60 + rank)), 9) AS score, array_to_string(list_sort(list(lane)), '+') AS origin FROM (SELECT item, rank, 'graph' AS lane FROM graph UNION ALL SELECT item, rank, 'text' FROM text) GROUP BY item""")
def dual_lane_rrf(spark, sf_dir):
    text = search.ranked(_scores(spark, sf_dir, "3"), 20).select(F.col("source").alias("item"), (F.col("rank") - 1).alias("rank"))
    page = match.page(match.query_any(fold.edges(tables.writings(spark, sf_dir)), objects=["src3"]), 20)
    order = F.row_number().over(Window.orderBy(F.abs("weight").desc(), "subject")) - 1  # a page of rows
    return evidence.dual_lane(page.select(F.col("subject").alias("item"), order.alias("rank")), text)


@query(f"""WITH v AS (SELECT 'vec:' || vec_id AS name, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.name AS a, b.name AS b, {COSINE} AS score FROM v a JOIN v b ON a.name < b.name WHERE {COSINE} >= 0.3 ORDER BY score DESC, a, b LIMIT 100""")
def semantic_twins(spark, sf_dir):
    """The closest pairs of vectors, of all there are."""
    rows = tables.read(spark, sf_dir, "embeddings").select(tables.named("vec", "vec_id").alias("name"), F.col("embedding").alias("vector"))
    return entry.semantic_twins(rows, 0.3)


@query("""SELECT 'doc:' || doc_id AS source, CAST(0 AS INTEGER) AS paragraph, sha256(text) AS hash FROM documents WHERE doc_id % 9 = 4 AND text IS NOT NULL""")
def stale_vectors(spark, sf_dir):
    """Vectors made of texts of which every ninth had another end."""
    rows = tables.read(spark, sf_dir, "documents").filter("text IS NOT NULL").select(tables.named("doc", "doc_id").alias("source"), F.lit(0).alias("paragraph"), F.sha2("text", 256).alias("hash"), "doc_id")
    live = rows.withColumn("hash", F.when(F.col("doc_id") % 9 == 4, "changed").otherwise(F.col("hash")))
    return search.stale_vectors(rows.drop("doc_id"), live).select("source", "paragraph", "hash")


@query("""WITH p AS (SELECT 'conv:' || conv_id AS source, CAST(turn AS INTEGER) AS paragraph, text FROM conversations WHERE text IS NOT NULL),
c AS (SELECT *, CAST(floor(coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY paragraph ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 300) AS BIGINT) AS chunk FROM p),
t AS (SELECT source, chunk, string_agg('[' || paragraph || '] ' || text, chr(10) || chr(10) ORDER BY paragraph) AS text FROM c GROUP BY ALL) SELECT source, chunk, text, sha256(text) AS digest FROM t""")
def chunked(spark, sf_dir):
    """Conversations in chunks of about 300 characters."""
    rows = tables.read(spark, sf_dir, "conversations").filter("text IS NOT NULL").select(tables.named("conv", "conv_id").alias("source"), F.col("turn").cast("int").alias("paragraph"), "text")
    return documents.chunks(rows, 300).select("source", F.col("chunk").cast("long").alias("chunk"), "text", "digest")


@query("""WITH lexical AS (SELECT 'doc:' || doc_id AS name, 0.3::DOUBLE AS score FROM documents WHERE doc_id % 3 = 0), semantic AS (SELECT 'doc:' || doc_id AS name, 0.7::DOUBLE AS score FROM documents WHERE doc_id % 2 = 0)
SELECT name, score, 'lexical' AS tier FROM lexical UNION ALL SELECT name, score, 'semantic' FROM semantic WHERE name NOT IN (SELECT name FROM lexical)""")
def tier_merge(spark, sf_dir):
    """Names of both tiers where the spelling alone isn't sure."""
    names = tables.read(spark, sf_dir, "documents").select(tables.named("doc", "doc_id").alias("name"), "doc_id")
    lexical, semantic = names.filter("doc_id % 3 = 0").select("name", F.lit(0.3).alias("score")), names.filter("doc_id % 2 = 0").select("name", F.lit(0.7).alias("score"))
    return entry.merged_tiers(lexical, semantic)


@query("SELECT 'tpch' AS context, 'order:' || l_orderkey AS source, 'association' AS what, count(DISTINCT (l_suppkey, l_partkey)) AS n FROM lineitem GROUP BY l_orderkey UNION ALL SELECT DISTINCT 'tpch', 'order:' || l_orderkey, 'header', 1 FROM lineitem")
def import_preview(spark, sf_dir):
    """What reading an export again would bring, by source and kind of line."""
    path = new_path(spark, "export")
    jsonl.write(jsonl.export_lines(tables.supplies(spark, sf_dir), "tpch"), path)
    return jsonl.preview(jsonl.parsed(jsonl.lines(spark, path)))


@query("""WITH m AS (SELECT 'order:' || o_orderkey AS source, CAST(o_orderkey % 5 AS INTEGER) AS paragraph, 'part ' || (o_orderkey % 3) AS section FROM orders)
SELECT 'supplier:' || l_suppkey AS subject, 'part:' || l_partkey AS object, s.source, s.paragraph, section FROM (SELECT l_suppkey, l_partkey, 'order:' || l_orderkey AS source, CAST(arg_min(l_linenumber, l_linenumber) AS INTEGER) AS paragraph FROM lineitem GROUP BY ALL) s LEFT JOIN m ON m.source = s.source AND m.paragraph = s.paragraph""")
def marked_attributions(spark, sf_dir):
    """Attributions with the section of their paragraph, where one is marked."""
    marks = tables.read(spark, sf_dir, "orders").select(F.lit("tpch").alias("context"), tables.named("order", "o_orderkey").alias("source"), (F.col("o_orderkey") % 5).cast("int").alias("paragraph"), F.concat(F.lit("part "), (F.col("o_orderkey") % 3).cast("string")).alias("section"), F.lit(None).cast("string").alias("locator"))
    return match.decorated(fold.attributions(tables.supplies(spark, sf_dir)), marks).select("subject", "object", "source", "paragraph", "section")


@query("SELECT 'region:' || n_regionkey AS context, 'supplier:' || l_suppkey AS subject, 'part:' || l_partkey AS object, count(*) AS count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey IN (1, 3) GROUP BY ALL")
def stored_contexts(spark, sf_dir):
    """Edges saved by context, two of the contexts read again."""
    path = new_path(spark, "stored")
    catalog.save(fold.edges(tables.regional(spark, sf_dir).assertions), path, "edges")
    return catalog.load(spark, path, "edges", "region:1", "region:3").select("context", "subject", "object", "count")


@query("SELECT 'copy' AS context, 'supplier:' || l_suppkey AS subject, 'part:' || l_partkey AS object, sum(CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) AS sum, count(*) AS count FROM lineitem WHERE l_orderkey IN (1, 2, 3, 32) GROUP BY ALL")
def promoted_sources(spark, sf_dir):
    """What four sources say, as edges of another context."""
    wanted = [f"order:{i}" for i in (1, 2, 3, 32)]
    return fold.edges(catalog.promoted(tables.supplies(spark, sf_dir), wanted, "copy")).select("context", "subject", "object", "sum", "count")
