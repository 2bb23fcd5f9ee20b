"""Registered queries of the graph operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions import scalar
from knotwork.functions.scalar import average
from knotwork.operators import audit, catalog, community, entry, evidence, fold, gloss, groups, match, retrieve, search, traverse
from knotwork.plans import tables
from knotwork.plans.stage import kept, staged
from knotwork.sources import documents

CONCEPT, PART, SINCE, UNTIL = "supplier:7", "part:7", 820_454_400, 883_612_800  # 1996-01-01, 1998-01-01
IS_A = {"Supplier": ["Organisation"], "Organisation": ["Agent"], "Part": ["Thing"], "Place": []}
RELATIONS = {"supplies": {"domain": ["Agent"], "range": ["Part"]}, "located_in": {"range": ["Place"]}}
TRIPLE = ["subject", "label", "object"]

SUPPLIES = """
supplies AS (
  SELECT l_orderkey * 8 + l_linenumber AS seq, 'supplier:' || l_suppkey AS subject, 'supplies' AS label, 'part:' || l_partkey AS object,
         CASE WHEN l_returnflag = 'R' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 'order:' || l_orderkey AS source, CAST(l_linenumber AS INTEGER) AS paragraph
  FROM lineitem),
places AS (
  SELECT 1000000000000 + c_custkey AS seq, 'customer:' || c_custkey AS subject, 'located_in' AS label, 'nation:' || c_nationkey AS object, 1.0::DOUBLE AS weight, NULL::VARCHAR AS source, NULL::INTEGER AS paragraph FROM customer
  UNION ALL SELECT 2000000000000 + s_suppkey, 'supplier:' || s_suppkey, 'located_in', 'nation:' || s_nationkey, 1.0, NULL, NULL FROM supplier
  UNION ALL SELECT 3000000000000 + n_nationkey, 'nation:' || n_nationkey, 'part_of', 'region:' || n_regionkey, 1.0, NULL, NULL FROM nation),
assertions AS (SELECT * FROM supplies UNION ALL SELECT * FROM places),
edges AS (SELECT subject, label, object, sum(weight) AS total, count(*) AS n, min(seq) AS first_seq FROM assertions GROUP BY ALL),
shares AS (SELECT subject, label, object, source, sum(weight) AS total, count(*) AS n, arg_min(paragraph, seq) AS paragraph, min(seq) AS first_seq FROM supplies GROUP BY ALL),
sources AS (
  SELECT 'order:' || o_orderkey AS source,
         CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS stored_at,
         CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 THEN CAST(epoch(o_orderdate) AS BIGINT) END AS date,
         [o_orderpriority, 'status:' || o_orderstatus] AS tags
  FROM orders),
types AS (
  SELECT 'supplier:' || s_suppkey AS concept, 'Supplier' AS type FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'Place' ELSE 'Part' END FROM part WHERE p_partkey % 2 = 1
  UNION ALL SELECT 'nation:' || n_nationkey, 'Place' FROM nation),
above AS (SELECT * FROM (VALUES ('Supplier', 'Supplier'), ('Supplier', 'Organisation'), ('Supplier', 'Agent'), ('Organisation', 'Organisation'), ('Organisation', 'Agent'), ('Agent', 'Agent'), ('Part', 'Part'), ('Part', 'Thing'), ('Thing', 'Thing'), ('Place', 'Place')) v(type, up)),
expanded AS (SELECT DISTINCT concept, up AS type FROM types JOIN above USING (type)),
either AS (SELECT subject AS src, object AS dst, subject, label, object, total, n, first_seq FROM edges UNION ALL SELECT object, subject, subject, label, object, total, n, first_seq FROM edges WHERE subject <> object)
"""
W = "WITH RECURSIVE " + SUPPLIES
ROW = "subject, label, object, total / n AS weight, n AS count"
FOUND: dict[str, tuple] = {}


def query(sql: str | None):
    def register(f):
        FOUND[f.__name__] = (f, sql)
        return f

    return register


def _edges(spark: SparkSession, sf_dir: str, subjects: list[str] | None = None, objects: list[str] | None = None) -> DataFrame:
    return fold.edges(tables.graph(spark, sf_dir, subjects, objects).assertions)


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges as a table, folded once for as long as what they come from doesn't change."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "customer", "supplier", "nation")]
    return kept(spark, "edges", inputs, lambda: {"edges": _edges(spark, sf_dir)}, ["edges"])["edges"]


def _rows(edge: DataFrame) -> DataFrame:
    return edge.select(*TRIPLE, average(F.col("sum"), F.col("count")).alias("weight"), "count")


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.edges(tables.graph(spark, sf_dir).assertions.union(tables.types(spark, sf_dir)))


@query(W + f"SELECT {ROW} FROM edges")
def assoc_fold(spark, sf_dir):
    return _rows(_edges(spark, sf_dir))


@query(W + "SELECT subject, label, object, source, total AS sum, n AS count, paragraph FROM shares")
def attribution_fold(spark, sf_dir):
    return fold.attributions(tables.supplies(spark, sf_dir)).select(*TRIPLE, "source", "sum", "count", "paragraph")


@query(W + f"SELECT {ROW}, (SELECT list({{'source': source, 'weight': s.total / s.n, 'count': s.n, 'paragraph': paragraph}} ORDER BY s.first_seq, source) FROM shares s WHERE s.subject = e.subject AND s.label = e.label AND s.object = e.object) AS attributions FROM edges e WHERE object = '{PART}'")
def attributed_recall(spark, sf_dir):
    log = tables.supplies(spark, sf_dir, objects=[PART])
    out = fold.with_attributions(fold.edges(log), fold.attributions(log))
    return out.select(*TRIPLE, average(F.col("sum"), F.col("count")).alias("weight"), "count", "attributions")


@query(W + f"SELECT {ROW} FROM edges WHERE subject = 'nation:3' OR object = 'nation:3'")
def recall_cue(spark, sf_dir):
    return _rows(match.recall(_edges(spark, sf_dir), "N3", tables.nation_aliases(spark, sf_dir)))


@query(W + f"SELECT {ROW}, count(*) OVER () AS total FROM edges WHERE subject = '{CONCEPT}' AND label = 'supplies' ORDER BY abs(total / n) DESC, subject, label, object LIMIT 100")
def query_pinned(spark, sf_dir):
    return match.page(match.query_any(_edges(spark, sf_dir, [CONCEPT]), [CONCEPT], ["supplies"])).select(*TRIPLE, "weight", "count", "total")


@query(W + f"SELECT {ROW} FROM edges WHERE subject IN ('supplier:1', 'supplier:2', 'nobody') AND label = 'supplies' AND object IN ({', '.join(f"'part:{i}'" for i in range(60))})")
def query_any(spark, sf_dir):
    subjects, objects = ["supplier:1", "supplier:2", "nobody"], [f"part:{i}" for i in range(60)]
    return _rows(match.query_any(_edges(spark, sf_dir, subjects, objects), subjects, ["provides"], objects, tables.nation_aliases(spark, sf_dir)))


@query(W + f""", ranked AS (SELECT {ROW}, count(*) OVER () AS total FROM edges WHERE label = 'supplies')
SELECT * FROM ranked WHERE (subject, label, object) <> ('supplier:5', 'supplies', 'part:5') AND (abs(weight) < 0.5 OR (abs(weight) = 0.5 AND (subject, label, object) > ('supplier:5', 'supplies', 'part:5')))
ORDER BY abs(weight) DESC, subject, label, object LIMIT 50""")
def match_page_cursor(spark, sf_dir):
    return match.page(match.query_any(_edges(spark, sf_dir), labels=["supplies"]), 50, (0.5, "supplier:5", "supplies", "part:5"))


@query(W + f"SELECT 'subject' AS role, label, count(*) AS edges FROM edges WHERE subject = '{CONCEPT}' GROUP BY label UNION ALL SELECT 'object', label, count(*) FROM edges WHERE object = '{CONCEPT}' GROUP BY label")
def describe_concept(spark, sf_dir):
    return match.describe(_edges(spark, sf_dir), CONCEPT)


@query(W + "SELECT concept, list_sort(list(DISTINCT type)) AS types FROM types GROUP BY concept")
def concept_types(spark, sf_dir):
    return match.concept_types(_typed(spark, sf_dir)).select("concept", "types")


@query(W + f"SELECT {ROW} FROM edges WHERE subject IN (SELECT concept FROM expanded WHERE type = 'Agent') AND object IN (SELECT concept FROM expanded WHERE type IN ('Thing'))")
def type_filter_query(spark, sf_dir):
    edge = _typed(spark, sf_dir)
    return _rows(match.type_filter(match.visible(edge), match.expanded_types(edge, IS_A), ["Agent"], ["Thing"]))


@query(W + """SELECT concept, count(*) AS degree FROM (
  SELECT subject AS concept, first_seq * 2 AS seen FROM edges UNION ALL SELECT object, first_seq * 2 + 1 FROM edges)
GROUP BY concept ORDER BY degree DESC, min(seen), concept LIMIT 20""")
def top_concepts(spark, sf_dir):
    return fold.top_concepts(_edges(spark, sf_dir), 20)


@query(W + """SELECT 'tpch' AS context, (SELECT count(*) FROM edges) AS associations, 0::BIGINT AS dead_edges, 0.0::DOUBLE AS dead_ratio,
  (SELECT count(*) FROM (SELECT subject FROM edges UNION SELECT object FROM edges)) AS concepts, (SELECT count(DISTINCT label) FROM edges) AS labels, (SELECT count(DISTINCT source) FROM assertions) AS sources""")
def context_stats(spark, sf_dir):
    log = tables.graph(spark, sf_dir).assertions
    return fold.statistics(log, fold.edges(log))


WINDOW = "SELECT subject, label, object, sum(weight) AS total, count(*) AS n FROM supplies WHERE source IN (SELECT source FROM sources WHERE coalesce(date, stored_at) {}) GROUP BY ALL"


@query(W + f", w AS ({WINDOW.format(f'< {UNTIL}')}) SELECT {ROW}, count(*) OVER () AS total FROM w ORDER BY abs(total / n) DESC, subject, label, object LIMIT 100")
def query_window_asof(spark, sf_dir):
    return match.page(match.windowed(tables.graph(spark, sf_dir), until=UNTIL))


@query(W + f", w AS ({WINDOW.format(f'BETWEEN {SINCE} AND {UNTIL - 1}')}) SELECT {ROW} FROM w WHERE object = '{PART}'")
def recall_window_range(spark, sf_dir):
    return _rows(match.recall(match.windowed(tables.graph(spark, sf_dir), SINCE, UNTIL), PART))


@query(W + "SELECT subject, label, object, total AS residual, n AS unattributed FROM edges WHERE label <> 'supplies'")
def unsourced_edges(spark, sf_dir):
    return fold.unsourced_edges(tables.graph(spark, sf_dir).assertions).select(*TRIPLE, "residual", "unattributed")


@query(W + "SELECT 'tpch' AS context, count(*) AS edges, sum(weight) AS residual, CAST(count(*) AS BIGINT) AS unattributed FROM places")
def unsourced_summary(spark, sf_dir):
    return fold.unsourced_summary(tables.graph(spark, sf_dir).assertions)


@query(W + "SELECT subject, label, object, coalesce(sum(weight) FILTER (WHERE source IS DISTINCT FROM 'order:7'), 0.0) AS sum, count(*) FILTER (WHERE source IS DISTINCT FROM 'order:7') AS count FROM assertions GROUP BY ALL")
def retract_source_fold(spark, sf_dir):
    return fold.retract_source(tables.graph(spark, sf_dir).assertions, "order:7").select(*TRIPLE, "sum", "count")


@query(W + "SELECT count(DISTINCT (subject, label, object)) AS edges FROM supplies WHERE source = 'order:7'")
def source_edge_count(spark, sf_dir):
    return fold.source_edges(tables.supplies(spark, sf_dir), "order:7")


@query(W + "SELECT subject, label, object, total AS sum, n AS count FROM (SELECT subject, label, object, sum(weight) AS total, count(*) AS n FROM assertions WHERE source IS DISTINCT FROM 'order:7' GROUP BY ALL)")
def compacted(spark, sf_dir):
    return fold.compacted(fold.retract_source(tables.graph(spark, sf_dir).assertions, "order:7")).select(*TRIPLE, "sum", "count")


OPS = """
ops AS (
  SELECT event_id AS seq, CASE event_type WHEN 'error' THEN 'retract_association' WHEN 'signup' THEN 'retract_source' ELSE 'associate' END AS op,
         'user:' || user_id AS subject, 'touches' AS label, 'k:' || (event_id % 10) AS object, CASE WHEN value > 50 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         'group:' || (user_id % 500) AS source FROM events),
folded AS (
  SELECT a.subject, a.label, a.object, coalesce(sum(a.weight) FILTER (WHERE live), 0.0) AS sum, count(*) FILTER (WHERE live) AS count FROM (
    SELECT o.*, o.seq > coalesce(e.last, -1) AND o.seq > coalesce(s.last, -1) AS live FROM ops o
    LEFT JOIN (SELECT subject, object, max(seq) AS last FROM ops WHERE op = 'retract_association' GROUP BY ALL) e ON o.subject = e.subject AND o.object = e.object
    LEFT JOIN (SELECT source, max(seq) AS last FROM ops WHERE op = 'retract_source' GROUP BY ALL) s ON o.source = s.source
    WHERE o.op = 'associate') a GROUP BY ALL)
"""


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of ops."""
    op = F.when(F.col("event_type") == "error", "retract_association").when(F.col("event_type") == "signup", "retract_source").otherwise("associate")
    return tables.read(spark, sf_dir, "events").select(
        F.lit("events").alias("context"), F.col("event_id").alias("seq"), op.alias("op"), tables.named("user", "user_id").alias("subject"), F.lit("touches").alias("label"),
        F.concat(F.lit("k:"), (F.col("event_id") % 10).cast("string")).alias("object"), F.when(F.col("value") > 50, -1.0).otherwise(1.0).alias("weight"), F.concat(F.lit("group:"), (F.col("user_id") % 500).cast("string")).alias("source"),
        F.floor(F.col("event_id") / 4).alias("call"),
    )


@query("WITH " + OPS + "SELECT * FROM folded")
def op_log_fold(spark, sf_dir):
    return fold.apply_ops(event_ops(spark, sf_dir)).select(*TRIPLE, "sum", "count")


@query(W + "SELECT subject, label, object, count(*) FILTER (WHERE total > 0) AS affirming, count(*) FILTER (WHERE total < 0) AS denying FROM shares GROUP BY ALL HAVING affirming > 0 AND denying > 0")
def sign_conflicts(spark, sf_dir):
    return audit.sign_conflicts(fold.attributions(tables.supplies(spark, sf_dir))).drop("context")


CONTRADICTIONS = """, g AS (SELECT subject, label, count(*) AS objects FROM edges GROUP BY ALL),
t AS (SELECT label, count(*) FILTER (WHERE objects = 1) / count(*) AS tendency FROM g GROUP BY label)
SELECT subject, label, objects, tendency FROM g JOIN t USING (label) WHERE objects > 1"""


@query(W + CONTRADICTIONS)
def contradiction_groups(spark, sf_dir):
    return audit.contradictions(_edges(spark, sf_dir)).drop("context")


@query(W + CONTRADICTIONS + " ORDER BY tendency DESC, label, subject LIMIT 100")
def contradiction_page(spark, sf_dir):
    return audit.contradiction_page(_edges(spark, sf_dir)).drop("context")


@query(W + """, l AS (SELECT subject, label, object, max(coalesce(date, stored_at)) AS latest FROM shares JOIN sources USING (source) GROUP BY ALL HAVING latest IS NOT NULL)
SELECT subject, label, object, latest, newest - latest AS gap FROM l JOIN (SELECT subject, max(latest) AS newest FROM l GROUP BY subject) USING (subject) WHERE newest - latest >= 31536000""")
def staleness(spark, sf_dir):
    t = tables.graph(spark, sf_dir)
    return audit.staleness(fold.attributions(t.assertions), t.sources, 31_536_000).drop("context")


@query(W + "SELECT subject, label, object FROM edges e WHERE NOT EXISTS (SELECT 1 FROM shares s JOIN sources o USING (source) WHERE coalesce(date, stored_at) IS NOT NULL AND s.subject = e.subject AND s.label = e.label AND s.object = e.object)")
def undatable(spark, sf_dir):
    t = tables.graph(spark, sf_dir)
    return audit.undatable(fold.attributions(t.assertions), t.sources, fold.edges(t.assertions)).select(*TRIPLE)


FACTS = """, f AS (SELECT subject AS c, 'out' AS d, label AS l, object AS o FROM edges UNION SELECT object, 'in', label, subject FROM edges),
said AS (SELECT c, count(*) AS n FROM f GROUP BY c)"""


@query(W + FACTS + """, p AS (SELECT 'supplier:' || s_suppkey AS a, 'supplier:' || (s_suppkey + 1) AS b FROM supplier),
k AS (SELECT p.a, p.b, count(*) AS k FROM p JOIN f x ON x.c = p.a JOIN f y ON y.c = p.b AND x.d = y.d AND x.l = y.l AND x.o = y.o GROUP BY ALL),
s AS (SELECT p.a, p.b, coalesce(k, 0) AS shared, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb FROM p LEFT JOIN k ON k.a = p.a AND k.b = p.b LEFT JOIN said x ON x.c = p.a LEFT JOIN said y ON y.c = p.b)
SELECT a, b, shared, na - shared AS only_a, nb - shared AS only_b, CASE WHEN na + nb - shared = 0 THEN 0.0 ELSE shared / (na + nb - shared) END AS overlap FROM s""")
def merge_evidence(spark, sf_dir):
    """Every supplier with the next."""
    pairs = tables.read(spark, sf_dir, "supplier").select(tables.named("supplier", "s_suppkey").alias("a"), F.concat(F.lit("supplier:"), (F.col("s_suppkey") + 1).cast("string")).alias("b"))
    return audit.merge_evidence(_edges(spark, sf_dir), pairs)


@query(W + FACTS + """, p AS (SELECT 'nation:' || x.n_nationkey AS a, 'nation:' || y.n_nationkey AS b, 1.0::DOUBLE / (1 + abs(x.n_regionkey - y.n_regionkey)) AS score FROM nation x, nation y WHERE x.n_nationkey < y.n_nationkey),
k AS (SELECT p.a, p.b, count(*) AS k FROM p JOIN f x ON x.c = p.a JOIN f y ON y.c = p.b AND x.d = y.d AND x.l = y.l AND x.o = y.o GROUP BY ALL),
s AS (SELECT p.a, p.b, score, coalesce(k, 0) AS shared, coalesce(x.n, 0) AS na, coalesce(y.n, 0) AS nb FROM p LEFT JOIN k ON k.a = p.a AND k.b = p.b LEFT JOIN said x ON x.c = p.a LEFT JOIN said y ON y.c = p.b)
SELECT a, b, score, shared, na - shared AS only_a, nb - shared AS only_b, shared / (na + nb - shared) AS overlap FROM s ORDER BY overlap DESC, score DESC, a, b LIMIT 100""")
def merge_section(spark, sf_dir):
    """Pairs of nations as candidates, scored by how near their regions' numbers are."""
    nations = tables.read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    x, y = nations.alias("x"), F.broadcast(nations).alias("y")  # the nations of the world
    pairs = x.join(y, F.expr("x.n_nationkey < y.n_nationkey")).select(tables.named("nation", "x.n_nationkey").alias("a"), tables.named("nation", "y.n_nationkey").alias("b"), (1.0 / (1 + F.abs(F.expr("x.n_regionkey - y.n_regionkey")))).alias("score"))
    return audit.merge_section(_edges(spark, sf_dir), pairs)


@query(W + """, g AS (SELECT subject, label, count(*) AS objects FROM edges GROUP BY ALL),
t AS (SELECT label, count(*) FILTER (WHERE objects = 1) / count(*) AS tendency FROM g GROUP BY label),
signs AS (SELECT subject, label, object, count(*) FILTER (WHERE total > 0) AS affirming, count(*) FILTER (WHERE total < 0) AS denying FROM shares GROUP BY ALL HAVING affirming > 0 AND denying > 0),
every AS (SELECT 0 AS k, 'objects' AS kind, subject, label, NULL::VARCHAR AS object, objects, tendency, NULL::BIGINT AS affirming, NULL::BIGINT AS denying FROM g JOIN t USING (label) WHERE objects > 1
  UNION ALL SELECT 1, 'contested', subject, label, object, NULL, NULL, affirming, denying FROM signs)
SELECT CAST(row_number() OVER (ORDER BY k, tendency DESC, label, subject, object) AS INTEGER) AS place, kind, subject, label, object, objects, tendency, affirming, denying FROM every QUALIFY place <= 200""")
def contradiction_section(spark, sf_dir):
    return audit.contradiction_section(_edges(spark, sf_dir), fold.attributions(tables.supplies(spark, sf_dir)), 200)


@query(W + """SELECT 'unsourced' AS section, concat_ws(' ', subject, label, object) AS a, NULL::VARCHAR AS b, total AS amount FROM edges WHERE label <> 'supplies'
UNION ALL SELECT 'dead_alias', 'gone', 'nobody', NULL""")
def drift_audit(spark, sf_dir):
    log, aliases = tables.graph(spark, sf_dir).assertions, tables.nation_aliases(spark, sf_dir)
    extra = spark.createDataFrame([("tpch", "concept", "gone", "nobody")], aliases.schema)
    edge = fold.edges(log)
    return audit.drift(log, edge, fold.dead_aliases(aliases.union(extra), edge), None, fold.unsourced_edges(log))


@query("""SELECT 'edge_twice' AS "check", (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'negative_count', (SELECT count(*) FROM region) UNION ALL SELECT 'weight_of_dead_edge', 0 UNION ALL SELECT 'sum_not_finite', 0
UNION ALL SELECT 'attested_above_count', (SELECT count(*) FROM region) UNION ALL SELECT 'attribution_without_edge', (SELECT count(*) FROM nation) UNION ALL SELECT 'alias_is_a_name', 1 UNION ALL SELECT 'alias_of_an_alias', 2""")
def verify_tables(spark, sf_dir):
    """Stored tables with faults put in: each nation's edge twice, counts below zero, shares of no edge, aliases of aliases."""
    log = tables.graph(spark, sf_dir).assertions
    edge, shares = fold.edges(log), fold.attributions(log)
    twice = edge.filter("label = 'part_of'")
    regions = tables.read(spark, sf_dir, "region").select(F.lit("tpch").alias("context"), tables.named("region", "r_regionkey").alias("subject"), F.lit("odd").alias("label"), F.lit("x").alias("object"))
    edge = edge.union(twice).union(regions.select("*", F.lit(0.0), F.lit(-1).cast("long"), F.lit(0).cast("long")))
    nations = tables.read(spark, sf_dir, "nation").select(F.lit("tpch").alias("context"), tables.named("nation", "n_nationkey").alias("subject"), F.lit("unheard").alias("label"), F.lit("y").alias("object"))
    more = regions.select("*", F.lit("s"), F.lit(1.0), F.lit(1).cast("long"), F.lit(None).cast("int"), F.lit(0).cast("long")).union(nations.select("*", F.lit("s"), F.lit(1.0), F.lit(1).cast("long"), F.lit(None).cast("int"), F.lit(0).cast("long")))
    aliases = tables.nation_aliases(spark, sf_dir)
    odd = spark.createDataFrame([("tpch", "concept", "nation:1", "nation:2"), ("tpch", "concept", "second", "N1")], aliases.schema)
    return catalog.verified(edge, shares.union(more), aliases.union(odd))


@query(W + """SELECT subject, label, object, 'range' AS kind FROM edges WHERE label = 'supplies' AND object IN (SELECT concept FROM types) AND object NOT IN (SELECT concept FROM expanded WHERE type = 'Part')
UNION ALL SELECT subject, label, object, 'range' FROM edges WHERE label = 'located_in' AND object IN (SELECT concept FROM types) AND object NOT IN (SELECT concept FROM expanded WHERE type = 'Place')
UNION ALL SELECT subject, label, object, 'domain' FROM edges WHERE label = 'supplies' AND subject IN (SELECT concept FROM types) AND subject NOT IN (SELECT concept FROM expanded WHERE type = 'Agent')
UNION ALL SELECT subject, label, object, 'label' FROM edges WHERE label NOT IN ('supplies', 'located_in')""")
def schema_audit(spark, sf_dir):
    return audit.schema_violations(_typed(spark, sf_dir), IS_A, RELATIONS, closed_labels=True).drop("context")


@query(W + "SELECT concept FROM (SELECT subject AS concept FROM edges UNION SELECT object FROM edges) WHERE concept NOT IN (SELECT concept FROM types)")
def untyped_concepts(spark, sf_dir):
    return audit.untyped_concepts(_typed(spark, sf_dir)).select("concept")


@query(W + "SELECT DISTINCT type FROM types WHERE type NOT IN ('Supplier', 'Organisation', 'Agent')")
def undeclared_types(spark, sf_dir):
    return audit.undeclared_types(_typed(spark, sf_dir), {"Supplier": ["Organisation"], "Organisation": ["Agent"]}).select("type")


REGIONAL = """, home AS (SELECT 'supplier:' || s_suppkey AS subject, 'region:' || n_regionkey AS context FROM supplier JOIN nation ON s_nationkey = n_nationkey),
regional AS (SELECT context, subject, label, object, sum(weight) AS total, count(*) AS n FROM supplies JOIN home USING (subject) GROUP BY ALL)
"""


@query(W + REGIONAL + f"SELECT context, {ROW}, count(*) OVER () AS total FROM regional WHERE context IN ('region:0', 'region:2', 'region:4') AND object = '{PART}' ORDER BY abs(total / n) DESC, context, subject, label, object LIMIT 100")
def cross_recall(spark, sf_dir):
    t = tables.regional(spark, sf_dir, [PART]).within("region:0", "region:2", "region:4")
    return match.page(match.recall(fold.edges(t.assertions), PART), contexts=True)


@query(W + REGIONAL + f"SELECT context, {ROW}, count(*) OVER () AS total FROM regional WHERE object IN ('part:1', 'part:2', 'part:3') ORDER BY abs(total / n) DESC, context, subject, label, object LIMIT 100")
def cross_query(spark, sf_dir):
    parts = ["part:1", "part:2", "part:3"]
    return match.page(match.query_any(fold.edges(tables.regional(spark, sf_dir, parts).assertions), objects=parts), contexts=True)


def region_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """even and odd regions, and all, which holds both."""
    regions = tables.read(spark, sf_dir, "region")
    parity = F.when(F.col("r_regionkey") % 2 == 0, "even").otherwise("odd")
    leaves = regions.groupBy(parity.alias("name")).agg(F.collect_list(tables.named("region", "r_regionkey")).alias("contexts"), F.array().cast("array<string>").alias("groups"))
    return leaves.union(spark.createDataFrame([("all", [], ["even", "odd"])], "name string, contexts array<string>, groups array<string>"))


@query("SELECT 'region:' || r_regionkey AS context FROM region")
def group_closure(spark, sf_dir):
    return groups.closure(staged(region_groups(spark, sf_dir), "groups"), "all")


@query("SELECT 'order:' || o_orderkey AS source, (SELECT count(*) FROM orders WHERE o_orderkey::VARCHAR LIKE '1%') AS total FROM orders WHERE o_orderkey::VARCHAR LIKE '1%' AND 'order:' || o_orderkey > 'order:12' ORDER BY source LIMIT 100")
def list_sources_page(spark, sf_dir):
    return match.listing(tables.order_sources(spark, sf_dir).select("source"), "source", "order:1", "order:12", 100)


@query(W + "SELECT name, (SELECT count(*) FROM (SELECT subject FROM edges WHERE starts_with(subject, 'part:') UNION SELECT object FROM edges WHERE starts_with(object, 'part:'))) AS total FROM (SELECT subject AS name FROM edges UNION SELECT object FROM edges) WHERE starts_with(name, 'part:') AND name > 'part:15' ORDER BY name LIMIT 50")
def list_concepts_page(spark, sf_dir):
    return match.vocabulary(_edges(spark, sf_dir), "part:", "part:15", 50)


@query(W + "SELECT DISTINCT label AS name, (SELECT count(DISTINCT label) FROM edges) AS total FROM edges")
def list_labels(spark, sf_dir):
    return match.vocabulary(_edges(spark, sf_dir), kind="label")


@query(W + f"SELECT source, date, stored_at FROM sources WHERE list_has_any(tags, ['1-URGENT', 'status:P']) AND coalesce(date, stored_at) >= {SINCE} AND coalesce(date, stored_at) < {UNTIL}")
def source_filter_tags(spark, sf_dir):
    return match.source_filter(tables.order_sources(spark, sf_dir), ["1-URGENT", "status:P"], SINCE, UNTIL).select("source", "date", "stored_at")


@query("SELECT source, source IN (SELECT 'order:' || o_orderkey FROM orders) AS found FROM (SELECT 'order:' || (c_custkey * 3) AS source FROM customer WHERE c_custkey <= 200)")
def source_lookup(spark, sf_dir):
    wanted = [f"order:{r[0] * 3}" for r in tables.read(spark, sf_dir, "customer").filter("c_custkey <= 200").select("c_custkey").collect()]
    return match.lookup(tables.order_sources(spark, sf_dir), wanted)


@query(W + f"SELECT count(*) > 0 AS adjacent FROM edges WHERE (subject = '{CONCEPT}' AND object = 'nation:1') OR (subject = 'nation:1' AND object = '{CONCEPT}')")
def adjacent(spark, sf_dir):
    return match.adjacent(_edges(spark, sf_dir), CONCEPT, "nation:1")


@query(W + "SELECT DISTINCT x.label AS a, y.label AS b FROM (SELECT DISTINCT subject, label FROM edges) x JOIN (SELECT DISTINCT subject, label FROM edges) y ON x.subject = y.subject AND x.label < y.label")
def labels_share_subject(spark, sf_dir):
    return match.labels_share_subject(_edges(spark, sf_dir)).select("a", "b")


@query(W + "SELECT kind, alias, canonical FROM (SELECT 'concept' AS kind, 'N' || n_nationkey AS alias, 'nation:' || n_nationkey AS canonical FROM nation UNION ALL SELECT 'concept', 'gone', 'nobody' UNION ALL SELECT 'label', 'provides', 'supplies') WHERE canonical NOT IN (SELECT subject FROM edges UNION SELECT object FROM edges UNION SELECT label FROM edges)")
def dead_aliases(spark, sf_dir):
    extra = spark.createDataFrame([("tpch", "concept", "gone", "nobody")], "context string, kind string, alias string, canonical string")
    return fold.dead_aliases(tables.nation_aliases(spark, sf_dir).union(extra), _edges(spark, sf_dir)).drop("context")


@query("SELECT * FROM (VALUES ('concept', 'N1', 'nation:1', 'ok'), ('concept', 'N1', 'nation:2', 'conflict'), ('concept', 'nation:3', 'nation:4', 'conflict'), ('concept', 'new', 'nobody', 'unknown_canonical'), ('label', 'gives', 'supplies', 'ok')) v(kind, alias, canonical, verdict)")
def alias_check(spark, sf_dir):
    asked = [("concept", "N1", "nation:1"), ("concept", "N1", "nation:2"), ("concept", "nation:3", "nation:4"), ("concept", "new", "nobody"), ("label", "gives", "supplies")]
    proposed = spark.createDataFrame([("tpch", *a) for a in asked], "context string, kind string, alias string, canonical string")
    return fold.check_aliases(proposed, tables.nation_aliases(spark, sf_dir), _edges(spark, sf_dir)).drop("context")


@query(W + "SELECT source, subject, label, object, total / n AS weight, n AS count FROM shares WHERE source IN ('order:1', 'order:2', 'order:3')")
def export_slice(spark, sf_dir):
    return fold.exported(tables.supplies(spark, sf_dir), ["order:1", "order:2", "order:3"]).drop("context")


@query(W + "SELECT subject, label, object, source, weight FROM assertions WHERE source IS DISTINCT FROM 'order:1' UNION ALL SELECT 'supplier:1', 'supplies', 'part:0', 'order:1', 1.0")
def import_replace(spark, sf_dir):
    batch = spark.createDataFrame([("tpch", 9, "supplier:1", "supplies", "part:0", 1.0, "order:1", 1)], "context string, seq long, subject string, label string, object string, weight double, source string, paragraph int")
    return fold.replaced_source(tables.graph(spark, sf_dir).assertions, batch).select(*TRIPLE, "source", "weight")


@query(W + f""", nodes AS (SELECT concept, min(d) AS d FROM (SELECT '{CONCEPT}' AS concept, 0 AS d UNION ALL SELECT dst, 1 FROM either WHERE src = '{CONCEPT}') GROUP BY concept)
SELECT subject, label, object, CAST(min(d) + 1 AS INTEGER) AS distance, any_value(total / n) AS weight, any_value(n) AS count FROM either JOIN nodes ON src = concept GROUP BY subject, label, object""")
def explore_depth2(spark, sf_dir):
    return traverse.explore(match.visible(_stored(spark, sf_dir)), [CONCEPT], 2).drop("path")


ACTIVE = """, pull AS (SELECT src, dst, max(abs(total)) AS p FROM either WHERE total <> 0 GROUP BY ALL),
tot AS (SELECT src, sum(abs(total)) AS t FROM either WHERE total <> 0 GROUP BY src),
flow(concept, f) AS (
  SELECT '{0}', 1.0::DOUBLE UNION
  SELECT p.dst, f.f * (p.p * 0.5 / t.t) FROM flow f JOIN pull p ON f.concept = p.src JOIN tot t ON t.src = p.src WHERE f.f * (p.p * 0.5 / t.t) >= 1e-6),
best AS (SELECT concept, max(f) AS f FROM flow GROUP BY concept),
reached AS (SELECT subject, label, object, any_value(total / n) AS weight, any_value(n) AS count, min(first_seq) AS seen, max(f * 0.5 * abs(total)) AS strength FROM either JOIN best ON src = concept WHERE total <> 0 GROUP BY subject, label, object)
"""


@query(W + ACTIVE.format(CONCEPT) + "SELECT round(strength, 9) AS strength, subject, label, object, weight, count, count(*) OVER () AS total FROM reached ORDER BY reached.strength DESC, seen, subject, label, object LIMIT 20")
def activate_top20(spark, sf_dir):
    out = traverse.activate(match.visible(_stored(spark, sf_dir)), [CONCEPT])
    return out.withColumn("strength", F.round("strength", 9))


DOCS = """, docs AS (SELECT 'doc:' || doc_id AS subject, 'written_in' AS label, 'lang:' || lang AS object, 1.0::DOUBLE AS total, 1::BIGINT AS n FROM documents WHERE lang IS NOT NULL
  UNION ALL SELECT 'doc:' || doc_id, 'comes_from', source, 1.0, 1 FROM documents WHERE source IS NOT NULL),
every AS (SELECT subject, label, object, total, n FROM edges UNION ALL SELECT * FROM docs)"""


def _whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of all facts there are: supplies, places and documents."""
    inputs = [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "customer", "supplier", "nation", "documents")]
    whole = lambda: {"edges": _stored(spark, sf_dir).union(fold.edges(tables.writings(spark, sf_dir)))}  # noqa: E731  no triple is in both
    return kept(spark, "whole", inputs, whole, ["edges"])["edges"]


@query(W + DOCS + """, hops AS (SELECT src, dst, first_seq, abs(total) AS pull FROM either UNION ALL SELECT subject, object, 9000000000000, 1.0 FROM docs WHERE false),
trail(node, concepts, edges, strength, length) AS (
  SELECT 'customer:1', ['customer:1'], []::BIGINT[], 'inf'::DOUBLE, 0
  UNION ALL SELECT dst, list_append(concepts, dst), list_append(edges, first_seq), least(strength, pull), length + 1 FROM trail JOIN hops ON node = src WHERE length < 4 AND NOT list_contains(concepts, dst))
SELECT CAST(length AS INTEGER) AS length, strength, concepts, edges, count(*) OVER () AS total, false AS capped FROM trail WHERE length > 0 AND node IN ('customer:2', 'part:7', 'region:1') ORDER BY length, strength DESC, concepts, edges LIMIT 10""")
def paths_depth4(spark, sf_dir):
    """``capped``: the budget of trails ran out, and longer paths are missing from rows and ``total``."""
    out, capped = traverse.paths(_whole(spark, sf_dir), ["customer:1"], ["customer:2", "part:7", "region:1"], 4)
    if capped and out.isEmpty():
        raise ValueError("the budget of trails ran out before any path was found")
    return out.withColumn("capped", F.lit(capped))


@query(W + DOCS + f""", hops AS (SELECT subject AS src, object AS dst FROM every UNION SELECT object, subject FROM every), reach(c) AS (SELECT 'region:0' UNION SELECT dst FROM reach JOIN hops ON c = src)
SELECT {ROW} FROM every WHERE subject NOT IN (SELECT c FROM reach)""")
def unreachable_from(spark, sf_dir):
    return _rows(traverse.unreachable_from(_whole(spark, sf_dir), ["region:0"]))


@query(W + "SELECT least(subject, object) AS a, greatest(subject, object) AS b, sum(abs(total)) AS weight FROM edges WHERE subject <> object GROUP BY ALL HAVING weight > 0")
def leaf_graph(spark, sf_dir):
    return community.leaf_graph(_edges(spark, sf_dir)).drop("context")


@query(W + REGIONAL + "SELECT context, count(DISTINCT concept) AS concepts, true AS better FROM (SELECT context, subject AS concept FROM regional WHERE total <> 0 UNION SELECT context, object FROM regional WHERE total <> 0) GROUP BY context")
def communities_cover(spark, sf_dir):
    """Every concept of a context is in one finest community, and these are no less dense inside than chance has it."""
    found = staged(community.analysed(tables.regional_edges(spark, sf_dir)).filter("level = 0"), "communities")
    once = found.groupBy("context", "concept").agg(F.count("*").alias("n")).filter("n = 1").groupBy("context").agg(F.count("*").alias("concepts"))
    better = community.cohesion(found).select("context", (F.col("modularity") > -1e-9).alias("better"))
    return once.join(better, "context").select("context", "concepts", "better")


@query(None)
def communities(spark, sf_dir):
    return community.communities(tables.regional_edges(spark, sf_dir))


@query(None)
def community_search(spark, sf_dir):
    """Communities of the first region whose heaviest facts name a part, with their strongest members."""
    edge = staged(fold.edges(tables.regional(spark, sf_dir).within("region:0").assertions), "edges")
    members = staged(community.communities(edge), "communities")
    rows = community.summaries(edge, members).select(F.concat_ws("/", "context", "community").alias("source"), F.lit(0).alias("paragraph"), "text")
    asked = search.query_terms(spark.createDataFrame([("part", "part 7 supplier"), ("supplier", "supplier 3")], "query string, text string"))
    hits = search.ranked(search.scores(search.indexed(staged(search.tokenized(rows), "tokens")), asked), 5)
    where = F.split("source", "/")
    return community.searched(hits.select("query", where[0].alias("context"), where[1].alias("community"), "score"), community.strongest_members(edge, members), 1, 1)


@query(W + f", w AS ({WINDOW.format(f'< {SINCE}')}) SELECT subject, label, object, CAST(1 AS INTEGER) AS distance, total / n AS weight, n AS count FROM w WHERE subject = '{CONCEPT}' OR object = '{CONCEPT}'")
def explore_window(spark, sf_dir):
    return traverse.explore(match.visible(match.windowed(tables.graph(spark, sf_dir), until=SINCE)), [CONCEPT], 1).drop("path")


@query(W + "SELECT 'nation:' || s_nationkey AS object, 'located_in' AS label, 'supplier:' || s_suppkey AS subject, 2.0::DOUBLE AS sum, 2::BIGINT AS count FROM supplier")
def alias_canonical_fold(spark, sf_dir):
    placed = tables.places(spark, sf_dir).filter("subject LIKE 'supplier:%'")
    said = placed.withColumn("object", F.regexp_replace("object", "^nation:", "N"))
    return fold.edges(fold.canonical(placed.union(said), tables.nation_aliases(spark, sf_dir))).select(*TRIPLE, "sum", "count")


@query(W + f""", nodes AS (SELECT concept, min(d) AS d FROM (SELECT '{CONCEPT}' AS concept, 0 AS d UNION ALL SELECT dst, 1 FROM either WHERE src = '{CONCEPT}') GROUP BY concept),
every AS (SELECT subject, label, object, CAST(min(d) + 1 AS INTEGER) AS distance, any_value(total / n) AS weight, any_value(n) AS count FROM either JOIN nodes ON src = concept GROUP BY subject, label, object)
SELECT *, (SELECT count(*) FROM every) AS total FROM every WHERE (distance, subject, label, object) > (1, '{CONCEPT}', 'supplies', 'part:5') ORDER BY distance, subject, label, object LIMIT 40""")
def explore_page(spark, sf_dir):
    rows = traverse.explore(match.visible(_stored(spark, sf_dir)), [CONCEPT], 2).drop("path")
    return traverse.explore_page(rows, 40, (1, CONCEPT, "supplies", "part:5"))


IN_WINDOW = f""", w AS (SELECT subject, label, object, sum(weight) AS total, count(*) AS n, min(seq) AS first_seq FROM supplies WHERE source IN (SELECT source FROM sources WHERE coalesce(date, stored_at) >= {SINCE} AND coalesce(date, stored_at) < {UNTIL}) GROUP BY ALL),
seen AS (SELECT subject AS src, object AS dst, subject, label, object, total, n, first_seq FROM w UNION ALL SELECT object, subject, subject, label, object, total, n, first_seq FROM w WHERE subject <> object)"""


@query(W + IN_WINDOW + ACTIVE.format(CONCEPT).replace("FROM either", "FROM seen") + "SELECT round(strength, 9) AS strength, subject, label, object, weight, count, count(*) OVER () AS total FROM reached ORDER BY reached.strength DESC, seen, subject, label, object LIMIT 20")
def activate_window(spark, sf_dir):
    """Activation over what sources of a window attest: other facts neither show nor lead on."""
    out = traverse.activate(match.visible(match.windowed(tables.graph(spark, sf_dir), SINCE, UNTIL)), [CONCEPT])
    return out.withColumn("strength", F.round("strength", 9))


@query(W + """, around AS (SELECT subject AS concept, * FROM edges UNION ALL SELECT object, * FROM edges WHERE subject <> object),
best AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY abs(total) DESC, first_seq, subject, label, object) AS place FROM around QUALIFY place <= 4),
said AS (SELECT *, lag(subject) OVER (PARTITION BY concept ORDER BY place) AS last FROM best)
SELECT concept, concept || '。' || string_agg(CASE WHEN subject <> concept AND subject IS DISTINCT FROM last THEN subject || 'の' ELSE '' END || label || 'は' || object || CASE WHEN total < 0 THEN 'ではない' ELSE '' END || '。', '' ORDER BY place) AS gloss FROM said GROUP BY concept""")
def concept_glosses(spark, sf_dir):
    return gloss.concept_glosses(_edges(spark, sf_dir)).drop("context")


@query(W + """, best AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY abs(total) DESC, first_seq, subject, label, object) AS place FROM edges QUALIFY place <= 3),
said AS (SELECT *, lag(subject) OVER (PARTITION BY label ORDER BY place) AS last FROM best)
SELECT label, label || '。' || string_agg(CASE WHEN subject IS DISTINCT FROM last THEN subject || 'の' ELSE '' END || label || 'は' || object || CASE WHEN total < 0 THEN 'ではない' ELSE '' END || '。', '' ORDER BY place) AS gloss FROM said GROUP BY label""")
def label_glosses(spark, sf_dir):
    return gloss.label_glosses(_edges(spark, sf_dir)).drop("context")


@query(W + ACTIVE.format(CONCEPT) + f""", q AS (SELECT 0 AS lane, row_number() OVER (ORDER BY abs(total / n) DESC, subject, label, object) AS n, subject, label, object, total / n AS weight, n AS count FROM edges WHERE subject = '{CONCEPT}' AND label = 'supplies' QUALIFY row_number() OVER (ORDER BY abs(total / n) DESC, subject, label, object) <= 100),
top AS (SELECT * FROM reached ORDER BY strength DESC, seen, subject, label, object LIMIT 20),
a AS (SELECT 1 AS lane, row_number() OVER (ORDER BY strength DESC, subject, label, object) AS n, subject, label, object, weight, count FROM top),
first AS (SELECT * FROM (SELECT * FROM q UNION ALL SELECT * FROM a) QUALIFY row_number() OVER (PARTITION BY subject, label, object ORDER BY lane, n) = 1)
SELECT CAST(row_number() OVER (ORDER BY lane, n) AS INTEGER) AS place, CASE lane WHEN 0 THEN 'query' ELSE 'activate' END AS origin, subject, label, object, weight, count FROM first""")
def retrieve_associations(spark, sf_dir):
    """A wording in capitals, resolved to its name; what that supplies, and what activation adds."""
    return retrieve.retrieve(tables.graph(spark, sf_dir), [CONCEPT.upper()], ["supplies"], edge=_stored(spark, sf_dir)).associations


@query("SELECT DISTINCT 'file' || (p_partkey % 9) || '.py::' || replace(p_name, ' ', '_') AS name FROM part WHERE p_partkey % 9 = 4")
def code_tree(spark, sf_dir):
    """What the fifth file contains, parts as its symbols."""
    part = tables.read(spark, sf_dir, "part")
    file = F.concat(F.lit("file"), (F.col("p_partkey") % 9).cast("string"), F.lit(".py"))
    facts = part.select(file.alias("subject"), F.lit("contains").alias("label"), F.concat(file, F.lit("::"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("object"))
    return documents.code_tree(facts, "file4.py")


@query(W + "SELECT DISTINCT label FROM edges WHERE label <> 'supplies'")
def unknown_labels(spark, sf_dir):
    return audit.unknown_labels(_typed(spark, sf_dir), {"supplies": {}}).select("label")


@query(W + """, p AS (SELECT 'supplier:' || s_suppkey AS a, 'nation:' || (s_suppkey % 25) AS b FROM supplier)
SELECT a, b FROM p WHERE NOT EXISTS (SELECT 1 FROM edges WHERE (subject = a AND object = b) OR (subject = b AND object = a))""")
def unrelated_pairs(spark, sf_dir):
    """Suppliers with nations, without those that lie there."""
    pairs = tables.read(spark, sf_dir, "supplier").select(tables.named("supplier", "s_suppkey").alias("a"), F.concat(F.lit("nation:"), (F.col("s_suppkey") % 25).cast("string")).alias("b"))
    return entry.unrelated(pairs, _edges(spark, sf_dir))


@query(W + "SELECT DISTINCT label AS name, (SELECT count(DISTINCT label) FROM edges WHERE label <> 'part_of') AS total FROM edges WHERE label <> 'part_of' AND label > 'a' ORDER BY name LIMIT 10")
def label_page_excluding(spark, sf_dir):
    return match.vocabulary(_edges(spark, sf_dir), after="a", limit=10, kind="label", excluded=["part_of"])


@query(W + ", types_too AS (SELECT subject, label, object, total, n FROM edges UNION ALL SELECT concept, 'schema:type', type, 1.0, 1 FROM types) SELECT subject, label, object, total / n AS weight, n AS count FROM types_too WHERE label NOT IN ('schema:type', 'part_of')")
def hidden_labels(spark, sf_dir):
    """What walks and pages show where two labels are hidden."""
    return _rows(match.visible(_typed(spark, sf_dir), (tables.TYPE_LABEL, "part_of")))


@query(W + "SELECT subject, label, object, total / n AS weight, CAST((SELECT count(DISTINCT source) FROM shares s WHERE s.subject = e.subject AND s.object = e.object AND s.label = e.label) AS INTEGER) AS sources FROM edges e WHERE label = 'supplies'")
def corroboration(spark, sf_dir):
    """How many sources attest each edge."""
    said = tables.supplies(spark, sf_dir)
    edge = fold.with_attributions(fold.edges(said), fold.attributions(said))
    return evidence.corroboration(edge).select(*TRIPLE, average(F.col("sum"), F.col("count")).alias("weight"), "sources")


@query(W + FACTS + """, p AS (SELECT 'nation:' || n_nationkey AS a, 'nation:' || (n_nationkey + 1) AS b FROM nation),
held AS (SELECT a, b, d, l, o, max(CASE WHEN c = a THEN 1 ELSE 0 END) AS of_a, max(CASE WHEN c = b THEN 1 ELSE 0 END) AS of_b FROM p JOIN f ON c IN (a, b) GROUP BY ALL)
SELECT * FROM (SELECT a, b, CASE WHEN of_a + of_b = 2 THEN 'both' WHEN of_a = 1 THEN 'a' ELSE 'b' END AS side, d AS direction, l AS label, o AS other,
  CAST(row_number() OVER (PARTITION BY a, b, CASE WHEN of_a + of_b = 2 THEN 'both' WHEN of_a = 1 THEN 'a' ELSE 'b' END ORDER BY d, l, o) AS INTEGER) AS place FROM held) WHERE place <= 20""")
def merge_facts(spark, sf_dir):
    """For each nation and the next, what is said of both and of each alone."""
    pairs = tables.read(spark, sf_dir, "nation").select(tables.named("nation", "n_nationkey").alias("a"), F.concat(F.lit("nation:"), (F.col("n_nationkey") + 1).cast("string")).alias("b"))
    return audit.shared_facts(_edges(spark, sf_dir), pairs).select("a", "b", "side", "fact.direction", "fact.label", "fact.other", "place")


@query(W + """, around AS (SELECT subject AS concept, * FROM edges WHERE label <> 'supplies' UNION ALL SELECT object, * FROM edges WHERE label <> 'supplies' AND subject <> object),
best AS (SELECT *, row_number() OVER (PARTITION BY concept ORDER BY abs(total) DESC, first_seq, subject, label, object) AS place FROM around QUALIFY place <= 4),
told AS (SELECT *, lag(subject) OVER (PARTITION BY concept ORDER BY place) AS last FROM best),
glosses AS (SELECT concept, concept || '。' || string_agg(CASE WHEN subject <> concept AND subject IS DISTINCT FROM last THEN subject || 'の' ELSE '' END || label || 'は' || object || CASE WHEN total < 0 THEN 'ではない' ELSE '' END || '。', '' ORDER BY place) AS gloss FROM told GROUP BY concept),
found AS (SELECT 'nation:1' AS cue, concept AS name, least(length(concept), 8) / greatest(length(concept), 8) AS score FROM glosses WHERE contains(concept, 'nation:1'))
SELECT cue, name, round(score, 9) AS score, CASE WHEN row_number() OVER (ORDER BY score DESC, name) <= 8 THEN gloss END AS gloss FROM found JOIN glosses ON name = concept""")
def glossed_candidates(spark, sf_dir):
    """The names that ``nation:1`` may mean by being part of them, the first eight with their glosses."""
    edge = staged(fold.edges(tables.places(spark, sf_dir)), "places")
    found = entry.resolve_all(entry.spellings(edge), spark.createDataFrame([("nation:1",)], "cue string")).filter("kind <> 'fuzzy'").drop("kind")
    return gloss.glossed(found, gloss.concept_glosses(edge).drop("context"), ["cue"]).withColumn("score", F.round("score", 9))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 0.5 ELSE greatest(least(value / 50, 1.0), 0.0) END AS share FROM events")
def clamped_shares(spark, sf_dir):
    """Values as shares, into [0, 1]; those of errors aren't numbers and take the fallback."""
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value") / 50)
    return tables.read(spark, sf_dir, "events").select("event_id", scalar.clamped(value, 0.5).alias("share"))
