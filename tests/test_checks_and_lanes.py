"""Scenarios of glosses, extraction checks, lanes, retrieval, caches and audits on small tables."""

import json
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from knotwork.functions import scalar
from knotwork.operators import audit, community, entry, evidence, extraction, fold, gloss, groups, match, retrieve, search, traverse, vectors
from knotwork.plans import stage, tables
from knotwork.sources import documents, evalset
from test_operators import log


def test_glosses_name_the_heaviest_facts(spark):
    rows = [("mill", "keeper", "Oda", 2.0), ("Oda", "born_in", "Ise", 1.0), ("Oda", "tends", "wheel", 1.0), ("mill", "grinds", "sand", -1.0), ("mill", "is", "mill", 9.0), ("far", "x", "y", 1.0)]
    edge = fold.edges(log(spark, rows))
    got = {r.concept: r.gloss for r in gloss.concept_glosses(edge).collect()}
    assert got["Oda"] == "Oda。millのkeeperはOda。born_inはIse。tendsはwheel。"
    assert got["mill"] == "mill。isはmill。keeperはOda。grindsはsandではない。"  # a loop once
    assert {r.concept: r.gloss for r in gloss.concept_glosses(edge, 1).collect()}["Oda"] == "Oda。millのkeeperはOda。"
    dead = fold.apply_ops(spark.createDataFrame([("c", 1, "associate", "a", "l", "b", 5.0, "s"), ("c", 2, "associate", "a", "m", "c", 1.0, "t"), ("c", 3, "retract_association", "a", "l", "b", None, None)], "context string, seq long, op string, subject string, label string, object string, weight double, source string"))
    assert {r.concept: r.gloss for r in gloss.concept_glosses(dead).collect()}["a"] == "a。mはc。"
    labels = {r.label: r.gloss for r in gloss.label_glosses(fold.edges(log(spark, [("a", "l", "b", 3.0), ("a", "l", "c", 2.0), ("d", "l", "b", -1.0), ("e", "l", "f", 0.5)]))).collect()}
    assert labels == {"l": "l。aのlはb。lはc。dのlはbではない。"}
    found = spark.createDataFrame([("mill", 1.0), ("Oda", 0.5), ("nobody", 0.4)], "name string, score double")
    assert [(r.name, r.gloss is None) for r in gloss.glossed(found, gloss.concept_glosses(edge), most=1).orderBy(F.desc("score")).collect()] == [("mill", False), ("Oda", True), ("nobody", True)]


def test_names_occur_as_they_are_or_nearly(spark):
    text = extraction.squeezed("CI の テストランナー runs プールの最大接続数 and k6 on S3 Express")
    for name, want in (("CI テストランナー", True), ("プール最大接続数", True), ("k6", True), ("k7", False), ("S3Express", True), ("s3", True), ("", True), ("Quantum Flux", False), ("abc", False)):
        assert extraction.occurs(text, name) is want, name
    df = spark.createDataFrame([("The Blue Mill", "bluemill"), ("x", None), (None, "x")], "t string, n string")
    assert [r[0] for r in df.select(extraction.occurrence(F.col("t"), F.col("n"))).collect()] == [True, None, None]

    def plain(within, name):  # the longest covering runs, looked for from the longest down
        wanted, at, covered = extraction.squeezed(name), 0, 0
        if wanted in within:
            return True
        if len(wanted) <= 3:
            return False
        while at < len(wanted):
            run = next((n for n in range(len(wanted) - at, 0, -1) if wanted[at : at + n] in within), 0)
            covered, at = (covered + run, at + run) if run >= 2 else (covered, at + 1)
        return covered >= 0.75 * len(wanted)

    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n))
    for _ in range(400):
        within, name = extraction.squeezed(word(12)), word(rng.randrange(9))
        assert extraction.occurs(within, name) == plain(within, name)


def test_sentences_that_no_fact_covers(spark):
    texts = spark.createDataFrame([("d", "Oda tends the Wheel. still one。Ise makes Salt!\n\nonly。Mill grinds Corn"), ("e", "Alpha Beta")], "source string, text string")
    facts = spark.createDataFrame([("d", "Oda", "tends", "Wheel"), ("d", "Mill", "grinds", "Sand")], "source string, subject string, label string, object string")
    got = {(r.source, r.paragraph, r.quote) for r in extraction.coverage_gaps(texts, facts).collect()}
    assert got == {("d", 0, "Ise makes Salt"), ("e", 0, "Alpha Beta")}


def test_aliases_and_passes_of_an_extraction(spark):
    aliases = spark.createDataFrame([("O", "Oda"), ("O", "Ise"), ("Od", "Oda"), ("Oda", "Oda"), (" ", "Oda"), ("N", "Nobody"), ("Od", "Oda")], "alias string, canonical string")
    names = spark.createDataFrame([("Oda",), ("Ise",)], "name string")
    assert [tuple(r) for r in extraction.pruned_aliases(aliases, names).collect()] == [("Od", "Oda")]
    rows = spark.createDataFrame([("s", " a", "l", "b", 1.0), ("s", "a", "l", "b ", 3.0), ("s", "", "l", "b", 1.0), ("t", "a", "l", "b", None)], "source string, subject string, label string, object string, weight double")
    assert sorted((r.source, r.weight, r.n) for r in extraction.merged_extractions(rows).collect()) == [("s", 2.0, 2), ("t", 1.0, 1)]


def test_quotes_match_after_normalising(spark):
    df = spark.createDataFrame([(" ＡＢＣ ", "xx abc yy"), ("リンゴ", "りんご です"), ("z", "abc"), ("\n a  b", "A  B")], "q string, t string")
    assert [r[0] for r in df.select(extraction.quote_matches(F.col("q"), F.col("t"))).collect()] == [True, True, False, True]


def test_windows_and_pages(spark):
    with pytest.raises(ValueError, match="one context"):
        match.refuse_window(["a", "b"], 1, None)
    match.refuse_window(["a", "a"], 1, 2)
    match.refuse_window(["a", "b"], None, None)
    rows = traverse.explore(fold.edges(log(spark, [("a", "l", x, 1.0) for x in "bcdef"] + [("b", "l", "z", 1.0)])), ["a"], 2)
    first = traverse.explore_page(rows, 3).orderBy("distance", "subject", "label", "object").collect()
    assert [(r.object, r.total) for r in first] == [("b", 6), ("c", 6), ("d", 6)]
    last = first[-1]
    rest = traverse.explore_page(rows, 10, (last.distance, last.subject, last.label, last.object)).orderBy("distance", "object").collect()
    assert [(r.object, r.total) for r in rest] == [("e", 6), ("f", 6), ("z", 6)]


def test_schemas_are_refused_with_a_reason():
    assert audit.installed({"a": ["b"]}, {"l": {"domain": ["a"]}}) == {"a": {"a", "b"}, "b": {"b"}}
    deep = {f"t{i}": [f"t{i + 1}"] for i in range(7)}
    audit.installed(deep, {})
    for is_a, relations, why in (
        ({**deep, "t7": ["t8"]}, {}, "deeper"), ({"a": ["b"], "b": ["a"]}, {}, "ancestor"), ({f"t{i}": [] for i in range(501)}, {}, "500 types"), ({}, {f"r{i}": {} for i in range(501)}, "500 relations"),
        ({}, {tables.TYPE_LABEL: {}}, "reserved"), ({}, {"l": {"range": [f"t{i}" for i in range(65)]}}, "more than 64"), ({"é" * 513: []}, {}, "too long"),
    ):
        with pytest.raises(ValueError, match=why):
            audit.installed(is_a, relations)


def test_symbols_are_found_by_tier_and_misspelt(spark):
    names = ["src/a.rs::parse_batch", "src/a.rs::Reader::parse", "src/b.rs::tests::parse", "src/b.rs::parser", "src/a.rs", "src/parse"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    ask = lambda cue: [(r.name, r.tier) for r in documents.code_find(df, cue).collect()]
    assert ask("parse") == [(names[1], "exact"), (names[2], "exact"), (names[0], "prefix"), (names[3], "prefix"), (names[5], "path")]
    assert ask("Reader::parse") == [(names[1], "qualified")] and ask("a.rs::parse_batch") == [(names[0], "qualified")] and ask("a.rs") == [(names[4], "path")]
    assert ask("parse_bacth") == [(names[0], "fuzzy")] and ask("batch") == [(names[0], "contains")] and ask("zzzz") == []
    facts = documents.code_facts(spark.createDataFrame([("m.py", "class A:\n  def f(self):\n    pass\ndef g(): pass\n")], "path string, text string"))
    tree = lambda n=None: [r.name for r in documents.code_tree(facts, n).collect()]
    assert (tree(), tree("m.py"), tree("m.py::A"), tree("none")) == (["m.py"], ["m.py::A", "m.py::g"], ["m.py::A::f"], [])


def test_small_functions(spark):
    assert [scalar.fnv1a(b) for b in (b"", b"a")] == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C]
    assert scalar.folded(["ab", "c"]) != scalar.folded(["a", "bc"])
    df = spark.createDataFrame([("aaa", "aa"), ("Ab", "aB"), ("a", "A"), ("a", "b"), ("abab", "baba")], "a string, b string")
    assert [round(r[0], 6) for r in df.select(scalar.multiset_dice(F.col("a"), F.col("b"))).collect()] == [0.666667, 1.0, 1.0, 0.0, 0.666667]
    sizes = spark.createDataFrame([(1, "é"), (2, None)], "i int, s string").select(scalar.json_bytes(F.struct("i", "s"))).collect()
    assert [r[0] for r in sizes] == [len('{"i":1,"s":"é"}'.encode()), len('{"i":2}')]


def test_plans_say_why_a_lane_does_not_run():
    why = lambda *a, **k: [r for _, _, r in search.plan(*a, **k)]
    model = ("m", 8)
    assert why(0, "x", True, model, model) == ["zero_limit"] * 2 and why(5, " ! ", True, model, model) == ["no_query_terms"] * 2
    assert why(5, "x", True, model, model) == [None, None] and why(5, "x", False, model, None) == [None, "off"] and why(5, "x", True, None, model) == [None, "no_vectors"]
    assert why(5, "x", True, ("n", 8), model) == [None, "model_changed"] and why(5, "x", True, ("m", 9), model) == [None, "width_changed"]
    assert why(5, "x", True, model, model, "timeout") == [None, "query_embedding_failed: timeout"]


def brute_nearest(rows, asked, k):
    out = {}
    for q, v in asked:
        v = np.array(v, float)
        found = []
        for s, p, w in rows:
            w = np.array(w, float)
            n = np.linalg.norm(v) * np.linalg.norm(w) if len(v) == len(w) else 0
            found.append((-round(float(v @ w / n), 6) if n else 0.0, s, p))
        out[q] = [(s, p, -x) for x, s, p in sorted(found)[:k]]
    return out


def test_nearest_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "ROWS", 16)
    rng = np.random.default_rng(1)
    rows = [(f"d{i}", i % 3, rng.normal(size=6).tolist()) for i in range(150)] + [(f"t{i}", 0, [1.0] * 6) for i in range(40)] + [("z", 0, [0.0] * 6), ("w", 0, [1.0, 2.0])]
    asked = [(f"q{i}", rng.normal(size=6).tolist()) for i in range(20)] + [("ones", [1.0] * 6), ("zero", [0.0] * 6), ("narrow", [2.0, 4.0])]
    got = {}
    for r in vectors.nearest(spark.createDataFrame(rows + [("null", 0, None)], "source string, paragraph int, vector array<double>"), spark.createDataFrame(asked, "query string, vector array<double>"), 9).collect():
        got.setdefault(r.query, []).append((-r.score, r.source, r.paragraph))
    assert {q: [(s, p, -x) for x, s, p in sorted(f)] for q, f in got.items()} == brute_nearest(rows, asked, 9)


def test_lists_find_most_of_the_nearest(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 24))
    rows = spark.createDataFrame([(f"d{i}", 0, v.tolist()) for i, v in enumerate(x)], "source string, paragraph int, vector array<double>")
    asked = spark.createDataFrame([(f"q{i}", x[i].tolist()) for i in range(0, 3000, 100)], "query string, vector array<double>")
    index = vectors.inverted(rows)
    assert sum(index[2].values()) == 3000 and len(index[1]) == 54
    pairs = lambda df: {(r.query, r.source) for r in df.collect()}
    exact, found = pairs(vectors.nearest(rows, asked, 50)), pairs(vectors.nearest_by_lists(index, asked, 50))
    assert len(found) == len(exact) and len(exact & found) >= 0.8 * len(exact)


def test_an_index_is_brought_up_to_date(spark):
    tokenize = lambda rows: search.tokenized(search.paragraphs(rows, ["source"]))
    table = lambda rows: spark.createDataFrame(rows, "source string, text string").withColumn("digest", F.xxhash64("text"))
    before, now = table([("a", "one two"), ("b", "three"), ("c", "four four")]), table([("a", "one two"), ("b", "three more"), ("d", "five")])
    tokens = tokenize(before)
    posted, length = search.refreshed(search.postings(tokens), search.lengths(tokens), before, now, tokenize)
    whole = tokenize(now)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(posted) == key(search.postings(whole)) and key(length) == key(search.lengths(whole))


def test_kept_tables_are_built_anew_when_their_input_changes(spark, tmp_path, monkeypatch):
    source, built = f"{tmp_path}/in.parquet", []
    spark.range(3).write.parquet(source)

    def build():
        built.append(1)
        return {"n": spark.read.parquet(source).agg(F.count("*").alias("n"))}

    ask = lambda: stage.kept(spark, "counted", [source], build, ["n"])["n"].collect()[0].n
    assert (ask(), ask(), len(built)) == (3, 3, 1)
    spark.range(5).write.mode("overwrite").parquet(source)
    assert (ask(), len(built)) == (5, 2)
    monkeypatch.setattr(stage, "LISTED", 0)
    before = stage.state_of(spark, source)
    assert before == stage.state_of(spark, source)
    spark.range(5).write.mode("append").parquet(source)
    assert before != stage.state_of(spark, source)


def test_retrieval_in_one_go(spark):
    rows = [("mill", "keeper", "Oda", 2.0, "s", 0), ("mill", "river", "Ise", 1.0, "t", 1), ("Oda", "born_in", "Nara", 1.0, "gone", 0), ("qq", "l", "ww", 1.0)]
    paragraphs = spark.createDataFrame([("c", "s", 0, "the keeper"), ("c", "t", 1, "the river"), ("c", "t", 0, "else")], "context string, source string, paragraph int, text string")
    aliases = spark.createDataFrame([("c", "concept", "watermill", "mill")], "context string, kind string, alias string, canonical string")
    t = tables.Tables(log(spark, rows), None, aliases, paragraphs)
    found = retrieve.retrieve(t, ["WaterMill", "oda", "WaterMill", "nobody at all"], ["keeper"])
    assert found.anchors == ["mill", "Oda"] and found.fallback == "not_requested"
    assert [(r.origin, r.object) for r in found.associations.orderBy("place").collect()] == [("query", "Oda"), ("activate", "Nara"), ("activate", "Ise")]
    assert sorted((r.source, r.paragraph) for r in found.citations.collect()) == [("s", 0), ("t", 1)]
    assert {(r.concept, r.role, r.label) for r in found.outline.collect()} == {("mill", "subject", "keeper"), ("mill", "subject", "river"), ("Oda", "object", "keeper"), ("Oda", "subject", "born_in")}
    index = search.indexed(search.tokenized(paragraphs))
    asked = search.query_terms(spark.createDataFrame([("q", "river")], "query string, text string"))
    empty = retrieve.retrieve(t, ["zzz"], fallback=(index, asked))
    assert empty.anchors == [] and empty.fallback == "graph_empty" and [(r.source, r.paragraph) for r in empty.passages.collect()] == [("t", 1)]
    assert retrieve.retrieve(t, ["oda"], fallback=(index, asked)).fallback == "suppressed"
    with pytest.raises(ValueError, match="at most"):
        retrieve.retrieve(t, [str(i) for i in range(1001)])


def test_resolving_all_cues_is_resolving_each(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcд ") for _ in range(rng.randrange(1, 9)))
    edge = fold.edges(log(spark, [(word() or "x", "l", word() or "y", 1.0) for _ in range(40)] + [("a", "l", "歯車", 1.0)]))
    spelled = entry.spellings(edge, spark.createDataFrame([("c", "concept", "other name", "歯車")], "context string, kind string, alias string, canonical string"))
    cues = [word() for _ in range(12)] + ["a", "OTHER", "歯", "", "zzzz"]
    got = {(r.cue, r.name): (round(r.score, 9), r.kind) for r in entry.resolve_all(spelled, spark.createDataFrame([(c,) for c in cues], "cue string")).collect()}
    assert got == {(c, r.name): (round(r.score, 9), r.kind) for c in set(cues) for r in entry.resolve(spelled, c).collect()}


def test_rerankers_that_fail_change_nothing():
    rows = [dict(kind="passage", item=str(i), source=str(i), text=f"{i}{i} text {i * 7}", score=1 - i / 10, group=None) for i in range(4)]
    items = lambda order: [r["item"] for r in evidence.select_pool(rows, order=order)]
    assert items(None) == ["0", "1", "2", "3"] and items(lambda t: list(range(len(t)))[::-1]) == ["3", "2", "1", "0"]

    def broken(_):
        raise RuntimeError

    for order, why in ((lambda t: [0, 0, 1, 2], "not_a_permutation"), (lambda t: [0], "not_a_permutation"), (broken, "failed: RuntimeError")):
        kept, reason = evidence.reordered(rows, order)
        assert (kept, reason) == (rows, why) and items(order) == ["0", "1", "2", "3"]


def test_shared_citations_are_charged_once():
    cite = [{"key": "s#1", "text": "x" * 60}]
    rows = [dict(kind="association", item=str(i), source="s", text="", score=1 - i / 10, group=None, citations=cite) for i in range(5)]
    assert len(evidence.select_pool(rows, most_bytes=100)) == 5
    rows[2]["citations"] = [{"key": "s#2", "text": "y" * 60}]
    assert [r["item"] for r in evidence.select_pool(rows, most_bytes=100)] == ["0", "1", "3", "4"]


def test_caches_serve_paraphrases_only(spark):
    asked = spark.createDataFrame([("q1", "is it open at 20"), ("q2", "is it not open at 20"), ("q3", "open at 21")], "query string, text string")
    cached = spark.createDataFrame([("e1", "open at ２０?"), ("e2", "other 20")], "entry string, text string")
    near = spark.createDataFrame([("q1", "e1", 0.95), ("q1", "e2", 0.9), ("q2", "e1", 0.99), ("q3", "e1", 0.99), ("q3", "e2", 0.1)], "query string, source string, score double")
    assert [tuple(r) for r in search.from_cache(near, asked, cached, 0.8).collect()] == [("q1", "e1", 0.95)]


def test_sets_of_questions_are_checked(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [{"kb_eval": 1}, {"case_id": "a", "query": "q", "expected_sources": [{"source": "s", "relevance": 2}]}, {"case_id": "b", "query": " "}, {"case_id": "a", "query": "again"}, {"case_id": "c", "query": "q", "typo": 1}, {"case_id": "d", "query": "q", "expected_sources": [{"source": "s", "relevance": 4}]}]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n")
    (tmp_path / "in" / "b.jsonl").write_text(json.dumps({"kb_eval": 2}))
    got = {(r.file[-7:], r.line): r.refused for r in evalset.load(spark, str(tmp_path / "in")).collect()}
    assert got == {("a.jsonl", 1): None, ("a.jsonl", 2): "query is empty", ("a.jsonl", 3): "case_id repeats", ("a.jsonl", 4): "unknown field", ("a.jsonl", 5): "expected source without name or of a relevance above 3", ("a.jsonl", 6): "not JSON", ("b.jsonl", 0): "not a header of this version"}
    with pytest.raises(ValueError, match="line 3: query is empty"):
        evalset.checked(evalset.load(spark, str(tmp_path / "in" / "a.jsonl")))


def test_communities_are_connected_and_follow_the_order_of_first_sight(spark):
    rng = random.Random(6)
    edge = fold.edges(log(spark, [(f"n{rng.randrange(30)}", "l", f"n{rng.randrange(30)}", float(rng.randrange(1, 4))) for _ in range(60)]))
    graph = community.leaf_graph(edge)
    near = {}
    for r in graph.collect():
        near.setdefault(r.a, set()).add(r.b)
        near.setdefault(r.b, set()).add(r.a)
    rows = community.communities(edge).collect()
    for level in {r.level for r in rows}:
        for name in {r.community for r in rows if r.level == level}:
            inside = {r.concept for r in rows if r.level == level and r.community == name}
            reached, todo = set(), [min(inside)]
            while todo:
                c = todo.pop()
                if c not in reached:
                    reached.add(c)
                    todo += near[c] & inside
            assert reached == inside
    by_level = {r.level: r.modularity for r in community.modularity(graph, community.communities(edge)).collect()}
    values = [by_level[k] for k in sorted(by_level)]
    assert values[0] > 0 and values == sorted(values)
    square = [("b", "a", 1.0), ("a", "c", 1.0), ("c", "d", 1.0), ("d", "b", 1.0)]
    one = community.detect([(min(a, b), max(a, b), w) for a, b, w in square], {"b": 0, "a": 1, "c": 3, "d": 5})
    assert one[0] == [["a", "b"], ["c", "d"]] and community.detect([(min(a, b), max(a, b), w) for a, b, w in square], {"b": 9, "a": 1, "c": 3, "d": 5})[0] == [["a", "c"], ["b", "d"]]


def test_related_names_are_no_twins(spark):
    edge = fold.edges(log(spark, [("a", "l", "b", 1.0), ("c", "m", "d", 1.0), ("c", "l", "e", 1.0)]))
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "a", 0.9), ("a", "c", 0.8)], "a string, b string, score double")
    assert [(r.a, r.b) for r in entry.unrelated(pairs, edge).collect()] == [("a", "c")]
    labels = spark.createDataFrame([("l", "m", 0.9), ("l", "n", 0.9)], "a string, b string, score double")
    assert [(r.a, r.b) for r in entry.unrelated(labels, edge, "label").collect()] == [("l", "n")]
    types = spark.createDataFrame([("c",)], "name string")
    assert sorted((r.a, r.b, r.tier) for r in entry.audited_names(pairs.limit(1), pairs, types).collect()) == [("a", "b", "lexical"), ("b", "a", "semantic")]


def test_sections_of_an_audit(spark):
    log_ = log(spark, [("k", "chief", "A", 1.0, "s"), ("k", "chief", "B", 1.0, "t"), ("m", "chief", "A", 1.0, "s"), ("m", "near", "A", 1.0, "s"), ("m", "near", "A", -1.0, "t")])
    edge, shares = fold.edges(log_), fold.attributions(log_)
    sources = spark.createDataFrame([("c", "s", None, 100), ("c", "t", None, 900)], "context string, source string, stored_at long, date long")
    pairs = spark.createDataFrame([("k", "m", 0.5), ("A", "B", 0.9)], "a string, b string, score double")
    out = audit.consolidation(edge, shares, sources, pairs, {"merge", "contradiction", "staleness"})
    assert [(r.a, r.b, round(r.overlap, 3)) for r in out["merge"].collect()] == [("A", "B", 0.333), ("k", "m", 0.333)]
    assert [(r.place, r.kind, r.subject) for r in out["contradiction"].orderBy("place").collect()] == [(1, "objects", "k"), (2, "contested", "m")]
    assert [(r.subject, r.object, r.gap) for r in out["staleness"].collect()] == [("k", "A", 800), ("m", "A", 800)]
    with pytest.raises(ValueError, match="one at least"):
        audit.consolidation(edge, shares, sources, pairs, set())
    facts = {(r.side, r.fact.direction, r.fact.label, r.fact.other) for r in audit.shared_facts(edge, pairs.filter("a = 'k'")).collect()}
    assert facts == {("both", "out", "chief", "A"), ("a", "out", "chief", "B"), ("b", "out", "near", "A")}
    assert {r.label for r in audit.unknown_labels(edge, {"near": {}}).collect()} == {"chief"}


def test_large_groups_and_files_are_refused_aloud(spark, tmp_path):
    held = spark.createDataFrame([("big", [f"c{i}" for i in range(1001)], []), ("small", ["b", "a"], [])], "name string, contexts array<string>, groups array<string>")
    assert groups.targets(["z", "a"], held, ["small"]) == ["z", "a", "b"]
    with pytest.raises(ValueError, match="big holds more than 1000"):
        groups.targets([], held, ["big"])
    (tmp_path / "a.md").write_text("\ufeffsmall")
    (tmp_path / "b.txt").write_text("x" * 50)
    got = {r.source: (r.text, r.refused) for r in documents.discover(spark, str(tmp_path), 20).collect()}
    assert got == {"a.md": ("small", None), "b.txt": (None, "50 bytes, 20 at most")}


def test_twins_are_found_among_any_number_of_names(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2600, 8))
    x[100:160] = x[7]  # more pairs of copies than are asked for
    x[2500] = 0.0
    rows = spark.createDataFrame([(f"n{i}", v.tolist()) for i, v in enumerate(x)], "name string, vector array<double>").repartition(3)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
    scores, names = np.round(unit @ unit.T, 6), [f"n{i}" for i in range(len(x))]
    for limit in (5, 100, 3000):
        edge = np.sort(scores[np.triu_indices(len(x), 1)])[-limit]
        want = sorted((-scores[i, j], *sorted((names[i], names[j]))) for i, j in zip(*np.nonzero(scores >= edge), strict=True) if i < j)[:limit]
        assert [(-r.score, r.a, r.b) for r in entry.semantic_twins(rows, 0.3, limit).collect()] == want
    assert entry.semantic_twins(rows.limit(1), 0.3).collect() == []


def test_communities_shuffle_their_edges_once_and_fold_by_keys(spark, sf, tmp_path):
    said, keyed = fold.edges(tables.regional(spark, sf).assertions), tables.regional_edges(spark, sf)
    assert said.schema == keyed.schema and said.exceptAll(keyed).isEmpty() and keyed.exceptAll(said).isEmpty()
    stored = stage.staged(keyed, "edges")
    assert community.communities(stored)._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    assert community.communities(stored)._jdf.queryExecution().sparkPlan().toString().count("Join") == 0
    assert keyed._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [l_suppkey") == 1
    several = [r for c in "xyz" for r in [(c, i, f"{c}{i % 7}", "l", f"n{i % 5}", 1.0, "s", 0) for i in range(40)]] + [("w", 1, "a", "l", "a", 1.0, "s", 0), ("v", 1, "a", "l", "b", 0.0, "s", 0)]
    rows = community.communities(fold.edges(spark.createDataFrame(several, "context string, seq long, subject string, label string, object string, weight double, source string, paragraph int"))).collect()
    assert {r.context for r in rows} == set("xyz") and {r.concept for r in rows if r.context == "x" and r.level == 0} == {f"x{i}" for i in range(7)} | {f"n{i}" for i in range(5)}


def test_communities_hold_pairs_as_numbers():
    rng = np.random.default_rng(1)
    n = 60_000
    columns = [["c"] * n, [f"supplier:{i}" for i in rng.integers(0, 100, n)], [f"part:{i}" for i in rng.integers(0, 10_000, n)], np.ones(n), np.arange(n)]
    batches = pa.Table.from_arrays([pa.array(c) for c in columns], ["context", "subject", "object", "weight", "first_seq"]).to_batches(10_000)
    tracemalloc.start()
    rows = sum(b.num_rows for b in community._analysed(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows >= 10_000 and peak < 400 * n


def test_cohesion_is_modularity(spark):
    rng = random.Random(8)
    edge = fold.edges(log(spark, [(f"n{rng.randrange(40)}", "l", f"n{rng.randrange(40)}", rng.choice([1.0, -2.0, 0.5])) for _ in range(120)]))
    members = community.analysed(edge)
    by_join = {r.level: r.modularity for r in community.modularity(community.leaf_graph(edge), members).collect()}
    assert {r.level: r.modularity for r in community.cohesion(members).collect()} == pytest.approx(by_join)
