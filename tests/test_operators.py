"""Scenarios and invariants of the knowledge operators on small tables."""

import json
import random

import pytest
from pyspark.sql import functions as F

from knotwork.functions import scalar
from knotwork.operators import audit, community, entry, evaluate, evidence, fold, groups, match, search, traverse
from knotwork.plans.tables import Tables
from knotwork.sources import documents, jsonl
from knotwork.streaming import oplog

LOG = "context string, seq long, subject string, label string, object string, weight double, source string, paragraph int"


def log(spark, rows):
    """Rows (subject, label, object, weight, source?, paragraph?) in order."""
    return spark.createDataFrame([("c", i, *r[:4], *(r[4:] + (None,) * (6 - len(r)))) for i, r in enumerate(rows)], LOG)


def millers(spark):
    return log(
        spark,
        [
            ("mill", "keeper", "Oda", 1.0, "old", 1), ("mill", "keeper", "Rin", 1.0, "new", 2), ("mill", "makes", "Flour", 2.0, "old", 3), ("mill", "makes", "Flour", 4.0, "new", 1),
            ("Oda", "knows", "Rin", -1.0, "old", 4), ("Rin", "born_in", "Ise", 1.0), ("far", "near", "away", 1.0, "old", 5), ("loop", "is", "loop", 3.0, "new", 1),
        ],
    )


def dates(spark):
    return spark.createDataFrame([("c", "old", 5, 100, ["a"]), ("c", "new", None, 200, ["b"]), ("c", "undated", None, None, ["a"])], "context string, source string, stored_at long, date long, tags array<string>")


def test_fold_accumulates_and_keeps_the_first_paragraph(spark):
    edge = {r.object: r for r in fold.edges(millers(spark)).collect()}
    assert (edge["Flour"].sum, edge["Flour"]["count"]) == (6.0, 2)
    shares = {(r.object, r.source): r.paragraph for r in fold.attributions(millers(spark)).collect()}
    assert shares["Flour", "old"] == 3 and shares["Flour", "new"] == 1


def test_shares_and_unsourced_weight_add_up(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), "l", rng.choice("xy"), float(rng.randrange(-4, 5)), rng.choice(["s", "t", None])) for _ in range(200)]
    df = log(spark, rows)
    total = {r.object + r.subject: r.sum for r in fold.edges(df).collect()}
    named, rest = {}, {}
    for r in fold.attributions(df).collect():
        named[r.object + r.subject] = named.get(r.object + r.subject, 0) + r.sum
    for r in fold.unsourced_edges(df).collect():
        rest[r.object + r.subject] = r.residual
    assert all(total[k] == named.get(k, 0) + rest.get(k, 0) for k in total)


def test_retraction_leaves_dead_edges_that_only_plain_reads_show(spark):
    edge = fold.retract_source(millers(spark), "old")
    assert {r.object: r["count"] for r in edge.collect()}["Oda"] == 0
    assert match.recall(edge, "Oda").filter("count = 0").count() == 2
    assert match.describe(edge, "mill").filter("label = 'keeper'").collect()[0].edges == 1
    assert "Oda" not in {r.object for r in fold.compacted(edge).collect()}


def test_barriers_of_the_op_log(spark):
    rows = [(1, "associate", "a", 1.0, "s"), (2, "associate", "a", 2.0, "t"), (3, "retract_source", None, None, "s"), (4, "associate", "a", 5.0, "s"), (5, "associate", "b", 1.0, "s"), (6, "retract_association", "b", None, None), (7, "associate", "b", 7.0, None)]
    ops = spark.createDataFrame([("c", q, op, "x" if o else None, "l" if o else None, o, w, s) for q, op, o, w, s in rows], "context string, seq long, op string, subject string, label string, object string, weight double, source string")
    want = {"a": (7.0, 2), "b": (7.0, 1)}
    assert {r.object: (r.sum, r["count"]) for r in fold.apply_ops(ops).collect()} == want
    for cut in range(1, 7):  # the stream's merge gives the same, wherever batches are cut
        state = oplog.merged(oplog.merged(None, ops.filter(f"seq <= {cut}")), ops.filter(f"seq > {cut}"))
        assert {r.object: (r.sum, r["count"]) for r in oplog.edges(state).collect()} == want


def test_windows_see_only_what_dated_sources_attest(spark):
    t = Tables(millers(spark), dates(spark))
    past = match.windowed(t, until=150)
    assert {r.object for r in past.collect()} == {"Oda", "Flour", "Rin", "away"} and "mill Rin" not in {f"{r.subject} {r.object}" for r in past.collect()}
    assert [(r.sum, r["count"]) for r in past.filter("object = 'Flour'").collect()] == [(2.0, 1)]
    with pytest.raises(ValueError):
        match.source_filter(dates(spark), since=2, until=2)


def test_types_and_schema(spark):
    rows = [("k", "schema:type", "Mill", 1.0), ("p", "schema:type", "Person", 1.0), ("k", "keeper", "p", 1.0), ("p", "keeper", "k", 1.0), ("u", "keeper", "v", 1.0), ("k", "odd", "p", 1.0)]
    edge, is_a = fold.edges(log(spark, rows)), {"Mill": ["Organisation"], "Person": []}
    found = {(r.subject, r.label, r.kind) for r in audit.schema_violations(edge, is_a, {"keeper": {"domain": ["Organisation"], "range": ["Person"]}}, True).collect()}
    assert found == {("p", "keeper", "domain"), ("p", "keeper", "range"), ("k", "odd", "label")}
    assert match.type_filter(match.visible(edge), match.expanded_types(edge, {}), ["Nothing"]).count() == 0
    with pytest.raises(ValueError):
        match.closure({"a": ["b"], "b": ["a"]})


def best_first(edges, origins, decay):
    """Strength of every concept by relaxation until nothing changes."""
    near = {}
    for s, o, w in edges:
        if w:
            near.setdefault(s, []).append((o, abs(w)))
            if s != o:
                near.setdefault(o, []).append((s, abs(w)))
    best = {o: 1.0 for o in origins if o in near}
    while True:
        new = dict(best)
        for c, a in best.items():
            total = sum(w for _, w in near[c])
            for o, w in near[c]:
                f = a * decay * w / total
                if f >= traverse.FLOOR and f > new.get(o, 0):
                    new[o] = f
        if new == best:
            return best
        best = new


def test_walks_against_plain_ones(spark):
    rng = random.Random(5)
    rows = [(f"n{rng.randrange(12)}", rng.choice("lm"), f"n{rng.randrange(12)}", float(rng.choice([-2, -1, 1, 1, 3]))) for _ in range(22)] + [("z1", "l", "z2", 1.0)]
    edge = fold.edges(log(spark, rows))
    plain = [(r.subject, r.object, r.sum) for r in edge.collect()]
    got = {r.concept: r.strength for r in traverse.activation(edge, ["n1", "nobody"]).collect()}
    want = best_first(plain, ["n1"], 0.5)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    hops = {"n1": 0}
    while True:
        more = {b: hops[a] + 1 for s, o, _ in plain for a, b in ((s, o), (o, s)) if a in hops and b not in hops}
        if not more:
            break
        hops |= {k: min(v for b, v in ((b, hops[a] + 1) for s, o, _ in plain for a, b in ((s, o), (o, s)) if a in hops) if b == k) for k in more}
    found = {(r.subject, r.label, r.object): r for r in traverse.explore(edge, ["n1"], 3).collect()}
    assert all(r.distance == min(hops[k[0]], hops[k[2]]) + 1 for k, r in found.items()) and all(r.path[0] == "n1" and len(r.path) == r.distance for r in found.values())
    assert {(s, o) for s, o, _ in plain if min(hops.get(s, 9), hops.get(o, 9)) < 3} == {(k[0], k[2]) for k in found}
    assert {r.subject for r in traverse.unreachable_from(edge, ["n1"]).collect()} == {s for s, _, _ in plain if s not in hops}
    assert traverse.unreachable_from(edge, ["nobody"]).count() == edge.count()

    def trails(at, seen, left):
        if seen[1:] and at in ("n2", "n3"):
            yield tuple(seen)
        if left:
            for i, (s, o, _) in enumerate(plain):
                for a, b in {(s, o), (o, s)}:
                    if a == at and b not in seen:
                        yield from trails(b, [*seen, b], left - 1)

    got, capped = traverse.paths(edge, ["n1"], ["n2", "n3"], 4, 1000)
    assert not capped and sorted(tuple(r.concepts) for r in got.collect()) == sorted(trails("n1", ["n1"], 4))


def test_resolve_tiers(spark):
    edge = fold.edges(log(spark, [("歯車", "is", "歯車工房", 1.0), ("12番歯車展示会", "is", "Apple", 1.0), ("リンゴ", "is", "x", 1.0)]))
    spelled = entry.spellings(edge, spark.createDataFrame([("c", "concept", "pomme", "Apple")], "context string, kind string, alias string, canonical string"))
    ask = lambda cue: [(r.name, round(r.score, 6), r.kind) for r in entry.resolve(spelled, cue).collect()]
    assert ask("歯車")[:2] == [("歯車", 1.0, "exact"), ("歯車工房", 0.5, "containment")]
    assert ask("展示会") == [("12番歯車展示会", 0.375, "containment")]
    assert ask("ＡＰＰＬＥ") == [("Apple", 1.0, "exact")] and ask("POMME") == [("Apple", 1.0, "alias")] and ask("りんご") == [("リンゴ", 1.0, "exact")]
    assert ask("aple")[0][0] == "Apple" and ask("aple")[0][2] == "fuzzy" and ask("") == [] and ask("zzz") == []


def test_terms_and_paragraphs(spark):
    assert scalar.terms_of("HTTPServer v2 第10篇 日") == ["httpserver", "v2", "第", "10", "篇", "日", "http", "server"]
    assert scalar.terms_of("Größe ön") == ["gr", "ö", "ß", "e", "ö", "n"] or scalar.terms_of("Größe ön") == ["gr", "öß", "e", "ö", "n"]
    df = spark.createDataFrame([("c", "s", "\n \na\nb\r\n\u3000\nc  \n\n\n"), ("c", "t", " \n\t"), ("c", "u", "")], "context string, source string, text string")
    assert sorted((r.source, r.paragraph, r.text) for r in search.paragraphs(df).collect()) == [("s", 0, "a\nb"), ("s", 1, "c  ")]


def test_plain_terms_are_the_same_bag(spark):
    texts = ["HTTPServer v2 iPhone4S aB", "Größe ön été À l'Œuvre", "", "x_y-z 10%", "ABCdef GHi", "ÿÀ ßa éé", "camelCase and XMLHttpRequest2 Übung", "a\u00a0b", "日本 word", "½ ²", "ÀéÎõ", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: sorted(r.x) for r in df.select("i", scalar.terms(F.col("t")).alias("x")).collect()}
    assert got == {i: sorted(scalar.terms_of(t)) if t is not None else [] for i, t in enumerate(texts)}
    low = {r.i: r.x for r in df.select("i", scalar.normalized(F.col("t")).alias("x")).collect()}
    assert low == {i: None if t is None else scalar._normalized(t) for i, t in enumerate(texts)}


def test_selection_is_greedy_and_keeps_groups_together():
    rows = [dict(kind="passage", item=str(i), source=s, text=t, score=1 - i / 10, group=g) for i, (s, t, g) in enumerate([("a", "same text here", None), ("b", "same text here", None), ("a", "y" * 50, None), ("c", "z" * 400, "g"), ("c", "w" * 10, "g"), ("d", "q" * 20, None)])]
    assert [r["item"] for r in evidence.select_pool(rows, items=8, most_bytes=100)] == ["0", "2", "5"]
    assert [r["item"] for r in evidence.select_pool(rows, items=8)] == ["0", "2", "3", "4", "5"] or [r["item"] for r in evidence.select_pool(rows, items=8)][0] == "0"
    assert evidence.token_count("abcd") == 1 and evidence.token_count("日a") == 2


def test_measures(spark):
    hits = spark.createDataFrame([("q", "a", 1), ("q", "x", 2), ("q", "b", 3), ("q", "a", 4)], "query string, item string, rank int")
    want = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 1), ("q", "d", 0)], "query string, item string, relevance int")
    r = evaluate.retrieval(hits, want, 10).collect()[0]
    assert (round(r.recall, 6), r.reciprocal) == (0.666667, 1.0) and abs(r.ndcg - (1 + 2 / 2) / (2 + 1 / 1.5849625 + 1 / 2)) < 1e-6
    d = evaluate.distribution(spark.createDataFrame([("k", float(v)) for v in (5, 1, 2, 3, 4)] + [("k", float("nan"))], "k string, v double"), "v", ["k"]).collect()[0]
    assert (d.n, d.min, d.p50, d.p90, d.p99, d.max, d.mean) == (5, 1, 3, 5, 5, 5, 3)


def test_communities_split_two_cliques(spark):
    rows = [(f"{g}{i}", "l", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i)] + [("a0", "l", "b0", 1.0)]
    found = {r.concept: r.community for r in community.communities(fold.edges(log(spark, rows))).filter("level = 0").collect()}
    assert len({found[f"a{i}"] for i in range(5)}) == len({found[f"b{i}"] for i in range(5)}) == 1 and found["a1"] != found["b1"]


def test_groups():
    assert groups.validate({"a": {"groups": ["b"]}, "b": {"groups": ["a"]}}) == [("b", "a")]
    assert groups.validate({"a": {"groups": ["b"]}, "b": {"groups": ["c"]}, "c": {"groups": ["d"]}, "d": {}}) == [("c", "d")]
    assert groups.changed_members(["x", "y"], ["z", "x"], ["x"], {"x", "z"}) == ["y", "z", "x"]
    with pytest.raises(LookupError):
        groups.changed_members([], ["q"], [], set())


def test_import_of_json_lines(spark, tmp_path):
    lines = [{"kb_batch": 1, "context": "c", "source": "s"}, {"passage": "a\n\nb", "date": 5, "tags": ["t"]}, {"subject": "x", "label": "l", "object": "y", "weight": -1.0, "paragraph": 1}, {"alias": "ex", "canonical": "x"},
             {"question": "why", "paragraph": 0}, {"section": "one", "paragraph": 0}, {"section": "two", "paragraph": 0}, {"surprise": 1}, {"kb_batch": 1, "context": "c", "source": "t"}, {"subject": "x", "label": "l", "object": "z"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nno json\n")
    read = jsonl.parsed(jsonl.lines(spark, str(tmp_path / "in")))
    assert sorted((r.source, r.object, r.weight) for r in jsonl.associations(read).collect()) == [("s", "y", -1.0), ("t", "z", 1.0)]
    assert [(r.source, r.date, r.tags) for r in jsonl.passages(read).collect()] == [("s", 5, ["t"])]
    assert [(r.kind, r.alias) for r in jsonl.aliases(read).collect()] == [("concept", "ex")]
    assert [(r.paragraph, r.questions, r.section) for r in jsonl.marks(read).collect()] == [(0, ["why"], "two")]
    assert {(r.source, r.what): r.n for r in jsonl.preview(read).collect()}[("s", "refused")] == 1


def test_pages_and_code(spark):
    title, canonical, blocks = documents.page_parts("<title>T</title><link rel=canonical href=/x><script>no()</script><h1>Head</h1><p>One <b>two</b><p>three &amp; four</p>")
    assert (title, canonical, blocks) == ("T", "/x", [("Head", "One two"), ("Head", "three & four")])
    facts = documents.code_facts(spark.createDataFrame([("m.py", "class A:\n  def f(self):\n    pass\n"), ("bad.py", "def (")], "path string, text string")).collect()
    assert {(r.subject, r.label, r.object) for r in facts} == {("m.py::A", "defined_in", "m.py"), ("m.py", "contains", "m.py::A"), ("m.py::A::f", "defined_in", "m.py"), ("m.py::A", "contains", "m.py::A::f")}


def test_references_in_pages_end_with_a_semicolon():
    title, canonical, blocks = documents.page_parts("<title>and&amp;&amp</title><link rel=canonical href='/x?a=1&copy=2&amp;b=3'><p>R&ampD &#228; &#228 &notit; &eacute; &quo &")
    assert (title, canonical, blocks) == ("and&&amp", "/x?a=1&copy=2&b=3", [(None, "R&ampD ä &#228 &notit; é &quo &")])


def test_guard_tells_negations_numbers_and_names_apart(spark):
    same = lambda a, b: scalar.guard_marks(a) == scalar.guard_marks(b)
    assert same("Does it open at ２０?", "is it open at 20") and not same("does it", "doesn't it") and not same("about Paris", "about Rome") and not same("v2", "v3")


def test_feed_is_stale_once_the_ring_has_dropped_events(spark):
    events = spark.range(1, 21).select(F.lit("c").alias("context"), F.col("id").alias("seq"), F.lit("k").alias("kind"))
    assert [(r.seq, r.stale) for r in oplog.feed(events, 12, 2, ring=5).orderBy("seq").collect()] == [(16, True), (17, True)]
    assert [(r.seq, r.stale) for r in oplog.feed(events, 17, 9, ring=5).orderBy("seq").collect()] == [(18, False), (19, False), (20, False)]
    assert [r.seq for r in oplog.feed(events, None, 9).collect()] == [20]
