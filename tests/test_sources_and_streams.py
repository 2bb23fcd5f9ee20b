"""Scenarios of file connectors, imports, feeds, refreshes and measures on small tables."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from knotwork.functions import scalar
from knotwork.operators import entry, evaluate, fold, match, search
from knotwork.plans import stage
from knotwork.sources import documents, jsonl, office
from knotwork.streaming import oplog
from test_operators import log


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in parts.items():
            archive.writestr(name, text)
    return out.getvalue()


def docx(*paragraphs):
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}{"".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in texts)}</w:p>' for style, *texts in paragraphs)
    return zipped({"word/document.xml": f'<w:document xmlns:w="{word}"><w:body>{body}</w:body></w:document>'})


def pptx(*slides):
    ns = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="p"'
    return zipped({f"ppt/slides/slide{i}.xml": f"<p:sld {ns}>{''.join(f'<a:p><a:r><a:t>{t}</a:t></a:r></a:p>' for t in lines)}</p:sld>" for i, lines in enumerate(slides, 1)})


def test_office_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(("Title", "Top"), (None, "one", " two"), (None, " "), ("Heading1", "Part"), (None, "three &amp; four")))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.docx").write_bytes(zipped({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'}))
    (tmp_path / "d.docx").write_bytes(zipped({"other.xml": "<x/>"}))
    got = {(r.source, r.paragraph): (r.text, r.section, r.locator, r.refused is None) for r in office.paragraphs(office.files(spark, str(tmp_path), "docx"), office.docx_parts).collect()}
    assert got[("a.docx", 0)] == ("one two", "Top", "2", True) and got[("a.docx", 1)] == ("three & four", "Part", "5", True)
    assert len(got) == 5 and all(got[(f"{x}.docx", None)] == (None, None, None, False) for x in "bcd")
    (tmp_path / "s.pptx").write_bytes(pptx(["Head", "point"], ["Alone"], *[[f"S{i}", "x"] for i in range(9)]))
    slides = office.paragraphs(office.files(spark, str(tmp_path), "pptx"), office.pptx_parts).orderBy("paragraph").collect()
    assert [(r.text, r.section, r.locator) for r in slides[:3]] == [("point", "Head", "1"), ("Alone", "Alone", "2"), ("x", "S0", "3")] and slides[-1].locator == "11"
    (tmp_path / "p.pdf").write_bytes(b"%PDF-")
    assert office.paragraphs(office.files(spark, str(tmp_path), "pdf"), office.pdf_parts).collect()[0].refused


def test_files_of_another_producer_and_what_they_create(spark, tmp_path):
    lines = [{"own_batch": 1, "context": "c", "source": "s", "create": {"description": "first", "pinned": True}}, {"subject": "x", "label": "l", "object": "y"}, {"own_batch": 1, "context": "c", "source": "t", "create": {"description": "second"}}, {"passage": "p", "own_batch_": 1}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    read = jsonl.parsed(jsonl.lines(spark, str(tmp_path)), "own")
    assert [(r.source, r.object) for r in jsonl.associations(read).collect()] == [("s", "y")]
    assert [tuple(r) for r in jsonl.created(read).collect()] == [("c", "first", True)]
    assert {r.what: r.n for r in jsonl.preview(read).filter("what = 'refused'").collect()} == {"refused": 1}
    assert jsonl.associations(jsonl.parsed(jsonl.lines(spark, str(tmp_path)))).filter("context IS NOT NULL").collect() == []


def test_export_with_passages_aliases_and_back(spark, tmp_path):
    said = log(spark, [("x", "l", "y", -1.0, "s", 1), ("x", "l", "z", 1.0, "t", 0)])
    aliases = spark.createDataFrame([("c", "concept", "ex", "x")], "context string, kind string, alias string, canonical string")
    paragraphs = spark.createDataFrame([("c", "s", 0, "a"), ("c", "s", 1, "b"), ("c", "none", 0, "n")], "context string, source string, paragraph int, text string")
    jsonl.write(jsonl.export_lines(said, "c", None, ("what it holds", False), aliases, paragraphs).coalesce(1), str(tmp_path / "out"))
    read = jsonl.parsed(jsonl.lines(spark, str(tmp_path / "out")))
    assert sorted((r.source, r.object, r.weight, r.paragraph) for r in jsonl.associations(read).collect()) == [("s", "y", -1.0, 1), ("t", "z", 1.0, 0)]
    assert [(r.source, r.text) for r in jsonl.passages(read).collect()] == [("s", "a\n\nb")]
    assert [(r.kind, r.alias, r.canonical) for r in jsonl.aliases(read).collect()] == [("concept", "ex", "x")]
    assert [tuple(r) for r in jsonl.created(read).collect()] == [("c", "what it holds", False)]
    new = spark.createDataFrame([("c", "s", 0, "new")], paragraphs.schema)
    assert sorted((r.source, r.text) for r in jsonl.replaced(paragraphs, new, new).collect()) == [("none", "n"), ("s", "new")]
    assert [(r.alias, r.canonical) for r in jsonl.with_aliases(aliases, spark.createDataFrame([("c", "concept", "ex", "z")], aliases.schema)).collect()] == [("ex", "z")]


def test_feeds_by_cursor(spark):
    events = spark.range(1, 21).select(F.lit("c").alias("context"), F.col("id").alias("seq"), F.lit("k").alias("kind"))
    page = lambda since, limit=3, epoch=7, ring=10: oplog.feed_page(events, "c", epoch, since, limit, ring)
    rows, at, more = page(None)
    assert (rows.collect(), at, more) == ([], "cf1-0000000000000007-20", False)
    rows, at, more = page(oplog.cursor(7, 15))
    assert ([r.seq for r in rows.collect()], oplog.position(at), more) == ([16, 17, 18], (7, 18), True)
    rows, at, more = page(at)
    assert ([r.seq for r in rows.collect()], oplog.position(at), more) == ([19, 20], (7, 20), False)
    for stale in (oplog.cursor(8, 15), oplog.cursor(7, 21), oplog.cursor(7, 9), "cf1-zz-1", "other", "cf1-7"):
        assert page(stale) == (None, None, False)
    assert [r.seq for r in page(oplog.cursor(7, 10), 99)[0].collect()] == list(range(11, 21))


def random_ops(spark, n, seed=2):
    rng = random.Random(seed)
    rows = []
    for q in range(n):
        op = rng.choice(["associate"] * 6 + ["retract_association", "retract_source"])
        triple = (None, None, None) if op == "retract_source" else ("x", "l", rng.choice("abcd"))
        rows.append(("c", q, op, *triple, float(rng.randrange(-3, 4)), rng.choice(["s", "t", None]) if op == "associate" else rng.choice(["s", "t"])))
    return spark.createDataFrame(rows, "context string, seq long, op string, subject string, label string, object string, weight double, source string")


def test_batches_write_what_they_change_alone(spark, tmp_path):
    ops, state = random_ops(spark, 60), oplog.Fold(spark, str(tmp_path / "state"), every=3)
    live = lambda df: sorted((r.object, r.sum, r["count"]) for r in df.filter("count > 0").collect())
    for number in range(8):
        batch = ops.filter(f"seq >= {number * 7 - 2} AND seq < {number * 7 + 7}")  # the first two come a second time
        state(batch, number)
        if number in (2, 4):
            state(batch, number)  # runs again after a failure
        assert live(oplog.edges(state.version(number))) == live(fold.apply_ops(ops.filter(f"seq < {number * 7 + 7}"))), number
    names = {p.name for p in (tmp_path / "state").iterdir()}
    assert {n for n in names if n.startswith("state")} == {"state-2", "state-5"} and {f"delta-{i}" for i in range(8)} <= names


def test_tailing_lands_whole_versions(spark, tmp_path):
    ops, source, target = random_ops(spark, 30, 3), oplog.Fold(spark, str(tmp_path / "from"), every=2), str(tmp_path / "to")
    assert oplog.tail(source, target) is None
    for n in range(3):
        source(ops.filter(f"seq >= {n * 10} AND seq < {n * 10 + 10}"), n)
        assert oplog.tail(source, target) == n and oplog.complete(spark, target, "state") == [n]
        want = source.version(n)
        assert sorted(map(str, spark.read.parquet(f"{target}/state-{n}").select(want.columns).collect())) == sorted(map(str, want.collect()))
    (tmp_path / "from" / "mark-3").mkdir()  # begun and not complete
    assert oplog.tail(source, target) == 2


def test_only_changed_paragraphs_are_embedded(spark):
    live = spark.createDataFrame([("a", 0, "same words", 1), ("a", 1, "new words", 2), ("b", 0, "more words", 3)], "source string, paragraph int, text string, hash long")
    old = spark.createDataFrame([("a", 0, 1, [9.0]), ("a", 1, 7, [8.0]), ("gone", 0, 5, [7.0])], "source string, paragraph int, hash long, vector array<double>")
    got = {(r.source, r.paragraph): r.vector for r in search.refreshed_vectors(old, live, lambda texts: search.hashed_embedding(texts, 4)).collect()}
    assert got == {("a", 0): [9.0], ("a", 1): search.hashed_embedding(["new words"], 4)[0], ("b", 0): search.hashed_embedding(["more words"], 4)[0]}
    with pytest.raises(ValueError, match="more than 1"):
        search.refreshed_vectors(old, live, search.hashed_embedding, 1)
    hits = spark.createDataFrame([("q", "a", 0, 0.9, 1), ("q", "a", 1, 0.8, 7)], "query string, source string, paragraph int, score double, hash long")
    words = spark.createDataFrame([("q", "b", 0, 2.0)], "query string, source string, paragraph int, score double")
    assert {(r.source, r.paragraph) for r in search.fused(words, hits, 5, 0.0, live).collect()} == {("b", 0), ("a", 0)}


def test_results_are_cached_by_parameters_and_inputs(spark, tmp_path):
    source, built = f"{tmp_path}/in.parquet", []
    spark.range(3).write.parquet(source)

    def ask(least):
        def build():
            built.append(least)
            return spark.read.parquet(source).filter(F.col("id") >= least)

        return stage.cached(spark, "least", [source], {"least": least}, build).count()

    assert (ask(1), ask(1), ask(2), built) == (2, 2, 1, [1, 2])


def test_measures_of_structure_and_citations(spark):
    expected = spark.createDataFrame([("q", "concepts", "Oda"), ("q", "concepts", "ＩＳＥ"), ("q", "labels", "x")], "case_id string, kind string, item string")
    found = spark.createDataFrame([("q", "concepts", "ise"), ("q", "labels", "y"), ("r", "labels", "x")], "case_id string, kind string, item string")
    assert sorted(tuple(r) for r in evaluate.structural(expected, found).collect()) == [("q", "concepts", 0.5, 2), ("q", "labels", 0.0, 1)]
    wanted = spark.createDataFrame([("q", "s", 0, "one", "The River"), ("q", "s", 1, "two", None), ("q", "none", 0, None, "x"), ("q", "s", 2, None, None)], "case_id string, source string, paragraph int, section string, quote string")
    stored = spark.createDataFrame([("s", 0, "by the river", "one"), ("s", 1, "else", "one"), ("s", 2, "third", None)], "source string, paragraph int, text string, section string")
    served = spark.createDataFrame([("q", "s", 0), ("q", "s", 0), ("r", "s", 2)], "case_id string, source string, paragraph int")
    assert [tuple(r) for r in evaluate.citations(wanted, stored, served).collect()] == [("q", 0.25, 0.5, 0.5)]
    cases = spark.createDataFrame([("a", 1.0, None), ("b", 0.0, None), ("c", 0.5, 2.0)], "case_id string, recall double, ms double")
    assert {r.metric: (r.n, r.p50, r.max) for r in evaluate.summary(cases, ["recall", "ms"]).collect()} == {"recall": (3, 0.5, 1.0), "ms": (1, 2.0, 2.0)}
    samples = spark.createDataFrame([("bytes", 10, 120.0), ("bytes", 20, 220.0), ("bytes", 30, 320.0)], "what string, rows long, amount double")
    assert [round(r.amount, 6) for r in evaluate.capacity(samples, spark.createDataFrame([("bytes", 1000)], "what string, rows long")).collect()] == [10020.0]


def test_code_in_braces(spark):
    rust = 'pub mod deep {\n  pub(crate) struct One { a: u8 }\n  impl One {\n    pub fn of(x: &str) -> Self { let s = "fn no() {"; One { a: 1 } }\n    async fn two() {}\n  }\n}\nfn last() {}\n'
    files = spark.createDataFrame([("a.rs", rust), ("b.go", "func (r *R) Get() {\n}\ntype R struct {\n}\n"), ("c.ts", "export class A {\n  m() {}\n}\nexport async function f() {\n  function g() {}\n}\n"), ("d.txt", "fn no() {}")], "path string, text string")
    held = {(r.subject, r.object) for r in documents.code_facts(files).filter("label = 'contains'").collect()}
    assert held == {("a.rs", "a.rs::deep"), ("a.rs::deep", "a.rs::deep::One"), ("a.rs::deep::One", "a.rs::deep::One::of"), ("a.rs::deep::One", "a.rs::deep::One::two"), ("a.rs", "a.rs::last"), ("b.go", "b.go::Get"), ("b.go", "b.go::R"), ("c.ts", "c.ts::A"), ("c.ts", "c.ts::f"), ("c.ts::f", "c.ts::f::g")}


def test_why_a_name_is_not_served(spark):
    edge = fold.edges(log(spark, [("small ring", "l", "blue ring", 1.0), ("zebra", "m", "quartz", 1.0)]))
    spelled = entry.spellings(edge)
    why = lambda cue, name, limit=5, **k: [(r.verdict, r["rank"]) for r in entry.explained(spelled, cue, name, limit, **k).collect()][0]
    assert why("small ring", "small ring") == ("served", 1) and why("ring", "small ring", 1) == ("outranked", 2) and why("small ring", "nobody") == ("not_in_vocabulary", None)
    assert why("small ring", "zebra") == ("no_overlap", None) and why("small ring", "zebra", skipped="off") == ("tier_skipped: off", None)
    near = spark.createDataFrame([("zebra", 0.2), ("quartz", 0.6)], "name string, score double")
    assert why("small ring", "zebra", semantic=near) == ("below_floor", None) and why("small ring", "quartz", semantic=near) == ("served_by_meaning", None)
    assert [r.label for r in match.label_sample(edge, 1).collect()] == ["l"]
    assert [(r.name, r.total) for r in match.vocabulary(edge, kind="label", excluded=["l", "none"]).collect()] == [("m", 1)]
    assert scalar.folded([]) == scalar.FNV_OFFSET


def test_lines_of_a_file_in_several_splits(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("".join(f"line {i} {'x' * (i % 50)}\r\n" if i % 7 else "\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = jsonl.lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() >= 1 and spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 4
        assert {r.line: r.value for r in rows.collect()} == {i: f"line {i} {'x' * (i % 50)}" for i in range(3000) if i % 7}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
