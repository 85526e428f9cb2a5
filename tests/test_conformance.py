import json
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamarack import Attr, Freshness, FullText, Locator, Ontology, Relation, Scope, StableId, UnitType, Vector, Weight
from tamarack.cli import load_ontology, main
from tamarack.operators.conformance import accepts, check
from tamarack.operators.report import Finding, Report
from tamarack.plans.facts import Facts
from tamarack.sources.catalog import from_directory, from_frames, from_session

ASSESSMENTS = """DEFINE TABLE technical_assessment SCHEMAFULL; DEFINE FIELD code ON technical_assessment TYPE string; DEFINE FIELD body_text ON technical_assessment TYPE string;
DEFINE FIELD status ON technical_assessment TYPE string; DEFINE FIELD issued_at ON technical_assessment TYPE datetime;"""
LOOSE = "DEFINE TABLE technical_assessment TYPE ANY SCHEMALESS;"
NEWS = """DEFINE ANALYZER az_en TOKENIZERS blank FILTERS lowercase, snowball(english);
DEFINE TABLE feed SCHEMAFULL; DEFINE FIELD name ON feed TYPE string;
DEFINE TABLE news SCHEMAFULL; DEFINE FIELD title ON news TYPE string; DEFINE FIELD body ON news TYPE string; DEFINE FIELD published_at ON news TYPE datetime; DEFINE FIELD emb ON news TYPE option<array<float>>; DEFINE FIELD feed ON news TYPE record<feed>;
DEFINE INDEX by_text ON news FIELDS body FULLTEXT ANALYZER az_en BM25; DEFINE INDEX by_vec ON news FIELDS emb HNSW DIMENSION 4 DIST COSINE;
DEFINE TABLE entity SCHEMAFULL; DEFINE FIELD name ON entity TYPE string; DEFINE FIELD kind ON entity TYPE string;
DEFINE TABLE topic SCHEMAFULL; DEFINE FIELD name ON topic TYPE string;
DEFINE TABLE document SCHEMAFULL; DEFINE FIELD number ON document TYPE string; DEFINE FIELD status ON document TYPE string;
DEFINE TABLE mentions TYPE RELATION IN news OUT entity SCHEMAFULL; DEFINE FIELD relevance ON mentions TYPE float;
DEFINE TABLE about TYPE RELATION IN news OUT topic SCHEMAFULL; DEFINE TABLE cites TYPE RELATION IN news OUT document SCHEMAFULL;"""


def assessments(spark, n=12):
    rows = [(f"TA-{i:03d}", f"Text {i}.", "revoked" if i in (3, 6, 9, 11, 12) else "current", dt(2026, 1, i)) for i in range(1, n + 1)]
    return spark.createDataFrame(rows, "code string, body_text string, status string, issued_at timestamp_ntz")


def report_type(**over):
    return UnitType("report", **{"table": "technical_assessment", "id": StableId.of("code"), "text": "body_text", "locator": Locator(source="code"), "attrs": [Attr("status", "string", ["current", "revoked"]), Attr("issued_at", "datetime")]} | over)


def run(frames, script, *types, **parts):
    return check(Ontology(list(types), **parts), from_frames(frames, script), "4")


def pairs(report):
    return [(f.code, f.status) for f in report.findings]


def test_golden(spark):
    r = run({"technical_assessment": assessments(spark)}, ASSESSMENTS, report_type())
    assert pairs(r) == [("TBL-001", "PASS")] + [("FLD-001", "PASS")] * 4 + [("ATTR-010", "PASS")]
    assert (r.exit_code(), r.exit_code(True), r.table_counts) == (0, 0, {"technical_assessment": 12})


def test_missing_table(spark):
    r = run({"technical_assessment": assessments(spark)}, ASSESSMENTS, report_type(table="technical_assessment_v2"))
    assert pairs(r) == [("TBL-001", "FAIL")] and "does not exist" in r.findings[0].message and r.exit_code() == 1


def test_schemaless(spark):
    r = run({"technical_assessment": assessments(spark)}, LOOSE, report_type())
    assert pairs(r) == [("TBL-001", "PASS")] + [("FLD-002", "PASS")] * 4 + [("ATTR-010", "PASS")] and "kind=any" in r.findings[0].message


def test_vocabulary_drift(spark):
    r = run({"technical_assessment": assessments(spark)}, ASSESSMENTS, report_type(attrs=[Attr("status", "string", ["current"])]))
    assert pairs(r)[-1] == ("ATTR-010", "WARN") and "['revoked']" in r.findings[-1].message and (r.exit_code(), r.exit_code(True)) == (0, 1)


def test_empty_table_is_vacuous(spark):
    for frames in ({}, {"technical_assessment": assessments(spark).limit(0)}):
        r = run(frames, ASSESSMENTS, report_type())
        assert pairs(r) == [("TBL-001", "PASS"), ("VAC-001", "VACUOUS")] + [("FLD-001", "PASS")] * 4 and (r.exit_code(), r.exit_code(True)) == (0, 1)
    assert pairs(run({}, LOOSE, report_type())) == [("TBL-001", "PASS"), ("VAC-001", "VACUOUS")]


def test_absent_and_partly_null_fields(spark):
    df = assessments(spark).withColumn("status", F.expr("nullif(status, 'revoked')"))
    r = run({"technical_assessment": df}, LOOSE, report_type(text="body"))
    assert {(f.code, f.status) for f in r.findings if "'body'" in f.message or "'status'" in f.message} == {("FLD-002", "FAIL"), ("FLD-002", "WARN"), ("ATTR-010", "PASS")}
    assert any("7 of 12" in f.message for f in r.findings) and not any("None" in f.message for f in r.findings)


def test_undefined_fields_in_a_payload(spark):
    df = spark.createDataFrame([(1, '{"a": "x", "b": null}'), (2, '{"a": "y"}'), (3, None)], "id int, doc string")
    for rows in (df, df.select("id", F.parse_json("doc").alias("doc"))):
        c = from_frames({"t": rows}, "DEFINE TABLE t SCHEMALESS", payloads={"t": "doc"})
        r = check(Ontology([UnitType("u", "t", text=["a", "b"], attrs=[Attr("a", "string", ["x"])])]), c)
        assert pairs(r) == [("TBL-001", "PASS"), ("FLD-002", "WARN"), ("FLD-002", "FAIL"), ("ATTR-010", "WARN")]


def test_unsafe_names(spark):
    r = run({}, LOOSE, UnitType("a", "a b"), UnitType("b", "technical_assessment", text="x-y", attrs=[Attr("s t", "string", ["v"])]))
    assert pairs(r) == [("TBL-000", "FAIL"), ("TBL-001", "PASS"), ("VAC-001", "VACUOUS"), ("FLD-000", "FAIL"), ("FLD-000", "FAIL")]


def test_type_compatibility():
    yes = [("string", "none|string"), ("int", "number"), ("float", "number"), ("number", "decimal"), ("record", "record<a|b>"), ("array", "array<float>|none"), ("object", "object"), ("duration", "duration")]
    no = [("int", "float"), ("datetime", "date"), ("string", "none|string|int"), ("bool", "int"), ("record", "string"), ("float", "decimal")]
    assert all(accepts(*p) for p in yes) and not any(accepts(*p) for p in no)


def test_typed_columns_are_defined_fields(spark):
    r = run({"technical_assessment": assessments(spark)}, "", report_type(attrs=[Attr("status", "int"), Attr("issued_at", "datetime")]))
    assert pairs(r) == [("TBL-001", "PASS"), ("FLD-001", "PASS"), ("FLD-001", "PASS"), ("FLD-001", "PASS"), ("FLD-003", "WARN")]


# -- a graph of news ---------------------------------------------------------------------------
def news_frames(spark, emb=True):
    make = spark.createDataFrame
    e = lambda v: v if emb else None
    return {
        "feed": make([("feed:f1", "Main")], "id string, name string"),
        "news": make([(f"news:n{i}", f"T{i}", f"Body {i}", dt(2026, i, 1), e([0.1 * i] * 4), "feed:f1") for i in (1, 2, 3)], "id string, title string, body string, published_at timestamp_ntz, emb array<float>, feed string"),
        "entity": make([("entity:e1", "A", "person"), ("entity:e2", "B", "agency")], "id string, name string, kind string"),
        "topic": make([("topic:t1", "One"), ("topic:t2", "Two")], "id string, name string"),
        "document": make([("document:d1", "1", "pending"), ("document:d2", "2", "approved")], "id string, number string, status string"),
        "mentions": make([("news:n1", "entity:e1", 0.9), ("news:n1", "entity:e2", 0.4), ("news:n2", "entity:e1", 0.7)], "`in` string, out string, relevance double"),
        "about": make([("news:n1", "topic:t1"), ("news:n2", "topic:t2")], "`in` string, out string"),
        "cites": make([("news:n2", "document:d1"), ("news:n3", "document:d2")], "`in` string, out string"),
    }


def news_ontology(dim=4, metric="cosine", analyzer="az_en", language="english", feed_field="feed", fresh="published_at"):
    return Ontology(
        [
            UnitType("news", "news", id=StableId.of("title", "published_at"), text="body", attrs=[Attr("title", "string"), Attr("published_at", "datetime")], vector=Vector("emb", dim, metric), fulltext=FullText("body", analyzer, language)),
            UnitType("entity", "entity", attrs=[Attr("name", "string"), Attr("kind", "string", ["person", "agency", "organization"])]),
            UnitType("topic", "topic", attrs=[Attr("name", "string")]),
            UnitType("document", "document", attrs=[Attr("number", "string"), Attr("status", "string", ["pending", "approved", "rejected"])]),
            UnitType("feed", "feed", attrs=[Attr("name", "string")]),
        ],
        [Relation("mentions", "news", "entity", weight=Weight("relevance")), Relation("about", "news", "topic"), Relation("cites", "news", "document"), Relation("from_feed", "news", "feed", kind="field_link", field=feed_field)],
        [Scope("entity", "mentions")], [Freshness("news", fresh, "30d")],
    )


@pytest.fixture(scope="module")
def frames(spark):
    return news_frames(spark)


def news_run(frames, script=NEWS, **over):
    return check(news_ontology(**over), from_frames(frames, script))


@pytest.fixture(scope="module")
def golden(frames):
    return news_run(frames)


def changes(report, golden):
    key = lambda r: {(f.code, f.status, f.subject) for f in r.findings}
    return {x[:2] for x in key(report) - key(golden)}


def test_news_golden(golden):
    assert golden.tally() == {"PASS": 27}
    assert golden.table_counts == {"news": 3, "entity": 2, "topic": 2, "document": 2, "feed": 1, "mentions": 3, "about": 2, "cites": 2}
    subjects = [f.subject for f in golden.findings]
    assert {s: subjects.count(s) for s in ("type:news", "type:entity", "type:topic", "type:document", "type:feed")} == {"type:news": 9, "type:entity": 4, "type:topic": 2, "type:document": 4, "type:feed": 2}
    assert pairs(golden)[:9] == [("TBL-001", "PASS")] + [("FLD-001", "PASS")] * 4 + [("VEC-002", "PASS"), ("VEC-003", "PASS"), ("VEC-010", "PASS"), ("FTS-001", "PASS")]
    assert subjects[-6:] == ["relation:mentions", "relation:mentions", "relation:about", "relation:cites", "relation:from_feed", "freshness:news"]


@pytest.mark.parametrize(
    ("over", "expected"),
    [
        ({"dim": 8}, {("VEC-002", "FAIL"), ("VEC-010", "FAIL")}), ({"metric": "euclidean"}, {("VEC-003", "FAIL")}), ({"analyzer": "az_missing"}, {("FTS-002", "FAIL")}),
        ({"language": "french"}, {("FTS-003", "WARN")}), ({"feed_field": "source_feed"}, {("REL-003", "FAIL")}), ({"fresh": "seen_at"}, {("FRS-001", "WARN")}), ({"feed_field": "a b"}, {("FLD-000", "FAIL")}), ({"feed_field": "title"}, None),
    ],
)
def test_news_with_another_declaration(frames, golden, over, expected):
    if expected is None:  # the link collides with an attr
        with pytest.raises(Exception, match="ONT-009"):
            news_ontology(**over)
    else:
        assert changes(news_run(frames, **over), golden) == expected


@pytest.mark.parametrize(
    ("old", "new", "expected"),
    [
        ("DEFINE INDEX by_vec", "DEFINE NOTHING by_vec", {("VEC-001", "FAIL")}), ("HNSW", "MTREE", {("VEC-004", "WARN")}), ("DEFINE INDEX by_text", "DEFINE NOTHING by_text", {("FTS-001", "FAIL")}),
        ("DEFINE ANALYZER az_en", "DEFINE ANALYZER other", {("FTS-002", "FAIL")}), ("about TYPE RELATION IN news OUT topic", "about TYPE ANY", {("REL-002", "WARN")}), ("about TYPE RELATION IN news OUT topic", "about TYPE RELATION", {("REL-002", "WARN")}),
        ("about TYPE RELATION IN news OUT topic", "about TYPE RELATION IN news OUT entity", {("REL-002", "FAIL")}), ("about TYPE RELATION IN news OUT topic", "about TYPE NORMAL", {("REL-002", "FAIL")}),
        ("feed ON news TYPE record<feed>", "feed ON news TYPE record<topic>", {("REL-003", "FAIL")}), ("feed ON news TYPE record<feed>", "feed ON news TYPE string", {("REL-003", "FAIL")}), ("feed ON news TYPE record<feed>", "feed2 ON news TYPE string", {("REL-003", "WARN")}),
        ("DEFINE FIELD relevance ON mentions TYPE float", "", set()), ("published_at ON news TYPE datetime", "published_at ON news TYPE string", {("FLD-003", "WARN")}),
    ],
)
def test_news_with_other_definitions(frames, golden, old, new, expected):
    assert old in NEWS
    assert changes(news_run(frames, NEWS.replace(old, new)), golden) == expected


def test_news_with_other_rows(spark, frames, golden):
    assert changes(news_run(frames | {"news": news_frames(spark, emb=False)["news"]}), golden) == {("VEC-010", "VACUOUS")}
    loose = NEWS.replace("about TYPE RELATION IN news OUT topic", "about TYPE ANY").replace("DEFINE FIELD relevance ON mentions TYPE float", "")
    swapped = frames["about"].select(F.col("out").alias("in"), F.col("in").alias("out"))
    weights = frames["mentions"].withColumn("relevance", F.expr("nullif(relevance, 0.4D)"))
    assert changes(news_run(frames | {"about": swapped, "mentions": weights}, loose), golden) == {("REL-002", "FAIL"), ("REL-004", "WARN")}
    assert changes(news_run(frames | {"about": swapped.limit(0), "mentions": weights.limit(0)}, loose), golden) == {("REL-002", "VACUOUS"), ("REL-004", "VACUOUS")}
    assert changes(news_run(frames | {"mentions": weights.drop("relevance")}, loose), golden) == {("REL-002", "WARN"), ("REL-004", "FAIL")}
    r = news_run({k: v for k, v in frames.items() if k != "cites"}, NEWS.replace("DEFINE TABLE cites", "DEFINE NOTHING cites"))
    assert changes(r, golden) == {("REL-001", "FAIL")} and any("does not exist" in f.message for f in r.findings)


def test_a_broken_check_hides_no_other(spark, frames, golden, monkeypatch):
    broken = frames["entity"].withColumn("kind", F.raise_error(F.lit("unreadable")).cast("string"))
    r = news_run(frames | {"entity": broken}, NEWS.replace("DEFINE FIELD kind ON entity TYPE string", ""))
    assert changes(r, golden) == {("CHK-000", "FAIL")} and r.findings[-1].code == "FRS-001"


def test_one_job_per_table(spark, frames, monkeypatch):
    calls = []
    measure = Facts._measure
    monkeypatch.setattr(Facts, "_measure", lambda self, name, fields: (calls.append((name, tuple(fields))), measure(self, name, fields))[1])
    run({"technical_assessment": assessments(spark)}, LOOSE, report_type())
    assert calls == [("technical_assessment", ("body_text", "code", "issued_at", "status"))]


def test_samples_are_the_first_rows_by_key(spark):
    df = spark.createDataFrame([(i, "new" if i > 200 else "old") for i in reversed(range(1, 300))], "n int, state string").repartition(5)
    unit = UnitType("u", "t", attrs=[Attr("state", "string", ["old"])], locator=Locator(order="n"))
    assert pairs(run({"t": df}, "", unit))[-1] == ("ATTR-010", "PASS")


# -- reports, sources, command line ------------------------------------------------------------
def test_report(spark):
    r = Report("here", "4.1", {"b": 2, "a": 1})
    r.add("TBL-001", "PASS", "type:x", "fine", "a")
    r.findings.append(Finding("VAC-001", "VACUOUS", "type:x", "empty"))
    text = r.render_text()
    assert "a=1, b=2" in text and "PASS    TBL-001  type:x: fine" in text and "1 pass, 0 fail, 0 warn, 1 vacuous" in text and all(x in text for x in r.not_verified)
    assert json.loads(r.to_json())["findings"][1] == {"code": "VAC-001", "status": "VACUOUS", "subject": "type:x", "message": "empty", "table": None}
    assert [tuple(x) for x in r.to_frame(spark).orderBy("seq").collect()] == [(0, "TBL-001", "PASS", "type:x", "a", "fine"), (1, "VAC-001", "VACUOUS", "type:x", None, "empty")]
    assert Report("here").to_frame(spark).count() == 0


def test_sources(spark, tmp_path):
    assessments(spark).write.parquet(str(tmp_path / "technical_assessment.parquet"))
    (tmp_path / "definitions.ddl").write_text(LOOSE)
    assert from_directory(spark, str(tmp_path)).tables["technical_assessment"].definition.kind == "any"
    assert from_directory(spark, str(tmp_path), "").tables["technical_assessment"].definition.kind == "normal"
    assessments(spark).createOrReplaceTempView("technical_assessment")
    assert pairs(check(Ontology([report_type()]), from_session(spark)))[0] == ("TBL-001", "PASS")
    spark.catalog.dropTempView("technical_assessment")
    with pytest.raises(FileNotFoundError):
        from_directory(spark, str(tmp_path / "none"))


DECLARATION = "from tamarack import *\nontology = Ontology([UnitType('report', 'technical_assessment', attrs=[Attr('status', 'string', ['current'])])])\n"


def leave(*argv):
    with pytest.raises(SystemExit) as e:
        main(["check", *argv])
    return e.value.code


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.delenv("TAMARACK_DATA", raising=False)
    good = tmp_path / "ontology.py"
    good.write_text(DECLARATION + "again = ontology\n")
    data = tmp_path / "data"
    assessments(spark).write.parquet(str(data / "technical_assessment.parquet"))
    args = ["--ontology", str(good), "--data", str(data)]
    assert (leave(*args), leave(*args, "--strict")) == (0, 1)
    assert "1 warn" in capsys.readouterr().out
    assert leave(*args, "--json") == 0
    assert [f["code"] for f in json.loads(capsys.readouterr().out)["findings"]] == ["TBL-001", "FLD-001", "ATTR-010"]
    assert leave("--ontology", str(good)) == leave("--ontology", str(tmp_path / "no.py"), "--data", str(data)) == leave("--ontology", str(good), "--data", str(tmp_path / "none")) == 2
    bad = tmp_path / "bad.py"
    for text in ("import module_that_is_not_there\n", "x = 1\n", DECLARATION + "other = Ontology([UnitType('a', 'b')])\n", "from tamarack import *\nOntology([UnitType('a', 'b')], [Relation('r', 'a', 'c')])\n", "from tamarack import *\nVector('e', 0)\n", "a b"):
        bad.write_text(text)
        assert leave("--ontology", str(bad), "--data", str(data)) == 2


def test_ontology_files(tmp_path):
    (tmp_path / "neighbour.py").write_text("TABLE = 'rows'\n")
    f = tmp_path / "two.py"
    f.write_text("from neighbour import TABLE\nfrom tamarack import *\na = Ontology([UnitType('x', TABLE)])\nb = Ontology([UnitType('y', TABLE)])\n")
    assert load_ontology(f"{f}:b").types[0].name == "y"
    with pytest.raises(SystemExit):
        load_ontology(f"{f}:TABLE")
