"""Queries for the conformance engine's operators over the test tables, and their SQL twins.

``findings_*`` run the engine on a declaration over the test tables; their twins judge in SQL.
The others show the relational operators that the engine is made of.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.ontology import Attr, Freshness, FullText, Locator, Ontology, Relation, StableId, UnitType, Vector, Weight
from tamarack.operators.conformance import check
from tamarack.plans import facts
from tamarack.sources.catalog import Catalog, from_directory, from_frames
from tamarack.sources.parquet import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings feed news entity document mentions technical_assessment removal pack_spec".split()
DEFINITIONS = """
DEFINE ANALYZER words TOKENIZERS blank FILTERS lowercase, snowball(english);
DEFINE INDEX by_vector ON news FIELDS emb HNSW DIMENSION 64 DIST EUCLIDEAN;
DEFINE INDEX by_body ON news FIELDS body FULLTEXT ANALYZER words BM25;
DEFINE INDEX by_title ON news FIELDS title SEARCH ANALYZER lost BM25;
DEFINE INDEX by_old_vector ON embeddings FIELDS embedding MTREE DIMENSION 64;
DEFINE TABLE events TYPE ANY SCHEMALESS;
DEFINE TABLE mentions TYPE ANY SCHEMALESS;
DEFINE TABLE note SCHEMAFULL; DEFINE FIELD body ON note TYPE option<string>; DEFINE FIELD stars ON note TYPE int;
DEFINE TABLE cites TYPE RELATION IN news OUT document;
DEFINE TABLE follows TYPE RELATION SCHEMALESS;
"""
NEWS = UnitType("news", "news", id=StableId.of("id"), text="body", attrs=[Attr("published_at", "datetime"), Attr("feed", "record")], vector=Vector("emb", 64), fulltext=FullText("body", "words", "french"))
ENTITY = UnitType("entity", "entity", id=StableId.of("id"), attrs=[Attr("name", "string"), Attr("kind", "string", ["person", "agency", "organization"])])
EVENT = UnitType("event", "events", id=StableId.of("event_id"), text=["k", "zz"], attrs=[Attr("event_type", "string", ["signup", "error", "click", "view", "purchase"])], locator=Locator(order="ts"))
NOTE = UnitType("note", "note", text="body", attrs=[Attr("stars", "float")], vector=Vector("emb", 8))
DOCUMENT = UnitType("document", "document", attrs=[Attr("status", "string")])
FEED = UnitType("feed", "feed", attrs=[Attr("name", "string")])
PICTURE = UnitType("picture", "embeddings", id=StableId.of("vec_id"), vector=Vector("embedding", 64, "euclidean"), fulltext=FullText("label"))
TITLE = UnitType("title", "news", fulltext=FullText("title", "words"))
SHAPE = UnitType("shape", "document", vector=Vector("status", 64))  # no list, so no embedding
MENTIONS = Relation("mentions", "news", "entity", weight=Weight("relevance"))

ONTOLOGIES = {
    "findings_table": Ontology([NOTE, UnitType("gone", "no_such_table"), UnitType("odd", "a b")]),
    "findings_fields": Ontology([EVENT, UnitType("reading", "events", text="x-y")]),
    "findings_vocabulary": Ontology([ENTITY]),
    "findings_vector": Ontology([NEWS, PICTURE, NOTE, SHAPE]),
    "findings_fulltext": Ontology([TITLE]),
    "findings_edge": Ontology([FEED, DOCUMENT, UnitType("news", "news"), UnitType("entity", "entity")], [MENTIONS, Relation("cites", "news", "document"), Relation("cited_by", "document", "news", table="cites"), Relation("follows", "news", "news", weight=Weight("w")), Relation("lost", "news", "entity"), Relation("order", "news", "entity", table="orders")]),
    "findings_link": Ontology([UnitType("news", "news"), FEED, UnitType("event", "events"), NOTE], [Relation("from_feed", "news", "feed", kind="field_link", field="feed"), Relation("of_user", "event", "feed", kind="field_link", field="user_id"), Relation("of_none", "event", "feed", kind="field_link", field="zz"), Relation("of_note", "note", "feed", kind="field_link", field="f"), Relation("of_event", "news", "event", kind="field_link", field="feed"), Relation("of_body", "news", "feed", kind="field_link", field="body")]),
    "findings_freshness": Ontology([NOTE], freshness=[Freshness("note", "body", "30d"), Freshness("note", "at", "30d")]),
    "flagship_report": Ontology([ENTITY, EVENT, PICTURE, NOTE], [], [], [Freshness("event", "ts", "30d")]),
}


def test_catalog(spark: SparkSession, d: str, *names: str, ontology: Ontology | None = None) -> Catalog:
    """Test tables by name, or those that an ontology names, with the definitions above; record fields are marked as such."""
    named = {*names} | ({t.table for t in ontology.types} | {r.table for r in ontology.relations if r.table} if ontology else set())
    frames = {t: table(spark, d, t) for t in TABLES if t in named}
    if "news" in frames:
        frames["news"] = frames["news"].withColumn("feed", F.col("feed").alias("feed", metadata={"link": "feed"}))
    return from_frames(frames, DEFINITIONS, d, {"events": "props"})


def _findings(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return check(ONTOLOGIES[name], test_catalog(spark, d, ontology=ONTOLOGIES[name]), spark.version).to_frame(spark)

    return query


def row_counts(spark: SparkSession, d: str) -> DataFrame:
    catalog = from_directory(spark, d, "")
    return reduce(DataFrame.unionAll, [facts.counts(catalog.tables[t], []).select(F.lit(t).alias("table_name"), F.col("total").alias("n")) for t in TABLES])


def field_presence(spark: SparkSession, d: str) -> DataFrame:
    """Presence of every column of a table, in one aggregation."""
    t = test_catalog(spark, d, "technical_assessment").tables["technical_assessment"]
    names = ["id", "code", "body_text", "status", "issued_at", "load_id", "loaded_at", "no_such_column"]
    row = facts.counts(t, names)
    return row.select("total", F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(f"present_{i}").cast("long").alias("present")) for i, n in enumerate(names)])).alias("p")).select("p.*", "total")


def json_field_presence(spark: SparkSession, d: str) -> DataFrame:
    return facts.counts(test_catalog(spark, d, "events").tables["events"], ["k", "zz"]).select(F.col("present_0").alias("k"), F.col("present_1").alias("zz"), "total")


def variant_field_presence(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", F.parse_json("props").alias("props"))
    t = from_frames({"events": events}, "DEFINE TABLE events SCHEMALESS", payloads={"events": "props"}).tables["events"]
    return facts.counts(t, ["k", "zz"]).select(F.col("present_0").alias("k"), F.col("present_1").alias("zz"), "total")


def value_sample(spark: SparkSession, d: str) -> DataFrame:
    return facts.sample(test_catalog(spark, d, "entity").tables["entity"], "kind", facts.VALUES, ["id"]).groupBy("value").agg(F.count("*").alias("n"))


def vocabulary_violations(spark: SparkSession, d: str) -> DataFrame:
    """Sampled values outside of the vocabulary, as an anti join."""
    codes = spark.createDataFrame([(v,) for v in ENTITY.attrs[1].value_codes()], "value string")
    return facts.sample(test_catalog(spark, d, "entity").tables["entity"], "kind", facts.VALUES, ["id"]).distinct().join(codes, "value", "left_anti")


def embedding_dimensions(spark: SparkSession, d: str) -> DataFrame:
    lengths = facts.sample(test_catalog(spark, d, "news").tables["news"], "emb", facts.EMBEDDINGS, ["id"]).select(F.size("value").alias("dim"))
    return lengths.groupBy("dim").agg(F.count("*").alias("n"))


def edge_endpoints(spark: SparkSession, d: str) -> DataFrame:
    return facts.edge_ends(test_catalog(spark, d, "mentions").tables["mentions"])


def weight_profile(spark: SparkSession, d: str) -> DataFrame:
    w = F.when(~F.isnan("relevance"), F.col("relevance"))
    return table(spark, d, "mentions", "relevance").agg(F.count("relevance").alias("present"), F.count("*").alias("total"), F.min(w).alias("lowest"), F.max(w).alias("highest"))


def link_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Whether links resolve: a left join of orders to customers."""
    orders, customers = table(spark, d, "orders", "o_custkey"), table(spark, d, "customer", "c_custkey")
    return orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left").agg(F.count("o_custkey").alias("links"), F.count("c_custkey").alias("resolved"))


def stable_id_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


def status_tally(spark: SparkSession, d: str) -> DataFrame:
    return _findings("findings_fields")(spark, d).groupBy("status").agg(F.count("*").alias("n"))


QUERIES = {
    **{name: _findings(name) for name in ONTOLOGIES},
    **{f.__name__: f for f in (row_counts, field_presence, json_field_presence, variant_field_presence, value_sample, vocabulary_violations, embedding_dimensions, edge_endpoints, weight_profile, link_integrity, stable_id_duplicates, status_tally)},
}

# -- SQL twins ---------------------------------------------------------------------------------
_LIST = "'[' || string_agg('''' || replace(v, chr(9), '\\t') || '''', ', ' order by v) || ']'"


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _rows(*rows: tuple[str, str, str, str | None, str]) -> str:
    """Findings in order; statuses and messages are SQL expressions, the rest is text. A status that is null is no finding."""
    parts = [f"select {i} as place, {_text(code)} as code, ({status})::varchar as status, {_text(subject)} as subject, {_text(t) if t else 'null::varchar'} as \"table\", ({message})::varchar as message" for i, (code, status, subject, t, message) in enumerate(rows)]
    return "select (row_number() over (order by place) - 1)::int as seq, code, status, subject, \"table\", message from (" + " union all ".join(parts) + ") where status is not null"


def _exists(subject: str, t: str, mode: str, kind: str) -> tuple:
    return ("TBL-001", "'PASS'", subject, t, _text(f"table '{t}' exists ({mode}, kind={kind})"))


def _defined(subject: str, t: str, name: str) -> tuple:
    return ("FLD-001", "'PASS'", subject, t, _text(f"field '{name}' is defined"))


def _accepted(subject: str, t: str, name: str, declared: str, defined: str) -> tuple:
    return ("FLD-001", "'PASS'", subject, t, _text(f"attr '{name}': '{declared}' accepts the defined type '{defined}'"))


def _undefined(subject: str, t: str, name: str, value: str, code: str = "FLD-002", what: str = "field", empty_fails: str = "FAIL") -> tuple:
    status = f"(select case when count({value}) = 0 then '{empty_fails}' when count({value}) < count(*) then 'WARN' else '{'WARN' if code == 'REL-003' else 'PASS'}' end from {t})"
    return (code, status, subject, t, f"{_text(f'{what} {name!r} is not defined; ')} || (select count({value}) || ' of ' || count(*) from {t}) || ' rows have it'")


def _vocabulary(subject: str, t: str, attr: Attr, order: str) -> tuple:
    odd = f"(select distinct v from (select {attr.name} as v from {t} where {attr.name} is not null order by {order}, {attr.name} limit 200) where v not in ({', '.join(map(_text, attr.value_codes()))}))"
    message = f"case when exists {odd} then {_text(f'attr {attr.name!r}: sampled values ')} || (select {_LIST} from {odd}) || {_text(f' are none of {attr.value_codes()}')} else {_text(f'attr {attr.name!r}: no sampled value is outside of the vocabulary')} end"
    return ("ATTR-010", f"case when exists {odd} then 'WARN' else 'PASS' end", subject, t, message)


def _dimensions(subject: str, t: str, name: str, dim: int, order: str) -> tuple:
    seen = f"(select distinct len({name}) as n from (select {name} from {t} where {name} is not null order by {order}, {name} limit 500))"
    return (
        "VEC-010", f"(select case when count_if(n <> {dim}) > 0 then 'FAIL' when count(*) > 0 then 'PASS' else 'VACUOUS' end from {seen})", subject, t,
        f"(select case when count_if(n <> {dim}) > 0 then {_text(f'sampled embeddings in {name!r} have dimensions ')} || '[' || string_agg(n::varchar, ', ' order by n) filter (where n <> {dim}) || '], declared is {dim}' "
        f"else {_text(f'sampled embeddings in {name!r} all have dimension {dim}')} end from {seen})",
    )


_ENTITY = [_exists("type:entity", "entity", "SCHEMAFULL", "normal"), _defined("type:entity", "entity", "id"), _accepted("type:entity", "entity", "kind", "string", "string"), _accepted("type:entity", "entity", "name", "string", "string"), _vocabulary("type:entity", "entity", ENTITY.attrs[1], "id")]
_K, _ZZ = "json_extract_string(props, '$.k')", "json_extract_string(props, '$.zz')"
_EVENT = [_exists("type:event", "events", "SCHEMALESS", "any"), *[_undefined("type:event", "events", n, v) for n, v in (("event_id", "event_id"), ("event_type", "event_type"), ("k", _K), ("ts", "ts"), ("zz", _ZZ))], _vocabulary("type:event", "events", EVENT.attrs[0], "event_id")]
_PICTURE = [
    _exists("type:picture", "embeddings", "SCHEMAFULL", "normal"), *[_defined("type:picture", "embeddings", n) for n in ("embedding", "label", "vec_id")],
    ("VEC-004", "'WARN'", "type:picture", "embeddings", _text("index 'by_old_vector' is of the retired kind mtree")), ("VEC-002", "'PASS'", "type:picture", "embeddings", _text("index 'by_old_vector' has dimension 64")),
    ("VEC-003", "'PASS'", "type:picture", "embeddings", _text("index 'by_old_vector' has distance euclidean")), _dimensions("type:picture", "embeddings", "embedding", 64, "vec_id"), ("FTS-001", "'FAIL'", "type:picture", "embeddings", _text("no full-text index covers 'label'")),
]
_NOTE = [
    _exists("type:note", "note", "SCHEMAFULL", "normal"), ("VAC-001", "'VACUOUS'", "type:note", "note", _text("table 'note' has 0 rows: only its definitions can be checked")), _defined("type:note", "note", "body"),
    ("FLD-002", "null", "type:note", "note", "''"), ("FLD-003", "'WARN'", "type:note", "note", _text("attr 'stars': declared 'float', but defined as 'int'")), ("VEC-001", "'FAIL'", "type:note", "note", _text("no vector index (hnsw, mtree, diskann) covers 'emb'")),
]
_NEWS = [
    _exists("type:news", "news", "SCHEMAFULL", "normal"), _defined("type:news", "news", "body"), _defined("type:news", "news", "emb"), _accepted("type:news", "news", "feed", "record", "record<feed>"), _defined("type:news", "news", "id"), _accepted("type:news", "news", "published_at", "datetime", "datetime"),
    ("VEC-002", "'PASS'", "type:news", "news", _text("index 'by_vector' has dimension 64")), ("VEC-003", "'FAIL'", "type:news", "news", _text("index 'by_vector' has distance euclidean, declared is cosine")), _dimensions("type:news", "news", "emb", 64, "id"),
    ("FTS-001", "'PASS'", "type:news", "news", _text("full-text index 'by_body' covers 'body' (analyzer words)")), ("FTS-003", "'WARN'", "type:news", "news", _text("analyzer 'words' does not stem 'french': DEFINE ANALYZER words TOKENIZERS blank FILTERS lowercase, snowball(english)")),
]
_SHAPE = [
    _exists("type:shape", "document", "SCHEMAFULL", "normal"), _defined("type:shape", "document", "status"), ("VEC-001", "'FAIL'", "type:shape", "document", _text("no vector index (hnsw, mtree, diskann) covers 'status'")),
    ("VEC-010", "(select case when count_if(data_type like '%[]') = 0 then 'VACUOUS' end from information_schema.columns where table_name = 'document' and column_name = 'status')", "type:shape", "document", _text("no row has an embedding in 'status'")),
]
_TITLE = [
    _exists("type:title", "news", "SCHEMAFULL", "normal"), _defined("type:title", "news", "title"), ("FTS-001", "'PASS'", "type:title", "news", _text("full-text index 'by_title' covers 'title' (analyzer lost)")),
    ("FTS-002", "'FAIL'", "type:title", "news", _text("declared analyzer is 'words', index 'by_title' has 'lost'")), ("FTS-002", "'FAIL'", "type:title", "news", _text("analyzer 'lost' of index 'by_title' is not defined")),
]
_ENDS = "(select distinct coalesce(split_part(in_id, ':', 1), 'None') as s, coalesce(split_part(out_id, ':', 1), 'None') as t from mentions)"
_ADVICE = "it has no IN/OUT constraint; DEFINE TABLE {0} TYPE RELATION IN {1} OUT {2} would give it one"
_SQL_ENDS = f"(select string_agg('(''' || s || ''', ''' || t || ''')', ', ' order by s, t) from {_ENDS} where (s, t) <> ('news', 'entity'))"
_EDGES = [
    _exists("type:feed", "feed", "SCHEMAFULL", "normal"), _accepted("type:feed", "feed", "name", "string", "string"), _exists("type:document", "document", "SCHEMAFULL", "normal"), _accepted("type:document", "document", "status", "string", "string"),
    _exists("type:news", "news", "SCHEMAFULL", "normal"), _exists("type:entity", "entity", "SCHEMAFULL", "normal"),
    ("REL-002", f"case when {_SQL_ENDS} is null then 'WARN' else 'FAIL' end", "relation:mentions", "mentions",
     f"coalesce('edge ''mentions'': ends [' || {_SQL_ENDS} || '], declared is (''news'', ''entity''); ' || {_text(_ADVICE.format('mentions', 'news', 'entity'))}, {_text('edge ' + repr('mentions') + ': ends are as declared, but ' + _ADVICE.format('mentions', 'news', 'entity'))})"),
    _undefined("relation:mentions", "mentions", "relevance", "relevance", "REL-004", "weight field"),
    ("REL-002", "'PASS'", "relation:cites", "cites", _text("edge 'cites': defined from 'news' to 'document'")), ("REL-002", "'FAIL'", "relation:cited_by", "cites", _text("edge 'cites': IN is ['news'], declared is 'document'; OUT is ['document'], declared is 'news'")),
    ("REL-002", "'VACUOUS'", "relation:follows", "follows", _text("edge 'follows' is empty, so its direction is unknown, and " + _ADVICE.format("follows", "news", "news"))), ("REL-004", "'VACUOUS'", "relation:follows", "follows", _text("weight field 'w' is not defined and the edge is empty")),
    ("REL-001", "'FAIL'", "relation:lost", "lost", _text("edge table 'lost' does not exist")), ("REL-002", "'FAIL'", "relation:order", "orders", _text("table 'orders' is a normal table, no edge")),
]
_LINKS = [
    _exists("type:news", "news", "SCHEMAFULL", "normal"), _exists("type:feed", "feed", "SCHEMAFULL", "normal"), _accepted("type:feed", "feed", "name", "string", "string"), _exists("type:event", "events", "SCHEMALESS", "any"), *_NOTE,
    ("REL-003", "'PASS'", "relation:from_feed", "news", _text("link field 'feed' is record<feed>")), _undefined("relation:of_user", "events", "user_id", "user_id", "REL-003", "link field"), _undefined("relation:of_none", "events", "zz", _ZZ, "REL-003", "link field"),
    ("REL-003", "'VACUOUS'", "relation:of_note", "note", _text("link field 'f' is not defined; 0 of 0 rows have it")),
    *[("REL-003", f"case when contains('{kind}', 'record<{target}>') then 'PASS' else 'FAIL' end", f"relation:{name}", "news", _text(f"link field '{field}' is {kind}, declared is record<{target}>" + ('' if 'record' in kind else '; it is no link'))) for name, field, kind, target in (("of_event", "feed", "record<feed>", "events"), ("of_body", "body", "string", "feed"))],
]
_FIELDS = [*_EVENT, _exists("type:reading", "events", "SCHEMALESS", "any"), ("FLD-000", "'FAIL'", "type:reading", None, _text("field name 'x-y' is no plain identifier"))]

SQL = {
    "findings_table": _rows(*_NOTE, ("TBL-001", "'FAIL'", "type:gone", "no_such_table", _text("table 'no_such_table' does not exist")), ("TBL-000", "'FAIL'", "type:odd", None, _text("table name 'a b' is no plain identifier"))),
    "findings_fields": _rows(*_FIELDS),
    "findings_vocabulary": _rows(*_ENTITY),
    "findings_vector": _rows(*_NEWS, *_PICTURE, *_NOTE, *_SHAPE),
    "findings_fulltext": _rows(*_TITLE),
    "findings_edge": _rows(*_EDGES),
    "findings_link": _rows(*_LINKS),
    "findings_freshness": _rows(*_NOTE, ("FRS-001", "'PASS'", "freshness:note", None, _text("field 'body' is among the type's declared fields")), ("FRS-001", "'WARN'", "freshness:note", None, _text("field 'at' is not among the type's declared fields"))),
    "flagship_report": _rows(*_ENTITY, *_EVENT, *_PICTURE, *_NOTE, ("FRS-001", "'PASS'", "freshness:event", None, _text("field 'ts' is among the type's declared fields"))),
    "row_counts": " union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in TABLES),
    "field_presence": " union all ".join(f"select '{c}' as field_name, count({c}) as present, count(*) as total from technical_assessment" for c in ("id", "code", "body_text", "status", "issued_at", "load_id", "loaded_at")) + " union all select 'no_such_column', 0, count(*) from technical_assessment",
    "json_field_presence": f"select count({_K}) as k, count({_ZZ}) as zz, count(*) as total from events",
    "variant_field_presence": f"select count({_K}) as k, count({_ZZ}) as zz, count(*) as total from events",
    "value_sample": "select value, count(*) as n from (select kind as value from entity where kind is not null order by id, kind limit 200) group by 1",
    "vocabulary_violations": "select distinct value from (select kind as value from entity where kind is not null order by id, kind limit 200) where value not in ('person', 'agency', 'organization')",
    "embedding_dimensions": "select len(emb)::int as dim, count(*) as n from (select emb from news where emb is not null order by id, emb limit 500) group by 1",
    "edge_endpoints": f"select s as source, t as target from {_ENDS}",
    "weight_profile": "select count(relevance) as present, count(*) as total, min(relevance) filter (where not isnan(relevance)) as lowest, max(relevance) filter (where not isnan(relevance)) as highest from mentions",
    "link_integrity": "select count(o_custkey) as links, count(c_custkey) as resolved from orders left join customer on o_custkey = c_custkey",
    "stable_id_duplicates": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
    "status_tally": f"select status, count(*) as n from ({_rows(*_FIELDS)}) group by 1",
}
