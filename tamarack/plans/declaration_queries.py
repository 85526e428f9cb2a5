"""Queries over declarations and spellings, which the rules judge without any table, and over reports; with SQL twins that apply the rules."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.ontology import ATTR_TYPES, Attr, Freshness, Ontology, OntologyError, Relation, Scope, UnitType
from tamarack.operators.conformance import ACCEPTED, accepts, check
from tamarack.plans import conformance_queries
from tamarack.sources.catalog import from_frames
from tamarack.sources.ddl import core_type, is_safe_identifier, normalize_type
from tamarack.sources.parquet import table

#: Declarations as rows: (case, type), (case, type, attr, type of the attr), (case, relation, from, to, kind, field), (case, scope, via), (case, type that ages).
TYPES = [("sound", "a"), ("sound", "b"), ("repeats", "a"), ("repeats", "b"), ("repeats", "a"), ("repeats", "a"), ("ends", "a"), ("scopes", "a"), ("attrs", "a"), ("attrs", "b"), ("ages", "a"), ("links", "a"), ("links", "b"), ("all", "a"), ("all", "a")]
ATTRS = [
    ("sound", "a", "f", "record"), ("sound", "b", "f", "string"), ("attrs", "a", "f", "int"), ("attrs", "a", "f", "int"), ("attrs", "a", "g", "int"), ("attrs", "a", "f", "string"), ("attrs", "b", "g", "int"), ("attrs", "b", "g", "int"),
    ("links", "a", "f", "string"), ("links", "a", "g", "record"), ("links", "b", "h", "int"), ("all", "b", "f", "int"),
]
RELATIONS = [
    ("sound", "r", "a", "b", "edge", None), ("sound", "l", "a", "b", "field_link", "f"), ("repeats", "r", "a", "b", "edge", None), ("repeats", "r", "b", "a", "edge", None), ("ends", "r", "x", "y", "edge", None), ("ends", "q", "a", "x", "edge", None), ("ends", "p", "a", "a", "edge", None),
    ("links", "l", "a", "b", "field_link", "f"), ("links", "m", "a", "b", "field_link", "g"), ("links", "n", "a", "b", "field_link", "none"), ("links", "o", "b", "a", "field_link", "h"), ("all", "r", "a", "z", "edge", None),
]
SCOPES = [("sound", "s", "r"), ("sound", "t", None), ("repeats", "s", "r"), ("repeats", "s", None), ("scopes", "s", "r"), ("scopes", "t", "q"), ("scopes", "u", None), ("all", "s", "q")]
AGES = [("sound", "a"), ("ages", "z"), ("ages", "a"), ("ages", "z"), ("all", "z")]

CORES = ["string", "int", "float", "number", "bool", "datetime", "duration", "record", "record<news>", "array", "array<float>", "object", "decimal", "date", "any"]
FORMS = ["{}", " {} ", "option<{}>", "Option< {} >", "none | {}", "{}|none", "{} | int", "array<option<{}>> | none", "none|record<{}|b>|{}", "set<array<{}|none>|int>|string"]
NAMES = ["news", "_x", "Field9", "", "9x", "a-b", "a b", "a;b", "`a`", "é", "a\n", "A_"]


def ontology_violations(spark: SparkSession, d: str) -> DataFrame:
    """Violations that each declaration raises, by code."""
    rows = []
    for case in dict.fromkeys(c for c, _ in TYPES):
        of = lambda parts: [r[1:] for r in parts if r[0] == case]  # noqa: B023, E731
        attrs, first = of(ATTRS), set()
        types = [UnitType(t, t, attrs=[] if t in first or first.add(t) else [Attr(a, k) for owner, a, k in attrs if owner == t]) for (t,) in of(TYPES)]
        try:
            Ontology(types, [Relation(n, a, b, kind, field=f) for n, a, b, kind, f in of(RELATIONS)], [Scope(n, via) for n, via in of(SCOPES)], [Freshness(t, "at", "30d") for (t,) in of(AGES)])
        except OntologyError as e:
            rows += [(case, code, n) for code, n in Counter(v.code for v in e.violations).items()]
    return spark.createDataFrame(rows, "case_name string, code string, n long")


def type_spellings(spark: SparkSession, d: str) -> DataFrame:
    """The one spelling of a defined type, its core, and the declared types that accept it."""
    rows = []
    for spelt in (f.replace("{}", c) for f in FORMS for c in CORES):
        normal = normalize_type(spelt)
        rows.append((spelt, normal, core_type(normal), ",".join(sorted(a for a in ATTR_TYPES if accepts(a, normal)))))
    return spark.createDataFrame(rows, "spelt string, normal string, core string, accepted_by string")


def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n, is_safe_identifier(n)) for n in NAMES], "name string, safe boolean")


def exit_codes(spark: SparkSession, d: str) -> DataFrame:
    """What the command line would end with for each ontology over the test tables."""
    rows = []
    for name, ontology in conformance_queries.ONTOLOGIES.items():
        report = check(ontology, conformance_queries.test_catalog(spark, d, ontology=ontology))
        rows += [(name, strict, report.exit_code(strict)) for strict in (False, True)]
    return spark.createDataFrame(rows, "ontology string, strict boolean, code int")


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """The findings of a report as its text shows them."""
    ontology = conformance_queries.ONTOLOGIES["flagship_report"]
    report = check(ontology, conformance_queries.test_catalog(spark, d, ontology=ontology))
    shown = [line[2:] for line in report.render_text().splitlines()]
    return spark.createDataFrame([(i, line) for i, line in enumerate(line for line in shown if line in {str(f) for f in report.findings})], "seq int, line string")


def broken_checks(spark: SparkSession, d: str) -> DataFrame:
    """A table whose rows can't be read must not hide the findings about others: the events' payload raises an error in every row."""
    events = table(spark, d, "events", "event_id").withColumn("props", F.raise_error(F.lit("unreadable")).cast("string"))
    catalog = from_frames({"events": events, "feed": table(spark, d, "feed")}, "DEFINE TABLE events SCHEMALESS", d, {"events": "props"})
    report = check(Ontology([UnitType("event", "events", text="k"), UnitType("feed", "feed", attrs=[Attr("name", "string")])]), catalog)
    return report.to_frame(spark).select("code", "status", "subject")


QUERIES = {f.__name__: f for f in (ontology_violations, type_spellings, safe_names, exit_codes, report_lines, broken_checks)}


# -- SQL twins ---------------------------------------------------------------------------------
def _sql(value: object) -> str:
    return "null" if value is None else "'" + str(value).replace("'", "''") + "'"


def _values(name: str, columns: str, rows: list) -> str:
    return f"{name}({columns}) as (values " + ", ".join("(" + ", ".join(map(_sql, r if isinstance(r, tuple) else (r,))) + ")" for r in rows) + ")"


_DECLARED = ", ".join([_values("t", "c, name", TYPES), _values("a", "c, t, name, type", ATTRS), _values("r", "c, name, from_, to_, kind, field", RELATIONS), _values("s", "c, name, via", SCOPES), _values("f", "c, t", AGES)])
_repeat = lambda what, by: f"select c, count(*) - 1 as n from {what} group by {by} having count(*) > 1"
_ACCEPTED = [(declared, defined) for declared, all_ in ACCEPTED.items() for defined in sorted(all_)]

SQL = {
    "ontology_violations": f"""with {_DECLARED},
v as (
  select 'ONT-001' as code, * from ({_repeat('t', 'c, name')} union all {_repeat('r', 'c, name')} union all {_repeat('s', 'c, name')})
  union all select 'ONT-002', c, 1 from (select c, unnest([from_, to_]) as e from r) x where not exists (select 1 from t where t.c = x.c and t.name = x.e)
  union all select 'ONT-003', c, 1 from s where via is not null and not exists (select 1 from r where r.c = s.c and r.name = s.via)
  union all select 'ONT-005', * from (select c, count(*) - 1 as n from a where exists (select 1 from t where t.c = a.c and t.name = a.t) group by c, t, name having count(*) > 1)
  union all select 'ONT-008', c, 1 from f where not exists (select 1 from t where t.c = f.c and t.name = f.t)
  union all select 'ONT-009', r.c, 1 from r join a on r.c = a.c and r.from_ = a.t and r.field = a.name where kind = 'field_link' and type <> 'record')
select c as case_name, code, sum(n)::bigint as n from v group by 1, 2""",
    "type_spellings": f"""with {_values('spelling', 'spelt', [f.replace("{}", c) for f in FORMS for c in CORES])}, {_values('ok', 'declared, defined', _ACCEPTED)},
flat as (select spelt, lower(regexp_replace(spelt, '\\s', '', 'g')) as x from spelling),
opened as (select spelt, case when x like 'option<_%>' then 'none|' || substr(x, 8, length(x) - 8) else x end as x from flat),
piece as (select spelt, unnest(string_split(x, '|')) as p, generate_subscripts(string_split(x, '|'), 1) as i from opened),
depth as (select *, sum(2 * length(p) - length(replace(p, '>', '>>')) - length(replace(p, '<', ''))) over (partition by spelt order by i rows unbounded preceding) as after_it from piece),
member as (
  select spelt, no, string_agg(p, '|' order by i) as m from (
    select *, count_if(coalesce(before_it, 0) = 0) over (partition by spelt order by i rows unbounded preceding) as no from (
      select *, lag(after_it) over (partition by spelt order by i) as before_it from depth))
  group by 1, 2),
normal as (select spelt, string_agg(m, '|' order by m) as normal, count_if(m <> 'none') as n, any_value(m) filter (where m <> 'none') as one from member group by 1),
core as (select spelt, normal, case when n = 1 then one else normal end as core from normal)
select core.*, coalesce((select string_agg(declared, ',' order by declared) from (
  select declared from ok where defined = core.core union all select k from (values ('record'), ('array')) v(k) where starts_with(core.core, k))), '') as accepted_by from core""",
    "safe_names": f"with {_values('n', 'name', NAMES)} select name, length(name) > 0 and not regexp_matches(name, '[^A-Za-z0-9_]') and not regexp_matches(left(name, 1), '[0-9]') as safe from n",
    "exit_codes": " union all ".join(
        f"select '{name}' as ontology, {strict} as strict, case when count_if(status = 'FAIL') > 0 or {strict} and count_if(status in ('WARN', 'VACUOUS')) > 0 then 1 else 0 end as code from ({conformance_queries.SQL[name]})"
        for name in conformance_queries.ONTOLOGIES for strict in ("false", "true")
    ),
    "report_lines": f"select seq, rpad(status, 7, ' ') || ' ' || rpad(code, 8, ' ') || ' ' || subject || ': ' || message as line from ({conformance_queries.SQL['flagship_report']})",
    "broken_checks": """select * from (values ('TBL-001', 'PASS', 'type:event'), ('CHK-000', 'FAIL', 'type:event'), ('TBL-001', 'PASS', 'type:feed'), ('FLD-001', 'PASS', 'type:feed')) v(code, status, subject)""",
}
