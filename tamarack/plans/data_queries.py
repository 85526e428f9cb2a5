"""Queries over the test tables for the core's data operators, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.text import SPACE, pointer_key_sql
from tamarack.operators.quality import TextColumn, TimeColumn, columns_of, expressions, faults, profile
from tamarack.operators.references import orphan_references, orphan_report
from tamarack.sources.parquet import table

ASSESSMENT = [TextColumn("status", ("current", "revoked")), TimeColumn("issued_at")]


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(
        table(spark, d, "mentions", "id", "in_id", "out_id", "loaded_at"),
        {"in": ("in_id", "news"), "out": ("out_id", "entity")},
        {t: table(spark, d, t, "id", "loaded_at") for t in ("news", "entity")},
        table(spark, d, "removal", "record_id", "removed_at"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).selectExpr("reference_id AS mention_id", "side")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    profiled = profile(table(spark, d, "technical_assessment", "status", "issued_at", "load_id", "loaded_at"), ASSESSMENT)
    return faults(profiled, pattern=["status"], value_range=["issued_at"], distinct=["issued_at"])


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column but the load's own, as the kind that fits it. No figure here hangs on an induced expression, so none is sought; they are in ``p3_expressions`` and ``p3_coverage``."""
    rows = table(spark, d, "technical_assessment")
    columns = [TextColumn("status", ("current", "revoked")), *columns_of(rows, ("status", "load_id", "loaded_at"))]
    return profile(rows, columns, induced=False)


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Values of ``code`` and ``issued_at``, which have no vocabulary, beyond their expressions, by load and against the load before."""
    rows = table(spark, d, "technical_assessment", "code", "issued_at", "load_id", "loaded_at")
    profiled = profile(rows, [TextColumn("code"), TimeColumn("issued_at")])
    changed = faults(profiled, [], [], [], ["code", "issued_at"]).where("check_name = 'coverage'").select("load_id", "field_name", F.lit(True).alias("changed"))
    covered = profiled.select("load_id", "field_name", (F.col("n_rows") - F.col("n_null")).alias("n_values"), "n_nonconforming", "before_conforming")
    return covered.join(changed, ["load_id", "field_name"], "left").fillna(False, ["changed"])


def p3_expressions(spark: SparkSession, d: str) -> DataFrame:
    """The induced expressions of all columns. They have no twin: SQL has no minimum description length."""
    rows = table(spark, d, "technical_assessment")
    return expressions(rows, [TextColumn("status", ("current", "revoked")), *columns_of(rows, ("status", "load_id", "loaded_at"))])


def _p2_sql(result: str) -> str:
    return f"""
with parent as (
  select tbl, key, min(seen) as since, case when max(gone) > max(seen) then max(gone) end as until, max(stored) as stored from (
    select 'news' as tbl, {pointer_key_sql('id', 'news')} as key, loaded_at as seen, null::timestamp as gone, 1 as stored from news
    union all select 'entity', {pointer_key_sql('id', 'entity')}, loaded_at, null, 1 from entity
    union all select 'news', {pointer_key_sql('record_id', 'news')}, null, removed_at, 0 from removal
    union all select 'entity', {pointer_key_sql('record_id', 'entity')}, null, removed_at, 0 from removal)
  where key is not null group by 1, 2),
m as (select *, min(loaded_at) over (partition by id) as first from mentions),
ref as (
  select id, 'in' as side, 'news' as tbl, {pointer_key_sql('in_id', 'news')} as key, first from m where in_id is not null
  union all select id, 'out', 'entity', {pointer_key_sql('out_id', 'entity')}, first from m where out_id is not null),
judged as (
  select ref.id, ref.side, ref.tbl, ref.first,
    case when ref.key is null then 'unreadable' when coalesce(parent.stored, 0) = 0 then 'missing' when parent.until is not null then 'removed' when parent.since > ref.first then 'late' end as reason
  from ref left join parent on ref.tbl = parent.tbl and ref.key = parent.key),
orphan as (select id, side, tbl, min(first) as first, arg_min(reason, list_position(['unreadable', 'missing', 'removed', 'late'], reason)) as reason from judged where reason is not null group by 1, 2, 3)
{result}"""


def _null(c: str) -> str:
    return f"({c} is null or regexp_full_match({c}, '{SPACE}*'))"


def _text_rows(c: str, odd: str = "null") -> str:
    value = f"case when not {_null(c)} then {c} end"
    return f"select load_id, '{c}' as field_name, {value} as value, {value} as cell, case when {value} is null then 0 else {odd} end as odd, 0 as outside from technical_assessment"


def _p3_sql(*texts: str) -> str:
    """Figures per load of ``status``, ``issued_at`` and further text columns."""
    return f"""
with r as (
  {_text_rows('status', "case when status not in ('current', 'revoked') then 1 else 0 end")}
  {''.join(f"union all {_text_rows(c)} " for c in texts)}
  union all
  select load_id, 'issued_at', strftime(issued_at, '%Y-%m-%d %H:%M:%S.%f'), case when issued_at is null then null when issued_at > loaded_at then 'after'
      when loaded_at - issued_at < interval 30 day then '0' when loaded_at - issued_at < interval 180 day then '30' else '180' end,
    null, case when issued_at > loaded_at or issued_at < timestamp '1990-01-01' then 1 else 0 end from technical_assessment),
load as (
  select load_id, field_name, count(*) as n, count(*) - count(value) as nulls, count(distinct value) as d, min(value) as lowest, max(value) as highest, case when field_name = 'status' then sum(odd) end as odd, sum(outside) as outside from r group by 1, 2),
l as (select *, lag(n) over w as n0, lag(nulls) over w as nulls0, lag(load_id) over w as before, lead(load_id) over w as after from load window w as (partition by field_name order by load_id)),
share as (
  select r.load_id, r.field_name, r.cell, l.after, count(*) / (l.n - l.nulls) as s from r join l using (load_id, field_name) where r.cell is not null group by r.load_id, r.field_name, r.cell, l.after, l.n, l.nulls),
moved as (
  select load_id, field_name, round(sum(abs(s)) / 2, 9) as moved from (
    select load_id, field_name, cell, sum(s) as s from (
      select load_id, field_name, cell, s from share union all select after, field_name, cell, -s from share where after is not null)
    group by 1, 2, 3) group by 1, 2)
"""


#: Columns without vocabulary have one way to be written here, so what their expression must cover is the commonest mask.
_COVERAGE = r"""
with v as (
  select load_id, 'code' as field_name, code as value from technical_assessment union all select load_id, 'issued_at', issued_at::varchar from technical_assessment),
m as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(value, '[.][0-9]+$', ''), '\p{Ll}', 'a', 'g'), '\p{Lu}', 'A', 'g'), '\p{Nd}', '9', 'g') as mask from v),
common as (select field_name, mode(mask) as mask from m group by 1),
l as (select load_id, field_name, count(value) as n, count_if(m.mask <> common.mask)::bigint as odd from m join common using (field_name) group by 1, 2),
b as (select *, lag(n) over w as n0, lag(odd) over w as odd0 from l window w as (partition by field_name order by load_id))
select load_id, field_name, n as n_values, odd as n_nonconforming, n0 - odd0 as before_conforming, coalesce(abs((n - odd) * n0 - (n0 - odd0) * n) * 10 > n * n0, false) as changed from b"""

SQL = {
    "p2_found": _p2_sql("select id as mention_id, side from orphan"),
    "p2_report": _p2_sql("select tbl as \"table\", strftime(first, '%Y-%m') as month, reason, count(*) as n from orphan group by 1, 2, 3"),
    "p3_profile": _p3_sql("id", "code", "body_text")
    + """
select load_id, field_name, n as n_rows, nulls as n_null, d as n_distinct, lowest, highest, outside::bigint as n_outside, odd::bigint as n_unlisted,
  before as before_load_id, n0 as before_rows, nulls0 as before_null, case when before is not null then coalesce(moved, 0) end as moved
from l left join moved using (load_id, field_name)""",
    "p3_coverage": _COVERAGE,
    "p3_found": _p3_sql()
    + """
select load_id, field_name, 'null_rate' as check_name from l where abs(nulls * n0 - nulls0 * n) * 100 > n * n0 * 10
union all select load_id, field_name, 'distribution' from l join moved using (load_id, field_name) where before is not null and moved > 0.25
union all select load_id, field_name, 'pattern' from l where field_name = 'status' and odd * 100 > (n - nulls) * 5
union all select load_id, field_name, 'value_range' from l where field_name = 'issued_at' and outside * 100 > (n - nulls) * 5
union all select load_id, field_name, 'distinct' from l where field_name = 'issued_at' and d * 100 < (n - nulls) * 60""",
}

QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_profile": p3_profile, "p3_coverage": p3_coverage, "p3_expressions": p3_expressions}
