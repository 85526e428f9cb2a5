"""Queries for the extension operators (search, evaluation, evidence) over the test tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.operators import evidence, retrieval
from tamarack.sources.parquet import table

NOW = "2025-06-30"
#: Every so many records one is a query.
EVERY = 50


def _units(spark: SparkSession, d: str) -> DataFrame:
    """News with a body, a redelivered record once, by its last delivery."""
    news = table(spark, d, "news", "id", "body", "feed", "published_at", "loaded_at").where("body is not null")
    last = news.groupBy(F.col("id").alias("unit_id")).agg(F.max(F.struct("loaded_at", "body", "feed", "published_at")).alias("r"))
    return last.select("unit_id", F.col("r.body").alias("text"), F.col("r.feed").alias("source"), F.col("r.published_at").alias("at"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """The texts of the units whose number is divisible by ``EVERY``, as queries."""
    return _units(spark, d).where(F.regexp_extract("unit_id", "([0-9]+)$", 1).try_cast("bigint") % EVERY == 0).select(F.col("unit_id").alias("query_id"), "text")


def _rounded(ranking: DataFrame) -> DataFrame:
    return ranking.withColumn("score", F.round("score", 6))


def _found(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    return retrieval.bm25_each(_units(spark, d), _asked(spark, d), k, 6)  # ties are ties of rounded scores


def _newest(spark: SparkSession, d: str, k: int = 10) -> DataFrame:
    """The newest units that the queries' scopes hold, as a second ranked list of each query."""
    scored = _units(spark, d).where("source is not null").select(F.lit("").alias("query_id"), "unit_id", F.unix_seconds(F.col("at").cast("timestamp")).cast("double").alias("score"))
    return _asked(spark, d).select("query_id").crossJoin(F.broadcast(retrieval.ranked(scored, k).drop("query_id")))


def bm25_top(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d)


def bm25_stemmed(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.bm25_each(_units(spark, d), _asked(spark, d), 10, 6, stem=True)


def degraded_fusion(spark: SparkSession, d: str) -> DataFrame:
    """A fusion of which one branch is missing and one has found nothing."""
    found = _found(spark, d)
    return _rounded(retrieval.reciprocal_rank_fusion([None, found, found.where("place < 0")], 10))


def cosine_top(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "embeddings", "vec_id", "embedding").withColumnsRenamed({"vec_id": "unit_id", "embedding": "emb"})
    queries = units.where(F.col("unit_id") % EVERY == 0).select(F.col("unit_id").cast("string").alias("query_id"), "emb")
    return _rounded(retrieval.cosine_each(units, queries, 10))


def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(retrieval.reciprocal_rank_fusion([_found(spark, d, 30), _newest(spark, d, 30)], 20))


def score_fusion(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.linear_fusion([(_found(spark, d, 30), 0.7), (_newest(spark, d, 30), 0.3)], 20, digits=6)


def scoped_units(spark: SparkSession, d: str) -> DataFrame:
    members = table(spark, d, "mentions", "in_id").select(F.col("in_id").alias("unit_id"))
    return retrieval.within_scope(_units(spark, d), members).groupBy("source").agg(F.count("*").alias("n"))


def freshness(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).select("unit_id", F.round(retrieval.freshness_weight(F.col("at"), F.lit(NOW).cast("timestamp_ntz"), 30), 6).alias("weight"))


def diverse_top(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.diverse(_found(spark, d, 30), _units(spark, d).select("unit_id", "source"), 2, 1.0)


def budget_top(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.within_budget(_found(spark, d, 30), _units(spark, d).select("unit_id", F.char_length("text").alias("size")), 500)


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Every document's neighbours; a document is its own query, so that the result keeps whose they are."""
    places = table(spark, d, "documents", "doc_id", "bitext_id", "seg_no").select(F.col("doc_id").alias("unit_id"), F.col("bitext_id").alias("source"), F.col("seg_no").alias("position"))
    ranking = places.select(F.col("unit_id").cast("string").alias("query_id"), "unit_id")
    return retrieval.with_neighbours(ranking, places, 2)


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    good = _units(spark, d).where("text like '%repair%' or text like '%signal box%'")
    e = retrieval.evaluate_common(_found(spark, d), _asked(spark, d), good, 10)
    return e.select("query_id", *[F.round(c, 6).alias(c) for c in e.columns[1:]])


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document", "id", "number", "status").select("id", evidence.stable_id(F.col("number"), F.col("status")).alias("stable_id"))


def content_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return evidence.content_copies(table(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "unit_id"), "text")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "document", "id", "loaded_at").select(F.col("id").alias("unit_id"), F.col("loaded_at").alias("version"), F.col("loaded_at").alias("made_at"))


def document_versions(spark: SparkSession, d: str) -> DataFrame:
    return evidence.current_versions(_versions(spark, d).select("unit_id", "version"))


def superseded_versions(spark: SparkSession, d: str) -> DataFrame:
    cited = _versions(spark, d).where("unit_id like '%7'").select("unit_id", "version")
    return evidence.collectable_versions(_versions(spark, d), cited, F.lit("2025-01-01").cast("timestamp_ntz"))


def provenance(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda t, a, b, x, y: table(spark, d, t, a, b).select(F.concat(F.lit(x), F.col(a)).alias("unit_id"), F.concat(F.lit(y), F.col(b)).alias("origin_id"))
    edges = pair("customer", "c_custkey", "c_nationkey", "c", "n").unionAll(pair("nation", "n_nationkey", "n_regionkey", "n", "r")).unionAll(pair("supplier", "s_suppkey", "s_nationkey", "s", "n"))
    return evidence.origins(edges.select("unit_id").distinct(), edges, 3)


def _mentioned(spark: SparkSession, d: str) -> DataFrame:
    """Mentions as derived from the news record that they point to, in the version that was current when they were loaded."""
    return table(spark, d, "mentions", "id", "in_id", "loaded_at").where("id is not null").select(F.col("id").alias("unit_id"), F.col("in_id").alias("origin_id"), F.col("loaded_at").alias("used")).distinct()


def _news_versions(spark: SparkSession, d: str) -> DataFrame:
    return evidence.current_versions(table(spark, d, "news", "id", "loaded_at").select(F.col("id").alias("unit_id"), F.col("loaded_at").alias("version")))


def stale_mentions(spark: SparkSession, d: str) -> DataFrame:
    return evidence.stale_dependents(_mentioned(spark, d), _news_versions(spark, d))


def derivation_check(spark: SparkSession, d: str) -> DataFrame:
    return evidence.verify_derivations(_mentioned(spark, d), _news_versions(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


def existence_check(spark: SparkSession, d: str) -> DataFrame:
    cited = table(spark, d, "mentions", "id", "out_id").select(F.col("id").alias("citation_id"), F.col("out_id").alias("unit_id"))
    return evidence.verify_existence(cited, table(spark, d, "entity", "id").withColumnRenamed("id", "unit_id"))


def receipt_check(spark: SparkSession, d: str) -> DataFrame:
    """Receipts of every delivery of a news record, against its last."""
    receipts = table(spark, d, "news", "id", "body", "loaded_at").select(F.concat_ws(" ", "id", F.col("loaded_at").cast("string")).alias("receipt_id"), F.col("id").alias("unit_id"), F.md5(F.coalesce("body", F.lit(""))).alias("text_hash"))
    return evidence.verify_receipts(receipts, _units(spark, d))


def text_sections(spark: SparkSession, d: str) -> DataFrame:
    return evidence.sections(table(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "unit_id"))


def quote_check(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d)
    quote = F.when(F.col("unit_id").like("%1"), F.substr("text", F.lit(5), F.lit(10))).otherwise("no such words")
    cited = F.when(F.col("unit_id").like("%3"), F.lit("0")).when(F.col("unit_id").like("%1"), F.md5("text"))
    citations = units.select(F.col("unit_id").alias("citation_id"), F.when(F.col("unit_id").like("%5"), "news:lost").otherwise(F.col("unit_id")).alias("unit_id"), quote.alias("quote"), cited.alias("text_hash"))
    return evidence.verify_quotes(citations, units)


def figure_check(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    claimed = orders.groupBy("o_orderpriority").agg(F.count_if(F.col("o_orderstatus") != "P").alias("claimed"))
    return evidence.verify_figures(claimed, orders.where("o_orderstatus <> 'P' or o_orderpriority like '1%'"), ["o_orderpriority"], F.count("*"))


def undelivered(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda t, a, b: table(spark, d, t, a, b).select(F.col(a).alias("run_id"), F.col(b).alias("unit_id"))
    return evidence.undelivered_citations(pair("mentions", "in_id", "out_id"), pair("mentions", "in_id", "out_id").where("unit_id not like '%17'"))


def mixed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "embeddings", "label", "embedding").select(F.col("label").alias("type"), F.size("embedding").alias("config_hash"))
    return evidence.mixed_configurations(units.unionAll(units.where("type = 1").select("type", F.lit(0))))


def text_chunks(spark: SparkSession, d: str) -> DataFrame:
    return evidence.chunks(table(spark, d, "documents", "doc_id", "text").withColumnRenamed("doc_id", "unit_id"), 200, 20)


def tool_use(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_type", "user_id", "value").select(F.col("event_type").alias("tool"), F.col("user_id").alias("unit_id"), F.col("value").alias("latency"), (F.col("value") > 50).alias("cited"))
    use = evidence.use_by_tool(e)
    return use.select("tool", "calls", "units", *[F.round(c, 6).alias(c) for c in use.columns[3:]])


def never_used(spark: SparkSession, d: str) -> DataFrame:
    ids = lambda t, c: table(spark, d, t, c).withColumnRenamed(c, "unit_id")
    return evidence.never_accessed(ids("customer", "c_custkey"), ids("events", "user_id"))


QUERIES = {
    f.__name__: f
    for f in (
        bm25_top, cosine_top, rank_fusion, score_fusion, scoped_units, freshness, diverse_top, budget_top, neighbours, evaluation, stable_ids, content_duplicates, document_versions, superseded_versions, provenance,
        quote_check, figure_check, undelivered, bm25_stemmed, degraded_fusion, stale_mentions, derivation_check, existence_check, receipt_check, text_sections, mixed_embeddings, text_chunks, tool_use, never_used,
    )
}

# -- SQL twins ---------------------------------------------------------------------------------
_UNITS = """unit as (
  select id as unit_id, body as text, feed as source, published_at as at_ from news where body is not null
  qualify row_number() over (partition by id order by loaded_at desc nulls last, body desc, feed desc nulls last, published_at desc nulls last) = 1)"""
_ASKED = f"ask as (select unit_id as query_id, text from unit where try_cast(regexp_extract(unit_id, '([0-9]+)$', 1) as bigint) % {EVERY} = 0)"
_BM25 = rf"""
with {_UNITS}, {_ASKED},
word as (select unit_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') as w from unit),
size as (select count(*) as n, avg(len(w)) as mean from word),
posting as (select unit_id, term, len(w) as length, count(*) as tf from (select unit_id, w, unnest(w) as term from word) group by unit_id, term, w),
df as (select term, count(*) as df from posting group by term),
asked as (select distinct query_id, term from (select query_id, unnest(regexp_split_to_array(lower(text), '\s+')) as term from ask) where term <> ''),
scored as (
  select query_id, unit_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) as score
  from asked join posting using (term) join df using (term), size group by 1, 2),
found as (select query_id, unit_id, score, row_number() over (partition by query_id order by score desc, unit_id)::int as place from scored),
newest as (
  select query_id, fresh.* from ask, (
    select unit_id, epoch(at_)::bigint::double as score, row_number() over (order by epoch(at_)::bigint desc, unit_id)::int as place from unit where source is not null and at_ is not null qualify place <= 30) fresh)
"""
_PLACE = "row_number() over (partition by query_id order by score desc, unit_id)::int"
_BOTH = "select query_id, unit_id, place, score, 0.7 as weight, 'a' as l from found where place <= 30 union all select query_id, unit_id, place, score, 0.3, 'b' from newest where place <= 30"
_VERSIONS = "v as (select id as unit_id, loaded_at as version from document)"
_EDGES = "edge as (select distinct * from (select 'c' || c_custkey as unit_id, 'n' || c_nationkey as origin_id from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 's' || s_suppkey, 'n' || s_nationkey from supplier) where unit_id is not null and origin_id is not null)"
_STEM = "case when w like '%ies' then case when w like '%eies' or w like '%aies' then w else left(w, length(w) - 3) || 'y' end when w like '%es' then case when w like '%aes' or w like '%ees' or w like '%oes' then w else left(w, length(w) - 1) end when w like '%s' then case when w like '%us' or w like '%ss' then w else left(w, length(w) - 1) end else w end"
_CURRENT = "current as (select id as origin_id, max(loaded_at) as version from news where id is not null and loaded_at is not null group by 1), used as (select distinct id as unit_id, in_id as origin_id, loaded_at as used from mentions where id is not null)"
SQL = {
    "bm25_stemmed": _BM25.replace("lambda x: x <> '')", f"lambda x: x <> '').list_transform(lambda w: {_STEM})").replace("select distinct query_id, term from (select", f"select distinct query_id, {_STEM.replace('w ', 'term ').replace('(w,', '(term,').replace('(w)', '(term)')} as term from (select") + "select * from found where place <= 10",
    "degraded_fusion": _BM25 + "select query_id, unit_id, round(1.0 / (60 + place), 6) as score, place from found where place <= 10",
    "stale_mentions": f"with {_CURRENT} select unit_id, origin_id, used, version from used join current using (origin_id) where version > used",
    "derivation_check": f"with {_CURRENT} select case when current.origin_id is null then 'origin_missing' when version = used then 'verified' else 'origin_changed' end as status, count(*) as n from used left join current using (origin_id) group by 1",
    "existence_check": "select id as citation_id, out_id as unit_id, case when out_id in (select id from entity where id is not null) then 'verified' else 'unit_missing' end as status from mentions",
    "receipt_check": f"with {_UNITS} select concat_ws(' ', id, strftime(loaded_at, '%Y-%m-%d %H:%M:%S')) as receipt_id, id as unit_id, case when unit.text is null then 'unit_missing' when md5(coalesce(body, '')) = md5(unit.text) then 'verified' else 'text_changed' end as status from news left join unit on id = unit_id",
    "text_sections": r"""
with block as (
  select doc_id as unit_id, unnest(b) as b, generate_subscripts(b, 1) as i from (select doc_id, regexp_split_to_array(text, '\r?\n[ \t]*\r?\n\s*') as b from documents where text is not null)),
part as (select unit_id, i, regexp_replace(b, '^\s+|\s+$', '', 'g') as section from block where regexp_replace(b, '^\s+|\s+$', '', 'g') <> ''),
marked as (select *, regexp_matches(section, '^(#{1,6}|[0-9]+([.][0-9]+)*[.]) [^\r\n]*$') as head from part),
headed as (
  select unit_id, section, head, last_value(case when head then section end ignore nulls) over w as heading, (count_if(not head) over w - 1)::int as section_no from marked window w as (partition by unit_id order by i rows unbounded preceding))
select unit_id, section_no, heading, section from headed where not head""",
    "bm25_top": _BM25 + "select * from found where place <= 10",
    "cosine_top": f"""select query_id, unit_id, round(s, 6) as score, place from (
  select q.vec_id::varchar as query_id, e.vec_id as unit_id, list_cosine_similarity(e.embedding::double[], q.embedding::double[]) as s,
    row_number() over (partition by q.vec_id order by s desc, e.vec_id)::int as place from embeddings e, embeddings q where q.vec_id % {EVERY} = 0) where place <= 10""",
    "rank_fusion": _BM25 + f"select * from (select *, {_PLACE} as place from (select query_id, unit_id, round(sum(1.0 / (60 + place)), 6) as score from ({_BOTH}) group by 1, 2)) where place <= 20",
    "score_fusion": _BM25
    + f"""select * from (select *, {_PLACE} as place from (select query_id, unit_id, round(sum(case when hi > lo then (score - lo) / (hi - lo) else 0 end * weight), 6) as score from (
  select *, min(score) over (partition by query_id, l) as lo, max(score) over (partition by query_id, l) as hi from ({_BOTH})) group by 1, 2)) where place <= 20""",
    "scoped_units": f"with {_UNITS} select source, count(*) as n from unit where unit_id in (select in_id from mentions) group by 1",
    "freshness": f"with {_UNITS} select unit_id, case when at_ is not null then round(pow(0.5, greatest((epoch_us(timestamp '{NOW}') - epoch_us(at_)) / 86400e6, 0) / 30), 6) end as weight from unit",
    "diverse_top": _BM25
    + """select query_id, unit_id, score, row_number() over (partition by query_id order by place)::int as place from (
  select found.*, row_number() over (partition by query_id, source order by place) as i from found join unit using (unit_id) where place <= 30 and score >= 1) where i <= 2""",
    "budget_top": _BM25 + "select * from (select query_id, unit_id, score, place, (sum(length(text)) over (partition by query_id order by place))::bigint as used from found join unit using (unit_id) where place <= 30) where used <= 500",
    "neighbours": "select distinct a.doc_id::varchar as query_id, b.doc_id as unit_id from documents a join documents b on a.bitext_id = b.bitext_id and b.seg_no between a.seg_no - 2 and a.seg_no + 2",
    "evaluation": _BM25
    + """, relevant as (select distinct query_id, unit_id from ask, unit where unit.text like '%repair%' or unit.text like '%signal box%'),
per as (select query_id, count(*) as wanted, count(place) as found, min(place) as first, coalesce(sum(1 / log2(place + 1)), 0) as gain from relevant left join (select * from found where place <= 10) using (query_id, unit_id) group by 1)
select query_id, round(found / wanted, 6) as recall, round(found / 10, 6) as precision, round(coalesce(1 / first, 0), 6) as reciprocal_rank, round(gain / (select sum(1 / log2(i + 1)) from range(1, 11) t(i) where i <= wanted), 6) as ndcg from per""",
    "stable_ids": "select id, md5(case when number is null then '-' else length(number) || ':' || number end || ';' || case when status is null then '-' else length(status) || ':' || status end) as stable_id from document",
    "content_duplicates": "select md5(text) as content_hash, count(*) as n, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1",
    "document_versions": f"with {_VERSIONS} select unit_id, max(version) as version from v where version is not null group by 1",
    "superseded_versions": f"with {_VERSIONS} select distinct unit_id, version from v where version < timestamp '2025-01-01' and version < (select max(version) from v w where w.unit_id = v.unit_id) and unit_id not like '%7'",
    "provenance": f"""with {_EDGES}, two as (select a.unit_id, b.origin_id from edge a join edge b on a.origin_id = b.unit_id)
select unit_id, origin_id, min(hops)::int as hops from (select *, 1 as hops from edge union all select *, 2 from two union all select a.unit_id, b.origin_id, 3 from two a join edge b on a.origin_id = b.unit_id) group by 1, 2""",
    "quote_check": f"""with {_UNITS},
citation as (
  select unit_id as citation_id, case when unit_id like '%5' then 'news:lost' else unit_id end as unit_id, case when unit_id like '%1' then substr(text, 5, 10) else 'no such words' end as quote,
    case when unit_id like '%3' then '0' when unit_id like '%1' then md5(text) end as text_hash from unit)
select citation_id, unit_id, case when unit.text is null then 'unit_missing' when text_hash <> md5(unit.text) then 'unit_changed' when contains(unit.text, quote) then 'verified' else 'quote_missing' end as status
from citation left join unit using (unit_id)""",
    "figure_check": "select o_orderpriority, count_if(o_orderstatus <> 'P')::bigint as claimed, nullif(count_if(o_orderstatus <> 'P' or o_orderpriority like '1%'), 0)::bigint as actual, case when claimed = actual then 'verified' else 'differs' end as status from orders group by 1",
    "undelivered": "select distinct in_id as run_id, out_id as unit_id from mentions m where not exists (select 1 from mentions n where n.out_id not like '%17' and n.in_id = m.in_id and n.out_id = m.out_id)",
    "mixed_embeddings": "select label as type, count(distinct c) as configurations from (select label, len(embedding) as c from embeddings union all select label, 0 from embeddings where label = 1) group by 1 having count(distinct c) > 1",
    "text_chunks": "select doc_id as unit_id, (i / 180)::int as chunk_no, i::int as start_char, substr(text, i::int + 1, 200) as chunk from documents, range(0, 1000000, 180) t(i) where length(text) > 0 and i <= greatest(0, length(text) - 21)",
    "tool_use": "select event_type as tool, count(*) as calls, count(distinct user_id) as units, round(count_if(value > 50) / count(*), 6) as citation_rate, round(quantile_cont(value, 0.5), 6) as median_latency, round(quantile_cont(value, 0.95), 6) as p95_latency from events group by 1",
    "never_used": "select c_custkey as unit_id from customer where c_custkey not in (select user_id from events where user_id is not null)",
}
