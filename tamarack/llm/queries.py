"""Queries of this subpackage over the test tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamarack.functions.text import pointer_key, pointer_key_sql, strip_sql
from tamarack.llm.bpe import count_tokens, encode_corpus
from tamarack.llm.packing import fill_report, mixture_report, pack, windows
from tamarack.llm.sentences import split_sentences
from tamarack.llm.terms import term_frequency
from tamarack.llm.topn import top_n
from tamarack.llm.vectors import recall_against_all, similar_vectors, usable
from tamarack.operators.retrieval import cosine_each
from tamarack.sources.parquet import table

#: Similarity from which a pair of news records is a case.
CLOSE = 0.85
#: Shares of tokens that sources have while they last, and the power of their tokens in proportion to which the others share the rest of a report's windows.
MIXTURE, TEMPERATURE = {"minutes-main": 0.15}, 0.7
TERM_FIELDS = {"entity.kind": ("entity", "kind"), "document.status": ("document", "status")}


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Ten for every record with a usable vector."""
    return similar_vectors(table(spark, d, "news", "id", "emb", "loaded_at"), "id", "emb", "loaded_at", 10, 64)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = p1_neighbours(spark, d).where(F.col("similarity") >= CLOSE)
    return near.select(F.least("id", "similar_id").alias("id_a"), F.greatest("id", "similar_id").alias("id_b")).distinct()


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of ``p1_neighbours``, by brute force for every record whose number is divisible by 50, against all."""
    rows = table(spark, d, "news", "id", "emb", "loaded_at").where(F.col("id").isNotNull() & usable(F.col("emb"), 64))
    units = rows.groupBy(F.col("id").alias("unit_id")).agg(F.max_by("emb", F.struct("loaded_at", "emb")).alias("emb"))
    asked = units.where(F.regexp_extract("unit_id", "([0-9]+)$", 1).try_cast("bigint") % 50 == 0).select(F.col("unit_id").alias("query_id"), "emb")
    exact = cosine_each(units, asked, 11).where("unit_id <> query_id")  # one is the query itself
    exact = exact.withColumn("_i", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where("_i <= 10")
    return recall_against_all(p1_neighbours(spark, d), exact, 10)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t, "id", c).select(F.lit(field).alias("field_name"), "id", F.col(c).alias("value")) for field, (t, c) in TERM_FIELDS.items()]
    return term_frequency(parts[0].unionAll(parts[1]))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").select("field_name", "item")


def p4_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)


def p5_top(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mentions", "id", "in_id", "relevance", "loaded_at")
    top = top_n(rows, pointer_key(F.col("in_id"), "news"), "id", "relevance", "loaded_at", 3)
    return top.select(F.concat(F.lit("news:"), "group_key").alias("news_id"), F.col("item_id").alias("mention_id"), F.col("score").alias("relevance"), "place")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_top(spark, d).select("news_id", "mention_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def _specs(spark: SparkSession, d: str) -> dict[str, int]:
    return {r["spec"]: r["capacity"] for r in table(spark, d, "pack_spec", "spec", "capacity").collect()}  # a fixed few


def _packed(spark: SparkSession, d: str) -> DataFrame:
    counts = count_tokens(table(spark, d, "documents", "doc_id", "source", "text"), ["doc_id", "source"], "text")
    return pack(counts.withColumnsRenamed({"doc_id": "item", "n_tokens": "size"}), _specs(spark, d), MIXTURE)


def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("item", "doc_id")


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(_packed(spark, d))


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual tokens per window and source, and the credit carried on.

    Here a text's size is its length in characters, which SQL knows as well, and a window has 8 containers, so that there are many.
    """
    sizes = table(spark, d, "documents", "doc_id", "source", "n_chars").withColumnsRenamed({"doc_id": "item", "n_chars": "size"})
    return mixture_report(windows(sizes, _specs(spark, d), MIXTURE, TEMPERATURE, 8))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return split_sentences(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


_P1 = """
with v as (
  select id, emb::double[] as x from news where id is not null and len(emb) = 64
  and len(list_filter(emb, lambda y: y is not null and isfinite(y))) = 64 and len(list_filter(emb, lambda y: y <> 0)) > 0
  qualify row_number() over (partition by id order by loaded_at desc nulls last) = 1),
s as (select a.id as id, b.id as other, round(list_dot_product(a.x, b.x) / sqrt(list_dot_product(a.x, a.x) * list_dot_product(b.x, b.x)), 6) as s from v a join v b on a.id <> b.id),
t as (select *, row_number() over (partition by id order by s desc, other)::int as place from s qualify place <= 10)
"""

_P4 = f"""
with piece as (
  select 'entity.kind' as field_name, id, unnest(regexp_split_to_array(kind, '[;,/|]')) as x from entity
  union all select 'document.status', id, unnest(regexp_split_to_array(status, '[;,/|]')) from document),
term as (select field_name, id, lower({strip_sql('x')}) as item from piece where {strip_sql('x')} <> ''),
total as (select field_name, count(distinct id) as total from term group by 1),
counted as (
  select field_name, item, count(*) as occurrences, count(distinct id) as records from term group by 1, 2)
select field_name, item, occurrences, records, case when records < 3 then 'too rare' when records * 10 > total * 4 then 'too common' end as mark
from counted join total using (field_name)"""

_P5 = f"""
with last as (
  select id, {pointer_key_sql('in_id', 'news')} as key, case when not isnan(relevance) then relevance end as relevance from mentions where id is not null
  qualify row_number() over (partition by id order by loaded_at desc nulls last, case when not isnan(relevance) then relevance end desc nulls last) = 1)
select 'news:' || key as news_id, id as mention_id, relevance, row_number() over (partition by key order by relevance desc, id)::int as place
from last where key is not null and relevance is not null qualify place <= 3"""

_P7 = f"""
with item as (select doc_id as item, coalesce(source, '') as q, n_chars as size, ('0x' || substr(md5(doc_id::varchar), 1, 15))::bigint as h from documents where n_chars > 0),
queued as (select *, sum(size) over (partition by q order by h, item rows unbounded preceding) - size as start from item),
queue as (select q, sum(size)::double as total, max(size) as most, (('0x' || substr(md5(q), 1, 15))::bigint % 1048576) / 1048576.0::double as begins from item group by 1),
share as (select q, most, begins, case when q = 'minutes-main' then 0.15::double else pow(total, {TEMPERATURE}) * ({1 - 0.15!r}::double / (select sum(pow(total, {TEMPERATURE})) from queue where q <> 'minutes-main')) end as share from queue),
part as (
  select spec, capacity, q, start + part * capacity as before, least(capacity, size - part * capacity) as tokens, share * (capacity * 8.0::double) as quantum, begins * least(capacity, most) as credit
  from (select *, unnest(range(0, (size - 1) // capacity + 1)) as part from queued, pack_spec) join share using (q)),
sent as (select spec, greatest(ceil((before + tokens - credit) / quantum) - 1, 0)::bigint as window_no, q as source, quantum, credit, sum(tokens)::bigint as tokens from part group by all)
select spec, window_no, source, round(quantum, 3) as target, tokens,
  round(credit + (window_no + 1) * quantum - sum(tokens) over (partition by spec, source order by window_no rows unbounded preceding), 3) as carried from sent"""

SQL = {
    "p7_mixture": _P7,
    "p1_found": _P1 + "select distinct least(id, other) as id_a, greatest(id, other) as id_b from t where s >= 0.85",
    "p1_neighbours": _P1 + "select id, other as similar_id, s as similarity, place from t",
    "p4_terms": _P4,
    "p4_found": f"select field_name, item from ({_P4}) where mark is not null",
    "p5_top": _P5,
    "p5_found": f"select news_id, mention_id from ({_P5})",
}

QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p1_recall": p1_recall, "p4_found": p4_found, "p4_terms": p4_terms, "p5_found": p5_found, "p5_top": p5_top, "p6_ids": p6_ids, "p7_packed": p7_packed, "p7_fill": p7_fill, "p7_mixture": p7_mixture, "p8_found": p8_found}
