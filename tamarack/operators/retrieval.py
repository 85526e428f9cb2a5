"""Search over declared units, and how good it is: extensions of the conformance engine.

All operators take and give DataFrames. They stay in built-in expressions, except for searches by
many queries, ``bm25_each`` and ``cosine_each``: there blocks of units meet blocks of queries in
Arrow batches. Ranked lists have ``(query_id, unit_id, score, place)``; places start at 1 and ties
go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.plans.scale import salt, ship_code

#: Usual constants of BM25 and of reciprocal rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60
#: Units and queries in a block, and the queries of a block that are compared at once.
UNITS, QUERIES, AT_ONCE = 8192, 8192, 128


def tokens(text: Column, stem: bool = False) -> Column:
    """Lower-case words between white space, or their stems; none in null texts."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda t: t != "")
    return F.transform(words, stemmed) if stem else words


def stemmed(word: Column) -> Column:
    """An English word without the ending of a plural or third person: Harman's S stemmer, the first rule whose ending fits decides."""
    ends = lambda *endings: reduce(lambda a, b: a | b, [word.endswith(e) for e in endings])
    without = lambda n: F.left(word, F.char_length(word) - n)
    return (
        F.when(ends("ies"), F.when(ends("eies", "aies"), word).otherwise(F.concat(without(3), F.lit("y"))))
        .when(ends("es"), F.when(ends("aes", "ees", "oes"), word).otherwise(without(1)))
        .when(ends("s"), F.when(ends("us", "ss"), word).otherwise(without(1)))
        .otherwise(word)
    )


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query in ``scored(query_id, unit_id, score)``; null scores rank nowhere."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "unit_id")
    return scored.where("score is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "unit_id", "score", "place")


def bm25(units: DataFrame, queries: DataFrame, k: int, stem: bool = False) -> DataFrame:
    """Full-text search: ``units(unit_id, text)`` by the words of ``queries(query_id, text)``.

    Queries are few, as people ask them: their terms are joined to the postings before anything is
    counted per term, so only postings of asked terms are shuffled. Words are taken as they stand,
    or by their stems. Unknown words score nothing; a query without known words has no result.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text"), stem))).alias("term"))
    words = units.select("unit_id", tokens(F.col("text"), stem).alias("words"))
    n, mean = words.agg(F.count("*"), F.avg(F.size("words"))).first()
    hits = words.select("unit_id", F.size("words").alias("length"), F.explode("words").alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    postings = hits.groupBy("term", "unit_id", "length").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(float(mean or 1))))
    scored = asked.join(postings, "term").join(df, "term").select("query_id", "unit_id", (idf * weight).alias("score"))
    return ranked(scored.groupBy("query_id", "unit_id").agg(F.sum("score").alias("score")), k)


def _in_blocks(units: DataFrame, queries: DataFrame, search: Callable[[pa.Table, pa.Table], tuple[np.ndarray, np.ndarray, np.ndarray]], k: int, keys: Sequence[str] = ()) -> DataFrame:
    """The ``k`` best of each query, where every block of units meets every block of queries with the same ``keys``.

    ``search`` gets two blocks, the units by id, and gives positions of queries and of units and the
    scores, ``k`` a query at most.
    """
    ship_code(units.sparkSession)
    a, b = (max(1, math.ceil(df.count() / n)) for df, n in ((units, UNITS), (queries, QUERIES)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = units.select("*", salt(F.col("unit_id"), a).alias("_u")).select("*", each(b).alias("_q"))
    right = queries.select("*", salt(F.col("query_id"), b).alias("_q")).select("*", each(a).alias("_u"))

    def run(x: pa.Table, q: pa.Table) -> pa.Table:
        if not (x.num_rows and q.num_rows):
            return pa.table({"query_id": q["query_id"].slice(0, 0), "unit_id": x["unit_id"].slice(0, 0), "score": pa.array([], pa.float64())})
        x = x.take(pc.sort_indices(x, sort_keys=[("unit_id", "ascending")], null_placement="at_start"))
        i, j, score = search(x, q)
        return pa.table({"query_id": q["query_id"].take(pa.array(i)), "unit_id": x["unit_id"].take(pa.array(j)), "score": pa.array(score, pa.float64())})

    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("unit_id", units.schema["unit_id"].dataType), T.StructField("score", T.DoubleType())])
    by = ["_u", "_q", *keys]
    return ranked(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, schema), k)


def _flat(lists: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """Items of all lists, and how many each list has."""
    return pa.concat_arrays([c.flatten() for c in lists.chunks]), pc.list_value_length(lists).to_numpy()


def bm25_each(units: DataFrame, queries: DataFrame, k: int, digits: int = 9, stem: bool = False) -> DataFrame:
    """``bm25`` for many queries, whole texts among them, by scores of so many ``digits``.

    A block of units is an inverted file; a query adds up the weights of its words' postings there,
    and only its ``k`` best leave the block.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text"), stem))).alias("term"))
    words = units.select("unit_id", tokens(F.col("text"), stem).alias("words"))
    n, mean = words.agg(F.count("*"), F.avg(F.size("words"))).first()
    mean, ten = float(mean or 1), 10.0**digits
    df = words.select(F.explode(F.array_distinct("words")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    terms = asked.join(df, "term").select("query_id", F.struct("term", idf.alias("idf")).alias("t")).groupBy("query_id").agg(F.array_sort(F.collect_list("t")).alias("t"))

    def search(x: pa.Table, q: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, length = _flat(x["words"])
        of = flat.dictionary_encode()
        known = {t: i for i, t in enumerate(of.dictionary.to_pylist())}
        posting, tf = np.unique(of.indices.to_numpy().astype(np.int64) * len(length) + np.repeat(np.arange(len(length)), length), return_counts=True)
        row, start = posting % len(length), np.searchsorted(posting // len(length), np.arange(len(known) + 1))
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / mean))
        found = []
        for i, (ts, idfs) in enumerate(zip(q["term"].to_pylist(), q["idf"].to_pylist(), strict=True)):
            score = np.zeros(len(length))
            for t, w in zip(ts, idfs, strict=True):
                if (c := known.get(t)) is not None:
                    score[row[start[c] : start[c + 1]]] += w * weight[start[c] : start[c + 1]]
            hit = np.flatnonzero(score)
            score = np.floor(score[hit] * ten + 0.5) / ten
            if len(hit) > k:
                best = np.flatnonzero(score >= np.partition(score, len(hit) - k)[len(hit) - k])
                hit, score = hit[best], score[best]
            order = np.argsort(-score, kind="stable")[:k]
            found.append((np.full(len(order), i), hit[order], score[order]))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    return _in_blocks(words, terms.select("query_id", F.col("t.term").alias("term"), F.col("t.idf").alias("idf")), search, k)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(units: DataFrame, query: Sequence[float], k: int, query_id: str = "q") -> DataFrame:
    """Exact vector search of ``units(unit_id, emb)`` for one query vector; vectors of another length or of length 0 have no score."""
    q = F.array(*[F.lit(float(x)) for x in query])
    fits = (F.size("emb") == len(query)) & (_dot(F.col("emb"), F.col("emb")) > 0)
    score = F.when(fits, _dot(F.col("emb"), q) / F.sqrt(_dot(F.col("emb"), F.col("emb"))) / float(sum(x * x for x in query)) ** 0.5)
    best = units.select("unit_id", score.alias("score")).where("score is not null").orderBy(F.desc("score"), "unit_id").limit(k)
    return ranked(best.select(F.lit(query_id).alias("query_id"), "unit_id", "score"), k)


def cosine_each(units: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact vector search of ``units(unit_id, emb)`` for each of ``queries(query_id, emb)``.

    Vectors meet those of their own length; vectors of length 0 or with values that are no finite
    numbers have no score. A product of matrices finds the candidates, whose scores are then added up
    in the order of ``cosine``, so that equal vectors have equal scores.
    """
    usable = lambda df: df.withColumn("_dim", F.size("emb")).where((_dot(F.col("emb"), F.col("emb")) > 0) & (_dot(F.col("emb"), F.col("emb")) < float("inf")))

    def vectors(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x = _flat(rows["emb"])[0].to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)
        return x, np.sqrt(reduce(np.add, (c * c for c in x.T)))

    def search(x: pa.Table, q: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (x, x_size), (q, q_size), found = vectors(x), vectors(q), []
        unit = (x / x_size[:, None]).T
        for at in range(0, len(q), AT_ONCE):
            near = (q[at : at + AT_ONCE] / q_size[at : at + AT_ONCE, None]) @ unit
            least = max(len(x) - k, 0)
            i, j = np.nonzero(near >= np.partition(near, least, axis=1)[:, least, None] - 1e-9)
            i += at
            score = reduce(np.add, (q[i, d] * x[j, d] for d in range(x.shape[1]))) / x_size[j] / q_size[i]
            order = np.lexsort((j, -score, i))
            i, j, score = i[order], j[order], score[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            found.append((i[kept], j[kept], score[kept]))
        return tuple(map(np.concatenate, zip(*found, strict=True)))

    return _in_blocks(usable(units.select("unit_id", "emb")), usable(queries.select("query_id", "emb")), search, k, ["_dim"])


def _nothing(ranked_as: str = "query_id string, unit_id string, score double, place int") -> DataFrame:
    return SparkSession.active().createDataFrame([], ranked_as)


def reciprocal_rank_fusion(lists: Sequence[DataFrame | None], k: int, constant: int = RRF_K) -> DataFrame:
    """Ranked lists to one, by the sum of ``1 / (constant + place)``. A list that is missing (``None``) or empty is no error; without any, nothing is ranked."""
    there = [r.select("query_id", "unit_id", "place") for r in lists if r is not None]
    if not there:
        return _nothing()
    return ranked(reduce(DataFrame.unionByName, there).groupBy("query_id", "unit_id").agg(F.sum(F.lit(1.0) / (constant + F.col("place"))).alias("score")), k)


def linear_fusion(lists: Sequence[tuple[DataFrame | None, float]], k: int, scale: str = "min-max", digits: int | None = None) -> DataFrame:
    """Ranked lists to one, by weighted scores that are scaled per query and list: ``min-max`` or ``z-score``. Equal scores scale to 0.

    Lists may be missing, as above. With ``digits``, sums are rounded before they are ranked.
    """
    w = Window.partitionBy("query_id")
    score, parts = F.col("score"), []
    for ranking, weight in lists:
        if ranking is not None:
            low, span = (F.min(score).over(w), F.max(score).over(w) - F.min(score).over(w)) if scale == "min-max" else (F.avg(score).over(w), F.stddev_pop(score).over(w))
            parts.append(ranking.select("query_id", "unit_id", (F.when(span > 0, (score - low) / span).otherwise(0.0) * weight).alias("score")))
    if not parts:
        return _nothing()
    total = F.sum("score") if digits is None else F.round(F.sum("score"), digits)
    return ranked(reduce(DataFrame.unionByName, parts).groupBy("query_id", "unit_id").agg(total.alias("score")), k)


def within_scope(units: DataFrame, members: DataFrame) -> DataFrame:
    """Units that a scope holds, cut before ranking: a semi join on ``unit_id``."""
    return units.join(members, "unit_id", "left_semi")


def freshness_weight(at: Column, now: Column, half_life_days: float) -> Column:
    """1 for what is new, halved with each half-life; units from the future weigh 1, unknown times are null."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / F.lit(86_400e6)
    return F.pow(F.lit(0.5), F.when(age > 0, age).when(age <= 0, 0.0) / F.lit(float(half_life_days)))


def diverse(ranking: DataFrame, sources: DataFrame, per_source: int, least: float | None = None) -> DataFrame:
    """At most ``per_source`` units of one source per query, none below ``least``; places close up. ``sources`` has ``(unit_id, source)``."""
    kept = ranking if least is None else ranking.where(F.col("score") >= least)
    order = Window.partitionBy("query_id", "source").orderBy("place")
    kept = kept.join(sources, "unit_id").withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= per_source)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).select("query_id", "unit_id", "score", "place")


def within_budget(ranking: DataFrame, sizes: DataFrame, budget: int) -> DataFrame:
    """The best units per query whose running size stays within ``budget``. ``sizes`` has ``(unit_id, size)``."""
    order = Window.partitionBy("query_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return ranking.join(sizes, "unit_id").withColumn("used", F.sum("size").over(order)).where(F.col("used") <= budget).select("query_id", "unit_id", "score", "place", "used")


def with_neighbours(ranking: DataFrame, places: DataFrame, reach: int) -> DataFrame:
    """Found units and those up to ``reach`` before and after them in their source: ``(query_id, unit_id)``.

    ``places`` has ``(unit_id, source, position)`` with whole positions that count up.
    """
    near = ranking.select("query_id", "unit_id").join(places, "unit_id").select("query_id", "source", F.explode(F.expr(f"sequence(position - {reach}, position + {reach})")).alias("position"))
    return near.join(places, ["source", "position"]).select("query_id", "unit_id").distinct()


def evaluate(ranking: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query: recall, precision, reciprocal rank and nDCG at ``k``.

    ``relevant`` has ``(query_id, unit_id)``; queries without relevant units are not judged, queries
    without results score 0.
    """
    hits = relevant.distinct().withColumn("_r", F.lit(1)).join(ranking.where(F.col("place") <= k).select("query_id", "unit_id", "place"), ["query_id", "unit_id"], "left")
    per = hits.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("place").alias("found"), F.min("place").alias("first"), F.coalesce(F.sum(1 / F.log2(F.col("place") + 1.0)), F.lit(0.0)).alias("gain"))
    return _measures(per, k)


def _measures(per: DataFrame, k: int) -> DataFrame:
    ideal = F.aggregate(F.expr(f"sequence(1, least(cast(wanted as int), {k}))"), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return per.select("query_id", (F.col("found") / F.col("wanted")).alias("recall"), (F.col("found") / k).alias("precision"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), (F.col("gain") / ideal).alias("ndcg"))


def evaluate_common(ranking: DataFrame, queries: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``evaluate`` where ``relevant(unit_id)`` is the same for all ``queries(query_id)``, without a row for each pair."""
    good = relevant.select("unit_id").distinct()
    hits = ranking.where(F.col("place") <= k).join(good, "unit_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("found"), F.min("place").alias("first"), F.sum(1 / F.log2(F.col("place") + 1.0)).alias("gain"))
    per = queries.select("query_id").distinct().join(hits, "query_id", "left").crossJoin(F.broadcast(good.agg(F.count("*").alias("wanted")))).where("wanted > 0")
    return _measures(per.fillna(0, ["found"]).fillna(0.0, ["gain"]), k)
