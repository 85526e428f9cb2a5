"""The whole job over all rows, where a part of them would look the same on small tables."""

import math
import random
from datetime import datetime

import pytest

from tamarack.operators import retrieval
from tamarack.plans import extension_queries, facts
from tamarack.sources.catalog import from_frames


def test_edge_ends_of_all_rows(spark):
    rows = [(None, f"entity:{i}") for i in range(300)] + [(f"news:{i}", f"entity:{i}") for i in range(300)] + [("entity:1", "news:1"), ("news:1", None)]
    for a, b in facts.ENDS:
        edges = from_frames({"edge": spark.createDataFrame(rows, f"`{a}` string, `{b}` string")}).tables["edge"]
        got = {tuple(r) for r in facts.edge_ends(edges).collect()}
        assert got == {("None", "entity"), ("news", "entity"), ("entity", "news"), ("news", "None")}


def test_neighbours_of_every_document(spark, tmp_path):
    rows = [(i, i % 3, i // 3 * (2 if i % 2 else 1)) for i in range(90)] + [(90, None, 1), (91, 1, None)]
    spark.createDataFrame(rows, "doc_id long, bitext_id int, seg_no int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in extension_queries.neighbours(spark, str(tmp_path)).collect()]
    near = {(str(a), b) for a, s, i in rows for b, t, j in rows if None not in (s, t, i, j) and s == t and abs(i - j) <= 2}
    assert len(got) == len(near) and set(got) == near


def test_bm25_each_is_bm25(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "UNITS", 16)
    monkeypatch.setattr(retrieval, "QUERIES", 4)
    rnd = random.Random(1)
    texts = [" ".join(rnd.choices("a b c d e The the pump".split(), k=rnd.randint(0, 9))) for _ in range(60)]
    units = spark.createDataFrame([*enumerate(texts), (60, None), (61, texts[0]), (62, texts[0])], "unit_id int, text string")
    queries = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts[:9])] + [("x", "unknown"), ("y", None)], "query_id string, text string")
    want = retrieval.ranked(retrieval.bm25(units, queries, 99).selectExpr("query_id", "unit_id", "round(score, 6) score"), 5)
    assert {tuple(r) for r in retrieval.bm25_each(units, queries, 5, 6).collect()} == {tuple(r) for r in want.collect()}
    assert retrieval.bm25_each(units.limit(0), queries, 5).count() == retrieval.bm25_each(units, queries.limit(0), 5).count() == 0


def test_cosine_each_is_cosine(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "UNITS", 16)
    monkeypatch.setattr(retrieval, "QUERIES", 2)
    monkeypatch.setattr(retrieval, "AT_ONCE", 1)
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(3)]) for i in range(60)]
    rows += [(60 + i, rows[i % 2][1]) for i in range(9)] + [(70, None), (71, [0.0] * 3), (72, [1.0]), (73, [1.0, None, 1.0]), (74, [math.nan, 1.0, 1.0])]
    units = spark.createDataFrame(rows, "unit_id int, emb array<float>")
    queries = units.where("unit_id < 5 or unit_id > 69").selectExpr("string(unit_id) query_id", "emb")
    got = [tuple(r) for r in retrieval.cosine_each(units, queries, 4).collect()]
    plain = units.where("unit_id <> 74")
    want = [tuple(r) for i in (0, 1, 2, 3, 4, 72) for r in retrieval.cosine(plain, plain.where(f"unit_id = {i}").first()["emb"], 4, str(i)).collect()]
    close = lambda rows: {(q, u, round(s, 12), p) for q, u, s, p in rows}
    assert len(got) == len(want) and close(got) == close(want)


def test_evaluate_common_is_evaluate(spark):
    ranking = spark.createDataFrame([("q", "x", 2.0, 1), ("q", "a", 1.0, 2), ("r", "b", 1.0, 1)], "query_id string, unit_id string, score double, place int")
    queries, good = spark.createDataFrame([("q",), ("r",), ("z",)], "query_id string"), spark.createDataFrame([("a",), ("a",), ("b",)], "unit_id string")
    want = retrieval.evaluate(ranking, queries.crossJoin(good), 2)
    assert {tuple(r) for r in retrieval.evaluate_common(ranking, queries, good, 2).collect()} == {tuple(r) for r in want.collect()}
    assert retrieval.evaluate_common(ranking, queries, good.limit(0), 2).count() == 0


@pytest.mark.parametrize("name", ["bm25_top", "cosine_top", "rank_fusion", "score_fusion", "diverse_top", "budget_top", "evaluation"])
def test_every_fiftieth_record_is_a_query(spark, tmp_path, name):
    news = [(f"news:n{i:05}", f"The repair of weir {i} and pump {i % 7}", f"feed:{i % 5}", datetime(2025, 1, 1 + i % 28), None) for i in range(201)]
    spark.createDataFrame(news, "id string, body string, feed string, published_at timestamp_ntz, loaded_at timestamp_ntz").write.parquet(f"{tmp_path}/news.parquet")
    spark.createDataFrame([(i, [1.0, float(i)]) for i in range(201)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["query_id"] for r in extension_queries.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {str(i) if name == "cosine_top" else f"news:n{i:05}" for i in range(0, 201, 50)}


def test_undelivered_takes_all_citations(spark, tmp_path):
    rows = [("news:1", "entity:17"), ("news:1", "entity:17"), ("news:1", "entity:7"), ("news:2", "entity:8"), ("news:3", None)]
    spark.createDataFrame(rows, "in_id string, out_id string").write.parquet(f"{tmp_path}/mentions.parquet")
    got = {tuple(r) for r in extension_queries.undelivered(spark, str(tmp_path)).collect()}
    assert got == {("news:1", "entity:17"), ("news:3", None)}


def test_samples_of_several_fields_in_one_pass_are_the_samples_of_each(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(50) if i % 9 else None, rnd.choice(["a", "b", None, f"v{i}"]), None if i % 3 else f"w{i % 7}", f'{{"k": "{i % 5}"}}' if i % 2 else None) for i in range(900)]
    t = from_frames({"t": spark.createDataFrame(rows, "n int, x string, y string, props string").repartition(7)}, "DEFINE TABLE t SCHEMALESS", payloads={"t": "props"}).tables["t"]
    for order in (["n"], [], ["lost", "x"]):
        got: dict[str, list] = {"x": [], "y": [], "k": []}
        for r in facts.samples(t, list(got), 40, order).collect():
            got[r["field"]].append(r["value"])
        assert {f: sorted(v) for f, v in got.items()} == {f: sorted(r["value"] for r in facts.sample(t, f, 40, order).collect()) for f in got}


def test_a_measurement_that_fails_is_kept_and_made_alone(spark):
    from pyspark.sql import functions as F

    from tamarack.ontology import Attr, Ontology, UnitType
    from tamarack.operators.conformance import needs

    broken = spark.range(3).select(F.col("id"), F.raise_error(F.lit("unreadable")).cast("string").alias("x"), F.lit("a").alias("y"))
    ontology = Ontology([UnitType("u", "t", attrs=[Attr("x", "string", ["a"]), Attr("y", "string", ["a"])])])
    catalog = from_frames({"t": broken}, "DEFINE TABLE t SCHEMALESS")
    measured = facts.Facts(catalog)
    measured.prefetch(needs(ontology, catalog))
    assert "unreadable" in str(measured.failed["t"]) and measured.values("t", "y", []) == ["a"] * 3
    with pytest.raises(Exception, match="unreadable"):
        measured.values("t", "x", [])
