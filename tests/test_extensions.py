import math
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from tamarack.operators import evidence, retrieval


def ranking(spark, rows):
    return spark.createDataFrame(rows, "query_id string, unit_id string, score double, place int")


def places(df):
    return {(r["query_id"], r["unit_id"], r["place"]) for r in df.collect()}


def test_bm25_prefers_rare_words_and_short_texts(spark):
    units = spark.createDataFrame([("a", "the pump"), ("b", "the pump and the long gate of the town"), ("c", "the the the"), ("d", None), ("e", "")], "unit_id string, text string")
    asked = spark.createDataFrame([("q", "PUMP the"), ("r", "nothing"), ("s", None)], "query_id string, text string")
    got = retrieval.bm25(units, asked, 2)
    assert places(got) == {("q", "a", 1), ("q", "b", 2)}
    assert retrieval.bm25(units.limit(0), asked, 2).count() == 0


def test_cosine(spark):
    units = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 2.0]), ("c", [0.0, 0.0]), ("d", None), ("e", [1.0])], "unit_id string, emb array<float>")
    got = {r["unit_id"]: round(r["score"], 6) for r in retrieval.cosine(units, [3, 0], 5).collect()}
    assert got == {"a": 1.0, "b": round(math.sqrt(0.5), 6)}


def test_fusion(spark):
    a = ranking(spark, [("q", "x", 9.0, 1), ("q", "y", 5.0, 2)])
    b = ranking(spark, [("q", "y", 1.0, 1)])
    none = ranking(spark, [])
    fused = retrieval.reciprocal_rank_fusion([a, b, none], 5)
    assert places(fused) == {("q", "y", 1), ("q", "x", 2)}
    assert {r["unit_id"]: r["score"] for r in fused.collect()}["y"] == pytest.approx(1 / 61 + 1 / 62)
    for scale in ("min-max", "z-score"):
        assert places(retrieval.linear_fusion([(a, 0.5), (b, 0.5), (none, 1.0)], 5, scale)) == {("q", "x", 1), ("q", "y", 2)}


def test_shaping_a_ranking(spark):
    r = ranking(spark, [("q", u, s, p) for p, (u, s) in enumerate([("a", 9.0), ("b", 8.0), ("c", 7.0), ("d", 1.0)], 1)])
    of = spark.createDataFrame([("a", "s", 1, 10), ("b", "s", 2, 20), ("c", "t", 1, 30), ("d", "t", 2, 5)], "unit_id string, source string, position int, size int")
    assert places(retrieval.diverse(r, of.select("unit_id", "source"), 1, 2.0)) == {("q", "a", 1), ("q", "c", 2)}
    assert {x["unit_id"] for x in retrieval.within_budget(r, of.select("unit_id", "size"), 59).collect()} == {"a", "b"}
    assert {x["unit_id"] for x in retrieval.with_neighbours(r.where("unit_id = 'a'"), of, 1).collect()} == {"a", "b"}
    assert {x["unit_id"] for x in retrieval.within_scope(r, of.where("source = 't'")).collect()} == {"c", "d"}


def test_evaluate(spark):
    r = ranking(spark, [("q", "x", 2.0, 1), ("q", "a", 1.0, 2)])
    relevant = spark.createDataFrame([("q", "a"), ("q", "a"), ("q", "b"), ("z", "a")], "query_id string, unit_id string")
    got = {e["query_id"]: e for e in retrieval.evaluate(r, relevant, 2).collect()}
    assert (got["q"]["recall"], got["q"]["precision"], got["q"]["reciprocal_rank"]) == (0.5, 0.5, 0.5)
    assert got["q"]["ndcg"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert tuple(got["z"])[1:] == (0, 0, 0, 0)


def test_freshness(spark):
    df = spark.createDataFrame([(dt(2025, 1, 1),), (dt(2025, 1, 31),), (dt(2026, 1, 1),), (None,)], "at timestamp_ntz")
    assert [r[0] for r in df.select(retrieval.freshness_weight(F.col("at"), F.lit(dt(2025, 1, 31)), 30)).collect()] == [0.5, 1.0, 1.0, None]


def test_stable_ids_do_not_run_together(spark):
    df = spark.createDataFrame([("a", "b"), ("ab", ""), ("ab", None), ("a;1:b", None), (None, None)], "x string, y string")
    assert df.select(evidence.stable_id(F.col("x"), F.col("y")).alias("i")).distinct().count() == 5


def test_versions(spark):
    v = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("a", 2, 2), ("b", 1, 9), ("a", 0, 9)], "unit_id string, version int, made_at int")
    assert {tuple(r)[:2] for r in evidence.current_versions(v).collect()} == {("a", 2), ("b", 1)}
    cited = spark.createDataFrame([("b", 1)], "unit_id string, version int")
    assert {tuple(r) for r in evidence.collectable_versions(v, cited, F.lit(5)).collect()} == {("a", 1)}


def test_origins_end_in_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", None), ("a", "b")], "unit_id string, origin_id string")
    got = {tuple(r) for r in evidence.origins(spark.createDataFrame([("a",)], "unit_id string"), edges, 9).collect()}
    assert got == {("a", "b", 1), ("a", "c", 2), ("a", "a", 3)}


def test_verifiers(spark):
    units = spark.createDataFrame([("a", "some text"), ("n", None)], "unit_id string, text string")
    c = spark.createDataFrame([(1, "a", "me te", None), (2, "a", "other", None), (3, "a", "some", "0"), (4, "x", "some", None), (5, "n", "q", None), (6, "a", None, None)], "citation_id int, unit_id string, quote string, text_hash string")
    assert {r["citation_id"]: r["status"] for r in evidence.verify_quotes(c, units).collect()} == {1: "verified", 2: "quote_missing", 3: "unit_changed", 4: "unit_missing", 5: "quote_missing", 6: "quote_missing"}
    claimed = spark.createDataFrame([("x", 3), ("y", 1), ("z", None)], "k string, claimed long")
    rows = spark.createDataFrame([("x", 1), ("x", 2), ("y", 2)], "k string, v int")
    assert {r["k"]: r["status"] for r in evidence.verify_figures(claimed, rows, ["k"], F.sum("v")).collect()} == {"x": "verified", "y": "differs", "z": "verified"}


def test_chunks(spark):
    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None), (4, "abc")], "unit_id int, text string")
    got = {(r["unit_id"], r["chunk_no"]): r["chunk"] for r in evidence.chunks(df, 4, 1).collect()}
    assert got == {(1, 0): "abcd", (1, 1): "defg", (1, 2): "ghij", (4, 0): "abc"}
    with pytest.raises(ValueError):
        evidence.chunks(df, 4, 4)


def test_fusion_without_any_list(spark):
    a = ranking(spark, [("q", "x", 9.0, 1)])
    for lists in ([], [None], [None, None]):
        assert retrieval.reciprocal_rank_fusion(lists, 5).count() == retrieval.linear_fusion([(r, 1.0) for r in lists], 5).count() == 0
    assert places(retrieval.reciprocal_rank_fusion([None, a], 5)) == places(retrieval.linear_fusion([(None, 0.9), (a, 0.1)], 5)) == {("q", "x", 1)}
    b = ranking(spark, [("q", "x", 1.0, 1), ("q", "y", 0.9999999, 2), ("q", "z", 0.0, 3)])
    assert places(retrieval.linear_fusion([(b, 1.0)], 2, digits=3)) == {("q", "x", 1), ("q", "y", 2)}


def test_stems(spark):
    cases = {"parties": "party", "movies": "movy", "eies": "eies", "gates": "gate", "goes": "goes", "trees": "trees", "pumps": "pump", "bus": "bus", "pass": "pass", "pump": "pump", "s": ""}
    df = spark.createDataFrame([(w,) for w in cases], "w string").select("w", retrieval.stemmed(F.col("w")).alias("s"))
    assert {r["w"]: r["s"] for r in df.collect()} == cases
    units = spark.createDataFrame([("a", "Pumps"), ("b", "gate")], "unit_id string, text string")
    asked = spark.createDataFrame([("q", "pump GATES"), ("r", None)], "query_id string, text string")
    assert places(retrieval.bm25(units, asked, 5)) == set()
    assert places(retrieval.bm25(units, asked, 5, stem=True)) == places(retrieval.bm25_each(units, asked, 5, stem=True)) == {("q", "a", 1), ("q", "b", 2)}


def test_current_versions_are_whole_rows(spark):
    v = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("a", 2, "y"), ("b", None, "z"), (None, 5, "w")], "unit_id string, version int, text string")
    assert {tuple(r) for r in evidence.current_versions(v).collect()} == {("a", 2, "y")}
    assert evidence.current_versions(v.limit(0)).count() == 0


def test_what_has_to_be_made_again(spark):
    uses = spark.createDataFrame([("u", "a", 1), ("u", "a", 1), ("v", "a", 2), ("w", "gone", 1), ("x", "a", None), ("y", None, 1)], "unit_id string, origin_id string, used int")
    now = spark.createDataFrame([("a", 2), ("b", None)], "unit_id string, version int")
    assert [tuple(r) for r in evidence.stale_dependents(uses, now).collect()] == [("u", "a", 1, 2)]
    status = {(r["unit_id"], r["status"]) for r in evidence.verify_derivations(uses, now).collect()}
    assert status == {("u", "origin_changed"), ("v", "verified"), ("w", "origin_missing"), ("x", "origin_changed"), ("y", "origin_missing")}


def test_existence_and_receipts(spark):
    cited = spark.createDataFrame([("c", "a"), ("c", "a"), ("d", "z"), ("e", None)], "citation_id string, unit_id string")
    units = spark.createDataFrame([("a", "text"), ("b", None)], "unit_id string, text string")
    assert sorted((r["citation_id"], r["status"]) for r in evidence.verify_existence(cited, units.unionAll(units)).collect()) == [("c", "verified"), ("c", "verified"), ("d", "unit_missing"), ("e", "unit_missing")]
    md5 = lambda s: __import__("hashlib").md5(s.encode()).hexdigest()
    receipts = spark.createDataFrame([("r", "a", md5("text")), ("s", "a", md5("old")), ("t", "b", md5("")), ("u", "z", md5("")), ("v", "a", None)], "receipt_id string, unit_id string, text_hash string")
    assert {(r["receipt_id"], r["status"]) for r in evidence.verify_receipts(receipts, units).collect()} == {("r", "verified"), ("s", "text_changed"), ("t", "verified"), ("u", "unit_missing"), ("v", "text_changed")}


def test_sections(spark):
    text = "Before.\n\n# One\n \nA\nb.\n\n  C.  \r\n\r\n2.1. Two\n\n\n3. not a\nheading"
    df = spark.createDataFrame([(1, text), (2, None), (3, " \n\n "), (4, "# Only")], "unit_id int, text string")
    got = sorted(tuple(r) for r in evidence.sections(df).collect())
    assert got == [(1, 0, None, "Before."), (1, 1, "# One", "A\nb."), (1, 2, "# One", "C."), (1, 3, "2.1. Two", "3. not a\nheading")]


def test_approximate_latencies(spark):
    events = spark.createDataFrame([("t", i, float(i), True) for i in range(1, 1001)], "tool string, unit_id int, latency double, cited boolean")
    r = evidence.use_by_tool(events, 1000).first()
    assert abs(r["median_latency"] - 500) <= 2 and abs(r["p95_latency"] - 950) <= 2
