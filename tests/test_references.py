from datetime import datetime as dt

from tamarack.operators import references
from tamarack.operators.references import orphan_references, orphan_report

SIDES = {"in": ("in_id", "news"), "out": ("out_id", "entity")}


def judge(spark, mentions, news=(), entity=(), removal=()):
    m = spark.createDataFrame(mentions, "id string, in_id string, out_id string, loaded_at timestamp_ntz, _key string")
    p = {"news": spark.createDataFrame(list(news), "id string, loaded_at timestamp_ntz, _at int"), "entity": spark.createDataFrame(list(entity), "id string, loaded_at timestamp_ntz, _at int")}
    return orphan_references(m, SIDES, p, spark.createDataFrame(list(removal), "record_id string, removed_at timestamp_ntz"))


def reasons(df):
    return {(r["reference_id"], r["side"]): r["reason"] for r in df.collect()}


def test_missing_removed_late_and_unreadable(spark):
    day = lambda n: dt(2024, 1, n)
    mentions = [
        ("m1", "news:a", "entity:x", day(5), ""), ("m2", " NEWS:`a`\t", "entity:⟨x⟩ ", day(5), ""), ("m3", "news:none", "entity:gone", day(5), ""),
        ("m4", "entity:x", "x", day(5), ""), ("m5", "news:late", None, day(5), ""), ("m5", "news:late", None, day(20), ""), ("m6", "news:back", "entity:X", day(5), ""), ("m7", None, "entity:`", day(5), ""),
    ]
    news = [("news:a", day(1), 0), ("news:late", day(9), 0), ("news:back", day(1), 0), ("news:back", day(8), 0), (None, day(1), 0)]
    entity = [("entity:x", day(1), 0), ("entity:gone", day(1), 0)]
    removal = [("entity:gone", day(2)), ("entity:gone", day(2)), ("news:back", day(4)), (None, day(4)), ("news:a", None)]
    df = judge(spark, mentions, news, entity, removal)
    assert reasons(df) == {
        ("m3", "in"): "missing", ("m3", "out"): "removed", ("m4", "in"): "unreadable", ("m4", "out"): "unreadable", ("m5", "in"): "late", ("m6", "out"): "missing", ("m7", "out"): "missing",
    }
    assert {(r["table"], r["month"], r["reason"], r["n"]) for r in orphan_report(df).collect() if r["table"] == "news"} == {("news", "2024-01", "missing", 1), ("news", "2024-01", "unreadable", 1), ("news", "2024-01", "late", 1)}


def test_first_load_of_a_reference_counts_for_each_of_its_pointers(spark):
    mentions = [("m", "news:a", None, dt(2024, 1, 1), ""), ("m", "news:b", None, dt(2024, 1, 9), "")]
    news = [("news:a", dt(2023, 1, 1), 0), ("news:b", dt(2024, 1, 5), 0)]
    assert reasons(judge(spark, mentions, news)) == {("m", "in"): "late"}


def test_null_ids_and_times(spark):
    mentions = [(None, "news:a", "entity:q", None, None), (None, "news:zz", None, dt(2024, 1, 1), None)]
    assert reasons(judge(spark, mentions, [("news:a", None, None)], (), [("news:a", dt(2024, 1, 1))])) == {(None, "in"): "missing", (None, "out"): "missing"}


def test_empty_tables(spark):
    assert judge(spark, []).count() == 0
    assert orphan_report(judge(spark, [])).count() == 0


def test_heavy_keys_and_pointers_of_one_reference(spark, monkeypatch):
    """A third of all mentions point to one record, another third is one mention delivered with ever other pointers."""
    monkeypatch.setattr(references, "LIGHT", 100)
    day = lambda n: dt(2024, 1, n)
    mentions = [(f"m{i}", "news:hot", None, day(5), "") for i in range(2000)] + [("many", f"news:{i}", None, day(2 + i % 9), "") for i in range(2000)] + [(f"x{i}", f"news:{i}", None, day(5), "") for i in range(2000)]
    news = [("news:hot", day(1), 0)] + [(f"news:{i}", day(1 if i < 1500 else 20), 0) for i in range(1990)]
    df = judge(spark, mentions, news)
    assert reasons(df) == {(f"x{i}", "in"): "late" for i in range(1500, 1990)} | {(f"x{i}", "in"): "missing" for i in range(1990, 2000)} | {("many", "in"): "missing"}
    assert judge(spark, [("m", "news:a", "entity:b", day(5), "")] * 5).count() == 2


def test_the_first_of_several_reasons_stands(spark):
    day = lambda n: dt(2024, 1, n)
    mentions = [("m", p, None, day(5), "") for p in ("news:late", "news:none", "news:gone")] + [("n", p, None, day(5), "") for p in ("news:late", "news:gone", "news:a")] + [("o", "news:late", None, day(5), ""), ("o", "lost", None, day(9), "")]
    news = [("news:late", day(9), 0), ("news:gone", day(1), 0), ("news:a", day(1), 0)]
    assert reasons(judge(spark, mentions, news, (), [("news:gone", day(2))])) == {("m", "in"): "missing", ("n", "in"): "removed", ("o", "in"): "unreadable"}
