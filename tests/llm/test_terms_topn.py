import math
import random
from datetime import datetime as dt

from pyspark.sql import functions as F

from tamarack.llm.terms import places_of, term_bitmaps, term_frequency
from tamarack.llm.topn import top_n

VALUES = "field_name string, id string, value string, item string, bucket int, _n int"


def test_terms_against_brute_force(spark):
    rng = random.Random(1)
    data = [("f", f"r{rng.randrange(400)}", rng.choice(["a", "A ; b", "c,d/e|", " ", None, ";;", f"Z{rng.randrange(300)}", "b ", "b; b"]), "x", 1, 1) for _ in range(3000)]
    data += [("f", "hot", "a", "", 0, 0)] * 1500 + [("g", None, "only", "", 0, 0)]
    occurrences, records, any_term = {}, {}, {}
    for field, i, v, *_ in data:
        for piece in (p.strip().lower() for s in [v or ""] for p in s.replace(",", ";").replace("/", ";").replace("|", ";").split(";")):
            if piece:
                occurrences[field, piece] = occurrences.get((field, piece), 0) + 1
                records.setdefault((field, piece), set()).update({i} - {None})
                any_term.setdefault(field, set()).update({i} - {None})
    got = {(r["field_name"], r["item"]): (r["occurrences"], r["records"], r["mark"]) for r in term_frequency(spark.createDataFrame(data, VALUES)).collect()}
    expected = {}
    for k, n in occurrences.items():
        d = len(records[k])
        expected[k] = (n, d, "too rare" if d < 3 else "too common" if d > 0.4 * len(any_term[k[0]]) else None)
    assert got == expected


def test_containers_are_compressed_and_hold_each_record_once(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("f").alias("field_name"), F.concat(F.lit("r"), "id").alias("id"), F.when(F.col("id") % 1000 == 0, "a;b").otherwise("a").alias("value"), F.lit("").alias("item"))
    rows = term_bitmaps(df.unionAll(df)).collect()
    by_item = {i: [r for r in rows if r["item"] == i] for i in ("a", "b", None)}
    for item, records in (("a", n), ("b", 200), (None, n)):
        assert sum(r["cardinality"] for r in by_item[item]) == records
        assert len({r["block"] for r in by_item[item]}) == len(by_item[item])
        for r in by_item[item]:
            places = places_of(r["container"])
            assert len(places) == r["cardinality"] and (len(places) < 2 or (places[1:] > places[:-1]).all())
    assert sum(len(r["container"]) for r in by_item["b"]) <= 2 * 200 + len(by_item["b"])
    assert all(len(r["container"]) <= 8193 for r in rows)


def test_container_of_any_number_of_places():
    import numpy as np

    from tamarack.llm.terms import BLOCK, LISTED, container_of

    for places in (np.arange(0), np.array([7]), np.arange(LISTED) * 3, np.arange(LISTED + 1) * 5, np.arange(BLOCK)):
        assert (places_of(container_of(places)) == places).all()


def test_terms_of_empty_table(spark):
    assert term_frequency(spark.createDataFrame([], VALUES)).count() == 0
    assert term_frequency(spark.createDataFrame([("f", "1", None, "", 0, 0), ("f", "2", " ; ", "", 0, 0)], VALUES)).count() == 0


ROWS = "id string, g string, s double, at timestamp_ntz, _part int, place int"


def test_top_n_against_brute_force(spark):
    rng = random.Random(2)
    score = lambda: rng.choice([None, float("nan"), 0.0, -0.0, math.inf, -math.inf, 0.5, 0.5, 0.5, rng.random()])
    data = [(f"m{rng.randrange(4000):05d}", "hot" if rng.random() < 0.35 else None if rng.random() < 0.05 else f"g{rng.randrange(300)}", score(), None if rng.random() < 0.1 else dt(2024, 1, rng.randrange(1, 29)), 0, 0) for _ in range(5000)]
    clean = lambda s: None if s is None or s != s else s
    last = {}
    for i, g, s, at, *_ in data:
        key = (at is not None, at or dt.min, clean(s) is not None, clean(s) or 0.0, g is not None, g or "")
        if i not in last or key > last[i][0]:
            last[i] = (key, g, clean(s))
    groups = {}
    for i, (_, g, s) in last.items():
        if g is not None and s is not None:
            groups.setdefault(g, []).append((-s, i))
    expected = {(g, i, k + 1) for g, v in groups.items() for k, (_, i) in enumerate(sorted(v)[:3])}
    got = top_n(spark.createDataFrame(data, ROWS), F.col("g"), "id", "s", "at", 3)
    assert {(r["group_key"], r["item_id"], r["place"]) for r in got.collect()} == expected


def test_top_n_of_empty_and_null_rows(spark):
    assert top_n(spark.createDataFrame([], ROWS), F.col("g"), "id", "s", "at", 3).count() == 0
    assert top_n(spark.createDataFrame([(None, "g", 1.0, None, 0, 0), ("a", "g", None, None, 0, 0)], ROWS), F.col("g"), "id", "s", "at", 3).count() == 0


def test_partition_passes_on_its_best_in_bounded_memory(monkeypatch):
    import pyarrow as pa

    from tamarack.llm import topn

    monkeypatch.setattr(topn, "HELD_ROWS", 50)
    rng = random.Random(3)
    rows = [(rng.choice("aab") if rng.random() < 0.5 else f"g{rng.randrange(40)}", f"m{i:04d}", rng.choice([0.5, rng.random()])) for i in range(2000)]
    batches = [pa.RecordBatch.from_pylist([{"_group": g, "_item": i, "_score": s} for g, i, s in rows[a : a + 70]]) for a in range(0, 2000, 70)]
    out = [r for b in topn._local(3)(iter(batches)) for r in b.to_pylist()]
    for g in {g for g, _, _ in rows}:
        best = sorted((-s, i) for h, i, s in rows if h == g)[:3]
        kept = sorted((-r["_score"], r["_item"]) for r in out if r["_group"] == g)
        assert kept[: len(best)] == best
        for r in out:
            if r["_group"] == g and r["_nth"]:
                assert (-r["_score"], r["_item"]) >= best[2]
    assert len(out) < len(rows)
