import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tamarack.llm import packing
from tamarack.llm.packing import best_fit, fill_report, mixture_report, pack, windows


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=80))
def test_best_fit_places_everything_once_without_overlap(sizes):
    container, place, at = best_fit(sizes, 20)
    held = {}
    for i in sorted(range(len(sizes)), key=lambda i: (container[i], place[i])):
        used, n = held.get(container[i], (0, 0))
        assert (at[i], place[i]) == (used, n)
        held[container[i]] = (used + sizes[i], n + 1)
    assert all(used <= 20 for used, _ in held.values())
    assert len(held) <= max(1, 2 * sum(sizes) / 20 + 1)


def rows(spark, data):
    return spark.createDataFrame(data, "item long, source string, size long, _queue string, _hash int")


def check(packed, sizes, specs):
    by = {}
    for r in packed:
        assert r["capacity"] == specs[r["spec"]]
        by.setdefault((r["spec"], r["item"]), []).append(r)
    for spec, capacity in specs.items():
        for item, size in sizes.items():
            parts = sorted(by[spec, item], key=lambda r: r["part"])
            assert sum(r["tokens"] for r in parts) == (size or 0)
            assert [r["from_token"] for r in parts] == [i * capacity for i in range(len(parts))]
            assert len(parts) == max(1, -(-(size or 0) // capacity))
        ends = {}
        for r in sorted((r for r in packed if r["spec"] == spec and r["container"] is not None), key=lambda r: (r["container"], r["place"])):
            assert r["at_token"] == ends.get(r["container"], 0)
            ends[r["container"]] = r["at_token"] + r["tokens"]
        assert all(e <= capacity for e in ends.values())


def test_every_item_is_packed(spark):
    rng = random.Random(3)
    sizes = {i: rng.choice([0, 100, 101, 250, *range(1, 60)]) for i in range(3000)} | {9000: 4321, 9001: None}
    source = {i: "hot" if rng.random() < 0.4 else None if rng.random() < 0.1 else f"s{rng.randrange(200)}" for i in sizes}
    packed = pack(rows(spark, [(i, source[i], n, "q", 1) for i, n in sizes.items()]), {"a": 100, "b": 300}, window_containers=64)
    got = packed.collect()
    check(got, sizes, {"a": 100, "b": 300})
    assert all(r["container"] is None and r["tokens"] == 0 for r in got if not sizes[r["item"]])
    report = {r["spec"]: r for r in fill_report(packed).collect()}
    assert report["a"]["tokens"] == report["b"]["tokens"] == sum(n or 0 for n in sizes.values())
    assert max(r["unused_share"] for r in report.values()) < 0.02


def test_windows_hold_the_target_mixture(spark):
    data = [(i, "x" if i % 2 else "y", 10, "", 0) for i in range(4000)]
    for mixture, share in ((None, 0.5), ({"x": 0.75}, 0.75)):
        got = pack(rows(spark, data), {"a": 100}, mixture, window_containers=20).collect()
        total, x = {}, {}
        for r in got:
            total[r["window_no"]] = total.get(r["window_no"], 0) + r["tokens"]
            x[r["window_no"]] = x.get(r["window_no"], 0) + r["tokens"] * (r["item"] % 2)
        last_x = max(w for w in x if x[w])
        inner = [w for w in total if 0 < w < last_x]
        assert inner and all(abs(x[w] / total[w] - share) <= 0.02 and abs(total[w] - 2000) <= 20 for w in inner)


def test_many_small_sources_spread_over_windows(spark):
    got = pack(rows(spark, [(i, f"s{i}", 10, "", 0) for i in range(4000)]), {"a": 100}, window_containers=20).collect()
    total = {}
    for r in got:
        total[r["window_no"]] = total.get(r["window_no"], 0) + r["tokens"]
    assert len(total) >= 20 and max(total.values()) < 3000


def test_empty_and_wrong_input(spark):
    assert pack(rows(spark, []), {"a": 10}).count() == 0
    assert pack(rows(spark, [(1, "s", 5, "", 0)]), {}).count() == 0
    with pytest.raises(ValueError):
        pack(rows(spark, []), {"a": 0})
    with pytest.raises(ValueError):
        pack(rows(spark, [(1, "s", 5, "", 0)]), {"a": 10}, {"s": 1.5})


def test_repeated_rows_are_items_of_their_own(spark):
    got = pack(rows(spark, [(1, "s", 5, "", 0)] * 2), {"a": 10}).collect()
    assert sorted(r["at_token"] for r in got) == [0, 5]


def test_credit_is_carried_and_never_negative(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_ITEMS", 50)  # sums go over many chunks
    rng = random.Random(5)
    data = [(i, rng.choice(["x", "x", "y", "z", None]), rng.choice([0, 400, *range(1, 90)]), "", 0) for i in range(3000)]
    for mixture, temperature in ((None, 1.0), ({"x": 0.2, "": 0.3}, 0.5), ({"x": 0.5, "y": 0.5}, 1.0)):
        placed = windows(rows(spark, data), {"a": 100}, mixture, temperature, 20).cache()
        report = mixture_report(placed).collect()
        last = {}
        for r in sorted(report, key=lambda r: r["window_no"]):
            assert r["carried"] >= -0.001
            last[r["source"]] = r
        for source, r in last.items():
            assert sum(x["tokens"] for x in report if x["source"] == source) == sum(n for _, s, n, *_ in data if (s or "") == source)
            inner = [x for x in report if x["source"] == source and 0 < x["window_no"] < r["window_no"]]
            assert all(x["carried"] <= 100 + x["target"] for x in inner)  # what waits is less than an item
            assert all(abs(x["tokens"] - x["target"]) <= 100 for x in inner)
        got = pack(rows(spark, data), {"a": 100}, mixture, 20, temperature).where("tokens > 0").select("item", "part", "source", "window_no", "tokens")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, placed.select(got.columns).collect()))
    shares = {r["source"]: r["target"] / 2000 for r in report}
    assert shares["x"] == shares["y"] == 0.5 and min(r["window_no"] for r in report if r["source"] in ("z", "")) > max(r["window_no"] for r in report if r["source"] in ("x", "y"))


def test_temperature_lifts_small_sources(spark):
    placed = windows(rows(spark, [(i, "big" if i % 10 else "small", 10, "", 0) for i in range(9000)]), {"a": 100}, None, 0.5, 10)
    share = {r["source"]: r["target"] / 1000 for r in mixture_report(placed).collect()}
    assert abs(share["small"] - 0.25) < 1e-6 and abs(share["big"] - 0.75) < 1e-6
