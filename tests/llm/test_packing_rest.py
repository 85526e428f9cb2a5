from tamarack.llm.packing import pack


def test_sources_beside_a_whole_mixture_come_after_it(spark):
    source = ["x", "y", "z", None]
    sizes = spark.createDataFrame([(i, source[i % 4], 10) for i in range(4000)], "item long, source string, size long")
    for mixture in ({"x": 0.75, "y": 0.25}, {"x": 0.7, "y": 0.1, "lost": 0.1, "gone": 0.1}):
        got = pack(sizes, {"a": 100, "b": 30}, mixture, 10).collect()
        assert sorted((r["spec"], r["item"]) for r in got) == sorted((s, i) for s in "ab" for i in range(4000))
        for spec in "ab":
            windows = {named: [r["window_no"] for r in got if r["spec"] == spec and (r["item"] % 4 < 2) == named] for named in (True, False)}
            assert 0 <= min(windows[True]) and max(windows[True]) < min(windows[False])
