from tamarack import Attr, Ontology, UnitType
from tamarack.streaming.watch import watch


def test_batches_are_judged_apart(spark, tmp_path):
    data, ontology = tmp_path / "in", Ontology([UnitType("event", "events", attrs=[Attr("kind", "string", ["a", "b"])])])
    run = lambda: watch(spark.readStream.schema("kind string").parquet(str(data)), "events", ontology, str(tmp_path / "out"), str(tmp_path / "checkpoint"), once=True).awaitTermination(120)
    for kinds in (["a", "b"], ["a", "z"]):
        spark.createDataFrame([(k,) for k in kinds], "kind string").coalesce(1).write.mode("append").parquet(str(data))
        assert run()
    got = {(r["batch"], r["code"], r["status"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(b, c, s) for b in (0, 1) for c, s in (("TBL-001", "PASS"), ("FLD-001", "PASS"))} | {(0, "ATTR-010", "PASS"), (1, "ATTR-010", "WARN")}
