import pytest
from pyspark.sql import functions as F

from tamarack.functions.text import pointer_key, pointer_key_sql

CASES = {
    "news:a": "a", " NEWS:a\t": "a", "news:⟨a⟩": "a", "news:`a`": "a", "news:⟨`a`⟩": "`a`", "news:`⟨a⟩`": "⟨a⟩", "news:``a``": "`a`", "news:⟨": "⟨", "news: a": " a", "news:a:b": "a:b", "news:a\nb": "a\nb", "news:⟨ ⟩": " ",
    "news:": None, "news:⟨⟩": None, "news:``": None, " news: ": None, "new:a": None, "a\nnews:b": None, "news :a": None, "news": None, "": None, ":a": None,
}


def test_keys_of_pointers(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "p string").select("p", pointer_key(F.col("p"), "news").alias("key"))
    assert {r["p"]: r["key"] for r in df.collect()} == CASES


@pytest.mark.parametrize("pointer", CASES)
def test_the_twin_reads_pointers_alike(pointer):
    import duckdb

    assert duckdb.execute(f"select {pointer_key_sql('p', 'news')} from (select ?::varchar as p)", [pointer]).fetchone()[0] == CASES[pointer]
