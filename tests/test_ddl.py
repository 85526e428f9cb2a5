"""Statements are built from their parts, in any order that the grammar allows, and must be read back as those parts."""

import re

import pytest
from hypothesis import assume, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.sources.catalog import from_frames, type_name
from tamarack.sources.ddl import VECTOR_KINDS, core_type, field_def, index_def, is_safe_identifier, normalize_type, read_definitions, split_union, table_def

names = st.from_regex(r"[a-z_][a-z0-9_]{0,6}", fullmatch=True)
blanks = st.sampled_from(["", " ", "  ", "\n"])
quoted = st.sampled_from(["'TYPE ANY; | SCHEMAFULL'", '"IN x OUT y"', "''"])


def several(of, least=1):
    return st.lists(of, min_size=least, max_size=3, unique=True)


# -- tables
@st.composite
def tables(draw):
    """(statement, kind, in, out, schemafull)."""
    kind, ins, outs = draw(st.sampled_from(["normal", "any", "relation"])), draw(several(names)), draw(several(names))
    ends = draw(st.booleans())
    mark = draw(st.sampled_from(["", "`"]))
    pipe = draw(st.sampled_from(["|", " | ", " |"]))
    of_type = {"normal": draw(st.sampled_from(["", "TYPE NORMAL"])), "any": "TYPE ANY", "relation": "TYPE RELATION"}[kind]
    if kind == "relation" and ends:
        of_type += " IN " + pipe.join(mark + n + mark for n in ins) + " OUT " + pipe.join(mark + n + mark for n in outs)
    full = draw(st.booleans())
    others = [c for c in ("SCHEMAFULL" if full else "SCHEMALESS", "PERMISSIONS NONE", f"COMMENT {draw(quoted)}") if c == "SCHEMAFULL" or draw(st.booleans())]
    # names end at a keyword, so a clause may stand on either side of the type
    clauses = draw(st.permutations([of_type, *others]))
    return " ".join(["DEFINE TABLE t", *filter(None, clauses)]) + draw(st.sampled_from(["", ";"])), kind, ins if kind == "relation" and ends else [], outs if kind == "relation" and ends else [], full


@settings(max_examples=300, deadline=None)
@given(tables())
def test_tables_are_read_as_written(case):
    raw, kind, ins, outs, full = case
    assume("SCHEMAFULL" not in re.sub(r"'[^']*'|\"[^\"]*\"", "", raw) or full)
    t = table_def("t", raw)
    assert (t.kind, t.in_tables, t.out_tables) == (kind, ins, outs)
    assert t.schemafull or not full


@pytest.mark.parametrize("clause", ["IN a", "OUT b", "IN a OUT", "IN OUT b"])
def test_a_relation_with_one_end_is_no_relation(clause):
    assert table_def("t", f"DEFINE TABLE t TYPE RELATION {clause}").kind == "normal"


# -- types
leaves = st.sampled_from("string int float number bool datetime object decimal any uuid".split())
types_ = st.recursive(
    st.one_of(leaves, several(names).map(lambda n: ("record", tuple(n)))),
    lambda inner: st.one_of(inner.map(lambda t: ("array", t)), inner.map(lambda t: ("option", t)), st.lists(inner, min_size=2, max_size=3).map(lambda t: ("union", tuple(t)))),
    max_leaves=5,
)


def spell(t, blank):
    """A type as a server might print it, with blanks around its signs."""
    if isinstance(t, str):
        return t
    kind, of = t
    if kind == "union":
        return f"{blank}|{blank}".join(spell(x, blank) for x in of)
    return f"{kind}<{blank}" + (f"{blank}|{blank}".join(of) if kind == "record" else spell(of, blank)) + f"{blank}>"


@settings(max_examples=300, deadline=None)
@given(types_, blanks, st.booleans())
def test_blanks_case_and_order_make_no_difference(t, blank, upper):
    plain = spell(t, "")
    spelt = spell(t, blank)
    assert normalize_type(spelt.upper() if upper else spelt) == normalize_type(plain)
    assert normalize_type("|".join(reversed(split_union(plain)))) == normalize_type(plain)


@given(st.lists(types_.filter(lambda t: isinstance(t, str) or t[0] != "union"), min_size=1, max_size=4))
def test_members_of_a_union(members):
    spelt = [spell(t, "") for t in members]
    assert split_union("|".join(spelt)) == spelt
    if not any(m.startswith("option<") for m in spelt):
        assert normalize_type("|".join(spelt)) == "|".join(sorted(spelt))


@given(types_)
def test_an_option_is_none_or_its_type(t):
    plain = spell(t, "")
    assert normalize_type(f"option<{plain}>") == "|".join(sorted(["none", *split_union(plain)]))
    assert normalize_type(f"int|option<{plain}>") == "|".join(sorted(["int", "none", *split_union(plain)]))
    if len(split_union(plain)) == 1 and not plain.startswith("option<"):
        assert core_type(normalize_type(f"none|{plain}")) == plain


# -- fields
@settings(max_examples=200, deadline=None)
@given(types_, blanks, st.permutations(["DEFAULT now()", "ASSERT $value IN ['TYPE int', 'b']", "PERMISSIONS FULL", "READONLY", "COMMENT 'of TYPE x'", "FLEXIBLE"]), st.integers(0, 6), st.booleans())
def test_a_type_ends_at_the_next_clause(t, blank, clauses, n, flexible_first):
    raw = "DEFINE FIELD f ON t " + ("FLEXIBLE " if flexible_first else "") + f"TYPE {spell(t, blank)} " + " ".join(clauses[:n])
    assert field_def("f", raw).type == normalize_type(spell(t, ""))


def test_a_field_without_type():
    assert field_def("f", "DEFINE FIELD f ON t PERMISSIONS FULL COMMENT 'TYPE int'").type is None


# -- indexes
@settings(max_examples=300, deadline=None)
@given(st.sampled_from([*VECTOR_KINDS, "plain", "unique", "fulltext"]), several(names), st.integers(1, 4096), st.sampled_from(["COSINE", "EUCLIDEAN", "MANHATTAN", None]), names, st.data())
def test_indexes_are_read_as_written(kind, listed, dimension, dist, analyzer, data):
    mark, comma = data.draw(st.sampled_from(["", "`"])), data.draw(st.sampled_from([",", ", ", " , "]))
    fields = data.draw(st.sampled_from(["FIELDS", "COLUMNS"])) + " " + comma.join(mark + n + mark for n in listed)
    if kind in VECTOR_KINDS:
        options = data.draw(st.permutations([f"DIMENSION {dimension}", *([f"DIST {dist}"] if dist else []), "TYPE F32", "CAPACITY 40"]))
        clause = " ".join([kind.upper(), *options])
    else:
        clause = {"plain": "", "unique": "UNIQUE", "fulltext": data.draw(st.sampled_from(["FULLTEXT", "SEARCH"])) + f" ANALYZER {analyzer} BM25(1.2,0.75) HIGHLIGHTS"}[kind]
    index = index_def("i", f"DEFINE INDEX i ON t {fields} {clause} " + data.draw(st.sampled_from(["", "CONCURRENTLY", "COMMENT 'UNIQUE HNSW'"])))
    assert (index.kind, index.fields) == (kind, listed)
    assert (index.dimension, index.dist) == ((dimension, (dist or "euclidean").lower()) if kind in VECTOR_KINDS else (None, None))
    assert index.analyzer == (analyzer if kind == "fulltext" else None)


# -- names, scripts, catalogs
@given(st.text(alphabet="aZ_09 -;`\né", max_size=5))
def test_identifiers(name):
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"
    assert is_safe_identifier(name) is (name != "" and name[0] in letters and all(c in letters + "0123456789" for c in name))


@given(st.lists(tables(), max_size=4), blanks)
def test_a_script_is_its_statements(cases, blank):
    script = f"{blank};".join(["-- DEFINE TABLE no", *(raw.rstrip(";").replace("TABLE t", f"TABLE t{i}", 1) for i, (raw, *_) in enumerate(cases)), "CREATE x SET y = 'DEFINE TABLE z; '"])
    script = script.replace("-- DEFINE TABLE no" + blank + ";", "-- DEFINE TABLE no;\n", 1)
    d = read_definitions(script)
    assert list(d.tables) == [f"t{i}" for i in range(len(cases))]
    for i, (_, kind, ins, outs, _) in enumerate(cases):
        assert d.tables[f"t{i}"].kind == kind
        ends = {k: f.type for k, f in d.fields.get(f"t{i}", {}).items()}
        assert ends == ({"in": f"record<{'|'.join(ins)}>", "out": f"record<{'|'.join(outs)}>"} if ins else {})


def test_statements_about_a_table():
    d = read_definitions("DEFINE ANALYZER words FILTERS lowercase; DEFINE FIELD OVERWRITE w ON TABLE a TYPE float; DEFINE INDEX IF NOT EXISTS i ON a FIELDS w UNIQUE; REMOVE TABLE a")
    assert (list(d.analyzers), d.fields["a"]["w"].type, d.indexes["a"]["i"].kind, d.tables) == (["words"], "float", "unique", {})


def test_names_of_spark_types():
    spark_types = {T.ArrayType(T.FloatType()): "array<float>", T.DecimalType(9, 2): "decimal", T.DateType(): "date", T.TimestampNTZType(): "datetime", T.TimestampType(): "datetime", T.VariantType(): "object", T.BinaryType(): "binary", T.ShortType(): "int", T.StructType(): "object"}
    assert {t: type_name(t) for t in spark_types} == spark_types
    assert type_name(T.StringType(), "Feed") == "record<feed>"


def test_catalog_of_frames(spark):
    df = spark.createDataFrame([(1, "x", "f:1")], "id int, props string, link string").withColumn("link", F.col("link").alias("link", metadata={"link": "feed"}))
    c = from_frames({"t": df, "s": df}, "DEFINE TABLE s SCHEMALESS; DEFINE TABLE gone SCHEMAFULL; DEFINE FIELD a ON gone TYPE int; DEFINE INDEX i ON t FIELDS props UNIQUE", payloads={"s": "props"})
    assert {k: f.type for k, f in c.tables["t"].fields.items()} == {"id": "int", "props": "string", "link": "record<feed>"}
    assert c.tables["s"].fields == {} and c.tables["gone"].rows is None and list(c.tables["t"].indexes) == ["i"]
    assert c.tables["t"].value("ID") is None and c.tables["s"].value("k") is not None
