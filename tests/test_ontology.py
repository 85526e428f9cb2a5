import json

import pytest

from tamarack import Attr, Freshness, FullText, Locator, Ontology, OntologyError, Relation, Scope, StableId, UnitType, Vector, Weight


def unit(name="report", **parts):
    return UnitType(name, table=parts.pop("table", f"{name}_rows"), **parts)


def codes(**parts):
    with pytest.raises(OntologyError) as e:
        Ontology(**parts)
    assert not isinstance(e.value, ValueError)
    return [v.code for v in e.value.violations]


def test_parts_by_position_and_defaults():
    t = UnitType("report", "rows", "derived", StableId.of("code", version=["hash"]), ["title", "body"], [Attr("status", "string")], Locator(source="code", order="seq"), Vector("emb", 8), FullText("body"))
    assert t.declared_fields() == {"code", "hash", "title", "body", "status", "seq", "emb"}
    assert (t.vector.metric, t.locator.order, t.order_key(), unit(locator=Locator(order="seq")).order_key(), unit().order_key()) == ("cosine", "seq", ["code"], ["seq"], [])
    assert Relation("cites", "a", "b").table == "cites" and Relation("cites", "a", "b", table="c").table == "c"
    with pytest.raises(TypeError):
        Attr("a", "string", name="b")
    with pytest.raises(TypeError):
        Scope("a", "b", "c", "d")


def test_violations_are_reported_together():
    assert codes(types=[unit()], relations=[Relation("r", "report", "person"), Relation("q", "x", "y")], scopes=[Scope("s", via="none"), Scope("ok")]) == ["ONT-002"] * 3 + ["ONT-003"]


@pytest.mark.parametrize(
    ("parts", "expected"),
    [
        ({"types": [unit(), unit(), unit()]}, ["ONT-001"] * 2),
        ({"types": [unit()], "scopes": [Scope("s"), Scope("s")]}, ["ONT-001"]),
        ({"types": [unit(attrs=[Attr("a", "int"), Attr("a", "string")])]}, ["ONT-005"]),
        ({"types": [unit()], "freshness": [Freshness("other", "at", "30d")]}, ["ONT-008"]),
        ({"types": [unit(attrs=[Attr("project", "string")]), unit("project")], "relations": [Relation("of", "report", "project", kind="field_link", field="project")]}, ["ONT-009"]),
    ],
)
def test_violation(parts, expected):
    assert codes(**parts) == expected


def test_a_link_may_be_a_record_attr():
    Ontology([unit(attrs=[Attr("project", "record")]), unit("project")], [Relation("of", "report", "project", kind="field_link", field="project")])


@pytest.mark.parametrize(
    "build",
    [
        lambda: Vector("emb", 0), lambda: Vector("emb", 4, "chebyshev"), lambda: Vector("", 4), lambda: Attr("a", "text"), lambda: Attr("", "string"), lambda: Attr("a", "string", []), lambda: Attr("a", "string", {}),
        lambda: Attr("a", "string", {"c": ""}), lambda: Locator(source=1), lambda: Locator(source=""), lambda: StableId([]), lambda: UnitType("", "t"), lambda: UnitType("t", "t", "other"), lambda: Ontology([]),
        lambda: Relation("r", "a", "b", kind="field_link"), lambda: Relation("r", "a", "b", field="f"), lambda: Relation("r", "a", "b", kind="field_link", field="f", table="t"),
        lambda: Relation("r", "a", "b", kind="field_link", field="f", weight=Weight("w")), lambda: Relation("r", "a", "b", kind="row"), lambda: Freshness("t", "f", ""),
    ],
)
def test_malformed_parts(build):
    with pytest.raises(ValueError):
        build()


def test_vocabulary_forms():
    assert Attr("s", "string", {"c_1": "open", "c_2": "shut"}).value_codes() == ["c_1", "c_2"]
    assert Attr("s", "string", ["open"]).value_codes() == ["open"] and Attr("s", "string").value_codes() == []


def test_json_round_trip():
    o = Ontology(
        [unit(vector=Vector("emb", 4), fulltext=FullText("body"), id=StableId.of("a"), locator=Locator(order="n"), attrs=[Attr("s", "string", {"x": "y"})]), unit("place")],
        [Relation("in", "report", "place", weight=Weight("w", False, (0, 1)))], [Scope("s", "in")], [Freshness("report", "at", "30d")],
    )
    assert Ontology(**json.loads(o.to_json())) == o
    assert json.loads(o.to_json(indent=None))["types"][0]["vector"] == {"field": "emb", "dim": 4, "metric": "cosine", "model": None}
    with pytest.raises(KeyError):
        o.type_named("nobody")
