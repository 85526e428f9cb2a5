"""The declaration: what a project's tables mean, as code.

Parts are plain records, built by position or by name. Each checks its own shape when it is built
and raises ``ShapeError`` (a ``ValueError``) if it is malformed. An ``Ontology`` then checks its
parts against each other, without any data, and raises ``OntologyError`` with every violation.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, fields
from typing import Any

ATTR_TYPES = ("string", "int", "float", "number", "bool", "datetime", "duration", "record", "array", "object")
METRICS = ("cosine", "euclidean", "manhattan")
NATURES = ("original", "derived", "authored", "computed")
RELATION_KINDS = ("edge", "field_link")


class ShapeError(ValueError):
    """A part of a declaration is malformed."""


@dataclass(frozen=True)
class Violation:
    """An inconsistency between parts, under a stable code."""

    code: str
    message: str

    def __str__(self) -> str:
        return f"[{self.code}] {self.message}"


class OntologyError(Exception):
    """All inconsistencies of a declaration; on purpose no ``ValueError``."""

    def __init__(self, violations: list[Violation]):
        self.violations = violations
        super().__init__(f"{len(violations)} violation(s) in the ontology:" + "".join(f"\n  {v}" for v in violations))


# -- what a field of a part may hold: (place, value) -> value ------------------------------------
Shape = Callable[[str, Any], Any]


def _fail(place: str, wanted: str, value: Any) -> None:
    raise ShapeError(f"{place}: expected {wanted}, got {value!r}")


def _text(place: str, value: Any) -> str:
    if not isinstance(value, str) or not value:
        _fail(place, "a text that is not empty", value)
    return value


def _flag(place: str, value: Any) -> bool:
    if not isinstance(value, bool):
        _fail(place, "true or false", value)
    return value


def _positive(place: str, value: Any) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        _fail(place, "a positive whole number", value)
    return value


def _one_of(options: tuple[str, ...]) -> Shape:
    return lambda place, value: value if value in options else _fail(place, "one of " + ", ".join(options), value)


def _optional(shape: Shape) -> Shape:
    return lambda place, value: None if value is None else shape(place, value)


def _note(place: str, value: Any) -> str | None:
    if value is not None and not isinstance(value, str):
        _fail(place, "a text", value)
    return value


def _many(shape: Shape, least: int = 0) -> Shape:
    def check(place: str, value: Any) -> list:
        if not isinstance(value, (list, tuple)) or len(value) < least:
            _fail(place, f"a list of at least {least}", value)
        return [shape(f"{place}[{i}]", v) for i, v in enumerate(value)]

    return check


def _any_text(place: str, value: Any) -> str:
    if not isinstance(value, str):
        _fail(place, "a text", value)
    return value


def _part(kind: Callable[[], type]) -> Shape:
    """A part, or the mapping that its JSON form is."""

    def check(place: str, value: Any) -> Any:
        if isinstance(value, Mapping):
            return kind()(**value)
        return value if isinstance(value, kind()) else _fail(place, kind().__name__, value)

    return check


def _names(place: str, value: Any) -> str | list[str]:
    return _any_text(place, value) if isinstance(value, str) else _many(_any_text)(place, value)


def _vocabulary(place: str, value: Any) -> list[str] | dict[str, str]:
    if not isinstance(value, (list, tuple, Mapping)) or not value:
        _fail(place, "codes, or codes with their meanings", value)
    for code in value:
        _any_text(place, code)
    if isinstance(value, Mapping):
        return {code: _text(f"{place}[{code!r}] (list the codes if they explain themselves)", meaning) for code, meaning in value.items()}
    return list(value)


def _range(place: str, value: Any) -> tuple[float, float]:
    if not isinstance(value, (list, tuple)) or len(value) != 2 or not all(isinstance(v, (int, float)) for v in value):
        _fail(place, "a lower and an upper bound", value)
    return float(value[0]), float(value[1])


def of(shape: Shape, **default: Any) -> Any:
    """A field of a part, with its shape."""
    return field(metadata={"shape": shape}, **default)


class _Part:
    def __post_init__(self) -> None:
        for f in fields(self):
            setattr(self, f.name, f.metadata["shape"](f"{type(self).__name__}.{f.name}", getattr(self, f.name)))
        self.check()

    def check(self) -> None:
        """Rules over several fields."""


@dataclass
class Attr(_Part):
    """A field that queries filter, sort or show. ``values`` closes its vocabulary: codes, or codes with meanings."""

    name: str = of(_text)
    type: str = of(_one_of(ATTR_TYPES))
    values: list[str] | dict[str, str] | None = of(_optional(_vocabulary), default=None)
    description: str | None = of(_note, default=None)

    def value_codes(self) -> list[str]:
        return list(self.values or ())


@dataclass
class StableId(_Part):
    """The fields that make a unit the same over time, apart from those that change when it is processed again."""

    fields: list[str] = of(_many(_any_text, 1))
    version_fields: list[str] = of(_many(_any_text), default_factory=list)

    @classmethod
    def of(cls, *fields: str, version: list[str] | None = None) -> StableId:
        return cls(list(fields), version or [])


class Locator:
    """Where a unit stands in its source: role to field name. The role ``order`` gives the reading order."""

    def __init__(self, **roles: str):
        self._roles = {role: _text(f"Locator.{role}", name) for role, name in roles.items()}

    def fields(self) -> dict[str, str]:
        return dict(self._roles)

    def __getattr__(self, role: str) -> str:
        if role.startswith("_") or role not in self._roles:
            raise AttributeError(role)
        return self._roles[role]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Locator) and self._roles == other._roles

    __hash__ = None  # type: ignore[assignment]

    def __repr__(self) -> str:
        return f"Locator({', '.join(f'{k}={v!r}' for k, v in self._roles.items())})"


@dataclass
class Vector(_Part):
    """An embedding field; its index is derived from this. ``model`` is a label."""

    field: str = of(_text)
    dim: int = of(_positive)
    metric: str = of(_one_of(METRICS), default="cosine")
    model: str | None = of(_note, default=None)


@dataclass
class FullText(_Part):
    """A field that full-text search covers."""

    field: str = of(_text)
    analyzer: str | None = of(_note, default=None)
    language: str | None = of(_note, default=None)


@dataclass
class UnitType(_Part):
    """A type of the domain, and the table that holds its units."""

    name: str = of(_text)
    table: str = of(_text)
    nature: str = of(_one_of(NATURES), default="original")
    id: StableId | None = of(_optional(_part(lambda: StableId)), default=None)
    text: str | list[str] | None = of(_optional(_names), default=None)
    attrs: list[Attr] = of(_many(_part(lambda: Attr)), default_factory=list)
    locator: Locator | None = of(_optional(_part(lambda: Locator)), default=None)
    vector: Vector | None = of(_optional(_part(lambda: Vector)), default=None)
    fulltext: FullText | None = of(_optional(_part(lambda: FullText)), default=None)
    description: str | None = of(_note, default=None)

    def declared_fields(self) -> set[str]:
        """Every field of the table that the declaration refers to."""
        groups = [
            [self.text] if isinstance(self.text, str) else self.text or [],
            [*self.id.fields, *self.id.version_fields] if self.id else [],
            [a.name for a in self.attrs],
            self.locator.fields().values() if self.locator else [],
            [part.field for part in (self.vector, self.fulltext) if part],
        ]
        return {name for group in groups for name in group}

    def order_key(self) -> list[str]:
        """The fields that samples are ordered by: identity, else reading order; none if neither is declared."""
        if self.id:
            return list(self.id.fields)
        order = self.locator.fields().get("order") if self.locator else None
        return [order] if order else []


@dataclass
class Weight(_Part):
    """A ranking weight on an edge."""

    field: str = of(_text)
    higher_is_better: bool = of(_flag, default=True)
    range: tuple[float, float] | None = of(_optional(_range), default=None)


@dataclass
class Relation(_Part):
    """A connection of two unit types: an edge table, or a record field of the first type."""

    name: str = of(_text)
    from_: str = of(_text)
    to: str = of(_text)
    kind: str = of(_one_of(RELATION_KINDS), default="edge")
    table: str | None = of(_note, default=None)
    field: str | None = of(_note, default=None)
    weight: Weight | None = of(_optional(_part(lambda: Weight)), default=None)
    description: str | None = of(_note, default=None)

    def check(self) -> None:
        edge = self.kind == "edge"
        foreign = ["field"] if edge else ["table", "weight"]
        for name in foreign:
            if getattr(self, name) is not None:
                raise ShapeError(f"relation {self.name!r}: an {self.kind} has no {name!r}")
        if edge and self.table is None:
            self.table = self.name
        if not edge and not self.field:
            raise ShapeError(f"relation {self.name!r}: a field_link needs the record field of its first type as 'field'")


@dataclass
class Scope(_Part):
    """A cut made before ranking, possibly along a relation."""

    name: str = of(_text)
    via: str | None = of(_note, default=None)
    description: str | None = of(_note, default=None)


@dataclass
class Freshness(_Part):
    """A time field by which units of a type age."""

    unit_type: str = of(_text)
    field: str = of(_text)
    decay: str = of(_text)


# -- rules between parts -------------------------------------------------------------------------
def _repeats(names: list[str]) -> Iterator[str]:
    """A name for each time that it occurs again."""
    seen: Counter[str] = Counter()
    for name in names:
        if seen[name]:
            yield name
        seen[name] += 1


def _unique_names(o: Ontology) -> Iterator[Violation]:
    for label, parts in (("unit type", o.types), ("relation", o.relations), ("scope", o.scopes)):
        yield from (Violation("ONT-001", f"{label} {name!r} is declared more than once") for name in _repeats([p.name for p in parts]))


def _relation_ends(o: Ontology) -> Iterator[Violation]:
    known = {t.name for t in o.types}
    for r in o.relations:
        yield from (Violation("ONT-002", f"relation {r.name!r}: {end} names {name!r}, which is none of the unit types {sorted(known)}") for end, name in (("from_", r.from_), ("to", r.to)) if name not in known)


def _scope_relations(o: Ontology) -> Iterator[Violation]:
    known = {r.name for r in o.relations}
    yield from (Violation("ONT-003", f"scope {s.name!r}: via names {s.via!r}, which is no relation") for s in o.scopes if s.via is not None and s.via not in known)


def _unique_attrs(o: Ontology) -> Iterator[Violation]:
    for t in o.types:
        yield from (Violation("ONT-005", f"type {t.name!r}: attr {name!r} is declared more than once") for name in _repeats([a.name for a in t.attrs]))


def _freshness_types(o: Ontology) -> Iterator[Violation]:
    known = {t.name for t in o.types}
    yield from (Violation("ONT-008", f"freshness names {f.unit_type!r}, which is no unit type") for f in o.freshness if f.unit_type not in known)


def _links_are_records(o: Ontology) -> Iterator[Violation]:
    attrs = [(t.name, a) for t in {t.name: t for t in o.types}.values() for a in t.attrs]
    for r in o.relations:
        if r.kind == "field_link":
            yield from (Violation("ONT-009", f"relation {r.name!r}: its field {r.field!r} is an attr of {owner!r} with type {a.type!r}, but a link holds records") for owner, a in attrs if owner == r.from_ and a.name == r.field and a.type != "record")


RULES = (_unique_names, _relation_ends, _scope_relations, _unique_attrs, _freshness_types, _links_are_records)


@dataclass
class Ontology(_Part):
    """The whole declaration."""

    types: list[UnitType] = of(_many(_part(lambda: UnitType), 1))
    relations: list[Relation] = of(_many(_part(lambda: Relation)), default_factory=list)
    scopes: list[Scope] = of(_many(_part(lambda: Scope)), default_factory=list)
    freshness: list[Freshness] = of(_many(_part(lambda: Freshness)), default_factory=list)

    def check(self) -> None:
        violations = [v for rule in RULES for v in rule(self)]
        if violations:
            raise OntologyError(violations)

    def type_named(self, name: str) -> UnitType:
        return next((t for t in self.types if t.name == name), None) or _unknown(name)

    def to_json(self, **options: Any) -> str:
        """The declaration as JSON; ``Ontology(**json.loads(...))`` is equal to it."""
        return json.dumps(_plain(self), **{"indent": 2} | options)


def _unknown(name: str) -> UnitType:
    raise KeyError(name)


def _plain(value: Any) -> Any:
    if isinstance(value, Locator):
        return value.fields()
    if isinstance(value, _Part):
        return {f.name: _plain(getattr(value, f.name)) for f in fields(value)}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value
