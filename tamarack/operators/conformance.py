"""Does the data honor the ontology?

``check`` plans what has to be known, has it measured, and judges. Judgements are generators that
yield findings in a fixed order and stop where nothing further can be said: types in order of
declaration, then relations, then freshness. What is defined is judged by its definition, and no
row is read for it; what is not, by the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from tamarack.ontology import Freshness, Ontology, Relation, UnitType
from tamarack.operators.report import Finding, Report
from tamarack.plans.facts import Facts, Need
from tamarack.sources.catalog import Catalog, Table
from tamarack.sources.ddl import VECTOR_KINDS, core_type, is_safe_identifier

#: Defined types that a declared type accepts; record and array accept any of their kind.
ACCEPTED = {
    "string": {"string"},
    "int": {"int", "number"},
    "float": {"float", "number"},
    "number": {"number", "int", "float", "decimal"},
    "bool": {"bool"},
    "datetime": {"datetime"},
    "duration": {"duration"},
    "object": {"object"},
}
Findings = Iterator[Finding]


def accepts(declared: str, defined: str) -> bool:
    """Whether a declared type accepts a defined one, optional or not."""
    core = core_type(defined)
    return core.startswith(declared) if declared in ("record", "array") else core in ACCEPTED[declared]


def needs(ontology: Ontology, catalog: Catalog) -> dict[str, Need]:
    """What the judgements will ask for, per table."""
    out: dict[str, Need] = {}

    def undefined(table: str, names: set[str]) -> None:
        if is_safe_identifier(table) and (t := catalog.tables.get(table)):
            out.setdefault(table, Need()).present.update(n for n in names if is_safe_identifier(n) and n not in t.fields)

    for unit in ontology.types:
        undefined(unit.table, unit.declared_fields())
        listed = {a.name for a in unit.attrs if a.values and is_safe_identifier(a.name)}
        if listed and unit.table in out:
            out[unit.table].sampled.setdefault(tuple(unit.order_key()), set()).update(listed)
    for r in ontology.relations:
        if r.kind == "edge":
            undefined(r.table or r.name, {r.weight.field} if r.weight else set())
        else:
            undefined(ontology.type_named(r.from_).table, {r.field})
    return out


@dataclass
class _Of:
    """Findings about one subject and table."""

    subject: str
    table: str | None = None

    def __call__(self, code: str, status: str, message: str) -> Finding:
        return Finding(code, status, self.subject, message, self.table)


class Judge:
    def __init__(self, ontology: Ontology, catalog: Catalog, facts: Facts, table_counts: dict[str, int]):
        self.ontology, self.catalog, self.facts, self.table_counts = ontology, catalog, facts, table_counts

    # -- unit types
    def unit_type(self, unit: UnitType) -> Findings:
        say = _Of(f"type:{unit.name}", unit.table)
        if not is_safe_identifier(unit.table):
            yield Finding("TBL-000", "FAIL", say.subject, f"table name {unit.table!r} is no plain identifier")
            return
        table = self.catalog.tables.get(unit.table)
        if table is None:
            yield say("TBL-001", "FAIL", f"table {unit.table!r} does not exist")
            return
        mode = "SCHEMAFULL" if table.definition.schemafull else "SCHEMALESS"
        yield say("TBL-001", "PASS", f"table {unit.table!r} exists ({mode}, kind={table.definition.kind})")
        total = self.table_counts[unit.table] = self.facts.total(unit.table)
        if not total:
            yield say("VAC-001", "VACUOUS", f"table {unit.table!r} has 0 rows: only its definitions can be checked")
        for name in sorted(unit.declared_fields()):
            yield from self._field(say, unit, table, name, total)
        if total:
            yield from self._vocabularies(say, unit)
        if unit.vector:
            yield from self._vector_index(say, unit, table)
            if total and is_safe_identifier(unit.vector.field):
                yield self._dimensions(say, unit)
        if unit.fulltext:
            yield from self._fulltext_index(say, unit, table)

    def _field(self, say: _Of, unit: UnitType, table: Table, name: str, total: int) -> Findings:
        if not is_safe_identifier(name):
            yield Finding("FLD-000", "FAIL", say.subject, f"field name {name!r} is no plain identifier")
            return
        if defined := table.fields.get(name):
            attr = next((a for a in unit.attrs if a.name == name), None)
            if attr is None or defined.type is None:
                yield say("FLD-001", "PASS", f"field {name!r} is defined")
            elif accepts(attr.type, defined.type):
                yield say("FLD-001", "PASS", f"attr {name!r}: {attr.type!r} accepts the defined type {core_type(defined.type)!r}")
            else:
                yield say("FLD-003", "WARN", f"attr {name!r}: declared {attr.type!r}, but defined as {core_type(defined.type)!r}")
        elif total:
            present = self.facts.present(unit.table, name)
            status = "FAIL" if not present else "WARN" if present < total else "PASS"
            yield say("FLD-002", status, f"field {name!r} is not defined; {present} of {total} rows have it")

    def _vocabularies(self, say: _Of, unit: UnitType) -> Findings:
        for attr in unit.attrs:
            if attr.values and is_safe_identifier(attr.name):
                codes = attr.value_codes()
                unexpected = sorted({str(v) for v in self.facts.values(unit.table, attr.name, unit.order_key())} - set(codes))
                if unexpected:
                    yield say("ATTR-010", "WARN", f"attr {attr.name!r}: sampled values {unexpected} are none of {codes}")
                else:
                    yield say("ATTR-010", "PASS", f"attr {attr.name!r}: no sampled value is outside of the vocabulary")

    def _vector_index(self, say: _Of, unit: UnitType, table: Table) -> Findings:
        vector = unit.vector
        index = next((i for i in table.indexes.values() if i.kind in VECTOR_KINDS and i.fields == [vector.field]), None)
        if index is None:
            yield say("VEC-001", "FAIL", f"no vector index ({', '.join(VECTOR_KINDS)}) covers {vector.field!r}")
            return
        if index.kind == "mtree":
            yield say("VEC-004", "WARN", f"index {index.name!r} is of the retired kind mtree")
        for code, what, has, wants in (("VEC-002", "dimension", index.dimension, vector.dim), ("VEC-003", "distance", index.dist, vector.metric)):
            yield say(code, "PASS" if has == wants else "FAIL", f"index {index.name!r} has {what} {has}" + ("" if has == wants else f", declared is {wants}"))

    def _dimensions(self, say: _Of, unit: UnitType) -> Finding:
        vector = unit.vector
        lengths = self.facts.lengths(unit.table, vector.field, unit.order_key())
        if wrong := sorted(lengths - {vector.dim}):
            return say("VEC-010", "FAIL", f"sampled embeddings in {vector.field!r} have dimensions {wrong}, declared is {vector.dim}")
        if lengths:
            return say("VEC-010", "PASS", f"sampled embeddings in {vector.field!r} all have dimension {vector.dim}")
        return say("VEC-010", "VACUOUS", f"no row has an embedding in {vector.field!r}")

    def _fulltext_index(self, say: _Of, unit: UnitType, table: Table) -> Findings:
        wanted = unit.fulltext
        index = next((i for i in table.indexes.values() if i.kind == "fulltext" and i.fields == [wanted.field]), None)
        if index is None:
            yield say("FTS-001", "FAIL", f"no full-text index covers {wanted.field!r}")
            return
        yield say("FTS-001", "PASS", f"full-text index {index.name!r} covers {wanted.field!r} (analyzer {index.analyzer})")
        if wanted.analyzer and wanted.analyzer != index.analyzer:
            yield say("FTS-002", "FAIL", f"declared analyzer is {wanted.analyzer!r}, index {index.name!r} has {index.analyzer!r}")
        if not index.analyzer:
            return
        definition = self.catalog.analyzers.get(index.analyzer)
        if definition is None:
            yield say("FTS-002", "FAIL", f"analyzer {index.analyzer!r} of index {index.name!r} is not defined")
        elif wanted.language and f"snowball({wanted.language})".lower() not in definition.lower():
            yield say("FTS-003", "WARN", f"analyzer {index.analyzer!r} does not stem {wanted.language!r}: {definition}")

    # -- relations
    def relation(self, relation: Relation) -> Findings:
        ends = tuple(self.ontology.type_named(n).table for n in (relation.from_, relation.to))
        return (self._edge if relation.kind == "edge" else self._link)(relation, *ends)

    def _edge(self, relation: Relation, source: str, target: str) -> Findings:
        name = relation.table or relation.name
        say = _Of(f"relation:{relation.name}", name)
        if not is_safe_identifier(name):
            yield Finding("TBL-000", "FAIL", say.subject, f"table name {name!r} is no plain identifier")
            return
        table = self.catalog.tables.get(name)
        if table is None:
            yield say("REL-001", "FAIL", f"edge table {name!r} does not exist")
            return
        total = self.table_counts[name] = self.facts.total(name)
        yield self._direction(say, table, name, source, target, total)
        if relation.weight:
            yield self._weight(say, table, name, relation.weight.field, total)

    def _direction(self, say: _Of, table: Table, name: str, source: str, target: str, total: int) -> Finding:
        d = table.definition
        if d.kind == "normal":
            return say("REL-002", "FAIL", f"table {name!r} is a normal table, no edge")
        if d.in_tables or d.out_tables:
            wrong = [f"{end} is {of}, declared is {wanted!r}" for end, of, wanted in (("IN", d.in_tables, source), ("OUT", d.out_tables, target)) if of and wanted not in of]
            return say("REL-002", "FAIL" if wrong else "PASS", f"edge {name!r}: " + ("; ".join(wrong) or f"defined from {source!r} to {target!r}"))
        advice = f"it has no IN/OUT constraint; DEFINE TABLE {name} TYPE RELATION IN {source} OUT {target} would give it one"
        if not total:
            return say("REL-002", "VACUOUS", f"edge {name!r} is empty, so its direction is unknown, and {advice}")
        if wrong := sorted(self.facts.ends(name) - {(source, target)}):
            return say("REL-002", "FAIL", f"edge {name!r}: ends {wrong}, declared is {(source, target)}; {advice}")
        return say("REL-002", "WARN", f"edge {name!r}: ends are as declared, but {advice}")

    def _weight(self, say: _Of, table: Table, name: str, field: str, total: int) -> Finding:
        if not is_safe_identifier(field):
            return say("FLD-000", "FAIL", f"weight field name {field!r} is no plain identifier")
        if field in table.fields:
            return say("REL-004", "PASS", f"weight field {field!r} is defined")
        if not total:
            return say("REL-004", "VACUOUS", f"weight field {field!r} is not defined and the edge is empty")
        present = self.facts.present(name, field)
        return say("REL-004", "FAIL" if not present else "WARN" if present < total else "PASS", f"weight field {field!r} is not defined; {present} of {total} rows have it")

    def _link(self, relation: Relation, source: str, target: str) -> Findings:
        say, field = _Of(f"relation:{relation.name}", source), relation.field
        if not is_safe_identifier(field):
            yield say("FLD-000", "FAIL", f"link field name {field!r} is no plain identifier")
            return
        table = self.catalog.tables.get(source)
        if table is None:
            return  # the type's own TBL-001 says so
        defined = table.fields.get(field)
        if defined is None:
            total = self.facts.total(source)
            present = self.facts.present(source, field) if total else 0
            status = "VACUOUS" if not total else "WARN" if present else "FAIL"
            yield say("REL-003", status, f"link field {field!r} is not defined; {present} of {total} rows have it")
            return
        kind = defined.type or ""
        ok = f"record<{target.lower()}>" in kind
        yield say("REL-003", "PASS" if ok else "FAIL", f"link field {field!r} is {kind or 'untyped'}" + ("" if ok else f", declared is record<{target}>" + ("" if "record" in kind else "; it is no link")))

    # -- freshness
    def freshness(self, fresh: Freshness) -> Findings:
        declared = fresh.field in self.ontology.type_named(fresh.unit_type).declared_fields()
        say = _Of(f"freshness:{fresh.unit_type}")
        yield say("FRS-001", "PASS" if declared else "WARN", f"field {fresh.field!r} is {'' if declared else 'not '}among the type's declared fields")


def check(ontology: Ontology, catalog: Catalog, engine_version: str | None = None) -> Report:
    """The report of an ontology against a catalog. A judgement that breaks down is a CHK-000 FAIL; the others go on."""
    report, facts = Report(catalog.source, engine_version), Facts(catalog)
    facts.prefetch(needs(ontology, catalog))
    judge = Judge(ontology, catalog, facts, report.table_counts)
    subjects: list[tuple[str, Callable[..., Findings], object]] = [
        *((f"type:{t.name}", judge.unit_type, t) for t in ontology.types),
        *((f"relation:{r.name}", judge.relation, r) for r in ontology.relations),
        *((f"freshness:{f.unit_type}", judge.freshness, f) for f in ontology.freshness),
    ]
    for subject, judgement, part in subjects:
        try:
            for finding in judgement(part):
                report.findings.append(finding)
        except Exception as e:  # noqa: BLE001 - one broken check must not hide the others
            report.add("CHK-000", "FAIL", subject, f"the check broke down: {e!r:.500}")
    return report
