"""Schema facts from definition statements: tables, fields, indexes, analyzers.

A statement is read as words. A clause begins at its keyword and ends at the next keyword of the
statement's kind, so spellings of several server versions come out the same. Keywords are in upper
case, as servers print them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import takewhile

_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def is_safe_identifier(name: str) -> bool:
    """True for plain names, the only ones put into queries."""
    return _IDENTIFIER.match(name) is not None


@dataclass
class TableDef:
    name: str
    raw: str = ""
    kind: str = "normal"  # normal, any, relation
    in_tables: list[str] = field(default_factory=list)
    out_tables: list[str] = field(default_factory=list)
    schemafull: bool = False


@dataclass
class FieldDef:
    name: str
    raw: str = ""
    type: str | None = None  # normalized


@dataclass
class IndexDef:
    name: str
    raw: str = ""
    fields: list[str] = field(default_factory=list)
    kind: str = "plain"  # plain, unique, fulltext, hnsw, mtree, diskann
    dimension: int | None = None
    dist: str | None = None
    analyzer: str | None = None


#: The keywords that end a clause, by kind of statement, and the kinds of vector index.
TABLE_CLAUSES = frozenset("SCHEMAFULL SCHEMALESS PERMISSIONS ENFORCED COMMENT CHANGEFEED AS".split())
FIELD_CLAUSES = frozenset("DEFAULT VALUE ASSERT PERMISSIONS READONLY COMMENT REFERENCE FLEXIBLE".split())
INDEX_CLAUSES = frozenset("UNIQUE FULLTEXT SEARCH HNSW MTREE DISKANN COMMENT CONCURRENTLY".split())
VECTOR_KINDS = ("hnsw", "mtree", "diskann")
DEFAULT_DIST = "euclidean"


def _words(raw: str) -> list[str]:
    """Words of a statement; a pipe or comma between names is a word of its own, quoted texts are left out."""
    return re.sub(r"([|,])", r" \1 ", re.sub(r"'[^']*'|\"[^\"]*\"", "''", raw)).rstrip("; \n").split()


def _until(words: Iterable[str], ends: Iterable[str]) -> list[str]:
    return list(takewhile(lambda w: w not in ends, words))


def _after(words: list[str], keyword: str) -> list[str] | None:
    return words[words.index(keyword) + 1 :] if keyword in words else None


def _names(words: list[str], separator: str) -> list[str]:
    return [name.strip().strip("`") for name in " ".join(words).split(separator)]


def table_def(name: str, raw: str) -> TableDef:
    """Kind, ends of a relation, and whether only defined fields may be stored.

    A relation needs both ends or neither; with one only it is a normal table.
    """
    words = _words(raw)
    out = TableDef(name, raw, schemafull="SCHEMAFULL" in raw.rstrip("; \n").split()[1:])
    pairs = set(zip(words, words[1:], strict=False))
    if ("TYPE", "ANY") in pairs:
        out.kind = "any"
    if ("TYPE", "RELATION") in pairs:
        clause = _until(words[words.index("RELATION") + 1 :], TABLE_CLAUSES)
        if not clause:
            out.kind = "relation"
        elif clause[0] == "IN" and "OUT" in clause[2:-1]:
            cut = clause.index("OUT")
            out.kind, out.in_tables, out.out_tables = "relation", _names(clause[1:cut], "|"), _names(clause[cut + 1 :], "|")
    return out


_ARGUMENTS = re.compile(r"<[^<>]*>")


def split_union(t: str) -> list[str]:
    """Members of a union type, not looking inside angle brackets.

    Arguments are set aside from the innermost outwards, what is left is cut at pipes, and they are put back.
    """
    aside: list[str] = []

    def set_aside(m: re.Match[str]) -> str:
        aside.append(m[0])
        return f"\0{len(aside) - 1}\0"

    while _ARGUMENTS.search(t):
        t = _ARGUMENTS.sub(set_aside, t)
    members = [m for m in t.split("|") if m]
    for i in reversed(range(len(aside))):
        members = [m.replace(f"\0{i}\0", aside[i]) for m in members]
    return members


def normalize_type(t: str) -> str:
    """One spelling per type: no blanks, lower case, ``option<T>`` as ``none|T``, members of a union sorted."""
    members = split_union("".join(t.split()).lower())
    options = {m: m[7:-1] for m in members if m.startswith("option<") and m.endswith(">") and len(m) > 8}
    return "|".join(sorted(x for m in members for x in (["none", *split_union(options[m])] if m in options else [m])))


def core_type(t: str) -> str:
    """A normalized type without its optionality, if one member is left."""
    members = [m for m in split_union(t) if m != "none"]
    return members[0] if len(members) == 1 else t


def field_def(name: str, raw: str) -> FieldDef:
    clause = _after(_words(raw), "TYPE")
    kind = _until(clause, FIELD_CLAUSES) if clause else []
    return FieldDef(name, raw, normalize_type("".join(kind)) if kind else None)


def _kind(words: list[str]) -> str:
    if "UNIQUE" in words:
        return "unique"
    if {("FULLTEXT", "ANALYZER"), ("SEARCH", "ANALYZER")} & set(zip(words, words[1:], strict=False)):
        return "fulltext"
    return next((k for k in VECTOR_KINDS if k.upper() in words), "plain")


def index_def(name: str, raw: str) -> IndexDef:
    words = _words(raw)
    first = lambda keyword: (_after(words, keyword) or [None])[0]
    listed = _after(words, "FIELDS") or _after(words, "COLUMNS")
    out = IndexDef(name, raw, _names(_until(listed, INDEX_CLAUSES), ",") if listed else [], _kind(words))
    if out.kind == "fulltext":
        out.analyzer = first("ANALYZER")
    if out.kind in VECTOR_KINDS:
        dimension = first("DIMENSION")
        out.dimension = int(dimension) if dimension and dimension.isdigit() else None
        out.dist = (first("DIST") or DEFAULT_DIST).lower()
    return out


@dataclass
class Definitions:
    """Everything that a script of definition statements defines; other statements are passed over."""

    tables: dict[str, TableDef] = field(default_factory=dict)
    fields: dict[str, dict[str, FieldDef]] = field(default_factory=dict)
    indexes: dict[str, dict[str, IndexDef]] = field(default_factory=dict)
    analyzers: dict[str, str] = field(default_factory=dict)


_STATEMENT = re.compile(r"DEFINE\s+(TABLE|FIELD|INDEX|ANALYZER)\s+(?:(?:OVERWRITE|IF\s+NOT\s+EXISTS)\s+)?(\S+)(?:\s+ON\s+(?:TABLE\s+)?(\S+))?")


def read_definitions(script: str) -> Definitions:
    """Statements end at a semicolon outside of quotation marks; ``--`` starts a comment.

    A table defined with ``TYPE RELATION IN a OUT b`` also has the record fields ``in`` and ``out``, as
    servers make them.
    """
    out = Definitions()
    script = re.sub(r"(?m)^\s*--.*$", "", script)
    for raw in (s.strip() for s in re.findall(r"(?:'[^']*'|\"[^\"]*\"|[^;'\"])+", script)):
        m = _STATEMENT.match(raw)
        if not m:
            continue
        kind, name, on = m[1], m[2].strip("`"), (m[3] or "").strip("`")
        if kind == "TABLE":
            t = out.tables[name] = table_def(name, raw)
            for end, targets in (("in", t.in_tables), ("out", t.out_tables)):
                if targets:
                    out.fields.setdefault(name, {})[end] = FieldDef(end, "", normalize_type("record<" + "|".join(targets) + ">"))
        elif kind == "ANALYZER":
            out.analyzers[name] = raw
        elif kind == "FIELD":
            out.fields.setdefault(on, {})[name] = field_def(name, raw)
        else:
            out.indexes.setdefault(on, {})[name] = index_def(name, raw)
    return out
