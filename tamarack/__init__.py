"""Ontology conformance and corpus data processing on Spark DataFrames."""

from tamarack.ontology import Attr, Freshness, FullText, Locator, Ontology, OntologyError, Relation, Scope, StableId, UnitType, Vector, Violation, Weight

__all__ = ["Attr", "Freshness", "FullText", "Locator", "Ontology", "OntologyError", "Relation", "Scope", "StableId", "UnitType", "Vector", "Violation", "Weight"]
