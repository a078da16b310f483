"""Registered queries; importing this package fills the registry."""

from factloom.plans import cases, catalog, evidence, forms, graphs, includes, lifecycle, links, requests, semantics
from factloom.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cases", "catalog", "evidence", "forms", "graphs", "includes", "lifecycle", "links", "requests", "semantics"]
