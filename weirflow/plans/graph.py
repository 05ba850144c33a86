"""Helpers on a workflow's edges."""

from __future__ import annotations

from collections.abc import Sequence
from graphlib import TopologicalSorter

from weirflow.plans.model import Entity, Join, Topic, Topology

Edges = Sequence[tuple[str, str]]


def nodes(edges: Edges) -> list[str]:
    return list(dict.fromkeys(n for edge in edges for n in edge))


def parents(edges: Edges, node: str) -> list[str]:
    return [a for a, b in edges if b == node]


def children(edges: Edges, node: str) -> list[str]:
    return [b for a, b in edges if a == node]


def roots(edges: Edges) -> set[str]:
    return {n for n in nodes(edges) if not parents(edges, n)}


def leaves(edges: Edges) -> set[str]:
    return {n for n in nodes(edges) if not children(edges, n)}


def order(edges: Edges) -> list[str]:
    """Every node after its parents; raises graphlib.CycleError on a cycle."""
    return list(TopologicalSorter({n: parents(edges, n) for n in nodes(edges)}).static_order())


def join_of(topology: Topology, node: str) -> tuple[tuple[str, ...], Join] | None:
    """The join whose names are the node's parents, with the names in the join's order."""
    own = set(parents(topology.workflow, node))
    return next(((names, join) for names, join in topology.joins.items() if set(names) == own), None)


def topics_by_name(entities: dict[str, Entity]) -> dict[str, Topic]:
    return {e.name: e for e in entities.values() if isinstance(e, Topic)}
