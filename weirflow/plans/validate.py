"""Checks of a topology before anything runs; each failure is one line of TopologyError."""

from __future__ import annotations

from collections.abc import Mapping
from graphlib import CycleError

from weirflow.plans import graph
from weirflow.plans.model import Aggregation, GlobalTable, Join, JoinWindow, SessionWindow, Stream, Table, TimeWindow, Topic, Topology


class TopologyError(ValueError):
    """What is wrong with a topology, one finding a line."""


def _entity(name: str, entity: object) -> list[str]:
    if isinstance(entity, Topic):
        return [] if entity.name else [f"{name}: a topic needs a name"]
    if isinstance(entity, Table):
        own = (entity.group_by, entity.aggregate)
        if any(x is not None for x in (*own, entity.window, entity.initial)) and None in own:
            return [f"{name}: an aggregating table needs group_by and aggregate"]
        if entity.window is not None and not isinstance(entity.window, TimeWindow | SessionWindow):
            return [f"{name}: a table's window is a TimeWindow or a SessionWindow"]
        if entity.initial is not None and (refused := _without_initial(entity.aggregate, entity.initial)):
            return [f"{name}: {refused}"]
        if entity.suppress is not None and entity.suppress.until == "window_close" and entity.window is None:
            return [f"{name}: only a windowed table can wait until its window closes"]
        return []
    if isinstance(entity, Stream | GlobalTable):
        return []
    return [f"{name}: not an entity: {entity!r}"]


def _without_initial(agg: Aggregation, initial: object) -> str | None:
    """Why an aggregation can't start from ``initial``."""
    if agg.kind in ("avg", "latest"):
        return f"{agg.kind} has no initial value"
    if agg.kind == "several":
        parts = dict(agg.parts)
        if not isinstance(initial, Mapping) or set(initial) - set(parts):
            return "the initial value of several aggregations is a mapping by their names"
        return next((r for n, x in initial.items() if (r := _without_initial(parts[n], x))), None)
    return None


def _joined(names: tuple[str, ...], join: Join, topology: Topology) -> list[str]:
    kinds = [topology.entities.get(n) for n in names]
    found = []
    if len(set(names)) != len(names):
        found.append(f"join {names}: a parent joins itself")
    if join.how == "merge":
        return found + [f"join {names}: only streams merge"] * any(isinstance(k, Table | GlobalTable) for k in kinds)
    streams = [isinstance(k, Stream | Topic) for k in kinds]
    globals_ = [isinstance(k, GlobalTable) for k in kinds]
    if sum(streams) > 1 and not isinstance(join.window, JoinWindow):
        found.append(f"join {names}: two streams need a JoinWindow")
    if any(globals_) and (globals_[0] or not streams[0] or join.how == "outer"):
        found.append(f"join {names}: a global table is looked up from a stream, inner or left")
    if join.how == "outer" and any(streams) and not all(streams):
        found.append(f"join {names}: a stream and a table have no outer join")
    if streams and not streams[0] and any(streams):
        found.append(f"join {names}: the stream comes before the table")
    return found


def validate(topology: Topology) -> None:
    """Raises TopologyError with all findings, or returns."""
    edges, entities = topology.workflow, topology.entities
    found = [] if edges else ["the workflow needs an edge"]
    found += ["an edge occurs twice"] * (len(set(edges)) != len(edges))
    found += [f"{a}: an edge to itself" for a, b in edges if a == b]
    found += [f"{n}: in the workflow but not among the entities" for n in graph.nodes(edges) if n not in entities]
    found += [x for n, e in entities.items() for x in _entity(n, e)]
    try:
        graph.order(edges)
    except CycleError as e:
        found.append(f"the workflow has a cycle: {' -> '.join(map(str, e.args[1]))}")
    for n in sorted(graph.roots(edges) | graph.leaves(edges)):
        if n in entities and not isinstance(entities[n], Topic) and n not in topology.overrides:
            found.append(f"{n}: first and last entities are topics")
    for names, join in topology.joins.items():
        found += _joined(names, join, topology)
    for n, e in entities.items():
        own = graph.parents(edges, n)
        if isinstance(e, GlobalTable):
            if len(own) > 1:
                found.append(f"{n}: a global table has one source")
            elif own and not isinstance(entities.get(own[0]), Topic):
                found.append(f"{n}: a global table's source is a topic")
        if isinstance(e, Table) and len(own) > 1 and graph.join_of(topology, n) is None:
            found.append(f"{n}: a table with several parents needs a join")
        if isinstance(e, Stream | Topic | Table) and len(own) == 1 and isinstance(entities.get(own[0]), GlobalTable):
            found.append(f"{n}: a global table can only be joined")
    if found:
        raise TopologyError("\n".join(found))
