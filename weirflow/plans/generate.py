"""Random valid topologies, for property tests."""

from __future__ import annotations

import random

from pyspark.sql import Column

from weirflow.functions import xform as X
from weirflow.plans.model import Agg, Join, JoinWindow, Stream, Table, Topic, Topology


def _same(k: Column, v: Column) -> Column:
    return k


def random_topology(rng: random.Random, most: int = 6) -> Topology:
    """Two source topics, up to ``most`` streams and tables over what is there, and a topic behind every leaf.

    Joins are merges and windowed joins of streams, joins of tables, and as-of joins; values stay numbers
    below a join only, so joined entities lead straight to a sink.
    """
    entities: dict = {"a": Topic("a"), "b": Topic("b")}
    kinds = {"a": "stream", "b": "stream"}
    edges: list[tuple[str, str]] = []
    joins: dict = {}
    last: set[str] = set()
    for i in range(rng.randint(1, most)):
        usable = [n for n in entities if n not in last]
        name, shape = f"n{i}", rng.choice(["map", "filter", "latest", "sum", "merge", "join"])
        if shape in ("merge", "join") and len(usable) > 1:
            pair = tuple(rng.sample(usable, 2))
            if set(pair) in [set(p) for p in joins]:
                continue
            both = [kinds[n] for n in pair]
            if shape == "merge":
                pair_ok, join, kind = both == ["stream", "stream"], Join("merge"), "stream"
            elif both == ["stream", "stream"]:
                pair_ok, join, kind = True, Join(rng.choice(["inner", "left", "outer"]), JoinWindow(rng.choice([0, 10, 100])), eager=rng.random() < 0.5), "stream"
            elif both == ["table", "table"]:
                pair_ok, join, kind = True, Join(rng.choice(["inner", "left", "outer"])), "table"
            else:
                pair, join, kind, pair_ok = pair if both[0] == "stream" else pair[::-1], Join(rng.choice(["inner", "left"])), "stream", True
            if not pair_ok:
                continue
            joins[pair] = join
            edges += [(n, name) for n in pair]
            entities[name] = Stream() if kind == "stream" else Table()
            if shape == "join":
                last.add(name)
        else:
            edges.append((rng.choice(usable), name))
            kind = "table" if shape in ("latest", "sum") else "stream"
            entities[name] = {
                "latest": Table(),
                "sum": Table(_same, Agg.sum()),
                "filter": Stream([X.value_pred(lambda v: v % 2 == 0)]),
            }.get(shape, Stream([X.transform_value(lambda v: v + 1)]))
        kinds[name] = kind
    for n in [n for n in entities if all(x != n for x, _ in edges)]:
        entities[f"{n}-out"] = Topic(f"{n}-out")
        edges.append((n, f"{n}-out"))
    return Topology(edges, entities, joins)
