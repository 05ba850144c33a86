"""The batch compiler: every entity of a topology as lazy DataFrames over given inputs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.functions.xform import Pipeline
from weirflow.operators.aggregates import aggregate, suppress
from weirflow.operators.joins import join_all, merge
from weirflow.operators.relation import Relation
from weirflow.operators.windows import assigned
from weirflow.plans import graph
from weirflow.plans.model import GlobalTable, Stream, Table, Topic, Topology


@dataclass
class Result:
    """What ran: ``relations`` by entity."""

    topology: Topology
    relations: dict[str, Relation]

    def __getitem__(self, name: str) -> DataFrame:
        """An entity's rows: events, or one row for each update of a table."""
        return self.relations[name].changelog

    def snapshot(self, name: str) -> DataFrame:
        return self.relations[name].snapshot()

    def results(self) -> dict[str, DataFrame]:
        return {n: r.changelog for n, r in self.relations.items()}

    def stores(self) -> dict[str, str]:
        """The name of each table's store: its own, or its entity's."""
        return {n: self.relations[n].store or getattr(e, "store", None) or n for n, e in self.topology.entities.items() if isinstance(e, Table | GlobalTable)}

    def open_stores(self) -> list[str]:
        """Makes a temporary view of the latest rows of every table, under the name of its store."""
        held = self.stores()
        if len(set(held.values())) < len(held):
            raise ValueError("two tables have one store")
        for n, store in held.items():
            self.snapshot(n).createOrReplaceTempView(store)
        return sorted(held.values())

    def collect(self, limit: int | None = None) -> dict[str, list]:
        """All entities' rows in order of time, for tests and experiments on small inputs."""
        frames = {n: df.orderBy("ts", "seq") for n, df in self.results().items()}
        return {n: (df.limit(limit) if limit else df).collect() for n, df in frames.items()}

    def write(self, folder: str, emit: str = "changelog") -> None:
        """Every topic that has a parent, as a Parquet folder named after the topic."""
        for n, e in self.topology.entities.items():
            if isinstance(e, Topic) and graph.parents(self.topology.workflow, n):
                df = self[n] if emit == "changelog" else self.snapshot(n)
                df.write.mode("overwrite").parquet(f"{folder}/{e.name}")


def small(table: DataFrame, entity: GlobalTable) -> bool:
    """Whether a lookup table's rows are as few, and as small, as may be broadcast; reads no more of it than that."""
    some = table.limit(entity.broadcast_rows + 1)
    n, size = some.agg(F.count("*"), F.sum(F.octet_length(F.to_json(F.struct("key", "value"))))).first()
    return n <= entity.broadcast_rows and (size or 0) <= entity.broadcast_bytes


def build(topology: Topology, name: str, parents: list[tuple[str, Relation]], made: dict[str, Relation]) -> Relation:
    """One entity from its parents' relations."""
    entity = topology.entities[name]
    relations = [r for _, r in parents]
    found = graph.join_of(topology, name) if len(parents) > 1 else None
    if isinstance(entity, Topic):
        return merge(relations) if len(relations) > 1 else relations[0].as_stream()
    if isinstance(entity, GlobalTable):
        return Relation("global", relations[0].changelog)
    if found:
        names, join = found
        ordered = [made[n] for n in names]
        fits = all(small(made[n].snapshot(), topology.entities[n]) for n in names if isinstance(topology.entities[n], GlobalTable))
        source = join_all(ordered, join, fits)
    elif len(relations) > 1:
        source = merge(relations)
    else:
        source = relations[0]
    if isinstance(entity, Stream):
        return Relation("stream", Pipeline(entity.xform, entity.keep_key)(source.as_stream().changelog))
    assert isinstance(entity, Table)
    out = aggregate(source, entity) if entity.aggregate else source.as_table(entity.store)
    return suppress(out, entity.suppress) if entity.suppress else out


def run(topology: Topology, inputs: Mapping[str, DataFrame], spark: SparkSession | None = None) -> Result:
    """Compiles a topology over ``inputs``: rows for any entity, added to what it computes.

    Rows for a windowed table have its windows in the column win, or get those that hold them.
    """
    topology.validated()
    made: dict[str, Relation] = {}
    for name in graph.order(topology.workflow):
        parents = [(n, made[n]) for n in graph.parents(topology.workflow, name)]
        seeded = inputs.get(name)
        if seeded is not None:
            window = getattr(topology.entities[name], "window", None)
            if window is not None and "win" not in seeded.columns:
                seeded = assigned(seeded, window)
            seeded = Relation("global" if isinstance(topology.entities[name], GlobalTable) else "table" if isinstance(topology.entities[name], Table) else "stream", seeded)
        if name in topology.overrides:
            out = topology.overrides[name](topology.entities[name], [r for _, r in parents], made)
            made[name] = out if isinstance(out, Relation) else Relation("stream", out)
        elif not parents:
            if seeded is None:
                raise KeyError(f"no input for {name}")
            made[name] = seeded
            continue
        else:
            made[name] = build(topology, name, parents, made)
        if seeded is not None:
            own = made[name]
            made[name] = Relation(own.kind, own.changelog.unionByName(seeded.changelog))
    return Result(topology, made)
