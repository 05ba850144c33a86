"""A topology as DOT text; rendered only where Graphviz is installed."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
import webbrowser
from collections.abc import Callable, Mapping
from pathlib import Path

from weirflow.plans import graph
from weirflow.plans.model import Entity, GlobalTable, Join, Stream, Table, Topic, Topology

LOOK = {Topic: ("cylinder", "lightgrey"), Stream: ("box", "lightblue"), Table: ("box3d", "lightgreen"), GlobalTable: ("box3d", "khaki")}


def _quoted(text: str) -> str:
    return '"' + text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def _attributes(pairs: Mapping[str, str]) -> str:
    return ", ".join(f"{k}={_quoted(str(v))}" for k, v in pairs.items())


def describe_node(name: str, entity: Entity, rows: list | None = None) -> dict[str, str]:
    """Label, shape and colour of an entity; ``rows`` of an experiment go below its name."""
    shape, colour = LOOK.get(type(entity), ("ellipse", "white"))
    shown = "".join(f"\n{r['key']}: {r['value']}" for r in rows or ())
    return {"label": name + shown, "shape": shape, "style": "filled", "fillcolor": colour}


def describe_cluster(names: tuple[str, ...], join: Join) -> dict[str, str]:
    return {"label": f"{join.how} join", "style": "dashed"}


def to_dot(topology: Topology, *, rows: Mapping[str, list] | None = None, node: Callable[..., dict[str, str]] = describe_node, cluster: Callable[..., dict[str, str]] = describe_cluster, show_joins: bool = True) -> str:
    """Nodes, edges and, for each join, a cluster of its parents."""
    lines = ["digraph topology {", "  rankdir=LR;"]
    for name in graph.nodes(topology.workflow):
        lines.append(f"  {_quoted(name)} [{_attributes(node(name, topology.entities[name], (rows or {}).get(name)))}];")
    lines += [f"  {_quoted(a)} -> {_quoted(b)};" for a, b in topology.workflow]
    for i, (names, join) in enumerate(topology.joins.items() if show_joins else ()):
        own = "; ".join(f"{k}={_quoted(str(v))}" for k, v in cluster(names, join).items())
        lines.append(f"  subgraph cluster_{i} {{ {own}; {' '.join(_quoted(n) + ';' for n in names)} }}")
    return "\n".join([*lines, "}"]) + "\n"


def save(topology: Topology, path: str, **options) -> Path:
    """Writes DOT text, or, for another file ending, the rendered image if ``dot`` is installed."""
    target = Path(path)
    text = to_dot(topology, **options)
    if target.suffix in (".dot", ".gv"):
        target.write_text(text)
        return target
    if not shutil.which("dot"):
        raise RuntimeError("Graphviz is not installed: save to a .dot file instead")
    subprocess.run(["dot", f"-T{target.suffix[1:]}", "-o", str(target)], input=text.encode(), check=True)
    return target


def view(topology: Topology, *, opener: Callable[[str], object] = webbrowser.open, **options) -> Path:
    """Shows the topology in the user's viewer: the rendered image, or DOT text where Graphviz isn't installed; the file's path."""
    name = "topology.png" if shutil.which("dot") else "topology.dot"
    target = save(topology, f"{tempfile.mkdtemp()}/{name}", **options)
    opener(target.as_uri())
    return target
